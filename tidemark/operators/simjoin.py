"""Exact similarity join of two sets of strings by prefix filtering, as equi-joins.

A string is the set of its (character, occurrence) tokens, so that two strings share as many tokens as their
multisets of characters have in common, and no similarity here can exceed 2 * shared / (length + length). Tokens
are ordered by rarity over the corpus. For a ratio above ``floor`` two strings must share a number of tokens that
their lengths decide, hence one among the first tokens of both: only these prefixes are joined. Lengths and the
places of the shared tokens bound what is left; the ratio itself is computed for survivors only.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.similarity import KERNELS

#: Room for the rounding of a ratio to two decimals, by kernel.
SLACK = {"indel": 0.005, "matcher": 0.0}
GRAM = 3


def tokens_of(text: Column) -> Column:
    """(character, occurrence) tokens of a string, as strings."""
    chars = F.split(text, "")
    nth = lambda c, i: F.size(F.filter(F.slice(chars, 1, i + 1), lambda x: x == c))
    return F.transform(chars, lambda c, i: F.concat(c, nth(c, i).cast("string")))


def _need(length: Column, other: Column, floor: float) -> Column:
    """Tokens that strings of these lengths must share; a hair below, as a ratio may only just exceed the floor."""
    return F.greatest(F.ceil((length + other) * (floor / 2.0) - 1e-6).cast("int"), F.lit(1))


def _prefixes(strings: DataFrame, order: DataFrame, floor: float, name: str) -> DataFrame:
    """name, token, place (from 1), size of the first tokens of each string by rarity, as many as the floor asks for."""
    least = F.ceil(F.col("size") * (floor / (2.0 - floor)) - 1e-6)
    keep = F.col("size") - _need(F.col("size"), least, floor) + 1
    each = strings.select(name, F.length(name).alias("size"), F.explode(tokens_of(F.col(name))).alias("token"))
    ranked = each.join(order, "token", "left").groupBy(name, "size").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token"))).alias("sorted"))
    return ranked.select(name, "size", F.posexplode(F.slice(F.col("sorted.token"), F.lit(1), keep.cast("int"))).alias("place", "token")).withColumn(
        "place", F.col("place") + 1)


def candidates(texts: DataFrame, strings: DataFrame, floor: float) -> DataFrame:
    """Pairs (q, s) of distinct non-empty strings that may have a ratio above the floor; every such pair is there.

    ``texts``: q, ``strings``: s, both distinct. The rarity of a token is its count over ``strings``, one row for
    each token, summed map-side; a token that all strings share costs rows only where it lies in a prefix.
    """
    texts, strings = texts.where(F.length("q") > 0), strings.where(F.length("s") > 0)
    order = strings.select(F.explode(tokens_of(F.col("s"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    a = _prefixes(texts, order, floor, "q").withColumnsRenamed({"size": "la", "place": "pa"})
    # only strings with a token of some text's prefix are worth an order of their own
    hit = strings.select("s", F.explode(tokens_of(F.col("s"))).alias("token")).join(a.select("token").distinct(), "token", "left_semi")
    b = _prefixes(hit.select("s").distinct(), order, floor, "s").withColumnsRenamed({"size": "lb", "place": "pb"})
    share = floor / (2.0 - floor)
    near = (F.col("lb") >= F.col("la") * share - 1e-6) & (F.col("la") >= F.col("lb") * share - 1e-6)
    # after the first shared token no more can follow than is left behind it in the shorter rest
    most = 1 + F.least(F.col("la") - F.col("pa"), F.col("lb") - F.col("pb"))
    need = _need(F.col("la"), F.col("lb"), floor)
    met = a.join(b, "token").where(near).groupBy("q", "s", "la", "lb").agg(
        F.min_by(F.struct(most.alias("most")), F.struct("pa", "pb")).alias("m"))
    return met.where(F.col("m.most") >= need).select("q", "s")


def shared(a: Column, b: Column) -> Column:
    """Characters that two strings have in common, each as often as both hold it."""
    return F.size(F.array_intersect(tokens_of(a), tokens_of(b)))


def ratio_udf(kernel: str):
    fn = KERNELS[kernel]

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([fn(x, y) for x, y in zip(a, b)], dtype="float64")

    return ratio


def ratio_join(texts: DataFrame, strings: DataFrame, floor: float, kernel: str) -> DataFrame:
    """q, s, score of all pairs of distinct strings whose ratio is above the floor, exactly."""
    low = floor - SLACK[kernel]
    met = candidates(texts, strings, low)
    bound = 2.0 * shared(F.col("q"), F.col("s")) / (F.length("q") + F.length("s"))
    left = met.where(bound + SLACK[kernel] + 1e-9 > floor)
    scored = left.repartition("q", "s").withColumn("score", ratio_udf(kernel)("q", "s"))
    return scored.where(F.col("score") > floor)


def _grams(text: Column, size: int) -> Column:
    last = F.greatest(F.length(text) - size + 1, F.lit(0))
    every = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(every, lambda i: F.substring(text, i, F.lit(size))))


def containing(texts: DataFrame, strings: DataFrame, size: int = GRAM) -> DataFrame:
    """Pairs (q, s) in which s contains q, exactly: joined on the rarest gram of q, then looked at.

    ``texts``: q, ``strings``: s, both distinct. A text shorter than a gram is a gram of its own length; the lengths
    that occur are looked up first.
    """
    own_size = F.least(F.length("q"), F.lit(size))
    asked = sorted(r[0] for r in texts.where(F.length("q") > 0).select(own_size).distinct().collect()) or [size]
    grams = F.array_distinct(F.concat(*[_grams(F.col("s"), n) for n in asked]))
    last = F.length("q") - own_size + 1
    parts = F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(F.col("q"), i, own_size))
    own = texts.where(F.length("q") > 0).select("q", F.explode(F.array_distinct(parts)).alias("g"))
    seen = strings.select("s", F.explode(grams).alias("g")).join(own.select("g").distinct(), "g", "left_semi")
    count = seen.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    # a gram that no string holds rules its text out
    rare = own.join(count, "g", "left").groupBy("q").agg(F.min_by("g", F.struct(F.coalesce("df", F.lit(0)), "g")).alias("g"))
    return seen.join(rare, "g").where(F.contains("s", F.col("q"))).select("q", "s")


def contained(texts: DataFrame, strings: DataFrame) -> DataFrame:
    """Pairs (q, s) in which q contains s: an equi-join on the substrings of q, the empty one included.

    ``texts`` are short (names, terms): their substrings are as many as the square of their length.
    """
    sizes = F.sequence(F.lit(0), F.length("q"))
    parts = texts.where(F.length("q") > 0).select("q", F.explode(sizes).alias("n")).select("q", F.explode(F.transform(
        F.sequence(F.lit(1), F.length("q") - F.col("n") + 1), lambda i: F.substring(F.col("q"), i, F.col("n")))).alias("s")).distinct()
    return parts.join(strings, "s").select("q", "s")
