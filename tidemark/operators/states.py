"""Column profiles as states that can be merged: what was seen so far plus a new batch, without the old rows.

A state is one row per (table, column): exact counts, range and sum, and three sketches of bounded size: distinct
values (HyperLogLog, standard error 0.8 %), quantiles of numbers (KLL, rank error about 1.3 %) and frequent values
(exact while a column has fewer than about 700 values; beyond that a count is off by at most 0.35 % of the rows, and
values rarer than that may be missing).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.operators.clean import chunks, is_numeric
from tidemark.operators.profile import business_category, union_all

HLL_BITS = 14
KLL_K = 200
TOP_TRACKED = 1024
TOP_ERROR = 3.5 / TOP_TRACKED  # share of the rows
TOP_SHOWN = 5
SHOWN_LENGTH = 64
FIRST_GROUPS = 64
MERGE_TASKS = 16

KEYS = ["table", "column", "dtype"]


def as_text(f: T.StructField) -> Column:
    """A value as text: nested values as JSON."""
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.to_json(c)
    return F.base64(c) if isinstance(f.dataType, T.BinaryType) else c.cast("string")


def shown(text: Column) -> Column:
    """Text that stands for a frequent value: a long one is its first characters and a part of its digest."""
    digest = F.substring(F.sha2(text.cast("binary"), 256), 1, 16)
    return F.when(F.length(text) > SHOWN_LENGTH, F.concat(F.substring(text, 1, SHOWN_LENGTH), F.lit("#"), digest)).otherwise(text)


def column_states(df: DataFrame, table: str) -> DataFrame:
    """One state per column of ``df``; of an empty table too. Columns are read in passes of fifty."""
    return merge_states(partial_states(df, table))


def partial_states(df: DataFrame, table: str) -> DataFrame:
    """Up to ``FIRST_GROUPS`` + 1 states per column, for merge_states: neither the tasks of a large table nor its
    columns meet in one place."""
    fields = [T.StructField(f.name, f.dataType) for f in df.schema.fields]
    parts = []
    for some in chunks(fields):
        cells = df.select(*[as_text(f).alias(f"t{i}") for i, f in enumerate(some)],
                          *[F.col(f"`{f.name}`").cast("double").alias(f"d{i}") for i, f in enumerate(some) if is_numeric(f.dataType)],
                          F.pmod(F.spark_partition_id(), F.lit(FIRST_GROUPS)).alias("part"))
        aggs, rows = [F.count(F.lit(1)).alias("rows")], []
        none = lambda kind: F.lit(None).cast(kind)
        for i, f in enumerate(some):
            t, num = F.col(f"t{i}"), is_numeric(f.dataType)
            # the sketch leaves out empty texts, so a value goes in behind a sign
            aggs += [F.count(t).alias(f"n{i}"), F.hll_sketch_agg(F.concat(F.lit("="), t), F.lit(HLL_BITS)).alias(f"h{i}"),
                     F.expr(f"approx_top_k_accumulate(v{i}, {TOP_TRACKED}) FILTER (WHERE v{i} IS NOT NULL)").alias(f"f{i}")]
            cells = cells.withColumn(f"v{i}", shown(t))
            if num:
                d = F.col(f"d{i}")
                aggs += [F.min(d).alias(f"lo{i}"), F.max(d).alias(f"hi{i}"), F.sum(d).alias(f"s{i}"),
                         F.kll_sketch_agg_double(d, F.lit(KLL_K)).alias(f"q{i}")]
            pick = lambda c, kind: F.col(c) if num else none(kind)  # noqa: E731, B023
            rows.append(F.struct(
                F.lit(table).alias("table"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"),
                F.lit(num).alias("numeric"), F.col("rows"), F.col(f"n{i}").alias("present"), F.col(f"h{i}").alias("values"),
                F.col(f"f{i}").alias("frequent"), pick(f"lo{i}", "double").alias("low"), pick(f"hi{i}", "double").alias("high"),
                pick(f"s{i}", "double").alias("total"), pick(f"q{i}", "binary").alias("quantiles")))
        # no rows at all still give one state a column
        wide = cells.groupBy("part").agg(*aggs).drop("part").unionByName(cells.limit(0).agg(*aggs))
        parts.append(wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*"))
    return union_all(parts)


def merge_states(states: DataFrame) -> DataFrame:
    """One state per column from any number of them, in any order and grouping.

    There are as many rows as columns, so they are dealt over MERGE_TASKS tasks, whatever a session sets for shuffles.
    """
    return states.repartition(MERGE_TASKS, *KEYS, "numeric").groupBy(*KEYS, "numeric").agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("present"), F.lit(0)).alias("present"),
        F.hll_union_agg("values").alias("values"),
        F.expr(f"approx_top_k_combine(frequent, {TOP_TRACKED})").alias("frequent"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total"),
        F.expr(f"kll_merge_agg_double(quantiles, {KLL_K}) FILTER (WHERE quantiles IS NOT NULL)").alias("quantiles"))


def catalog(states: DataFrame) -> DataFrame:
    """The profile that states stand for, with the columns of ``profile_columns`` and the sketched ones.

    ``distinct_count``, ``median_value`` and ``top_values`` (text and count, most frequent first, ties by text) are
    estimates, the others exact. Without a value they are 0, null and empty.
    """
    seen = F.col("present") > 0
    distinct = F.when(seen, F.hll_sketch_estimate("values")).otherwise(F.lit(0)).cast("bigint")
    median = F.when(seen & F.col("numeric"), F.kll_sketch_get_quantile_double("quantiles", F.lit(0.5)))
    top = F.when(seen, F.expr(f"approx_top_k_estimate(frequent, {TOP_TRACKED})"))
    ordered = F.array_sort(F.transform(top, lambda x: F.struct((-x["count"]).alias("n"), x["item"].alias("value"))))
    best = F.transform(F.slice(ordered, 1, TOP_SHOWN), lambda x: F.struct(x["value"].alias("value"), (-x["n"]).alias("count")))
    out = states.withColumns({
        "null_count": F.col("rows") - F.col("present"), "distinct_count": distinct, "is_nullable": F.col("rows") > F.col("present"),
        "min_value": F.round("low", 3), "max_value": F.round("high", 3),
        "avg_value": F.round(F.try_divide(F.col("total"), F.when(F.col("numeric"), F.col("present"))), 3),
        "median_value": median, "top_values": F.coalesce(best, F.array().cast("array<struct<value:string,count:bigint>>"))})
    return out.withColumn("business_category", business_category(F.col("column"), F.col("numeric"), F.col("distinct_count"), F.col("rows"))).select(
        *KEYS, "rows", "null_count", "distinct_count", "is_nullable", "min_value", "max_value", "avg_value", "median_value",
        "top_values", "business_category")
