"""SimHash near-duplicates: tiled exact comparison of fingerprints by exclusive-or and bit counts.

A tile holds fingerprints with the same population counts in each 16-bit quarter. Two fingerprints that
differ in r bits differ by at most r in the sum over quarters of the population counts, so only tiles whose
counts lie that near are compared; all other tile pairs are skipped, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.shared import documents, numbered, pick, sha256_hex, without, written
from tidemark.llm.words import bounds

SHINGLE, RADIUS, SEED = 3, 2, 42
#: Fingerprints in a tile, and shingles that are counted at once.
TILE, BATCH = 4096, 1 << 16
QUARTERS = 4
_WORD = np.ones(256, dtype=np.int8)
_WORD[[9, 10, 11, 12, 13, 32]] = 0
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The bits set in over half of the XXH64 hashes of the text's shingles; 0 without words."""
    raw = text.encode().translate(_LOWER)
    starts, ends = bounds(np.frombuffer(raw, dtype=np.uint8), _WORD)
    if not len(starts):
        return 0
    line = b" ".join(raw.split())
    size = ends - starts
    begin = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    width = min(shingle, len(size))
    first, last = begin[: len(size) - width + 1], (begin + size)[width - 1 :]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(first), BATCH):
        pairs = zip(first[at : at + BATCH].tolist(), last[at : at + BATCH].tolist(), strict=True)
        h = np.array([digest(line[a:b], seed) for a, b in pairs], dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int("".join("1" if 2 * n > len(first) else "0" for n in ones), 2)


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row; null texts have no words."""
    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = np.array([fingerprint(t or "", shingle) for t in texts], dtype=np.uint64)
            yield pd.Series(found.astype(np.int64))

    return pick(df, doc_id=doc_id, text=text).select("doc_id", run("text").alias("fp"), "text")


def near_counts(radius: int, quarters: int = QUARTERS) -> list[tuple[int, ...]]:
    """Differences of quarter counts within the radius, one of each pair of opposite ones, zero first."""
    steps = range(-radius, radius + 1)
    near = [d for d in product(steps, repeat=quarters) if sum(map(abs, d)) <= radius]
    return sorted((d for d in near if d >= (0,) * quarters), key=lambda d: (sum(map(abs, d)), d))


def tiles(prints: DataFrame, size: int = TILE) -> DataFrame:
    """tile (the quarter counts as one number), part and prints (packed), of distinct fingerprints `fp`.

    The fingerprints of one tile are spread over as many parts as its count asks for, by a hash.
    """
    quarters = [F.bit_count(F.shiftrightunsigned("fp", 16 * q).bitwiseAND(F.lit(0xFFFF))) for q in range(QUARTERS)]
    tile = sum((q * F.lit(32**i) for i, q in enumerate(quarters)), F.lit(0)).cast("int")
    rows = prints.select("fp", tile.alias("tile"))
    parts = rows.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("int").alias("parts"))
    rows = rows.join(parts, "tile").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    return rows.groupBy("tile", "part").agg(F.array_sort(F.collect_list("fp")).alias("prints"))


def links_within(x: np.ndarray, y: np.ndarray, radius: int, rows: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Enough links (a, b) between two tiles to join what is joined: each print to the smallest of its group."""
    same = x is y
    both = x if same else np.concatenate((x, y))
    label = np.arange(len(both))
    shift = 0 if same else len(x)
    for at in range(0, len(x), rows):
        strip = np.bitwise_count(x[at : at + rows, None] ^ y[None, :]) <= radius
        i, j = np.nonzero(strip)
        i, j = i + at, j + shift
        i, j = (i[i < j], j[i < j]) if same else (i, j)
        while len(i):
            low = np.minimum(label[i], label[j])
            differ = label[i] != label[j]
            if not differ.any():
                break
            i, j, low = i[differ], j[differ], low[differ]
            for end in (label[i], label[j]):
                np.minimum.at(label, end, low)
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
    moved = np.flatnonzero(label != np.arange(len(both)))
    return both[moved], both[label[moved]]


def links(prints: DataFrame, radius: int = RADIUS, size: int = TILE) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints within the radius; not every pair, but every group.

    The parts of tiles to compare are listed first, as numbers; the fingerprints then come to each pair of parts,
    so that the parts of one large tile meet in as many tasks as there are.
    """
    packed = written(tiles(prints, size), "tiles")
    offsets = [sum(d * 32**i for i, d in enumerate(step)) for step in near_counts(radius)]
    parts = packed.groupBy("tile").agg((F.max("part") + 1).alias("parts"))
    near = packed.select(F.explode(F.array(*[F.lit(o) for o in offsets])).alias("step"), "tile", "part")
    near = near.withColumn("other", F.col("tile") + F.col("step")).join(parts.withColumnRenamed("tile", "other"), "other")
    near = near.withColumn("other_part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    near = near.where("step <> 0 or part <= other_part").select("step", "tile", "part", "other", "other_part")
    x = packed.withColumnRenamed("prints", "x")
    y = packed.select(F.col("tile").alias("other"), F.col("part").alias("other_part"), F.col("prints").alias("y"))
    pairs = near.join(x, ["tile", "part"]).join(y, ["other", "other_part"])
    pairs = pairs.select((F.expr("step = 0 and part = other_part")).alias("own"), "x", "y")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for own, x, y in zip(batch["own"], batch["x"], batch["y"], strict=True):
                x = np.asarray(x, dtype=np.int64).view(np.uint64)
                a, b = links_within(x, x if own else np.asarray(y, dtype=np.int64).view(np.uint64), radius)
                if len(a):
                    yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return pairs.mapInPandas(run, "a long, b long")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id of the group) and text_key, one row per document.

    Documents with one fingerprint are one node; nodes within the radius are linked, links reach on. A null
    doc_id is in a group like any other, but names it only where no row has an id. Empty and null texts have
    fingerprint 0. Repeated rows stay; an empty table gives none; other columns are ignored.
    """
    rows = fingerprints(df, doc_id, text).select("doc_id", "fp", sha256_hex(F.coalesce("text", F.lit(""))).alias("text_key"))
    rows = written(rows, "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    nodes = written(nodes, "prints")
    roots = components(links(nodes.select("fp"), radius)).withColumnRenamed("node", "fp")
    named = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = written(named, "roots")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = written(named.join(least, "root").select("fp", "root", "component_id"), "classes")
    return rows.join(classes, "fp")


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of df without near-duplicates: of each group the smallest doc_id stays, with all its columns.

    Of rows that share that id the smallest text digest stays, and one of those that share both. Only the rows
    that go, or of which one goes, are listed.
    """
    found = near_duplicates(df, doc_id, text, radius)
    groups = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = groups.groupBy("root").agg(F.min("text_key").alias("keep_key"))
    keeper = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_key") == F.col("keep_key"))
    each = found.join(written(first, "stay"), "root").groupBy(F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
    gone = each.agg(F.bool_or(keeper).alias("once"), F.count(F.lit(1)).alias("n")).where("not once or n > 1").drop("n")
    plain, names = numbered(df)
    key = sha256_hex(F.coalesce(F.col(f"c{names.index(text)}"), F.lit("")))
    return without(plain, gone, f"c{names.index(doc_id)}", key, "near-gone").toDF(*names)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
