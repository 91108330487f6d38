"""Exact dedup by content-defined chunk recipes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import documents, numbered, pick, sha256_hex, without, written

#: A chunk ends behind one of these letters and a space, at least SHORTEST and at most LONGEST characters on.
BOUNDARY, SHORTEST, LONGEST = "[dglmr] ", 512, 4096
SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def chunks_of(text: Column, boundary: str = BOUNDARY, shortest: int = SHORTEST, longest: int = LONGEST) -> Column:
    """The text cut where its content says so; text without such a place is cut at the longest length."""
    pattern = f"(?s).{{{shortest - 2},{longest - 2}}}?{boundary}|.{{1,{longest}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def chunk_id(chunk: Column, seed: int = 0) -> Column:
    """A short identifier, 16 bytes; verify() tells whether it is one of a single chunk."""
    return F.unhex(F.md5(F.concat(F.lit(f"{seed}:"), chunk).cast("binary")))


def chunk_table(df: DataFrame, text: str = "text", seed: int = 0) -> DataFrame:
    """Every distinct chunk once: chunk_id, chunk."""
    rows = pick(df, text=text).select(F.explode(chunks_of(normalised(F.col("text")))).alias("chunk"))
    return rows.select(chunk_id(F.col("chunk"), seed).alias("chunk_id"), "chunk").distinct()


def verified_seed(df: DataFrame, text: str = "text", identify: Callable[[Column, int], Column] = chunk_id, most: int = 8) -> int:
    """The first seed under which no identifier names two different chunks of the corpus.

    A chunk is compared by its SHA-256, so chunks do not move; pairs of identifier and digest are reduced to
    one a task before they meet.
    """
    chunk = F.explode(chunks_of(normalised(F.col("text")))).alias("chunk")
    for seed in range(most):
        pairs = pick(df, text=text).select(chunk).select(
            identify(F.col("chunk"), seed).alias("id"), F.unhex(sha256_hex(F.col("chunk"))).alias("digest"))
        if pairs.distinct().groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() == 0:
            return seed
    raise ValueError("no seed gives each chunk an identifier of its own")


def recipes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 0) -> DataFrame:
    """One row per document: doc_id, text_sha256 and recipe, the ordered chunk identifiers. Nothing is moved."""
    norm = normalised(F.col("text"))
    rows = pick(df, doc_id=doc_id, text=text).select("doc_id", norm.alias("norm"))
    return rows.select(
        "doc_id",
        sha256_hex(F.col("norm")).alias("text_sha256"),
        F.transform(chunks_of(F.col("norm")), lambda c: chunk_id(c, seed)).alias("recipe"),
    )


def dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents with equal recipes are equal: doc_id, keep_id, group_size, kept, text_sha256, one row each.

    The smallest doc_id of a group stays (a null one counts as largest); of rows that repeat it, one stays.
    Null texts count as empty and have the empty recipe. No row is lost; an empty table gives none; other
    columns are ignored. A group is counted map-side before it meets, and only groups of two or more are
    joined back, on tables that Spark can split where one group is hot.
    """
    seed = verified_seed(df, text)
    rows = written(recipes(df, doc_id, text, seed).withColumn("row", F.monotonically_increasing_id()), "recipes")
    pairs = rows.groupBy("recipe", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("row"))
    groups = pairs.groupBy("recipe").agg(
        F.sum("n").alias("group_size"),
        F.min("doc_id").alias("keep_id"),
        F.coalesce(F.min_by("row", "doc_id"), F.min("row")).alias("keep_row"),
    )
    groups = written(groups.where("group_size > 1"), "copies")
    alone = F.col("group_size").isNull()
    return rows.join(groups, "recipe", "left").select(
        F.col("doc_id").alias(doc_id),
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        "text_sha256",
    )


def keep_first(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df that dedup() keeps, with all their columns.

    Only the rows that go are listed; where a row that stays is itself repeated, one of its repeats is taken.
    """
    gone = dedup(df, doc_id, text).where("not kept").groupBy(F.col(doc_id).alias("id"), F.col("text_sha256").alias("key"))
    gone = gone.agg(F.bool_or(F.expr(f"`{doc_id}` <=> keep_id")).alias("once"))
    plain, names = numbered(df)
    key = sha256_hex(normalised(F.col(f"c{names.index(text)}")))
    return without(plain, gone, f"c{names.index(doc_id)}", key, "copies-gone").toDF(*names)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP5_SQL = r"""
WITH d AS (
    SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
    FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
    doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
