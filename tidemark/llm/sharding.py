"""Rendezvous hashing of stable record keys over weighted shards, and gapless slots within each shard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.shared import documents, pick, written

#: The number of hexadecimal digits of a digest that make a score: 52 bits fit a double exactly.
DIGITS = 13


def shard_of(key: Column, shards: dict[int, float]) -> Column:
    """The shard whose weighted score for this key is smallest: -ln(u) / weight, u uniform from md5(shard:key).

    Key and shards alone decide. A new shard only takes the keys for which its own score is smallest; no
    key moves between the others. A null key counts as the text 'null'. Ties go to the smaller shard.
    """
    if not shards or any(w <= 0 for w in shards.values()):
        raise ValueError("shards need positive weights")
    text = F.coalesce(key.cast("string"), F.lit("null"))

    def score(shard: int, weight: float) -> Column:
        digest = F.md5(F.concat(F.lit(f"{shard}:"), text).cast("binary"))
        drawn = F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double")
        return -F.log((drawn + 0.5) / F.lit(float(16**DIGITS))) / F.lit(float(weight))

    scores = [F.struct(score(s, w).alias("score"), F.lit(s).cast("int").alias("shard")) for s, w in shards.items()]
    return (F.least(*scores) if len(scores) > 1 else scores[0])["shard"]


def with_slots(df: DataFrame, shard: str, order: list[str]) -> DataFrame:
    """df, which is written to the shared folder, with `slot`: gapless numbers from 0 within each shard.

    Rows are numbered within (shard, part of the input), then moved up by the counts of the parts before,
    so no task holds a shard; a part is one scan partition. Repeated rows get slots of their own. A column
    called slot is replaced.
    """
    rows = written(df.drop("slot").withColumn("__part", F.spark_partition_id()), "slots")
    sizes = rows.groupBy(shard, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(shard).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(shard, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inner = W.partitionBy(shard, "__part").orderBy(*[F.col(c).asc_nulls_last() for c in order])
    placed = rows.withColumn("__rank", F.row_number().over(inner))
    return (
        placed.join(starts, [shard, "__part"])
        .withColumn("slot", F.col("__start") + F.col("__rank") - 1)
        .drop("__part", "__start", "__rank")
    )


def assign(
    df: DataFrame, key: str = "doc_id", text: str = "text", shards: dict[int, float] | int = 8, grown: int | None = None
) -> DataFrame:
    """One row per record: key, size (UTF-8 bytes of the text plus 1), text_crc32, law, shard, slot, grown_shard.

    `shards` is {number: weight}, or a count of equal shards 0, 1, ...; grown_shard is the shard after one
    more of weight 1 came (number `grown`, by default the next). Null texts count as empty, null keys as one
    key; equal keys share a shard; an empty table gives no row. Other columns are ignored.
    """
    if isinstance(shards, int):
        shards = {s: 1.0 for s in range(shards)}
    more = {**shards, (max(shards) + 1 if grown is None else grown): 1.0}
    rows = pick(df, key=key, text=text)
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = rows.select(
        F.col("key").alias(key),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col("key"), shards).alias("shard"),
        shard_of(F.col("key"), more).alias("grown_shard"),
    )
    return with_slots(rows, "shard", [key, "text_crc32", "size"])


def op9_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )
