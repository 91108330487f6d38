"""Target-distribution importance resampling over hashed word n-grams, with the lines of texts deduplicated.

Texts are cut into lines. The features of a distinct line are counted once and multiplied by its occurrences; a
document's weight is the sum over its lines. N-grams that reach over an end of line belong to no line and are
counted for each text apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.order import in_order
from tidemark.llm.shared import documents, pick, written

BUCKETS, MOST_WORDS, SEED, LEAST_WORDS, PERCENT = 10_000, 1, 2024, 20, 10
#: A line that is at least this part of all lines is looked up in place; there are no more than HOT of them.
HOT = 4096
#: A-Z in lower case, every other ASCII character that is no letter or digit a blank; other bytes stay.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(line: bytes) -> list[bytes]:
    return line.translate(_PLAIN).split()


def buckets_of(words: list[bytes], most_words: int, buckets: int) -> np.ndarray:
    """The bucket of every run of 1 to most_words words, repeats included."""
    found = list(map(crc32, words))
    for k in range(2, most_words + 1):
        found += [crc32(b" ".join(words[i : i + k])) for i in range(len(words) - k + 1)]
    return np.array(found, dtype=np.uint32) % np.uint32(buckets)


def crossing(lines: list[bytes], most_words: int, buckets: int) -> np.ndarray:
    """The buckets of the runs of words that lie in more than one line."""
    words: list[bytes] = []
    line_of: list[int] = []
    for number, line in enumerate(lines):
        found = words_of(line)
        words += found
        line_of += [number] * len(found)
    at = np.array(line_of, dtype=np.int64)
    out: list[int] = []
    for k in range(2, most_words + 1):
        for i in np.flatnonzero(at[: max(0, len(at) - k + 1)] != at[k - 1 :]).tolist():
            out.append(crc32(b" ".join(words[i : i + k])))
    return np.array(out, dtype=np.uint32) % np.uint32(buckets)


def digest(line: bytes) -> bytes:
    return hashlib.sha256(line).digest()[:16]


def segments(texts: DataFrame, most_words: int, buckets: int, name: str) -> DataFrame:
    """digest, n (occurrences), words, features and buckets (packed) of every distinct line of column text."""
    lines = texts.select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    packed = np.min_scalar_type(buckets - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [line.encode() for line in batch.column(0).to_pylist()]
            words = [words_of(line) for line in raw]
            found = [buckets_of(w, most_words, buckets) for w in words]
            yield pa.RecordBatch.from_arrays(
                [pa.array([digest(line) for line in raw], pa.binary()), batch.column(1), pa.array([len(w) for w in words], pa.int64()),
                 pa.array([len(f) for f in found], pa.int64()), pa.array([f.astype(packed).tobytes() for f in found], pa.binary())],
                names=["digest", "n", "words", "features", "buckets"],
            )

    each = lines.groupBy("line").agg(F.count(F.lit(1)).alias("n"))
    return written(each.mapInArrow(run, "digest binary, n long, words long, features long, buckets binary"), name)


def totals(lines: DataFrame, texts: DataFrame, most_words: int, buckets: int) -> DataFrame:
    """bucket, n: how often each bucket's features occur in the texts; a task gives at most a row for each bucket."""
    packed = np.min_scalar_type(buckets - 1)

    def summed(total: np.ndarray) -> pd.DataFrame:
        at = np.flatnonzero(total)
        return pd.DataFrame({"bucket": at.astype(np.int64), "n": total[at]})

    def of_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            found = np.frombuffer(b"".join(batch["buckets"]), dtype=packed)
            times = np.repeat(batch["n"].to_numpy(), batch["features"].to_numpy())
            np.add.at(total, found, times)
        yield summed(total)

    def over_ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for text in batch["text"]:
                np.add.at(total, crossing((text or "").encode().split(b"\n"), most_words, buckets), 1)
        yield summed(total)

    parts = lines.select("n", "features", "buckets").mapInPandas(of_lines, "bucket long, n long")
    if most_words > 1:
        parts = parts.union(texts.select("text").mapInPandas(over_ends, "bucket long, n long"))
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """floor(1000 ln) of how much likelier each bucket is in the target than in the source: one number a bucket."""
    every = source.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    both = every.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    both = written(both.fillna(0, ["s", "t"]), "resample-buckets")
    d = lambda c: F.col(c).cast("double")
    size = both.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).head()
    ratio = (d("t") + 1.0) * float(size["s"] + buckets) / ((d("s") + 1.0) * float(size["t"] + buckets))
    rows = both.select("bucket", F.floor(F.log(ratio) * 1000.0).cast("long").alias("gain"))
    out = np.zeros(buckets, dtype=np.int64)
    for row in rows.collect():  # `buckets` numbers
        out[row["bucket"]] = row["gain"]
    return out


def weighed(lines: DataFrame, gain: np.ndarray) -> DataFrame:
    """digest, n, words, features, weight of every distinct line."""
    packed = np.min_scalar_type(len(gain) - 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            of = gain[np.frombuffer(b"".join(batch["buckets"]), dtype=packed)]
            sums = np.concatenate(([0], np.cumsum(of)))
            ends = np.cumsum(batch["features"].to_numpy())
            weight = sums[ends] - sums[ends - batch["features"].to_numpy()]
            yield batch.drop(columns="buckets").assign(weight=weight)

    return lines.mapInPandas(run, "digest binary, n long, words long, features long, weight long")


def uses(docs: DataFrame, hot: dict[bytes, tuple[int, int, int]], gain: np.ndarray, most_words: int) -> DataFrame:
    """Of every document a row without a digest, with what its hot lines and crossing n-grams add up to, and a row
    for each other distinct line with how often it stands there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for row, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                sums = [0, 0, 0]
                rest: dict[bytes, int] = {}
                lines = (text or "").encode().split(b"\n")
                for line in lines:
                    key = digest(line)
                    if known := hot.get(key):
                        sums = [a + b for a, b in zip(sums, known, strict=True)]
                    else:
                        rest[key] = rest.get(key, 0) + 1
                if most_words > 1:
                    found = crossing(lines, most_words, len(gain))
                    sums = [sums[0], sums[1] + len(found), sums[2] + int(gain[found].sum())]
                for values in [(None, 1, *sums), *((key, n, 0, 0, 0) for key, n in rest.items())]:
                    for column, value in zip(out, (row, doc_id, *values), strict=True):
                        column.append(value)
            types = (pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["row", "doc_id", "digest", "times", "words", "features", "weight"]
            )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "row long, doc_id long, digest binary, times long, words long, features long, weight long"
    return written(rows.mapInArrow(run, schema), "resample-uses")


def resample(
    docs: DataFrame, target: DataFrame, most_words: int = MOST_WORDS, buckets: int = BUCKETS, seed: int = SEED,
    least_words: int = LEAST_WORDS, percent: int = PERCENT,
) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of docs (doc_id, text); target has a column text.

    `percent` of the documents with least_words words or more are drawn, highest score (weight and Gumbel noise
    that the seed and the doc_id decide) first, ties by smaller doc_id; others have a null rank. Null texts count
    as empty. A null doc_id counts as empty text for the noise and comes last in ties. Repeated rows are scored
    and ranked one by one; an empty table gives none; other columns are ignored.
    """
    docs, target = pick(docs, doc_id="doc_id", text="text"), pick(target, text="text")
    lines = segments(docs, most_words, buckets, "resample-lines")
    wanted = segments(target, most_words, buckets, "resample-target")
    gain = gains(totals(lines, docs, most_words, buckets), totals(wanted, target, most_words, buckets), buckets)
    weights = written(weighed(lines, gain), "resample-weights")
    all_lines = weights.agg(F.sum("n")).head()[0] or 0
    hot = weights.where(F.col("n") * HOT >= F.lit(all_lines)).select("digest", "words", "features", "weight").collect()  # HOT at most
    known = {bytes(r["digest"]): (r["words"], r["features"], r["weight"]) for r in hot}
    found = uses(docs, known, gain, most_words)
    own = found.where("digest is null").select("row", "doc_id", "words", "features", "weight")
    rest = found.where("digest is not null").select("row", "doc_id", "digest", "times").join(
        weights.where(F.col("n") * HOT < F.lit(all_lines)).drop("n"), "digest"
    )
    rest = rest.select("row", "doc_id", *[(F.col("times") * F.col(c)).alias(c) for c in ("words", "features", "weight")])
    each = own.union(rest).groupBy("row", "doc_id").agg(*[F.sum(c).alias(c) for c in ("words", "features", "weight")])
    code = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(code.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000.0).cast("long")
    each = written(each.withColumn("score", F.col("weight") + noise), "resample-scores")
    able = each.where(F.col("words") >= least_words)
    drawn = able.count() * percent // 100
    ranked = in_order(able, [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "resample-order")
    rank = F.when(F.col("__at") < drawn, F.col("__at") + 1).cast("long")
    columns = ["doc_id", F.col("features").alias("n_features"), "weight", "score"]
    others = each.where(F.col("words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*columns, rank.alias("rank")).union(others)


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
