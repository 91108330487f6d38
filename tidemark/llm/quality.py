"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader.

Words are the runs between white space. Every word gives two symbols: its own hash, and that of its shape
(length class, capitals, digits, other marks, whether it repeats the word before). N-grams of both sequences
are hashed to a fixed number of weights. Labels, lang, source and doc_id are no inputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.labelled import held_out, sample
from tidemark.llm.shared import documents, numbered, pick, written
from tidemark.llm.words import blocks, bounds, grams, hashes, mix

BITS = 18
#: Distinct training rows at most (in expectation): the sample is drawn by hashes.
MAX_TRAIN = 12_000
#: Numbers in a row while states lie in the shared folder.
CHUNK = 1 << 14
#: Parts that are trained side by side (of PART_ROWS at least), rounds after which their states are averaged,
#: passes within a round.
PARTS, PART_ROWS, ROUNDS, PASSES = 8, 1500, 4, 2
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.02, 0.01

_WORD = np.ones(256, dtype=np.int8)
_WORD[[9, 10, 11, 12, 13, 32]] = 0
_UPPER, _DIGIT, _MARK = (np.zeros(256, dtype=np.int32) for _ in range(3))
_UPPER[65:91] = 1
_DIGIT[48:58] = 1
_MARK[[c for c in range(33, 127) if not chr(c).isalnum()]] = 1


def _within(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return total[ends] - total[starts]


def features(texts: list[bytes], bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each block of texts: text number, feature number and value of each n-gram, values of length 1 a text."""
    for first, last in blocks(texts):
        part = texts[first:last]
        data = np.frombuffer(b"\n".join(part), dtype=np.uint8)
        sizes = np.fromiter((len(t) for t in part), dtype=np.int64, count=len(part))
        ends_of = np.cumsum(sizes + 1)
        starts, ends = bounds(data, _WORD)
        if len(starts):
            doc = np.searchsorted(ends_of, starts, side="right")
            word = hashes(data, starts, ends)
            sums = [np.concatenate(([0], np.cumsum(t[data]))) for t in (_UPPER, _DIGIT, _MARK)]
            upper, digit, mark = (_within(s, starts, ends) for s in sums)
            size = ends - starts
            again = np.zeros(len(word), dtype=bool)
            again[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
            shape = np.minimum(size, 20) // 4
            for value in (np.minimum(upper, 2), 2 * upper >= size, np.minimum(digit, 2), np.minimum(mark, 3),
                          mark == size, again):
                shape = shape * 8 + value
            last_byte = data[ends - 1].astype(np.uint64) * (_MARK[data[ends - 1]] > 0)
            shape = mix((shape.astype(np.uint64) << np.uint64(8)) + last_byte)
            columns, rows = [], []
            for salt, (symbols, n) in enumerate(((word, 1), (word, 2), (shape, 1), (shape, 2), (shape, 3))):
                g = grams(symbols, n)
                same = doc[: len(g)] == doc[n - 1 : n - 1 + len(g)]
                columns.append(mix(g[same] + np.uint64(salt)) >> np.uint64(64 - bits))
                rows.append(doc[: len(g)][same])
            key = (np.concatenate(rows).astype(np.int64) << bits) | np.concatenate(columns).astype(np.int64)
            key, count = np.unique(key, return_counts=True)
            row, column = key >> bits, key & ((1 << bits) - 1)
            value = np.sqrt(count.astype(np.float64))
            norm = np.sqrt(np.bincount(row, weights=value * value, minlength=len(part)))
            yield row + first, column, value / norm[row]


def weights_of(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
    return np.where(np.abs(z) <= L1, 0.0, w)


def learn(rows: list[tuple[np.ndarray, np.ndarray, int, int]], z: np.ndarray, n: np.ndarray, passes: int) -> None:
    """Follow-the-regularised-leader over (columns, values, label, weight); z and n are changed. The last weight is a bias."""
    for _ in range(passes):
        for at, value, label, weight in rows:
            w = weights_of(z[at], n[at])
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ value, -35, 35)))
            g = weight * (p - label) * value
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g


def train(
    docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, bits: int = BITS,
    parts: int = PARTS, rounds: int = ROUNDS, passes: int = PASSES,
) -> np.ndarray:
    """Weights from labelled documents that are not held out.

    The sample is bounded by distinct rows (see labelled.sample). Each part runs over its own rows from the common
    state; the states of 2**bits numbers lie in the shared folder in chunks, are handed to the parts by a join and
    averaged by an aggregate. The driver only gets the last one. A small sample is one part. Without rows all
    weights are 0.
    """
    rows = sample(docs, labels, "quality", max_train, 8)
    count = rows.count()
    parts = max(1, min(parts, count // PART_ROWS, max_train // PART_ROWS))
    part = F.pmod(F.xxhash64("doc_id", "text", F.lit(9)), F.lit(parts)).cast("int")
    rows = written(rows.select("doc_id", "text", "label", "weight", part.alias("part")), "quality-training")
    spark, size = docs.sparkSession, (1 << bits) + 1
    state = spark.range(-(-size // CHUNK)).select(F.col("id").cast("int").alias("chunk"))
    state = state.withColumns({"z": F.lit(None).cast("binary"), "n": F.lit(None).cast("binary")})
    for _ in range(rounds if count else 0):
        given = state.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        both = rows.groupBy("part").cogroup(given.groupBy("part"))
        each = both.applyInPandas(one_round(bits, passes), "chunk int, rows long, z binary, n binary")
        state = written(each.groupBy("chunk").applyInPandas(averaged, "chunk int, z binary, n binary"), "quality-state")
    last = state.orderBy("chunk").collect() if count else []
    if not last:
        return np.zeros(size)
    return weights_of(*(np.concatenate([np.frombuffer(r[k]) for r in last]) for k in ("z", "n")))


def averaged(pdf: pd.DataFrame) -> pd.DataFrame:
    """One chunk of the states of all parts, weighted by their rows."""
    share = pdf["rows"].to_numpy() / pdf["rows"].sum()
    out = {k: [sum(a * np.frombuffer(v) for a, v in zip(share, pdf[k], strict=True)).tobytes()] for k in ("z", "n")}
    return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1].tolist(), **out})


def one_round(bits: int, passes: int):
    """The function that takes a part of the sample from the common state to its own, in chunks."""
    size = (1 << bits) + 1

    def run(pdf: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({"chunk": [], "rows": [], "z": [], "n": []})
        state = state.sort_values("chunk")
        blank = state["z"].isna().any()
        z, n = (np.zeros(size) if blank else np.concatenate([np.frombuffer(v) for v in state[k]]) for k in ("z", "n"))
        pdf = pdf.sort_values(["doc_id", "text"], kind="stable").reset_index(drop=True)
        pdf = pdf.iloc[np.random.default_rng(1).permutation(len(pdf))]
        given = vectors([t.encode() for t in pdf["text"]], bits)
        learn([(a, v, int(y), int(w)) for (a, v), y, w in zip(given, pdf["label"], pdf["weight"], strict=True)], z, n, passes)
        cuts = range(0, size, CHUNK)
        return pd.DataFrame({
            "chunk": range(len(cuts)), "rows": len(pdf), "z": [z[c : c + CHUNK].tobytes() for c in cuts], "n": [n[c : c + CHUNK].tobytes() for c in cuts],
        })

    return run


def vectors(texts: list[bytes], bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Columns and values of each text, the bias last."""
    bias = (np.array([1 << bits]), np.array([1.0]))
    out = [bias] * len(texts)
    for row, column, value in features(texts, bits):
        cuts = np.flatnonzero(np.diff(row)) + 1
        for r, a, v in zip(row[np.concatenate(([0], cuts))], np.split(column, cuts), np.split(value, cuts), strict=True):
            out[r] = (np.append(a, bias[0]), np.append(v, bias[1]))
    return out


def score(df: DataFrame, weights: np.ndarray) -> DataFrame:
    """df with `score` (0 to 1, higher for label 1): the sparse dot product of the weights with column `__text`.

    Null texts count as empty and get the score of the bias alone. The weights have a fixed size and are
    broadcast once.
    """
    bits = len(weights).bit_length() - 1
    shared = df.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def dot(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = shared.value
        for texts in batches:
            total = np.full(len(texts), w[-1])
            for row, column, value in features([(t or "").encode() for t in texts], bits):
                total += np.bincount(row, weights=w[column] * value, minlength=len(texts))
            yield pd.Series(1.0 / (1.0 + np.exp(-np.clip(total, -35, 35))))

    return df.withColumn("score", dot(F.col("__text")))


def classify(docs: DataFrame, labels: DataFrame, **training) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; other columns are ignored, repeated rows stay."""
    weights = train(docs, labels, **training)
    rows = pick(docs, doc_id="doc_id", __text="text")
    return score(rows, weights).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, **training) -> DataFrame:
    """The rows of docs that are predicted 1, with all their columns."""
    weights = train(docs, labels, **training)
    plain, names = numbered(docs)
    scored = score(plain.withColumn("__text", F.col(f"c{names.index('text')}")), weights)
    return scored.where("score >= 0.5").drop("__text", "score").toDF(*names)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
