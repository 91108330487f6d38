"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are the n-grams of characters that it holds, hashed to buckets. Each bucket has the log ratio of
its smoothed shares among toxic and other texts; the buckets that tell the classes apart best are the model's
inputs, each with its ratio as value, and a logistic regression is trained on them. Labels, lang, source and
doc_id are no inputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.labelled import held_out, sample
from tidemark.llm.shared import documents, pick, written

BITS, LENGTHS = 18, (3, 4, 5)
#: Distinct training rows at most (in expectation), inputs of the model, and partitions that training runs in.
MAX_TRAIN, INPUTS, PARTS = 10_000, 8192, 8
SMOOTH, PENALTY, ROUNDS = 1.0, 1e-4, 60
THRESHOLD = 0.7
#: Characters that are hashed at once; a longer text is taken in steps that overlap.
STEP = 1 << 17
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
_LAST = np.uint64(0xE7037ED1A0B428DB)


def buckets_of(text: str, bits: int = BITS) -> Iterator[np.ndarray]:
    """The buckets of a text's n-grams, repeats included, step by step. Case is folded, white space is one blank."""
    text = f" {' '.join(text.lower().split())} "
    for at in range(0, max(1, len(text) - LENGTHS[0] + 1), STEP):
        raw = text[at : at + STEP + LENGTHS[-1] - 1].encode("utf-32-le", "surrogatepass")
        codes = np.frombuffer(raw, dtype=np.uint32).astype(np.uint64)
        total = np.zeros(len(codes), dtype=np.uint64)
        for k in range(LENGTHS[-1]):
            if len(codes) <= k:
                break
            total = total[: len(codes) - k] + codes[k:] * _FACTORS[k]
            if k + 1 in LENGTHS:
                mixed = (total ^ (total >> np.uint64(29))) * _LAST
                yield (mixed[:STEP] >> np.uint64(64 - bits)).astype(np.int64)


def ratios(rows: DataFrame, bits: int = BITS, inputs: int = INPUTS) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that are the model's inputs, in rising order, and their log-count ratios.

    A task gives at most a row for each bucket. The inputs are the buckets with the largest chi-square statistic.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((2, 1 << bits))
        there = np.zeros(1 << bits, dtype=bool)
        for batch in batches:
            for text, label, weight in zip(batch["text"], batch["label"], batch["weight"], strict=True):
                found = list(buckets_of(text, bits))
                for b in found:
                    there[b] = True
                counts[int(label == 1)][np.flatnonzero(there)] += weight
                for b in found:
                    there[b] = False
        at = np.flatnonzero(counts.any(axis=0))
        yield pd.DataFrame({"bucket": at, "p": counts[1][at], "q": counts[0][at]})

    size = rows.groupBy().agg(F.sum(F.when(F.col("label") == 1, F.col("weight"))), F.sum(F.when(F.col("label") != 1, F.col("weight")))).head()
    n_p, n_q = float(size[0] or 0), float(size[1] or 0)
    if not n_p or not n_q:
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    counts = rows.mapInPandas(run, "bucket long, p double, q double").groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    n, seen = n_p + n_q, F.col("p") + F.col("q")
    cross = F.col("p") * n_q - F.col("q") * n_p
    spread = F.greatest(seen * (F.lit(n) - seen), F.lit(1e-9))
    ratio = F.log((F.col("p") + SMOOTH) / (n_p + 2 * SMOOTH)) - F.log((F.col("q") + SMOOTH) / (n_q + 2 * SMOOTH))
    best = counts.select("bucket", ratio.alias("r"), (cross * cross / spread).alias("chi"))
    found = sorted((r["bucket"], r["r"]) for r in best.orderBy(F.desc("chi"), "bucket").limit(inputs).collect())
    return np.array([b for b, _ in found], dtype=np.int64), np.array([r for _, r in found])


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, bits: int = BITS, inputs: int = INPUTS) -> np.ndarray:
    """What each bucket adds to the log odds if a text holds it, the bias last.

    The sample is bounded by the distinct rows that are trained on, so a repeated row or id costs no more than one.
    Without labelled rows all weights are 0; with one class only the bias says which.
    """
    rows = sample(docs, labels, "toxic", max_train, 11).select("text", "label", "weight")
    rows = written(rows.repartition(PARTS), "toxic-sample")
    out = np.zeros((1 << bits) + 1)
    at, ratio = ratios(rows, bits, inputs)
    place = np.full(1 << bits, -1, dtype=np.int64)
    place[at] = np.arange(len(at))

    @F.pandas_udf("array<int>")
    def held(texts: pd.Series) -> pd.Series:
        found = []
        for text in texts:
            here = [place[b] for b in buckets_of(text, bits)]
            here = np.unique(np.concatenate(here)) if here else place[:0]
            found.append(here[here >= 0].astype(np.int32))
        return pd.Series(found, dtype=object)

    width = max(1, len(at))
    vector = F.udf(lambda i: SparseVector(width, i, [float(ratio[k]) for k in i]), VectorUDT())
    points = rows.select(F.col("label").cast("double"), F.col("weight").cast("double"), held("text").alias("at"))
    points = written(points.select(F.when(F.col("label") == 1, 1.0).otherwise(0.0).alias("label"), "weight", "at"), "toxic-points")
    classes = points.agg(F.min("label"), F.max("label")).head()
    if classes[0] is None:
        return out
    if classes[0] == classes[1]:
        out[-1] = 35.0 if classes[0] else -35.0
        return out
    points = points.select("label", "weight", vector("at").alias("features")).coalesce(PARTS)
    model = LogisticRegression(weightCol="weight", regParam=PENALTY, standardization=False, maxIter=ROUNDS, family="binomial").fit(points)
    out[at] = model.coefficients.toArray()[: len(at)] * ratio
    out[-1] = model.intercept
    return out


def score(df: DataFrame, weights: np.ndarray) -> DataFrame:
    """df with `score` (0 to 1, higher for toxic) of column text: each bucket that the text holds counts once.

    Null and empty texts get the score of the bias and of a lone blank. The weights have a fixed size.
    """
    bits = len(weights).bit_length() - 1
    shared = df.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weight = shared.value
        counts = weight[:-1] != 0
        for texts in batches:
            total = np.full(len(texts), weight[-1])
            for i, text in enumerate(texts):
                here = [b[counts[b]] for b in buckets_of(text or "", bits)]
                if here:
                    total[i] += weight[np.unique(np.concatenate(here))].sum()
            yield pd.Series(1.0 / (1.0 + np.exp(-np.clip(total, -35, 35))))

    return df.withColumn("score", run(F.col("text")))


def toxicity(docs: DataFrame, labels: DataFrame, **training) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (doc_id, text), trained on labels (doc_id, toxic).

    Repeated rows stay; an empty table gives none; a null doc_id is scored and never trained on; other columns
    are ignored.
    """
    weights = train(docs, labels, **training)
    return score(pick(docs, doc_id="doc_id", text="text"), weights).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
