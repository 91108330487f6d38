"""Toxicity: held-out accuracy, plain n-gram features, and what must not matter."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import toxicity as X
from tidemark.llm.labelled import sample

DOCS = "doc_id long, text string, TEXT string, label string, weight string, score string"


def held_out(i):
    from zlib import crc32

    return crc32(str(i).encode()) % 3 == 1


def corpus(n, seed=3):
    rng = np.random.default_rng(seed)
    parts = ["an", "der", "ou", "ti", "sch", "est", "la", "mo"]
    word = lambda: "".join(rng.choice(parts, rng.integers(1, 4)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.integers(5, 120))]
        bad = i % 6 == 0
        if bad:
            for _ in range(rng.integers(1, 4)):
                words.insert(rng.integers(0, len(words)), "grulk" + word())
        docs.append((i, " ".join(words), "x", "y", "z", "w"))
        labels.append((i, int(bad)))
    return docs, labels


def test_held_out_accuracy_and_columns(spark):
    docs, labels = corpus(1500)
    docs += [(9001, None, "", "", "", ""), (9002, "", "", "", "", ""), (None, "Grulkan " * 3, "", "", "", ""), docs[0], docs[0]]
    got = X.toxicity(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = got.collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    wrong = [r for r in rows if r.doc_id is not None and r.doc_id < 1500 and held_out(r.doc_id) and r.predicted != (r.doc_id % 6 == 0)]
    assert len(wrong) <= 5
    assert all(r.held_out == held_out(r.doc_id) for r in rows if r.doc_id is not None)
    assert [r.predicted for r in rows if r.doc_id is None] == [1] and {r.predicted for r in rows if r.doc_id in (9001, 9002)} == {0}


def test_held_out_labels_are_never_read(spark):
    docs, labels = corpus(300)
    df = spark.createDataFrame(docs, DOCS)
    turned = [(i, 1 - y if held_out(i) else y) for i, y in labels]
    a, b = (X.train(df, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, turned))
    assert np.allclose(a, b, atol=1e-6) and a.any()


def test_without_labels_or_with_one_class(spark):
    docs, labels = corpus(40)
    df = spark.createDataFrame(docs, DOCS)
    schema = "doc_id long, toxic int"
    for given, score in (([], 0.5), ([(i, None) for i, _ in labels], 0.5), ([(i, 1) for i, _ in labels], 1.0), ([(i, 0) for i, _ in labels], 0.0)):
        scores = {round(r.score, 6) for r in X.toxicity(df, spark.createDataFrame(given, schema)).collect()}
        assert scores == {score}
    assert X.toxicity(df.limit(0), spark.createDataFrame(labels, schema)).collect() == []


def test_a_repeated_drawn_id_is_bounded_by_distinct_rows(spark):
    known = spark.createDataFrame([(0, 1), (0, 1), (1, 0)], "doc_id long, toxic int")
    same = spark.range(5000).select(F.lit(0).cast("long").alias("doc_id"), F.lit("same text").alias("text"))
    own = spark.range(5000).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("string").alias("text"))
    rows = sample(same.union(own), known, "toxic", 500, 11).collect()
    assert not held_out(0) and not held_out(1)
    assert 300 < len(rows) < 700
    assert all(r.weight == (10_000 if r.label else 1) for r in rows)


@pytest.mark.parametrize("text", ["", "a", "ab", "Some  Text\n here", "日本語 \U0001f600", "x" * 300])
def test_features_are_those_of_every_n_gram(monkeypatch, text):
    whole = sorted(b for part in X.buckets_of(text) for b in part.tolist())
    s = f" {' '.join(text.lower().split())} "
    assert len(whole) == sum(max(0, len(s) - n + 1) for n in X.LENGTHS)
    monkeypatch.setattr(X, "STEP", 7)
    assert sorted(b for part in X.buckets_of(text) for b in part.tolist()) == whole
    grams = {s[i : i + n] for n in X.LENGTHS for i in range(len(s) - n + 1)}
    assert len(set(whole)) >= len(grams) - 1
