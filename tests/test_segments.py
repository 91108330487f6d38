"""TF-IDF index in segments: the weights and hits of a plain count, whatever the segments, repeated ids, ties."""

from math import log, sqrt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import lexical as L, segments as S
from tidemark.sources import sinks

TEXTS = [(i, f"red blue {'green ' * (i % 3)}w{i} über") for i in range(30)] + [
    (4, "red red blue"), (4, "blue red"), (None, "red"), (40, None), (41, ""), (42, "a the"), (50, "long " * 60 + "tail"), (51, "red blue w1 über green")]
ASKED = [("x", "red green"), ("y", "w3 long tail"), ("z", "unknown"), ("y", "blue"), (None, "red"), ("n", None)]


def grams(text, n_max):
    t = [w for w in (text or "").lower().split() if len(w) > 1 and w not in ("the",)]
    return [" ".join(t[i:i + n]) for n in range(1, n_max + 1) for i in range(len(t) - n + 1)]


def counted(rows, n_max):
    out = {}
    for d, text in rows:
        for g in grams(text, n_max) if d is not None else []:
            out.setdefault(d, {})[g] = out.get(d, {}).get(g, 0) + 1
    return out


def plain(n_max):
    """(document: term: weight), (term: idf)"""
    held, df = counted(TEXTS, n_max), {}
    for c in held.values():
        for g in c:
            df[g] = df.get(g, 0) + 1
    idf = {g: log((1 + len(TEXTS)) / (1 + v)) + 1 for g, v in df.items()}
    norm = {d: sqrt(sum((v * idf[g]) ** 2 for g, v in c.items())) for d, c in held.items()}
    return {d: {g: v * idf[g] / norm[d] for g, v in c.items()} for d, c in held.items()}, idf


@pytest.mark.parametrize("n_max,segment_terms,shard_chars", [(2, 1 << 20, 1 << 23), (2, 40, 20), (1, 1, 10), (3, 25, 50)])
def test_weights_are_those_of_a_plain_count(spark, n_max, segment_terms, shard_chars):
    docs = spark.createDataFrame(TEXTS, "id bigint, body string")
    index = S.segments(docs, "id", "body", n_max, ["the"], segment_terms, shard_chars)
    got = S.weights(index, S.document_counts(index), docs.count()).collect()
    want, idf = plain(n_max)
    assert sorted((r["doc"], r["term"], round(r["weight"], 9)) for r in got) == sorted((d, g, round(w, 9)) for d, c in want.items() for g, w in c.items())
    assert {r["term"] for r in S.vocabulary(index).collect()} == set(idf)


def test_a_row_of_the_index_holds_many_postings(spark, tmp_path):
    docs = spark.createDataFrame(TEXTS, "id bigint, body string").coalesce(1)
    sinks.save_index(L.tfidf_index(docs, "id", "body"), str(tmp_path / "index"), {"type": "tfidf"})
    parts, _ = sinks.load_index(spark, str(tmp_path / "index"))
    assert set(parts) == {"postings", "counts", "documents"} and parts["postings"].count() < 10
    norms = {r["doc"]: r["norm"] for r in L.index_norms(parts).collect()}
    rows = {r["doc"]: r["norm"] for r in L.tfidf_norms(L.tfidf_postings(docs, "id", "body")).collect()}
    assert {d: round(v, 9) for d, v in norms.items()} == {d: round(v, 9) for d, v in rows.items()}


@pytest.mark.parametrize("ids", ["bigint", "string"])
def test_hits_are_those_of_the_rows(spark, tmp_path, ids):
    # copies tie at the k-th place; small segments, so that lists of several are merged
    texts = TEXTS + [(100 + i, "red green copy") for i in range(15)]
    docs = spark.createDataFrame(texts, "id bigint, body string").withColumn("id", F.col("id").cast(ids))
    asked = spark.createDataFrame(ASKED, "q string, body string")
    n = docs.count()
    index = {"postings": S.segments(docs, "id", "body", 2, None, 30, 50).localCheckpoint()}
    index["counts"] = S.document_counts(index["postings"])
    index["documents"] = S.norms(index["postings"], index["counts"], n)
    postings, vocab = L.tfidf_build(docs, "id", "body")
    found = lambda df: sorted((r["query"], r["doc"], r["score"], r["rank"]) for r in df.collect())
    for k, floor in ((3, None), (10, 0.1), (1, 0.1)):
        want = found(L.tfidf_search(postings, L.tfidf_queries(asked, "q", "body", vocab), k, floor))
        for limit in (L.SENT_TERMS, 2):
            a = L.Asked(index, asked, "q", "body", limit=limit)
            assert a.sent == (limit > 2)
            assert found(a.search(L.tfidf_queries(asked, "q", "body", a.vocab), k, floor)) == want and want


def test_empty_tables(spark, tmp_path):
    docs, asked = spark.createDataFrame(TEXTS, "id bigint, body string"), spark.createDataFrame(ASKED, "q string, body string")
    for i, (d, a) in enumerate([(docs.limit(0), asked), (docs, asked.limit(0)), (docs.where("id IN (40, 41)"), asked)]):
        sinks.save_index(L.tfidf_index(d, "id", "body"), f"{tmp_path}/{i}", {"type": "tfidf"})
        parts, _ = sinks.load_index(spark, f"{tmp_path}/{i}")
        found = L.Asked(parts, a, "q", "body")
        assert found.search(L.tfidf_queries(a, "q", "body", found.vocab)).collect() == []


def test_the_build_moves_its_segments_once(spark):
    docs = spark.createDataFrame([r for r in TEXTS if r[0] != 4], "id bigint, body string")
    built, _ = L.tfidf_build(docs, "id", "body")
    one = built.agg(F.count("*").alias("n"))
    assert one.first()["n"] == sum(len(c) for c in counted([r for r in TEXTS if r[0] != 4], 2).values())
    one.collect()
    assert one._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("ReusedExchange") == 1
