"""Saved keyword indexes: terms of many texts, repeated ids, what moves."""

from math import log, sqrt

from pyspark.sql import functions as F

from tidemark.operators import lexical as L

TEXTS = [(i, f"red blue {'green ' * (i % 3)}w{i}") for i in range(30)] + [(4, "red red blue"), (None, "red"), (40, None), (41, "")]


def held(docs):
    counts, n = {}, len(docs)
    for d, text in docs:
        if d is None or not text:
            continue
        t = text.split()
        c = counts.setdefault(d, {})
        for g in t + [f"{a} {b}" for a, b in zip(t, t[1:])]:
            c[g] = c.get(g, 0) + 1
    df = {}
    for c in counts.values():
        for g in c:
            df[g] = df.get(g, 0) + 1
    return counts, {g: log((1 + n) / (1 + v)) + 1 for g, v in df.items()}


def test_terms_of_many_texts_are_split_and_keep_their_count(spark):
    docs = spark.createDataFrame(TEXTS, "id bigint, body string")
    counts, idf = held(TEXTS)
    want = sorted((g, d, v, round(idf[g], 9)) for d, c in counts.items() for g, v in c.items())
    assert set(L.hot_terms(docs, "id", "body", limit=8)) == {"red", "blue", "green", "red blue", "blue green", "green green"}
    for limit in (8, L.HOT_DOCS):
        got = L.tfidf_postings(docs, "id", "body", hot_docs=limit)
        assert sorted((r["term"], r["doc"], r["tf"], round(r["idf"], 9)) for r in got.collect()) == want
    norms = {r["doc"]: r["norm"] for r in L.tfidf_norms(got).collect()}
    assert {d: round(v, 9) for d, v in norms.items()} == {
        d: round(sqrt(sum((v * idf[g]) ** 2 for g, v in c.items())), 9) for d, c in counts.items()}


def test_postings_move_once(spark):
    """One shuffle for the TF-IDF index, none for BM25 postings of ids that do not repeat."""
    docs = spark.createDataFrame([r for r in TEXTS if r[0] != 4], "id bigint, body string")
    plan_of = lambda df: df._jdf.queryExecution().executedPlan().toString()
    plan = plan_of(L.tfidf_postings(docs, "id", "body"))
    assert plan.count("Exchange hashpartitioning(") == 1
    rows = docs.select(F.col("id").alias("doc"), F.col("body").alias("text"))
    assert "Exchange hashpartitioning(" not in plan_of(L.bm25_impacts(rows, docs, "id", "body"))
