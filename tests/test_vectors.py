"""Block scoring against numpy, embedding life cycle, approximate recall."""

import numpy as np
import pytest

from tidemark.operators import embed as E, vector as V


@pytest.fixture(scope="module")
def vecs():
    rng = np.random.default_rng(4)
    m = rng.normal(size=(300, 16)).astype("float32")
    m[7] = 0.0  # zero vector
    m[20] = m[21]  # tie
    return m


def frame(spark, m, a, b):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], f"{a} bigint, {b} array<float>")


def brute(m, n_q, metric, k, drop_self=False):
    d = m.astype("float64")
    out = set()
    for q in range(n_q):
        if metric == "cosine":
            with np.errstate(invalid="ignore", divide="ignore"):
                s = (d @ d[q]) / (np.linalg.norm(d, axis=1) * np.linalg.norm(d[q]))
        else:
            s = 1 / (1 + np.linalg.norm(d - d[q], axis=1))
        s = np.round(s, 6)
        rows = sorted((-x, i) for i, x in enumerate(s) if not np.isnan(x) and not (drop_self and i == q))
        out |= {(q, i) for _, i in rows[:k]}
    return out


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("sizes", [{}, {"small_queries": True}, {"block_rows": 40}])
def test_topk(spark, vecs, metric, sizes):
    q, c = frame(spark, vecs[:50], "qid", "qv"), frame(spark, vecs, "cid", "cv").repartition(5)
    got = {(r["qid"], r["cid"]) for r in V.topk(q, c, 7, metric, **sizes).collect()}
    assert got == brute(vecs, 50, metric, 7)


def test_self_is_left_out(spark, vecs):
    q, c = frame(spark, vecs[:30], "qid", "qv"), frame(spark, vecs, "cid", "cv")
    got = {(r["qid"], r["cid"]) for r in V.topk(q, c, 4, exclude_self=True).collect()}
    assert got == brute(vecs, 30, "cosine", 4, True)


def test_topk_is_prefix(spark, vecs):
    q, c = frame(spark, vecs[:5], "qid", "qv"), frame(spark, vecs, "cid", "cv")
    big = {(r["qid"], r["rank"]): r["cid"] for r in V.topk(q, c, 20).collect()}
    for r in V.topk(q, c, 6).collect():
        assert big[r["qid"], r["rank"]] == r["cid"]


def test_zero_vector_has_no_unit(spark, vecs):
    df = frame(spark, vecs, "cid", "cv").select("cid", V.norm(V.l2_normalize("cv")).alias("n"))
    for r in df.collect():
        assert (r["n"] is None) if r["cid"] == 7 else abs(r["n"] - 1) < 1e-9


def test_metric_errors(spark):
    with pytest.raises(ValueError):
        V.similarity("a", "b", "manhattan")


def test_ivf_recall_and_skew(spark):
    rng = np.random.default_rng(9)
    centre = rng.normal(size=(6, 16)) * 4
    pick = np.where(rng.random(900) < 0.5, 0, rng.integers(0, 6, 900))  # one hot cell
    m = (centre[pick] + rng.normal(size=(900, 16))).astype("float32")
    q, c = frame(spark, m[:40], "qid", "qv"), frame(spark, m, "cid", "cv")
    exact = V.topk(q, c, 5)
    found = V.ivf_topk(q, c, V.train_cells(c, 6), 5, n_probe=3, block_rows=50)
    assert V.recall(found, exact).first()["recall"] >= 0.9
    every = V.ivf_topk(q, c, V.train_cells(c, 6), 5, n_probe=6, block_rows=50)
    assert V.recall(every, exact).first()["recall"] == 1.0


OBJ = "project_id bigint, object_type string, object_id bigint, text string"


def test_incremental_embeds_only_missing(spark):
    objs = spark.createDataFrame([(1, "table", i, f"t {i}") for i in range(5)], OBJ)
    stored = E.embed_batch(objs.where("object_id < 3")).select(*E.KEYS, "vector")
    assert E.missing_objects(objs, stored, "hash-64").count() == 2
    full = E.embed_incremental(objs, stored)
    assert full.count() == 5
    # a rerun adds nothing, and a replace leaves no copies
    assert E.missing_objects(objs, full, "hash-64").count() == 0
    assert E.embed_incremental(objs, full, overwrite=True).count() == 5


def test_failed_texts_stay_with_their_error(spark):
    class Flaky:
        def encode(self, texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("no")
            return np.ones((len(texts), 2))

    objs = spark.createDataFrame([(1, "table", i, "bad" if i == 0 else "ok") for i in range(64)], OBJ).coalesce(1)
    got = {r["object_id"]: (r["vector"], r["embed_error"]) for r in E.embed_batch(objs, Flaky).collect()}
    assert len(got) == 64 and got[0] == (None, "RuntimeError: no")
    assert all(got[i] == ([1.0, 1.0], None) for i in range(1, 64))


def test_null_vectors_do_not_stop_a_search(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [None, 1.0]), (4, [0.6, 0.8])], "cid int, cv array<double>")
    queries = spark.createDataFrame([(7, [1.0, 0.0]), (8, None)], "qid int, qv array<double>")
    for small in (True, False):
        assert [(r.qid, r.cid) for r in V.topk(queries, corpus, 5, small_queries=small).orderBy("rank").collect()] == [(7, 1), (7, 4)]


def test_embedding_is_repeatable():
    a, b = E.HashEmbedder().encode(["Hello World", "", None]), E.HashEmbedder().encode(["hello   world", "", None])
    assert np.allclose(a, b) and abs(np.linalg.norm(a[0]) - 1) < 1e-6 and not a[2].any()


def test_delete_scope(spark):
    df = spark.createDataFrame([(1, "table", 1), (1, "column", 2), (2, "table", 3)], "project_id bigint, object_type string, object_id bigint")
    kept, n = E.delete_scope(df, 1)
    assert (kept.count(), n.first()[0]) == (1, 2)
    kept, n = E.delete_scope(df, 1, "table")
    assert (kept.count(), n.first()[0]) == (2, 1)


def test_pieces_of_a_meeting_keep_the_rows_of_brute_force():
    """Ties, repeated ids, zero vectors and floors over several pieces of a meeting."""
    import numpy as np
    import pandas as pd

    from tidemark.operators.vector import _scorer

    rng = np.random.default_rng(3)
    vecs = rng.integers(-1, 2, (60, 3)).astype("float32")  # many equal directions, some of length zero
    ids = np.concatenate([np.arange(55), np.arange(5)])
    q, c = pd.DataFrame({"qid": ids, "qv": list(vecs)}), pd.DataFrame({"cid": ids[::-1], "cv": list(vecs[::-1])})
    with np.errstate(divide="ignore", invalid="ignore"):
        u = vecs.astype(float) / np.linalg.norm(vecs.astype(float), axis=1, keepdims=True)
    for floor, alone, step in ((None, True, 7), (0.5, False, 7), (None, False, 1000), (None, True, 1)):
        got = _scorer(4, "cosine", floor, alone, step)(q, c)
        want = []
        for i, x in enumerate(ids):
            hits = [(-round(float(u[i] @ u[j]), 6), int(y)) for j, y in enumerate(ids) if not (alone and x == y)]
            hits = sorted(h for h in hits if h[0] == h[0] and (floor is None or -h[0] >= floor))[:4]
            want += [(int(x), y, -s) for s, y in hits]
        assert sorted(zip(got["qid"], got["cid"], got["score"] + 0.0)) == sorted((x, y, s + 0.0) for x, y, s in want)


def test_a_row_is_copied_once_per_meeting_not_per_piece(spark):
    """Small pieces do not make small meetings."""
    from pyspark.sql import functions as F

    from tidemark.operators import blocks

    seen = spark.sparkContext.accumulator(0)
    rows = spark.range(1200)

    def score(q, c):
        seen.add(len(q))
        return q.rename(columns={"qid": "a"})[["a"]].head(0)

    blocks.block_topk(rows.select(F.col("id").alias("qid")), rows.select(F.col("id").alias("cid")), "qid", "cid",
                      score, "a bigint", None, block_rows=4).collect()
    cores = spark.sparkContext.defaultParallelism
    assert seen.value <= 1200 * ((2 * cores) ** 0.5 + 1)  # 300 copies of each row before
