"""The saved vector index against brute force: recall, exact form, pruned scans, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_vectors import brute, frame

from tidemark.operators import vector_index as VI


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(12, 24)) * 3
    pick = np.where(rng.random(1500) < 0.35, 0, rng.integers(0, 12, 1500))  # one hot cell
    m = (centre[pick] + rng.normal(size=(1500, 24))).astype("float32")
    m[3] = 0.0
    m[50] = m[51] = m[52]  # ties
    return m


@pytest.fixture(scope="module")
def saved(spark, clustered, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "v")
    meta = VI.build(frame(spark, clustered, "cid", "cv").repartition(6), path, n_cells=12, code_bytes=8, target=0.95)
    return path, meta


def test_every_row_is_indexed_once(spark, saved, clustered):
    ids = [r["cid"] for r in spark.read.parquet(f"{saved[0]}/rows").select("cid").collect()]
    assert sorted(ids) == [i for i in range(1500) if i != 3]


def test_recall_against_brute_force(spark, saved, clustered):
    queries = frame(spark, clustered[:80], "qid", "qv")
    got = VI.search(queries, saved[0], 10).collect()
    want = brute(clustered, 80, "cosine", 10)
    assert len(want & {(r["qid"], r["cid"]) for r in got}) / len(want) >= 0.9
    assert float(saved[1]["recall"]) >= 0.95
    unit = clustered.astype("float64") / np.maximum(np.linalg.norm(clustered.astype("float64"), axis=1), 1e-12)[:, None]
    for r in got:
        assert abs(r["score"] - unit[r["qid"]] @ unit[r["cid"]]) < 1e-5
    assert all(len([r for r in got if r["qid"] == q]) == 10 for q in range(80) if q != 3)


def test_exact_form_equals_brute_force(spark, saved, clustered):
    queries = frame(spark, clustered[:60], "qid", "qv")
    got = {(r["qid"], r["cid"]) for r in VI.search(queries, saved[0], 7, exact=True, block_rows=100).collect()}
    assert got == brute(clustered, 60, "cosine", 7)
    # all cells and every coded row ranked by its whole vector is the same again
    got = {(r["qid"], r["cid"]) for r in VI.search(queries, saved[0], 7, n_probe=12, depth=1500).collect()}
    assert got == brute(clustered, 60, "cosine", 7)


def test_only_probed_cells_are_read(spark, saved, clustered):
    one = VI.probes(frame(spark, clustered[:1], "qid", "qv"), VI.load(spark, saved[0])[1], 2)
    cut = VI.in_cells(spark.read.parquet(f"{saved[0]}/rows"), one).select("cid", "code")
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan and "ReadSchema: struct<cid:bigint,code:binary>" in plan
    probed = {r["cell"] for r in one.collect()}
    files = {int(r["f"].split("cell=")[1].split("/")[0]) for r in cut.select(F.input_file_name().alias("f")).distinct().collect()}
    assert files == probed and len(probed) == 2


def test_thresholds_and_prefixes(spark, saved, clustered):
    queries = frame(spark, clustered[:20], "qid", "qv")
    long = VI.search(queries, saved[0], 30, depth=300).collect()
    cut = VI.search(queries, saved[0], 30, depth=300, min_score=0.8).collect()
    assert {(r["qid"], r["cid"]) for r in cut} == {(r["qid"], r["cid"]) for r in long if r["score"] >= 0.8}


def test_odd_rows_and_empty_tables(spark, tmp_path):
    corpus = spark.createDataFrame([(1, [1.0, 0.0], "x"), (2, None, "x"), (3, [None, 1.0], "x"), (4, [0.6, 0.8], "x"), (5, [0.0, 0.0], "x"),
                                    (4, [0.6, 0.8], "y")], "cid int, cv array<double>, cell string")
    queries = spark.createDataFrame([(7, [1.0, 0.0]), (8, None), (9, [0.0, 0.0])], "qid int, qv array<double>")
    VI.build(corpus, str(tmp_path / "few"))
    got = [(r.qid, r.cid, r["rank"]) for r in VI.search(queries, str(tmp_path / "few"), 5).orderBy("rank").collect()]
    assert got == [(7, 1, 1), (7, 4, 2), (7, 4, 3)]
    assert VI.build(corpus.limit(0), str(tmp_path / "none"))["rows"] == "0"
    assert VI.search(queries, str(tmp_path / "none")).count() == 0
    assert VI.search(queries.limit(0), str(tmp_path / "few")).count() == 0
    mixed = spark.createDataFrame([(1, [1.0]), (2, [1.0, 0.5])], "cid int, cv array<double>")
    with pytest.raises(ValueError):
        VI.build(mixed, str(tmp_path / "mixed"))


def test_codes_keep_the_order_of_products():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    coder = VI.Coder.fit(x, 4, 16, 1)
    cell, code = coder.encode(x)
    pick = cell == 0
    estimated, exact = coder.scores(x[:20], 0, code[pick]), x[:20] @ x[pick].T
    assert np.abs(estimated - exact).max() < 0.1
    again = VI.Coder.of([dict(zip(("kind", "slice", "place", "value"), r)) for r in coder.rows()])
    assert np.allclose(again.scores(x[:20], 0, code[pick]), estimated)
