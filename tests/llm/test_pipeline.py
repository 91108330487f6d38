"""The pipeline's stages: columns, nulls, ties, clashing names, empty tables, and what they keep."""

import re

import pytest

import corpus_pipeline as C
from tidemark.llm import decontaminate as D
from tidemark.llm import simhash as S

DOCS = "doc_id long, text string, lang string, source string, n_chars long, TEXT string, score double, spans string, c0 string, item string"
SF = "/root/testdata/sf0.001"
ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("tables")
    good, bad = ("Plain words that go on, number {}.", "JUNK!! MORE!! {}!!")
    labels = [(i, int(i % 3 > 0), 0) for i in range(400)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return str(base), [(i, ((good if i % 3 else bad).format(i) + " ") * 5) for i in range(400)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None, "T", 0.0, "x", "y", None) for i, t in rows], DOCS)


def test_stages_keep_columns_and_rows_as_told(spark, folder):
    sf, texts = folder
    odd = [(None, None), (None, None), (7000, ""), (7001, ITEM), (7002, "  "), (7003, "one " * 3000), (7003, "one " * 3000), (7004, "one\n" * 3000)]
    docs = frame(spark, texts + odd)
    out = {name: stage(spark, docs, sf) for name, stage in C.STAGES[:-1]}
    assert all(x.columns == docs.columns for x in out.values())
    rows = {name: [(r[0], r[1]) for r in x.collect()] for name, x in out.items()}
    assert not any("JUNK" in (t or "") for _, t in rows["quality classifier"])
    assert sum("Plain" in (t or "") for _, t in rows["quality classifier"]) == sum("Plain" in t for _, t in texts)
    plain = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    exact = [plain(t) for _, t in rows["exact dedup"]]
    assert len(exact) == len(set(exact)) and set(exact) == {plain(t) for _, t in texts + odd}
    assert (7003, "one " * 3000) in rows["exact dedup"]
    prints = {S.fingerprint(t or "") for _, t in texts + odd}
    assert len(rows["simhash near-dedup"]) <= len(prints)
    kept = sorted(rows["benchmark decontamination"], key=str)
    assert kept == sorted([(i, t) for i, t in texts + odd if D.brute(t, [("1", ITEM)])[1] == 0], key=str)


def test_stages_take_empty_tables(spark, folder):
    sf, _ = folder
    none = spark.createDataFrame([], DOCS)
    assert all(stage(spark, none, sf).count() == 0 for _, stage in C.STAGES)


def test_the_pipeline_as_a_whole(spark):
    """On the smallest tables: each stage takes what the one before kept, and all that is left is packed."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = docs
    for _, stage in C.STAGES[:-1]:
        before, left = left, C.written(stage(spark, left, SF), "test-stage")
        assert left.columns == docs.columns and 0 < left.count() <= before.count()
    packed = C.run(spark, SF)
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert packed.select("doc_id").distinct().count() == left.select("doc_id").distinct().count()
    per = packed.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert all(r[1] <= 1024 for r in per)
