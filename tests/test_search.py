"""One search from request to log: routing, merging, thresholds, requests without an index."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import retrieve as R

HIT = "query bigint, object_type string, object_id bigint, score double"


@pytest.fixture(scope="module")
def world(spark):
    tables = spark.createDataFrame([(1, "t1", "Table one", "s", 10, "table")], "table_id bigint, name string, display_name string, schema_name string, row_count bigint, table_type string")
    columns = spark.createDataFrame([(1, "c1", None, 1, "INT", False, True, False)],
                                    "column_id bigint, name string, display_name string, table_id bigint, data_type string, is_primary_key boolean, is_nullable boolean, pii_flag boolean")
    entries = spark.createDataFrame([(1, "term", "meaning", "metric", "draft")], "entry_id bigint, term string, definition string, category string, status string")
    indexes = spark.createDataFrame([(1, 10, "faiss", "ready"), (2, 10, "tfidf", "ready"), (3, 10, "tfidf", "ready"), (4, 20, "tfidf", "ready"),
                                     (5, 30, "faiss", "building"), (6, 40, "pgvector", "ready")], "index_id bigint, project_id bigint, type string, status string")
    requests = spark.createDataFrame([(100, 10), (200, 20), (300, 30), (400, 40), (500, None), (600, 20)], "query bigint, project_id bigint")
    asked = {"faiss": [], "tfidf": []}

    def engine(kind, hits):
        def run(routed):
            asked[kind] = sorted(r["query"] for r in routed.collect())
            return spark.createDataFrame(hits, HIT).join(routed.select("query"), "query")
        return run

    engines = {"faiss": engine("faiss", [(100, "table", 1, 0.9), (100, "column", 1, 0.4), (100, "column", 9, 0.05)]),
               "tfidf": engine("tfidf", [(100, "table", 1, 0.7), (100, "dictionary_entry", 1, 0.4), (200, "column", 1, 0.2), (300, "table", 1, 1.0)])}
    return requests, indexes, engines, tables, columns, entries, asked


def rows(df):
    return [(r["query"], r["object_type"], r["object_id"], r["score"], r["method"], r["rank"], r["object_name"]) for r in df.orderBy("query", "rank").collect()]


def test_requests_go_to_the_ready_indexes_of_their_project(world):
    *parts, asked = world
    found, log = R.search(*parts)
    assert rows(found) == [
        (100, "table", 1, 0.9, "semantic", 1, "Table one"), (100, "column", 1, 0.4, "semantic", 2, "c1"),
        (100, "dictionary_entry", 1, 0.4, "keyword", 3, "term"), (200, "column", 1, 0.2, "keyword", 1, "c1")]
    assert asked == {"faiss": [100], "tfidf": [100, 200, 600]}
    # a type without an engine, an index that is building and a request without a project find nothing and are logged
    assert sorted((r["query"], r["results_count"], r["indexes_used"]) for r in log.collect()) == [
        (100, 3, 3), (200, 1, 1), (300, 0, 0), (400, 0, 0), (500, 0, 0), (600, 0, 1)]


def test_search_types_and_cuts(world):
    *parts, asked = world
    found, _ = R.search(*parts, search_type="keyword")
    assert {r[4] for r in rows(found)} == {"keyword"} and asked["faiss"] == []
    found, log = R.search(*parts, index_ids=[4])
    assert [r[0] for r in rows(found)] == [200] and log.agg(F.sum("indexes_used")).first()[0] == 2
    after = rows(R.search(*parts, k=2, threshold=0.5)[0])
    assert [(r[0], r[5]) for r in after] == [(100, 1)]
    assert [r[:3] for r in rows(R.search(*parts, k=2, threshold=0.0)[0])] == [(100, "table", 1), (100, "column", 1), (200, "column", 1)]


def test_empty_requests_and_indexes(world):
    requests, indexes, *rest, _ = world
    found, log = R.search(requests.limit(0), indexes, *rest)
    assert found.count() == 0 and log.count() == 0
    found, log = R.search(requests, indexes.limit(0), *rest)
    assert found.count() == 0 and log.where("results_count = 0 AND indexes_used = 0").count() == 6
