"""Guarded SQL: what runs, what is refused."""

import pytest

from tidemark.operators import sqlguard as G


@pytest.fixture(scope="module")
def views(spark):
    return {"nums": spark.range(250).withColumnRenamed("id", "created_at"), "other": spark.range(3)}


@pytest.mark.parametrize("sql", [
    "SELECT created_at FROM nums",  # CREATE inside a name is harmless
    "WITH t AS (SELECT max(created_at) AS m FROM nums) SELECT * FROM t JOIN other ON id <= m",
    "SELECT '{x} DROP TABLE' AS s FROM nums",
    "SELECT * FROM nums WHERE created_at IN (SELECT id FROM OTHER);",
    "SELECT 1 AS one",
    "WITH a AS (SELECT 1 AS x), b AS (WITH c AS (SELECT x FROM a) SELECT * FROM c) SELECT * FROM b UNION ALL SELECT id FROM other",
    "SELECT created_at, row_number() OVER (PARTITION BY created_at % 3 ORDER BY created_at) AS r FROM nums",
    "SELECT count(*) AS n FROM nums n JOIN other o ON n.created_at = o.id GROUP BY o.id HAVING count(*) > 0 ORDER BY 1 LIMIT 3",
])
def test_allowed(spark, views, sql):
    assert G.guarded_query(spark, sql, views).count() >= 1


@pytest.mark.parametrize("sql", [
    "DROP TABLE nums", "INSERT INTO nums SELECT * FROM other", "CREATE TABLE z AS SELECT 1", "SELECT * FROM secret",
    "SELECT * FROM parquet.`/etc`", "SET spark.x = 1", "EXPLAIN SELECT 1", "", "  ;", "SELECT * FROM range(5)",
    "SELECT * FROM nums WHERE created_at IN (SELECT id FROM secret)", "TRUNCATE TABLE nums", "CACHE TABLE nums",
    "FROM nums INSERT INTO a SELECT * INSERT INTO b SELECT *",
    "SELECT secret.* FROM (WITH secret AS (SELECT 1 x) SELECT * FROM secret) a, secret",
    "SELECT (WITH secret AS (SELECT 1 x) SELECT max(x) FROM secret) FROM secret",
    "WITH a AS (SELECT * FROM b), b AS (SELECT 1 x) SELECT * FROM a",
    "SELECT reflect('java.lang.System', 'getProperty', 'user.dir') FROM nums",
    "SELECT java_method('java.lang.System', 'getProperty', 'user.dir')", "SELECT try_reflect('java.lang.System', 'nanoTime')",
    "SELECT * FROM nums WHERE reflect('java.lang.System', 'nanoTime') > '1'", "SELECT * FROM nums ORDER BY reflect('java.lang.System', 'nanoTime')",
    "SELECT current_user()", "SELECT input_file_name() FROM nums", "SELECT * FROM nums LATERAL VIEW stack(2, 1, 2) s AS v",
    "SELECT count(*) FROM nums GROUP BY reflect('java.lang.System', 'nanoTime')", "SELECT * FROM VALUES (reflect('java.lang.System', 'nanoTime'))",
    "SELECT TRANSFORM (created_at) USING 'cat' FROM nums",
])
def test_refused(spark, views, sql):
    with pytest.raises(G.UnsafeSql):
        G.guarded_query(spark, sql, views)


def test_row_cap(spark, views):
    r = G.run_guarded(spark, "SELECT * FROM nums ORDER BY created_at", views, max_rows=100)
    assert (r.row_count, r.has_more, r.columns, r.rows[-1]) == (100, True, ["created_at"], (99,))
    r = G.run_guarded(spark, "SELECT * FROM other", views, max_rows=3)
    assert (r.row_count, r.has_more) == (3, False)


def test_frame_with_a_cap_tells_of_more(spark, views):
    got = G.guarded_query(spark, "SELECT * FROM nums ORDER BY created_at", views, 100).collect()
    assert len(got) == 100 and all(r.has_more for r in got)
    assert not any(r.has_more for r in G.guarded_query(spark, "SELECT * FROM other", views, 3).collect())
    assert G.guarded_query(spark, "SELECT * FROM nums", views).count() == 250


def test_preview(spark, views):
    r = G.preview_sql(spark, "SELECT * FROM nums", views)
    assert (r.row_count, r.has_more, r.is_preview) == (100, True, True)


def test_session_stays_clean(spark, views):
    G.guarded_query(spark, "SELECT * FROM nums", views).count()
    assert "nums" not in [t.name for t in spark.catalog.listTables()]


def test_audit_modes(spark):
    log = spark.createDataFrame([(1, "select created_at from t"), (2, "update t set a = 1"), (3, None), (4, "values (1)")], "id int, sql_text string")
    sub = {r["id"]: r for r in G.sql_audit(log).collect()}
    word = {r["id"]: r for r in G.sql_audit(log, mode="word").collect()}
    assert sub[1]["service_error"] == "Blocked keyword detected: CREATE" and not sub[1]["chat_ok"] and sub[1]["admin_ok"]
    assert word[1]["service_error"] is None and word[1]["chat_ok"]
    assert sub[2]["service_error"] == "Blocked keyword detected: UPDATE"
    assert sub[3]["service_error"] == "Empty SQL query"
    assert sub[4]["service_error"] == "Query must contain one of: SELECT, WITH, EXPLAIN"
