"""Dictionary folds, clean-up edge cases, fusion properties, pages, filters."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import clean, dictionary as D, ops, pii, profile, retrieve as R

START = datetime(2024, 1, 1)


def replay(rows):
    out = {}
    for _, e, _, action in sorted(rows, key=lambda r: (r[2], r[0])):
        s = out.setdefault(e, ["draft", 1, 0])
        if action == "approve":
            s[0], s[1] = "approved", s[1] + 1
        elif action == "edit" and s[0] == "approved":
            s[0], s[1] = "draft", s[1] + 1
        elif action == "use":
            s[2] += 1
        elif action in ("reject", "submit", "archive"):
            s[0] = {"reject": "rejected", "submit": "pending_review", "archive": "archived"}[action]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_workflow_fold(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice([1, 1, 1, 2, 3]), START + timedelta(hours=rng.randint(0, 300)),
             rng.choice(["approve", "edit", "edit", "use", "reject", "submit", "archive"])) for i in range(400)]
    df = spark.createDataFrame(rows, "event_id bigint, entry_id bigint, ts timestamp_ntz, action string").repartition(3)
    got = {r["entry_id"]: [r["status"], r["version"], r["usage_count"]] for r in D.workflow_fold(df).collect()}
    assert got == replay(rows)


def test_dedup_keeps_best_and_first_position(spark):
    rows = [("Order", 0.7, 5, 0), ("order", 0.9, 9, 0), ("Date", 0.9, 7, 0), ("ORDER", 0.9, 8, 0)]
    df = spark.createDataFrame(rows, "term string, confidence double, seq bigint, ordinal int")
    got = [(r["rank"], r["term"], r["confidence"]) for r in D.dedup_top(df).orderBy("rank").collect()]
    assert got == [(1, "ORDER", 0.9), (2, "Date", 0.9)]


def test_title_entries(spark):
    cols = spark.createDataFrame([("SKU", "t", ["1"]), ("id", "t", None), ("Order Total", "t", None)], "name string, table_name string, sample_values array<string>")
    got = {r["name"]: (r["term"], r["category"], r["synonyms"]) for r in D.from_columns(cols).collect()}
    assert got == {"SKU": ("Sku", "abbreviation", ["SKU"]), "id": ("Id", "technical_term", ["id"]), "Order Total": ("Order Total", "business_term", [])}


def test_upsert_overwrite(spark):
    old = spark.createDataFrame([("Order", "old", 1), ("Date", "old", 2)], "term string, definition string, seq int")
    new = spark.createDataFrame([("ORDER", "a", 3), ("order", "b", 4), ("New", "c", 5)], "term string, definition string, seq int")
    keep = {(r["term"], r["definition"]) for r in D.upsert(new, old, "seq").collect()}
    assert keep == {("Order", "old"), ("Date", "old"), ("New", "c")}
    over = {(r["term"], r["definition"]) for r in D.upsert(new, old, "seq", overwrite=True).collect()}
    assert over == {("order", "b"), ("Date", "old"), ("New", "c")}


def test_drop_empty_and_duplicate_names(spark):
    df = spark.createDataFrame([(None, None, None), (1, None, "x")], "`a b` int, b int, `a-b` string")
    out = clean.rename_clean(clean.drop_empty(df))
    assert out.columns == ["a_b", "a_b_2"] and out.count() == 1
    with pytest.raises(ValueError):
        clean.drop_empty(df.where("b = 9"))


def test_coerce_rules(spark):
    rows = [(1, "1", "1.5", "2024/01/02", "x", "null", "TRUE"), (2, "null", "oops", "soon", "y", "", "false"), (3, "3", "2", "", "z", "nan", "true")]
    df = spark.createDataFrame(rows, "k int, a string, b string, c string, d string, e string, f string")
    assert clean.decide_types(df, "k") == {"a": "bigint", "b": "double", "c": "timestamp", "d": "string", "e": "string", "f": "string"}
    out = clean.coerce_types(df, "k").orderBy("k").collect()
    assert [r["a"] for r in out] == [1, None, 3] and [r["b"] for r in out] == [1.5, None, 2.0]
    assert out[0]["c"] == datetime(2024, 1, 2) and out[1]["c"] is None and [r["e"] for r in out] == [None] * 3
    strict = clean.decide_types(df, "k", mode="threshold")
    assert strict["b"] == "string" and strict["a"] == "bigint" and strict["f"] == "boolean"


def test_late_dates_do_not_decide(spark):
    rows = [(i, f"w{i}" if i < 120 else "2024-01-01") for i in range(130)]
    df = spark.createDataFrame(rows, "k int, a string")
    assert clean.decide_types(df, "k", "first_values") == {"a": "string"}
    assert clean.decide_types(df) == clean.decide_types(df, "k") == {"a": "timestamp"}


def test_exact_numbers_and_dotted_names(spark):
    rows = [("9007199254740993", "1e5", "9" * 30, "1"), ("-9223372036854775808", "12.0", "5", "2024-01-02"), ("", "nan", "1", "x")]
    df = spark.createDataFrame(rows, "`a.id` string, b string, c string, `d.d` string")
    assert clean.decide_types(df) == {"a.id": "bigint", "b": "bigint", "c": "double", "d.d": "bigint"}
    out = clean.coerce_types(df).collect()
    assert [r[0] for r in out] == [9007199254740993, -(2**63), None] and [r[1] for r in out] == [100000, 12, None]
    assert out[0][2] == 1e30 and [r[3] for r in out] == [1, None, None]


def test_profile_with_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (2, "a"), (None, "b")], "n int, s string")
    got = {r["column"]: r for r in profile.profile_columns(df, "t").collect()}
    assert (got["n"]["null_count"], got["n"]["distinct_count"], got["n"]["min_value"], got["n"]["avg_value"]) == (1, 2, 1.0, 1.667)
    assert (got["s"]["null_count"], got["s"]["distinct_count"], got["s"]["is_nullable"], got["s"]["min_value"]) == (1, 2, True, None)
    q = profile.quality_scores(df, "t").first()
    assert (float(q["completeness"]), float(q["uniqueness"])) == (75.0, 66.67)


def test_samples_follow_first_seen(spark):
    cells = profile.melt(spark.createDataFrame([(3, "c"), (1, "b"), (2, None), (4, "b"), (5, "a")], "k int, v string"), "t", ["v"], "k")
    assert profile.sample_values(cells, 2).first()["sample_values"] == ["b", "c"]


def test_pii_flags(spark):
    s = spark.createDataFrame([
        ("t", "note", ["call me", "x a@b.co"]), ("t", "n", ["abc", "123"]), ("t", "user_email", []), ("t", "w", ["plain"])],
        "table string, column string, values array<string>")
    flags = {r["column"]: r["pii_flag"] for r in pii.flag_columns_file(s).collect()}
    assert flags == {"note": False, "n": True, "user_email": True, "w": False}
    kinds = {r["column"]: r["pii_type"] for r in pii.flag_columns_model(s).collect()}
    assert kinds == {"note": "email", "n": None, "user_email": "email", "w": None}


HIT = "query int, object_type string, object_id bigint, score double, method string"


def test_merge_does_not_depend_on_order(spark):
    a = spark.createDataFrame([(1, "t", 1, 0.5, "x"), (1, "t", 2, 0.9, "x")], HIT)
    b = spark.createDataFrame([(1, "t", 1, 0.7, "y"), (1, "c", 2, 0.9, "y")], HIT)
    one, two = (sorted(map(tuple, R.merge_results(x, 2).collect())) for x in ([a, b], [b, a]))
    assert one == two and [r[:3] for r in sorted(one, key=lambda r: r[-1])] == [(1, "c", 2), (1, "t", 2)]


def test_threshold_modes(spark):
    a = spark.createDataFrame([(1, "t", i, 1.0 - i / 10, "x") for i in range(6)], HIT)
    assert R.search_threshold([a], 0.75, "inside", 5).count() == R.search_threshold([a], 0.75, "after", 5).count() == 3
    with pytest.raises(ValueError):
        R.search_threshold([a], 0.5, "never")


def test_hybrid_missing_side_is_zero(spark):
    s = spark.createDataFrame([(1, "t", 1, 1.0, "x")], HIT)
    k = spark.createDataFrame([(1, "t", 2, 1.0, "y")], HIT)
    got = {r["object_id"]: r["score"] for r in R.hybrid_fuse(s, k).collect()}
    assert got == {1: 0.7, 2: 0.3}


def test_pages_agree(spark):
    df = spark.range(95).select((F.col("id") % 7).alias("a"), "id")
    page = [tuple(r)[:2] for r in ops.page(df, ["a", "id"], 20, 10).collect()]
    prev = ops.page(df, ["a", "id"], 19, 1).first()
    after = [tuple(r) for r in ops.page_after(df, ["a", "id"], {"a": prev["a"], "id": prev["id"]}, 10).collect()]
    assert page == after and ops.page(df, ["a", "id"], 0, 1).first()["total"] == 95


def test_filters_ignore_what_cannot_be_read(spark):
    df = spark.sql("SELECT 1.0D AS x, 2.0D AS y, TIMESTAMP_NTZ '2024-01-02 00:00:00' AS d, 'a' AS l, 'v' AS s UNION ALL SELECT 0.5D, 9D, TIMESTAMP_NTZ '2024-01-03 00:00:00', 'c', 'w'")
    count = lambda **spec: ops.apply_filters(df, spec).count()
    assert count(x_min="1") == 1 and count(x_max=0.7) == 1 and count(y_max="no") == 2 and count(y_min=None, s="") == 2
    assert count(d_date="2024-01-02T00:00:00Z") == 1 and count(d_date="bad") == 2
    assert count(l_list="a, ,b") == 1 and count(l_list=["c"], s="w") == 1 and count(s="v") == 1
    plan = ops.apply_filters(df, {"y_max": "no"})._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan


def test_settings_and_live_rows(spark):
    log = spark.createDataFrame([(1, 1, {"a": "x", "b": "y"}), (1, 2, {"b": "z"})], "project_id int, at int, settings map<string,string>")
    assert ops.settings_merge(log, "project_id", "settings", ["at"]).first()["settings"] == {"a": "x", "b": "z"}
    acts = spark.createDataFrame([(1, 1, "delete"), (1, 2, "restore"), (2, 1, "delete")], "row_id int, at int, action string")
    assert [r["row_id"] for r in ops.live_rows(acts, "row_id", ["at"]).collect()] == [1]


def test_no_group_collects_more_than_asked(spark):
    """A hot column keeps its first values only, whatever its size."""
    hot = spark.range(20000).select(F.col("id").alias("k"), F.col("id").cast("string").alias("v"))
    top = profile.first_values(profile.melt(hot, "t", ["v"], "k"), 10)
    assert top.count() == 10
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_relationships_of_text_dates_and_exact_numbers(spark):
    big = 2**53
    a = spark.sql(f"SELECT * FROM VALUES ('x', DATE '2024-01-01', {big}L, -0.0D), ('y', DATE '2024-01-02', {big + 1}L, 1D), ('z', DATE '2024-01-09', {big + 2}L, 2D) AS v(code, day, id, num)")
    b = spark.sql(f"SELECT * FROM VALUES ('x', TIMESTAMP_NTZ '2024-01-02 00:00:00', {big + 1}L, 0.0D), ('x', NULL, {big + 1}L, 0.5D) AS v(ref, at, `some.id`, n)")
    got = {(r.child_column, r.parent_column): (r.child_values, r.matched, r.confidence) for r in profile.relationships({"a": a, "b": b}).collect()}
    assert got == {("ref", "code"): (1, 1, 1.0), ("at", "day"): (1, 1, 1.0), ("some.id", "id"): (1, 1, 1.0), ("n", "num"): (2, 1, 0.5)}
    assert profile.relationships({"a": a, "b": b}, 0.9).count() == 3


def shapes_of(rows):
    """Brute force: the three most frequent shapes of every (table, column)."""
    counts = {}
    for table, column, value in rows:
        if value is not None:
            shape = "".join("A" if c.isalpha() else "9" if c in "0123456789" else c for c in value)
            of = counts.setdefault((table, column), Counter())
            of[shape] += 1
    return {(*k, p, n, i + 1) for k, of in counts.items() for i, (p, n) in enumerate(sorted(of.items(), key=lambda x: (-x[1], x[0].encode()))[:3])}


def test_value_patterns_of_long_texts(spark):
    same = "é1 " * 200
    rows = [("t", "a", f"{same}{end}") for end in ("-", "+", "x", "/", "-", "+", "x", "*")] + [("t", "a", None), ("t", "b", "x" * 64), ("t", "b", "y" * 65), ("t", "b", "")]
    got = profile.value_patterns(spark.createDataFrame(rows, "table string, column string, value string"))
    assert {tuple(r) for r in got.select("table", "column", "pattern", "n", "rank").collect()} == shapes_of(rows)


def test_value_patterns_all_reads_documents(spark):
    import __spark_entry__ as entry

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", "lang", "source").collect()
    want = shapes_of([("documents", c, r[c]) for r in docs for c in ("text", "lang", "source")])
    got = entry.queries()["value_patterns_all"](spark, "/root/testdata/sf0.001").where("table = 'documents' AND column IN ('text', 'lang', 'source')")
    assert {tuple(r) for r in got.select("table", "column", "pattern", "n", "rank").collect()} == want
