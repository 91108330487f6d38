"""Mergeable column states and the catalog that runs along with a stream."""

import random

import pytest

from tidemark.operators import profile, states as S
from tidemark.streaming import catalog as C

SCHEMA = "id int, `a.b` string, empty string, x double, tags array<int>"


def rows_of(n, seed):
    rnd = random.Random(seed)
    # a third of the names are one name
    return [(rnd.randrange(n) if rnd.random() < 0.9 else None, "hot" if rnd.random() < 0.33 else f"n{rnd.randrange(40)}", None,
             rnd.uniform(-5, 5), [rnd.randrange(3)]) for _ in range(n)]


def by_column(df):
    return {r["column"]: r for r in df.collect()}


def test_states_of_parts_merge_to_the_profile_of_all(spark):
    rows = rows_of(900, 1)
    frames = [spark.createDataFrame(rows[i::3], SCHEMA).repartition(4) for i in range(3)]
    a, b, c = (S.column_states(f, "t") for f in frames)
    whole = by_column(profile.profile_columns(spark.createDataFrame(rows, SCHEMA), "t"))
    for merged in (a.unionByName(b).unionByName(c), S.merge_states(c.unionByName(a)).unionByName(b)):
        got = by_column(S.catalog(S.merge_states(merged)))
        assert got.keys() == whole.keys()
        for name, want in whole.items():
            for field in ("dtype", "null_count", "is_nullable", "min_value", "max_value", "avg_value", "business_category"):
                assert got[name][field] == want[field], (name, field)
            assert abs(got[name]["distinct_count"] - want["distinct_count"]) <= 0.05 * want["distinct_count"]
            assert got[name]["rows"] == 900
    names = [r[1] for r in rows]
    assert [(v["value"], v["count"]) for v in got["a.b"]["top_values"]][:1] == [("hot", names.count("hot"))]
    assert [(v["value"], v["count"]) for v in got["a.b"]["top_values"]] == sorted(
        ((n, names.count(n)) for n in set(names)), key=lambda p: (-p[1], p[0]))[:5]
    xs = sorted(r[3] for r in rows)
    assert xs[int(900 * 0.44)] <= got["x"]["median_value"] <= xs[int(900 * 0.56)]
    assert got["empty"]["top_values"] == [] and got["empty"]["distinct_count"] == 0


def test_empty_table_and_long_values(spark):
    none = spark.createDataFrame([], SCHEMA)
    got = by_column(S.catalog(S.column_states(none, "t")))
    assert len(got) == 5 and all((r["rows"], r["distinct_count"], r["min_value"], r["is_nullable"]) == (0, 0, None, False) for r in got.values())
    long = spark.createDataFrame([("x" * 500 + "1",), ("x" * 500 + "2",), ("x" * 500 + "2",), ("",)], "t string")
    got = by_column(S.catalog(S.column_states(long, "t").unionByName(S.column_states(long.limit(0), "t")).transform(S.merge_states)))["t"]
    assert got["distinct_count"] == 3 and [v["count"] for v in got["top_values"]] == [2, 1, 1]
    assert all(len(v["value"]) <= S.SHOWN_LENGTH + 17 for v in got["top_values"])


def test_columns_beyond_one_pass(spark):
    wide = spark.createDataFrame([tuple(range(60))] * 3, ", ".join(f"c{i} int" for i in range(60)))
    got = by_column(S.catalog(S.column_states(wide, "w")))
    assert len(got) == 60 and all(r["rows"] == 3 and r["distinct_count"] == 1 for r in got.values())


def test_stream_adds_each_batch_once(spark, tmp_path):
    inbox, out, cp = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    rows = rows_of(600, 2)
    spark.createDataFrame(rows[:200], SCHEMA).coalesce(1).write.parquet(inbox)
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(inbox)
    assert C.catalog_at(spark, out) is None and C.history(spark, out) is None

    def run():
        C.catalog_stream(source, out, cp, "t").awaitTermination()

    run()
    spark.createDataFrame(rows[200:], SCHEMA).repartition(2).write.mode("append").parquet(inbox)
    run()
    run()  # nothing new
    whole = by_column(profile.profile_columns(spark.createDataFrame(rows, SCHEMA), "t"))
    got = by_column(C.catalog_at(spark, out))
    for name, want in whole.items():
        for field in ("null_count", "min_value", "max_value", "avg_value"):
            assert got[name][field] == pytest.approx(want[field], abs=2e-3) if want[field] is not None else got[name][field] is None
        assert got[name]["rows"] == 600
    assert C.versions(spark, out) == [0, 1, 2]
    first = by_column(C.catalog_at(spark, out, 0))
    assert first["id"]["rows"] == 200
    grown = [r["rows"] for r in C.history(spark, out).where("column = 'id'").orderBy("version").collect()]
    assert grown[0] == 200 and grown[-1] == 600 and grown == sorted(grown)


def test_a_batch_that_runs_again_does_not_count_twice(spark, tmp_path):
    out = str(tmp_path / "out")
    batches = [spark.createDataFrame(rows_of(50, i), SCHEMA) for i in range(2)]
    handlers = []

    class Writer:
        def foreachBatch(self, f):  # noqa: N802
            handlers.append(f)
            return self

        def option(self, *_):
            return self

        def trigger(self, **_):
            return self

        def start(self):
            return None

    class Stream:
        writeStream = Writer()  # noqa: N815

    C.catalog_stream(Stream(), out, "unused", "t")
    for batch, number in ((batches[0], 0), (batches[1], 1), (batches[1], 1), (batches[0].limit(0), 2)):
        handlers[0](batch, number)
    assert {r["rows"] for r in C.catalog_at(spark, out).collect()} == {100}
    assert C.versions(spark, out) == [0, 1]
