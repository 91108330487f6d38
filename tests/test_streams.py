"""Rate limit against a plain simulation, streams against their batch forms, ingest reruns."""

import random
from collections import deque
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import ingest, rate_limit as RL, search_log as SL

START = datetime(2024, 1, 1)


def calls(seed, n=600, users=4):
    rng = random.Random(seed)
    rows, clock = [], {u: START for u in range(users)}
    for i in range(n):
        u = 0 if rng.random() < 0.5 else rng.randrange(users)  # one busy user
        clock[u] += timedelta(seconds=rng.choice([0, 1, 3, 7, 7, 40, 200]))
        rows.append((i, u, clock[u]))
    rng.shuffle(rows)
    return rows


def simulate(rows, n, period):
    out, held = {}, {}
    for i, u, ts in sorted(rows, key=lambda r: (r[2], r[0])):
        q = held.setdefault(u, deque())
        while q and (ts - q[0]).total_seconds() >= period:
            q.popleft()
        out[i] = len(q) < n
        if out[i]:
            q.append(ts)
    return out


SCHEMA = "event_id bigint, user_id bigint, ts timestamp_ntz"


@pytest.mark.parametrize("preset", [(3, 60), (1, 7), (10, 60)])
def test_rate_limit_batch(spark, preset):
    rows = calls(1)
    got = RL.rate_limit(spark.createDataFrame(rows, SCHEMA).repartition(3), preset).collect()
    assert {r["event_id"]: r["accepted"] for r in got} == simulate(rows, *preset)


def test_rejected_calls_are_not_counted(spark):
    rows = [(i, 1, START + timedelta(seconds=s)) for i, s in enumerate([0, 30, 59, 60, 61, 119, 120])]
    got = {r["event_id"]: r["accepted"] for r in RL.rate_limit(spark.createDataFrame(rows, SCHEMA), (1, 60)).collect()}
    assert got == {0: True, 1: False, 2: False, 3: True, 4: False, 5: False, 6: True}


def test_rate_limit_stream(spark, tmp_path):
    rows = sorted(calls(2), key=lambda r: (r[2], r[0]))
    third = len(rows) // 3
    for k in range(3):  # three files in time order, one per micro-batch
        spark.createDataFrame(rows[k * third:(k + 1) * third], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = (RL.rate_limit_stream(src, (3, 60), late="1 day").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
         .trigger(availableNow=True).start(str(tmp_path / "out")))
    q.awaitTermination()
    got = {r["event_id"]: r["accepted"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == simulate(rows[: 3 * third], 3, 60)


def test_late_rows_are_dropped(spark, tmp_path):
    schema = "query_type string, search_time_ms double, created_at timestamp_ntz"
    (tmp_path / "in").mkdir()
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    day = timedelta(days=1)

    def put(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        q = (SL.log_windows_stream(src).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
             .outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out")))
        q.awaitTermination()

    put([("a", 1.0, START), ("a", 3.0, START + timedelta(hours=2)), ("a", 5.0, START + 3 * day)])
    run()
    put([("a", 100.0, START), ("a", 7.0, START + 9 * day)])  # the first is too late
    run()
    got = {r["window_start"].replace(tzinfo=None): (r["searches"], r["avg_ms"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {START: (2, 2.0), START + 3 * day: (1, 5.0)}


def test_ingest_takes_each_file_once(spark, tmp_path):
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    (inbox / "a.csv").write_text("id,full name\n1,ann\n2,\n")
    src = spark.readStream.schema("id string, `full name` string").option("header", True).csv(str(inbox))
    types = {"id": "bigint", "full_name": "string"}

    def run():
        ingest.ingest_stream(src, out, str(tmp_path / "cp"), "people", "full_name", "id", types).awaitTermination()

    run()
    (inbox / "b.csv").write_text("id,full name\n2,bob\n3,cy\n")
    run()
    run()
    rows = spark.read.parquet(f"{out}/rows").select("id", "full_name").collect()
    assert sorted((r[0], r[1]) for r in rows if r[1]) == [(1, "ann"), (2, "bob"), (3, "cy")]
    assert sorted(r[0] for r in spark.read.parquet(f"{out}/vectors").select("object_id").collect()) == [1, 2, 3]
    assert spark.read.parquet(f"{out}/profiles").where(F.col("column") == "id").count() == 2


@pytest.mark.parametrize("key", ["rate_limit_stream", "search_log_stream", "incremental_ingest"])
def test_a_folder_of_parts_gives_the_rows_of_a_file(spark, tmp_path, key):
    from tidemark.plans import load_all
    from tidemark.plans.registry import BASE_TABLES, QUERIES

    load_all()
    sf = "/root/testdata/sf0.001"
    for name in BASE_TABLES:
        if name in ("events", "customer"):
            spark.read.parquet(f"{sf}/{name}.parquet").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
        else:
            (tmp_path / f"{name}.parquet").symlink_to(f"{sf}/{name}.parquet")
    rows = lambda folder: sorted(map(str, QUERIES[key](spark, str(folder)).collect()))
    want = rows(sf)
    assert want and rows(tmp_path) == want
