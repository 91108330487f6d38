"""Every registered query against its oracle SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest
from check import rows_of

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("key", list(ORACLES))
def test_matches_oracle(spark, con, key):
    df = QUERIES[key](spark, SF)
    cur = con.execute(ORACLES[key])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, cur.fetchall())


@pytest.mark.parametrize("key", [k for k in QUERIES if k not in ORACLES])
def test_runs(spark, key):
    df = QUERIES[key](spark, SF)
    assert df.columns and df.count() > 0


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
