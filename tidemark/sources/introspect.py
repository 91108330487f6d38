"""Catalog rows from frames, from a session catalog database, or from a JDBC database."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

COLUMN_SCHEMA = ("table string, table_type string, column string, pos bigint, data_type string, is_nullable boolean, "
                 "is_primary_key boolean, is_foreign_key boolean")


def introspect(spark: SparkSession, tables: dict[str, DataFrame], views: set[str] = frozenset(),
               keys: dict[str, list[str]] | None = None, foreign: dict[str, list[str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(tables, columns). Row counts are one unioned aggregate, not one job per table."""
    keys, foreign = keys or {}, foreign or {}
    rows = [
        (name, "view" if name in views else "table", f.name, i, f.dataType.simpleString(), f.nullable,
         f.name in keys.get(name, []), f.name in foreign.get(name, []))
        for name, df in tables.items() for i, f in enumerate(df.schema.fields)
    ]
    columns = spark.createDataFrame(rows, COLUMN_SCHEMA)
    counts = reduce(DataFrame.unionByName, [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table"), "row_count") for n, df in tables.items()])
    shape = columns.groupBy("table", "table_type").agg(F.count(F.lit(1)).alias("column_count"))
    return shape.join(counts, "table"), columns


def introspect_database(spark: SparkSession, database: str | None = None) -> tuple[DataFrame, DataFrame]:
    """As ``introspect`` for all tables and views of a catalog database; unreadable ones are skipped."""
    tables, views = {}, set()
    for t in spark.catalog.listTables(database):
        name = t.name if t.isTemporary else ".".join([*(t.namespace or []), t.name])
        try:
            df = spark.table(name)
            df.schema  # noqa: B018 - analysis fails here when the table is broken
        except Exception:  # noqa: BLE001 - per-table failures are skipped by contract
            continue
        tables[t.name] = df
        if t.tableType in ("VIEW", "TEMPORARY"):
            views.add(t.name)
    return introspect(spark, tables, views)
