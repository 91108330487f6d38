"""Exports and saved indexes: Parquet, CSV or JSON folders plus one metadata row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def export_rows(entries: DataFrame, statuses: list[str] | None = None, categories: list[str] | None = None,
                include_metadata: bool = True) -> DataFrame:
    """Rows to export; without metadata only the term, definition and category stay."""
    out = entries
    if statuses:
        out = out.where(F.col("status").isin(*statuses))
    if categories:
        out = out.where(F.col("category").isin(*categories))
    return out if include_metadata else out.select("term", "definition", "category")


# values keep their outer spaces; quotes are doubled
CSV_OPTIONS = {"header": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "escape": '"'}


def _flat(df: DataFrame) -> DataFrame:
    """CSV has no nested types: arrays, maps and structs become JSON text."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[
        F.to_json(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def export(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Parallel write, one file per task."""
    out = _flat(df) if fmt == "csv" else df
    out.write.mode("errorifexists").format(fmt).options(**(CSV_OPTIONS if fmt == "csv" else {})).save(path)


def export_project(tables: dict[str, DataFrame], path: str, project_id: int, key: str = "project_id") -> None:
    """One JSON folder per catalog table, cut to the project where the table carries it."""
    for name, df in tables.items():
        scoped = df.where(F.col(key) == project_id) if key in df.columns else df
        export(scoped, f"{path}/{name}", "json")


def save_index(parts: dict[str, DataFrame | Callable[[dict[str, DataFrame]], DataFrame]], path: str, meta: dict[str, str]) -> None:
    """Index parts as Parquet below ``path``; the metadata row goes last and marks it complete.

    A part may be a function of the parts before it, as they were saved.
    """
    saved: dict[str, DataFrame] = {}
    for name, part in parts.items():
        df = part(saved) if callable(part) else part
        spark = df.sparkSession
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
        saved[name] = spark.read.schema(df.schema).parquet(f"{path}/{name}")
    row = {**meta, "parts": ",".join(sorted(parts))}
    schema = ", ".join(f"{k} string" for k in row)
    spark.createDataFrame([tuple(str(v) for v in row.values())], schema).coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def load_index(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict[str, str]]:
    meta = spark.read.json(f"{path}/metadata").first().asDict()
    return {p: spark.read.parquet(f"{path}/{p}") for p in meta["parts"].split(",")}, meta
