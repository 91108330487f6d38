"""Personal data: column flags, full row scans, masking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark import rules
from tidemark.functions.scalar import contains_any

PATTERN_SETS = {
    "file": rules.PII_VALUES_FILE,
    "model": rules.PII_VALUES_MODEL,
    "config": rules.PII_VALUES_CONFIG,
}


def name_is_pii(name: Column) -> Column:
    return contains_any(F.lower(name), rules.PII_NAMES_FILE)


def name_pii_type(name: Column) -> Column:
    """First listed keyword inside the name, else null."""
    low = F.lower(name)
    return F.coalesce(*[F.when(F.contains(low, F.lit(k)), F.lit(k)) for k in rules.PII_NAMES_MODEL])


def _starts_known(v: Column) -> Column:
    hit = F.lit(False)
    for p in rules.PII_VALUES_FILE.values():
        hit = hit | v.rlike(f"^(?:{p})")
    return hit


def flag_cells_file(cells: DataFrame) -> DataFrame:
    """Per (table, column): flagged by its name or by any value that starts with a known shape; one pass."""
    hit = F.coalesce(F.bool_or(_starts_known(F.col("value"))), F.lit(False))
    flags = cells.groupBy("table", "column").agg(hit.alias("hit"))
    return flags.select("table", "column", (name_is_pii(F.col("column")) | F.col("hit")).alias("pii_flag"))


def flag_cells_model(cells: DataFrame) -> DataFrame:
    """Per (table, column): name keyword first, then the first listed pattern found in any value; one pass."""
    pats = rules.PII_VALUES_MODEL
    hits = cells.groupBy("table", "column").agg(*[F.bool_or(F.col("value").rlike(p)).alias(f"has_{k}") for k, p in pats.items()])
    kind = F.coalesce(name_pii_type(F.col("column")), *[F.when(F.col(f"has_{k}"), F.lit(k)) for k in pats])
    return hits.select("table", "column", kind.isNotNull().alias("pii_flag"), kind.alias("pii_type"))


def flag_columns_file(samples: DataFrame) -> DataFrame:
    """``samples``: one row per (table, column) with an array of probe values.

    A column is flagged by its name or by a value that starts with a known shape.
    """
    flag = name_is_pii(F.col("column")) | F.exists("values", _starts_known)
    return samples.select("table", "column", flag.alias("pii_flag"))


def flag_columns_model(samples: DataFrame) -> DataFrame:
    """Name keyword first, then value patterns anywhere in a value, in listed order."""
    def found(pattern):
        return F.exists("values", lambda v: v.rlike(pattern))

    by_value = [F.when(found(p), F.lit(k)) for k, p in rules.PII_VALUES_MODEL.items()]
    kind = F.coalesce(name_pii_type(F.col("column")), *by_value)
    return samples.select(
        "table", "column", kind.isNotNull().alias("pii_flag"), kind.alias("pii_type")
    )


def scan_rows(df: DataFrame, text: str, mode: str = "model") -> DataFrame:
    """Add ``<kind>_hits`` (match count) per pattern and ``has_pii`` to every row."""
    pats = PATTERN_SETS[mode]
    counts = {
        f"{k}_hits": F.size(F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0))).cast("bigint")
        for k, p in pats.items()
    }
    out = df.withColumns(counts)
    hit = F.lit(False)
    for c in counts:
        hit = hit | (F.col(c) > 0)
    return out.withColumn("has_pii", hit)


def scan_totals(scanned: DataFrame, mode: str = "model") -> DataFrame:
    """One row per pattern: rows with a match and matches in all."""
    kinds = list(PATTERN_SETS[mode])
    totals = scanned.agg(
        *[F.count_if(F.col(f"{k}_hits") > 0).alias(f"{k}_rows") for k in kinds],
        *[F.coalesce(F.sum(f"{k}_hits"), F.lit(0)).alias(f"{k}_all") for k in kinds],
    )
    rows = F.array(
        *[F.struct(F.lit(k).alias("pii_type"), F.col(f"{k}_rows").alias("rows_hit"),
                   F.col(f"{k}_all").alias("matches")) for k in kinds]
    )
    return totals.select(F.explode(rows).alias("r")).select("r.*")


def mask_values(text, kinds=("credit_card", "ssn", "phone", "email")) -> Column:
    """Replace every match of the given kinds by its kind in brackets."""
    out = F.col(text) if isinstance(text, str) else text
    for k in kinds:
        out = F.regexp_replace(out, rules.PII_VALUES_MODEL[k], f"[{k}]")
    return out
