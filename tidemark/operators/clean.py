"""Table clean-up and type decisions.

``drop_empty`` and ``coerce_types`` look at the data once to decide, then add only lazy selects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark import rules
from tidemark.functions import scalar as S

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
COLUMNS_PER_PASS = 50


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, NUMERIC)


def chunks(items: list, n: int = COLUMNS_PER_PASS):
    return [items[i : i + n] for i in range(0, len(items), n)]


def rename_clean(df: DataFrame, cleaner=S.clean_column_name) -> DataFrame:
    """Rename every column in one select; a repeated clean name gets ``_2``, ``_3``, ..."""
    spark = df.sparkSession
    row = spark.range(1).select(*[cleaner(F.lit(c)).alias(str(i)) for i, c in enumerate(df.columns)])
    names = list(row.first()) if df.columns else []
    taken: set[str] = set()
    out = []
    for name in names:
        final, n = name, 1
        while final.lower() in taken:
            n += 1
            final = f"{name}_{n}"
        taken.add(final.lower())
        out.append(final)
    return df.toDF(*out)


def drop_empty(df: DataFrame) -> DataFrame:
    """Drop all-null rows, then all-null columns; an empty outcome is an error."""
    kept = df.dropna("all")
    counts: dict[str, int] = {}
    for cols in chunks(df.columns):
        counts.update(kept.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in cols]).first().asDict())
    live = [c for c in df.columns if counts[c] > 0]
    if not live:
        raise ValueError("no data left after dropping empty rows and columns")
    return kept.select(*[F.col(f"`{c}`") for c in live])


def null_tokens(c: Column, tokens=rules.COERCE_NULL_TOKENS) -> Column:
    return F.when(~c.isin(*tokens), c)


def number_or_null(c: Column) -> Column:
    return F.when(c.rlike(rules.NUMBER), F.trim(c).try_cast("double"))


def datetime_or_null(c: Column) -> Column:
    return F.replace(F.trim(c), F.lit("/"), F.lit("-")).try_cast("timestamp_ntz")


def bigint_or_null(c: Column) -> Column:
    """A whole number exactly, also one written as 12.0 or 1e5; never by way of a double."""
    text = F.trim(c)
    whole = F.coalesce(text.try_cast("bigint"), text.try_cast("decimal(38,6)").try_cast("bigint"))
    return F.when(c.rlike(rules.NUMBER), whole)


def _date_hints(df: DataFrame, cols: list[str], order_key: str) -> dict[str, bool]:
    """Does any of the first 100 non-null values (by ``order_key``) look like a date?"""
    if not cols:
        return {}
    parts = []
    for c in cols:
        v = null_tokens(F.col(f"`{c}`"))
        head = df.where(v.isNotNull()).orderBy(order_key).limit(100)
        parts.append(
            head.agg(F.max(v.rlike(rules.DATE_HINT)).alias("hit")).select(F.lit(c).alias("c"), "hit")
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return {r["c"]: bool(r["hit"]) for r in out.collect()}


def decide_types(df: DataFrame, order_key: str | None = None, mode: str = "any") -> dict[str, str]:
    """Target type per text column: bigint, double, timestamp, boolean or string.

    ``any``: one numeric value makes a column numeric, else one that looks like a date makes it a
    timestamp. ``first_values``: the same, but only the first 100 values by ``order_key`` may show the
    date. ``threshold``: the configured shares of non-null values must fit. All values decide, but for
    that; whole numbers that fit no bigint make a double.
    """
    if mode == "first_values" and order_key is None:
        raise ValueError("first_values needs an order_key")
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    stats: dict[str, int] = {}
    for cols in chunks(text):
        aggs = []
        for c in cols:
            v = null_tokens(F.col(f"`{c}`"))
            num = number_or_null(v)
            aggs += [
                F.count(v).alias(f"{c}|n"),
                F.count(num).alias(f"{c}|num"),
                F.count_if(num.isNotNull() & ((num != F.floor(num)) | bigint_or_null(v).isNull())).alias(f"{c}|frac"),
                F.max(v.rlike(rules.DATE_HINT)).alias(f"{c}|hint"),
                F.count(datetime_or_null(v)).alias(f"{c}|dt"),
                F.count_if(F.lower(v).isin("true", "false")).alias(f"{c}|bool"),
            ]
        stats.update(df.agg(*aggs).first().asDict())
    out = {}
    undecided = []
    for c in text:
        n, num, frac, dt, flag = (stats[f"{c}|{k}"] for k in ("n", "num", "frac", "dt", "bool"))
        numeric = "double" if frac else "bigint"
        if mode == "threshold":
            if n and flag / n >= rules.BOOLEAN_SHARE:
                out[c] = "boolean"
            elif n and num / n >= rules.NUMERIC_SHARE:
                out[c] = numeric
            elif n and dt / n >= rules.DATETIME_SHARE:
                out[c] = "timestamp"
            else:
                out[c] = "string"
        elif num:
            out[c] = numeric
        else:
            out[c] = "timestamp" if mode == "any" and dt and stats[f"{c}|hint"] else "string"
            if dt:
                undecided.append(c)
    if mode == "first_values":
        for c, hit in _date_hints(df, undecided, order_key).items():
            if hit:
                out[c] = "timestamp"
    return out


def apply_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """One select: null tokens to null, then the decided type; what does not fit becomes null."""

    def convert(c: str) -> Column:
        v = null_tokens(F.col(f"`{c}`"))
        kind = types[c]
        if kind == "bigint":
            return bigint_or_null(v).alias(c)
        if kind == "double":
            return number_or_null(v).alias(c)
        if kind == "timestamp":
            return datetime_or_null(v).alias(c)
        if kind == "boolean":
            return F.lower(v).try_cast("boolean").alias(c)
        return v.alias(c)

    return df.select(*[convert(c) if c in types else F.col(f"`{c}`") for c in df.columns])


def coerce_types(df: DataFrame, order_key: str | None = None, mode: str = "any") -> DataFrame:
    return apply_types(df, decide_types(df, order_key, mode))


def _plain_label(dtype: T.DataType, timestamp: str) -> str | None:
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "FLOAT"
    if is_numeric(dtype):
        return "INTEGER"
    if isinstance(dtype, T.BooleanType):
        return "BOOLEAN"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return timestamp
    return None


def sql_types_file(df: DataFrame, table: str) -> DataFrame:
    """(table, column, sql_type): VARCHAR, or TEXT when any value is longer than 255."""
    longest = df.agg(*[F.max(F.length(F.col(f"`{f.name}`").cast("string"))).alias(f.name)
                       for f in df.schema.fields])
    rows = []
    for f in df.schema.fields:
        label = _plain_label(f.dataType, "DATETIME")
        c = F.lit(label) if label else F.when(F.col(f"`{f.name}`") > 255, "TEXT").otherwise("VARCHAR")
        rows.append(F.struct(F.lit(table).alias("table"), F.lit(f.name).alias("column"), c.alias("sql_type")))
    return longest.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def sql_types_model(df: DataFrame, table: str) -> DataFrame:
    """As above, but text that is all numeric is FLOAT and all dates TIMESTAMP; VARCHAR(n) else."""
    aggs, rows = [F.lit(1).alias("_one")], []
    for f in df.schema.fields:
        label = _plain_label(f.dataType, "TIMESTAMP")
        if label:
            c = F.lit(label)
        else:
            v = F.col(f"`{f.name}`").cast("string")
            ok = lambda x: F.coalesce(F.bool_and(F.when(v.isNotNull(), x.isNotNull())), F.lit(True))  # noqa: E731,B023
            aggs += [
                ok(number_or_null(v)).alias(f"{f.name}|num"),
                ok(datetime_or_null(v)).alias(f"{f.name}|dt"),
                F.max(F.length(v)).alias(f"{f.name}|len"),
            ]
            size = F.col(f"`{f.name}|len`")
            c = (
                F.when(F.col(f"`{f.name}|num`"), "FLOAT")
                .when(F.col(f"`{f.name}|dt`"), "TIMESTAMP")
                .when(size > 255, "TEXT")
                .otherwise(F.concat(F.lit("VARCHAR("), F.coalesce(F.nullif(size, F.lit(0)), F.lit(255)).cast("string"), F.lit(")")))
            )
        rows.append(F.struct(F.lit(table).alias("table"), F.lit(f.name).alias("column"), c.alias("sql_type")))
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
