"""Profiles of whole tables: statistics, samples, quality, patterns, keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidemark import rules
from tidemark.functions.scalar import first_rule
from tidemark.operators.clean import chunks, is_numeric


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def melt(df: DataFrame, table: str, cols: list[str] | None = None, key: str | None = None) -> DataFrame:
    """One row per cell: table, column, value (text) and, when asked, the row's order key."""
    cols = cols or [c for c in df.columns]
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in cols]
    )
    keep = [F.col(key).cast("bigint").alias("key")] if key else []
    return df.select(F.lit(table).alias("table"), *keep, F.explode(cells).alias("c")).select(
        "table", *(["key"] if key else []), "c.*"
    )


def _explode_stats(stats: DataFrame, rows: list[Column]) -> DataFrame:
    return stats.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


#: text up to this length is its own key, longer text its digest
KEY_LENGTH = 64
#: first characters of a shape that go with its key, to order shapes of equal count; at least KEY_LENGTH
SHAPE_START = 256


def text_key(v: Column) -> Column:
    """What stands for a text where only equality counts, so that long texts are not shuffled."""
    return F.when(F.length(v) > KEY_LENGTH, F.concat(F.lit("#"), F.sha2(v.cast("binary"), 256))).otherwise(F.concat(F.lit("="), v))


def distinct_key(f: T.StructField) -> Column:
    c = F.col(f"`{f.name}`")
    return text_key(c) if isinstance(f.dataType, T.StringType) else c


def profile_columns(df: DataFrame, table: str, exact: bool = True) -> DataFrame:
    """Null and distinct counts, numeric min/max/avg (3 decimals), category: one pass per 50 columns.

    ``exact=False`` swaps the exact distinct counts for HyperLogLog sketches, which need no shuffle
    of values.
    """
    distinct = F.count_distinct if exact else F.approx_count_distinct
    parts = []
    for fields in chunks(df.schema.fields):
        aggs, rows = [F.count(F.lit(1)).alias("_rows")], []
        for f in fields:
            c, q = F.col(f"`{f.name}`"), lambda k, f=f: F.col(f"`{f.name}|{k}`")
            aggs += [F.count(c).alias(f"{f.name}|n"), distinct(distinct_key(f)).alias(f"{f.name}|d")]
            null = F.lit(None).cast("double")
            lo = hi = avg = null
            if is_numeric(f.dataType):
                d = c.cast("double")
                aggs += [F.min(d).alias(f"{f.name}|lo"), F.max(d).alias(f"{f.name}|hi"),
                         F.avg(d).alias(f"{f.name}|avg")]
                lo, hi, avg = (F.round(q(k), 3) for k in ("lo", "hi", "avg"))
            rows.append(F.struct(
                F.lit(table).alias("table"), F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("dtype"),
                (F.col("_rows") - q("n")).alias("null_count"), q("d").alias("distinct_count"),
                (F.col("_rows") > q("n")).alias("is_nullable"),
                lo.alias("min_value"), hi.alias("max_value"), avg.alias("avg_value"),
                F.lit(is_numeric(f.dataType)).alias("_numeric"), F.col("_rows"),
            ))
        parts.append(_explode_stats(df.agg(*aggs), rows))
    category = business_category(F.col("column"), F.col("_numeric"), F.col("distinct_count"), F.col("_rows"))
    return union_all(parts).withColumn("business_category", category).drop("_numeric", "_rows")


def profile_columns_lengths(df: DataFrame, table: str) -> DataFrame:
    """Variant: min and max as text, and for text columns the shortest and longest length."""
    parts = []
    for fields in chunks(df.schema.fields):
        aggs, rows = [F.count(F.lit(1)).alias("_rows")], []
        for f in fields:
            c, q = F.col(f"`{f.name}`"), lambda k, f=f: F.col(f"`{f.name}|{k}`")
            aggs += [F.count(c).alias(f"{f.name}|n"), F.count_distinct(distinct_key(f)).alias(f"{f.name}|d")]
            text = isinstance(f.dataType, T.StringType)
            lo = hi = F.lit(None).cast("string")
            size = F.lit(None).cast("bigint")
            if text or is_numeric(f.dataType):
                m = F.length(c) if text else c
                aggs += [F.min(m).alias(f"{f.name}|lo"), F.max(m).alias(f"{f.name}|hi")]
                lo, hi = q("lo").cast("string"), q("hi").cast("string")
                size = q("hi").cast("bigint") if text else size
            rows.append(F.struct(
                F.lit(table).alias("table"), F.lit(f.name).alias("column"),
                (F.col("_rows") - q("n")).alias("null_count"), q("d").alias("unique_count"),
                lo.alias("min_value"), hi.alias("max_value"), size.alias("max_length"),
            ))
        parts.append(_explode_stats(df.agg(*aggs), rows))
    return union_all(parts)


def business_category(name: Column, numeric: Column, distinct: Column, rows: Column) -> Column:
    low = F.coalesce(F.try_divide(distinct, rows), F.lit(0.0)) < rules.LOW_CARDINALITY
    rest = F.when(numeric & low, "categorical").when(numeric, "measure").otherwise("attribute")
    return F.coalesce(first_rule(F.lower(name), rules.CATEGORY_RULES), rest)


def business_category_by_name(name: Column) -> Column:
    return F.coalesce(first_rule(F.lower(name), rules.CATEGORY_NAME_RULES), F.lit("attribute"))


def first_values(cells: DataFrame, n: int = 10) -> DataFrame:
    """First ``n`` distinct non-null values per column by order key.

    Distinct is decided on short keys; the rank filter lets Spark cut every partition to ``n`` rows per
    column before the shuffle; the texts of those few are then looked up in the cells.
    """
    live = cells.where(F.col("value").isNotNull()).withColumn("is", text_key(F.col("value")))
    seen = live.groupBy("table", "column", "is").agg(F.min("key").alias("key"))
    w = Window.partitionBy("table", "column").orderBy("key", "is")
    top = seen.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    found = live.join(top, ["table", "column", "is", "key"])
    return found.groupBy("table", "column", "rank").agg(F.first("value").alias("value"), F.min("key").alias("key"))


def sample_values(cells: DataFrame, n: int = 10) -> DataFrame:
    top = first_values(cells, n)
    packed = F.array_sort(F.collect_list(F.struct("rank", "value")))
    return top.groupBy("table", "column").agg(
        F.transform(packed, lambda s: s["value"]).alias("sample_values")
    )


def sample_by_hash(cells: DataFrame, n: int = 10) -> DataFrame:
    """Repeatable sample of distinct values: the ``n`` smallest MD5 digests per column."""
    live = cells.where(F.col("value").isNotNull()).select("table", "column", "value", F.md5(F.col("value").cast("binary")).alias("digest"))
    w = Window.partitionBy("table", "column").orderBy("digest")
    top = live.select("table", "column", "digest").distinct().withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    found = live.join(top, ["table", "column", "digest"]).groupBy("table", "column", "rank").agg(F.first("value").alias("value"))
    packed = F.array_sort(F.collect_list(F.struct("rank", "value")))
    return found.groupBy("table", "column").agg(
        F.transform(packed, lambda s: s["value"]).alias("sample_values")
    )


def probe_values(cells: DataFrame, n: int = rules.PII_VALUE_PROBE) -> DataFrame:
    """First ``n`` non-null cells per column by order key, as one bounded array."""
    w = Window.partitionBy("table", "column").orderBy("key")
    live = cells.where(F.col("value").isNotNull())
    top = live.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    names = cells.select("table", "column").distinct()
    probes = top.groupBy("table", "column").agg(F.collect_list("value").alias("values"))
    return names.join(probes, ["table", "column"], "left").withColumn(
        "values", F.coalesce("values", F.array().cast("array<string>"))
    )


def profile_table(df: DataFrame, table: str) -> DataFrame:
    """Row and column counts, schema text, and an estimate of the text bytes held."""
    total = reduce(Column.__add__, [F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in df.columns])
    nulls = [F.count_if(F.col(f"`{c}`").isNull()).alias(f"{c}|null") for c in df.columns]
    stats = df.agg(F.count(F.lit(1)).alias("row_count"), F.sum(total.cast("bigint")).alias("text_bytes"), *nulls)
    schema = F.concat_ws(",", *[
        F.concat(F.lit(f"{f.name}:{f.dataType.simpleString()}:"),
                 F.when(F.col(f"`{f.name}|null`") > 0, "null").otherwise("not null"))
        for f in df.schema.fields
    ])
    return stats.select(
        F.lit(table).alias("table"), "row_count", F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        schema.alias("schema"), "text_bytes",
    )


def quality_scores(df: DataFrame, table: str, valid: dict[str, Column] | None = None) -> DataFrame:
    """Completeness, uniqueness and validity in percent, as decimal(5,2).

    ``valid`` gives a test per column; a column without one counts as valid where it is not null.
    """
    valid = valid or {}
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for c in df.columns:
        ok = valid.get(c, F.col(f"`{c}`").isNotNull())
        aggs += [F.count(F.col(f"`{c}`")).alias(f"{c}|n"), F.count_distinct(distinct_key(df.schema[c])).alias(f"{c}|d"),
                 F.count_if(ok).alias(f"{c}|v")]
    add = lambda k: reduce(Column.__add__, [F.col(f"`{c}|{k}`") for c in df.columns])
    cells, filled = F.col("_rows") * len(df.columns), add("n")
    pct = lambda a, b: F.round(F.try_divide(a * F.lit(100.0), b), 2).cast("decimal(5,2)")
    return df.agg(*aggs).select(
        F.lit(table).alias("table"), pct(filled, cells).alias("completeness"),
        pct(add("d"), filled).alias("uniqueness"), pct(add("v"), filled).alias("validity"),
    )


def value_patterns(cells: DataFrame, top: int = 3) -> DataFrame:
    """Most frequent value shapes (digits as 9, letters as A) per column.

    Shapes are counted by their keys and ordered by their starts; the long ones that may win, with all that tie
    with the last by count and start, are then looked up in the cells.
    """
    shape = F.regexp_replace(F.regexp_replace("value", r"\p{L}", "A"), r"[0-9]", "9")
    live = cells.where(F.col("value").isNotNull()).select("table", "column", shape.alias("pattern")).withColumn("is", text_key(F.col("pattern")))
    counts = live.groupBy("table", "column", "is", F.substring("pattern", 1, SHAPE_START).alias("start")).agg(F.count(F.lit(1)).alias("n"))
    columns = Window.partitionBy("table", "column")
    some = counts.withColumn("place", F.rank().over(columns.orderBy(F.desc("n"), "start"))).where(F.col("place") <= top)
    long = F.col("is").startswith("#")
    found = live.where(long).join(some.where(long).select("table", "column", "is", "n"), ["table", "column", "is"])
    texts = found.groupBy("table", "column", "is", "n").agg(F.min("pattern").alias("pattern")).select("table", "column", "pattern", "n")
    shapes = some.where(~long).select("table", "column", F.col("start").alias("pattern"), "n").unionByName(texts)
    w = columns.orderBy(F.desc("n"), "pattern")
    return shapes.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def key_candidates(profiles: DataFrame, row_counts: DataFrame) -> DataFrame:
    """Columns that are unique and never null."""
    p = profiles.join(row_counts, "table")
    return p.where((F.col("null_count") == 0) & (F.col("distinct_count") == F.col("row_count")) & (F.col("row_count") > 0)).select("table", "column")


def inclusion(child: DataFrame, child_col: str, parent: DataFrame, parent_col: str) -> DataFrame:
    """Share of distinct child values found among the parent values."""
    c = child.select(F.col(child_col).alias("v")).where("v IS NOT NULL").distinct()
    p = parent.select(F.col(parent_col).alias("v")).where("v IS NOT NULL").distinct()
    hit = c.join(p.withColumn("hit", F.lit(1)), "v", "left")
    return hit.agg(F.count(F.lit(1)).alias("child_values"), F.count("hit").alias("matched")).withColumn(
        "confidence", F.round(F.try_divide("matched", "child_values"), 4)
    )


#: what a column's values are compared as: (family, type)
FAMILIES = ("whole", "bigint"), ("number", "double"), ("time", "timestamp_ntz"), ("text", "string")


def family_of(dtype: T.DataType) -> tuple[str, str] | None:
    """Columns are compared within a family: whole numbers, other numbers, times, texts."""
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return FAMILIES[0]
    if is_numeric(dtype):
        return FAMILIES[1]
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return FAMILIES[2]
    return FAMILIES[3] if isinstance(dtype, T.StringType) else None


def column_ranges(df: DataFrame, table: str) -> DataFrame:
    """One row per comparable column: rows, non-null values and the exact smallest and largest one, by family."""
    fields = [(f, family_of(f.dataType)) for f in df.schema.fields if family_of(f.dataType)]
    aggs, rows = [F.count(F.lit(1)).alias("_rows")], []
    for i, (f, (name, kind)) in enumerate(fields):
        c = F.col(f"`{f.name}`").cast(kind)
        aggs += [F.count(c).alias(f"n{i}"), F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}")]
        at = lambda end, i=i, name=name: [
            (F.col(f"{end}{i}") if n == name else F.lit(None)).cast(k).alias(f"{end}_{n}") for n, k in FAMILIES]
        rows.append(F.struct(
            F.lit(table).alias("table"), F.lit(f.name).alias("column"), F.lit(name).alias("family"),
            F.col("_rows").alias("rows"), F.col(f"n{i}").alias("filled"), *at("lo"), *at("hi")))
    return _explode_stats(df.agg(*aggs), rows)


def column_values(df: DataFrame, table: str) -> DataFrame:
    """The distinct values of every comparable column: table, column, family, key. Long texts go as digests."""
    cells = []
    for f in df.schema.fields:
        if family := family_of(f.dataType):
            v = F.col(f"`{f.name}`").cast(family[1])
            v = (v + F.lit(0.0) if family[0] == "number" else v).cast("string")  # -0.0 is 0.0
            key = text_key(v)
            cells.append(F.struct(F.lit(f.name).alias("column"), F.lit(family[0]).alias("family"), key.alias("key")))
    flat = df.select(F.lit(table).alias("table"), F.explode(F.array(*cells)).alias("c")).select("table", "c.*")
    return flat.where("key IS NOT NULL").distinct()


def relationships(tables: dict[str, DataFrame], min_confidence: float = 0.0, folder: str | None = None) -> DataFrame:
    """(child, parent) column pairs where the parent is a key and the child's range lies inside its own.

    All pairs are tested at once: the distinct values of all columns meet by value, once, and a value has at
    most one row a column. Confidence is the share of the child's values found. Nothing is collected; pairs
    and ranges are tables of the size of the schema. ``folder`` keeps the distinct values there, so that they
    are found once for their three uses.
    """
    ranges = union_all([column_ranges(df, n) for n, df in tables.items()])
    values = union_all([column_values(df, n) for n, df in tables.items()])
    if folder:
        values.write.parquet(folder)
        values = values.sparkSession.read.schema(values.schema).parquet(folder)
    counts = values.groupBy("table", "column").agg(F.count(F.lit(1)).alias("distinct"))
    columns = ranges.join(counts, ["table", "column"])
    ends = [f"{end}_{n}" for end in ("lo", "hi") for n, _ in FAMILIES]
    child = columns.select("family", F.col("table").alias("child_table"), F.col("column").alias("child_column"),
                           F.col("distinct").alias("child_values"), *ends)
    keys = columns.where("rows > 0 AND filled = rows AND distinct = rows").select(
        "family", F.col("table").alias("parent_table"), F.col("column").alias("parent_column"), *[F.col(e).alias(f"p_{e}") for e in ends])
    fits = F.lit(False)
    for n, _ in FAMILIES:
        fits = fits | ((F.col(f"lo_{n}") >= F.col(f"p_lo_{n}")) & (F.col(f"hi_{n}") <= F.col(f"p_hi_{n}")))
    other = (F.col("child_table") != F.col("parent_table")) | (F.col("child_column") != F.col("parent_column"))
    names = ["child_table", "child_column", "parent_table", "parent_column"]
    pairs = child.join(keys, "family").where(F.coalesce(fits, F.lit(False)) & other).select(*names, "child_values")
    of_keys = values.withColumnsRenamed({"table": "parent_table", "column": "parent_column"}).join(
        keys.select("parent_table", "parent_column"), ["parent_table", "parent_column"], "left_semi")
    met = values.withColumnsRenamed({"table": "child_table", "column": "child_column"}).join(of_keys, ["family", "key"])
    matched = met.groupBy(*names).agg(F.count(F.lit(1)).alias("matched"))
    out = pairs.join(matched, names, "left").withColumn("matched", F.coalesce("matched", F.lit(0)))
    return out.withColumn("confidence", F.round(F.col("matched") / F.col("child_values"), 4)).where(F.col("confidence") >= min_confidence)


def table_governance(tables: DataFrame, columns: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Column, personal-data, nullable and key counts per table, with embedding counts."""
    per = columns.groupBy("table_id").agg(
        F.count(F.lit(1)).alias("column_count"), F.count_if("pii_flag").alias("pii_columns"),
        F.count_if("is_nullable").alias("nullable_columns"),
        F.count_if("is_primary_key").alias("primary_key_columns"),
    )
    own = embeddings.where("object_type = 'table'").groupBy(F.col("object_id").alias("table_id")).agg(
        F.count(F.lit(1)).alias("table_embeddings"))
    cols = embeddings.where("object_type = 'column'").groupBy(F.col("object_id").alias("column_id")).agg(
        F.count(F.lit(1)).alias("n"))
    by_col = columns.select("column_id", "table_id").join(cols, "column_id").groupBy("table_id").agg(
        F.sum("n").alias("column_embeddings"))
    out = tables.select("table_id", "name").join(per, "table_id", "left").join(own, "table_id", "left").join(
        by_col, "table_id", "left")
    zeros = ["column_count", "pii_columns", "nullable_columns", "primary_key_columns", "table_embeddings", "column_embeddings"]
    out = out.fillna(0, zeros)
    return out.withColumn("total_embeddings", F.col("table_embeddings") + F.col("column_embeddings"))
