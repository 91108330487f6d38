"""Clean-up, typing, profiles and personal data."""

from pyspark.sql import functions as F

from tidemark import rules
from tidemark.functions import scalar as S
from tidemark.operators import clean, pii, profile
from tidemark.plans.registry import query
from tidemark.sources.scratch import scratch_dir

# order key and columns per profiled table, with the dtype the profile reports
STAR = {
    "customer": ("c_custkey", {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int",
                               "c_acctbal": "double", "c_mktsegment": "string"}),
    "supplier": ("s_suppkey", {"s_suppkey": "bigint", "s_name": "string", "s_nationkey": "int",
                               "s_acctbal": "double"}),
    "part": ("p_partkey", {"p_partkey": "bigint", "p_name": "string", "p_brand": "string",
                           "p_type": "string", "p_size": "int", "p_retailprice": "double"}),
    "orders": ("o_orderkey", {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string",
                              "o_totalprice": "double", "o_orderdate": "timestamp_ntz",
                              "o_orderpriority": "string"}),
    "events": ("event_id", {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint",
                            "event_type": "string", "value": "double", "props": "string"}),
    "documents": ("doc_id", {"doc_id": "bigint", "text": "string", "lang": "string",
                             "source": "string", "n_chars": "bigint"}),
}
NUMERIC = ("bigint", "int", "double")


def each(t, fn, tables=None):
    return profile.union_all([fn(getattr(t, name), name) for name in tables or STAR])


def cells(t, tables):
    return each(t, lambda df, n: profile.melt(df, n, key=STAR[n][0]), tables)


def union_sql(make, tables=None) -> str:
    """UNION ALL of ``make(table, column, dtype, key)`` over all columns of the tables."""
    return "\nUNION ALL ".join(
        make(n, c, d, STAR[n][0]) for n in tables or STAR for c, d in STAR[n][1].items()
    )


def rule_sql(col: str, rule_list, rest: str) -> str:
    whens = " ".join(
        "WHEN " + " OR ".join(f"contains({col}, '{w}')" for w in words) + f" THEN '{name}'"
        for name, words in rule_list
    )
    return f"CASE {whens} ELSE {rest} END"


# --- clean-up -----------------------------------------------------------------------------
HOLES = """
    SELECT CASE WHEN o_orderkey % 10 <> 0 THEN o_orderkey END AS a,
           CASE WHEN o_orderkey % 20 > 5 THEN o_orderstatus END AS b,
           CASE WHEN o_orderkey < 0 THEN o_orderpriority END AS c
    FROM {orders}"""


@query(
    "drop_empty",
    f"""WITH h AS ({HOLES.replace('{orders}', 'orders')})
        SELECT a, b FROM h WHERE a IS NOT NULL OR b IS NOT NULL OR c IS NOT NULL""",
)
def drop_empty(t):
    return clean.drop_empty(t.sql(HOLES))


RAW_TEXT = """
    SELECT event_id,
           CASE WHEN event_id % 11 = 0 THEN 'null' ELSE cast(user_id AS varchar(20)) END AS id_text,
           CASE WHEN event_id % 13 = 0 THEN 'oops' WHEN event_id % 17 = 0 THEN ''
                ELSE cast(value AS varchar(20)) END AS value_text,
           CASE WHEN event_id % 7 = 0 THEN 'None' WHEN event_id % 101 = 0 THEN 'soon'
                ELSE substr(cast(ts AS varchar(40)), 1, 10) END AS day_text,
           event_type AS kind_text
    FROM {events}"""
_NULLS = "('', 'null', 'NULL', 'None', 'NaN', 'nan')"


@query(
    "coerce_types",
    f"""WITH r AS ({RAW_TEXT.replace('{events}', 'events')})
        SELECT event_id, try_cast(id_text AS BIGINT) AS id_text, try_cast(value_text AS DOUBLE) AS value_text,
               CASE WHEN day_text NOT IN {_NULLS} THEN try_cast(day_text AS TIMESTAMP) END AS day_text, kind_text FROM r""",
)
def coerce_types(t):
    return clean.coerce_types(t.sql(RAW_TEXT))


@query(
    "coerce_types_threshold",
    f"""WITH r AS ({RAW_TEXT.replace('{events}', 'events')})
        SELECT event_id, try_cast(id_text AS BIGINT) AS id_text, try_cast(value_text AS DOUBLE) AS value_text,
               CASE WHEN day_text NOT IN {_NULLS} THEN try_cast(day_text AS TIMESTAMP) END AS day_text, kind_text FROM r""",
)
def coerce_types_threshold(t):
    return clean.coerce_types(t.sql(RAW_TEXT), mode="threshold")


def _label_sql(d, stamp):
    return {"bigint": "'INTEGER'", "int": "'INTEGER'", "double": "'FLOAT'", "timestamp_ntz": f"'{stamp}'"}.get(d)


@query(
    "sql_type_file",
    union_sql(lambda n, c, d, k: f"""SELECT '{n}' AS "table", '{c}' AS "column",
        {f"max({_label_sql(d, 'DATETIME')})" if _label_sql(d, '') else f"CASE WHEN max(length({c})) > 255 THEN 'TEXT' ELSE 'VARCHAR' END"} AS sql_type FROM {n}"""),
)
def sql_type_file(t):
    return each(t, clean.sql_types_file)


def _strict_sql(n, c, d):
    fixed = _label_sql(d, "TIMESTAMP")
    if fixed:
        return f"""SELECT '{n}' AS "table", '{c}' AS "column", {fixed} AS sql_type FROM {n} LIMIT 1"""
    return f"""SELECT '{n}' AS "table", '{c}' AS "column",
        CASE WHEN coalesce(bool_and(regexp_matches({c}, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)$')), true) THEN 'FLOAT'
             WHEN bool_and(try_cast({c} AS TIMESTAMP) IS NOT NULL) THEN 'TIMESTAMP'
             WHEN max(length({c})) > 255 THEN 'TEXT' ELSE 'VARCHAR(' || max(length({c})) || ')' END AS sql_type FROM {n}"""


_ROUGH = """
    SELECT cast(o_custkey AS varchar(20)) AS digits, substr(cast(o_orderdate AS varchar(40)), 1, 10) AS days,
           o_orderpriority AS words
    FROM {orders}"""


@query(
    "sql_type_model",
    "\nUNION ALL ".join(
        f"(SELECT * FROM ({_strict_sql(n, c, d)}))" for n in ("customer", "part", "documents") for c, d in STAR[n][1].items()
    )
    + "\nUNION ALL "
    + "\nUNION ALL ".join(
        _strict_sql("rough", c, "string").replace("FROM rough", f"FROM ({_ROUGH.replace('{orders}', 'orders')})")
        for c in ("digits", "days", "words")
    ),
)
def sql_type_model(t):
    star = each(t, clean.sql_types_model, ["customer", "part", "documents"])
    return star.unionByName(clean.sql_types_model(t.sql(_ROUGH), "rough"))


# --- profiles -----------------------------------------------------------------------------
def _profile_sql(n, c, d, k):
    num = d in NUMERIC
    stat = lambda f: f"round({f}({c}::DOUBLE), 3)" if num else "NULL::DOUBLE"
    ratio = f"count(DISTINCT {c})::DOUBLE / count(*)"
    rest = f"CASE WHEN {ratio} < 0.1 THEN 'categorical' ELSE 'measure' END" if num else "'attribute'"
    return f"""SELECT '{n}' AS "table", '{c}' AS "column", '{d}' AS dtype, count(*) - count({c}) AS null_count,
        count(DISTINCT {c}) AS distinct_count, count(*) > count({c}) AS is_nullable, {stat('min')} AS min_value,
        {stat('max')} AS max_value, {stat('avg')} AS avg_value,
        {rule_sql(f"'{c}'", rules.CATEGORY_RULES, rest)} AS business_category FROM {n}"""


@query("profile_columns", union_sql(_profile_sql))
def profile_columns(t):
    return each(t, profile.profile_columns)


def _lengths_sql(n, c, d, k):
    m = f"length({c})" if d == "string" else c
    some = d in NUMERIC or d == "string"
    lo, hi = (f"min({m})::VARCHAR", f"max({m})::VARCHAR") if some else ("NULL", "NULL")
    size = f"max({m})::BIGINT" if d == "string" else "NULL::BIGINT"
    return f"""SELECT '{n}' AS "table", '{c}' AS "column", count(*) - count({c}) AS null_count,
        count(DISTINCT {c}) AS unique_count, {lo} AS min_value, {hi} AS max_value, {size} AS max_length FROM {n}"""


@query("profile_columns_lengths", union_sql(_lengths_sql))
def profile_columns_lengths(t):
    return each(t, profile.profile_columns_lengths)


SAMPLED = ["customer", "supplier", "part", "orders", "events", "documents"]
PATTERNED = SAMPLED[:-1]
_CELLS = lambda tables: union_sql(
    lambda n, c, d, k: f"""SELECT '{n}' AS "table", '{c}' AS "column", {k} AS key, {c}::VARCHAR AS value FROM {n}""", tables)


@query(
    "sample_values",
    f"""WITH c AS ({_CELLS(SAMPLED)}),
         s AS (SELECT "table", "column", value, min(key) AS key FROM c WHERE value IS NOT NULL GROUP BY ALL),
         r AS (SELECT *, row_number() OVER (PARTITION BY "table", "column" ORDER BY key, value) AS rn FROM s)
        SELECT "table", "column", string_agg(value, '|' ORDER BY rn) AS samples FROM r WHERE rn <= 10 GROUP BY ALL""",
)
def sample_values(t):
    return profile.sample_values(cells(t, SAMPLED)).select(
        "table", "column", F.array_join("sample_values", "|").alias("samples"))


@query(
    "sample_by_hash",
    f"""WITH c AS ({_CELLS(SAMPLED)}),
         s AS (SELECT DISTINCT "table", "column", value FROM c WHERE value IS NOT NULL),
         r AS (SELECT *, row_number() OVER (PARTITION BY "table", "column" ORDER BY md5(value), value) AS rn FROM s)
        SELECT "table", "column", string_agg(value, '|' ORDER BY rn) AS samples FROM r WHERE rn <= 10 GROUP BY ALL""",
)
def sample_by_hash(t):
    return profile.sample_by_hash(cells(t, SAMPLED)).select(
        "table", "column", F.array_join("sample_values", "|").alias("samples"))


@query(
    "profile_table",
    "\nUNION ALL ".join(
        f"""SELECT '{n}' AS "table", count(*) AS row_count, {len(cols)}::BIGINT AS column_count,
            concat_ws(',', {", ".join(f"'{c}:{d}:' || CASE WHEN count(*) > count({c}) THEN 'null' ELSE 'not null' END" for c, d in cols.items())}) AS schema,
            sum({" + ".join(f"coalesce(strlen({c}::VARCHAR), 0)" for c in cols)})::BIGINT AS text_bytes FROM {n}"""
        for n, (k, cols) in STAR.items()),
)
def profile_table(t):
    return each(t, profile.profile_table)


def _quality_sql(n, cols):
    filled = " + ".join(f"count({c})" for c in cols)
    distinct = " + ".join(f"count(DISTINCT {c})" for c in cols)
    valid = " + ".join(
        f"count(*) FILTER ({VALID_SQL[c]})" if c in VALID_SQL else f"count({c})" for c in cols)
    return f"""SELECT '{n}' AS "table", round(100.0::DOUBLE * ({filled}) / (count(*) * {len(cols)}), 2)::DECIMAL(5,2) AS completeness,
        round(100.0::DOUBLE * ({distinct}) / ({filled}), 2)::DECIMAL(5,2) AS uniqueness,
        round(100.0::DOUBLE * ({valid}) / ({filled}), 2)::DECIMAL(5,2) AS validity FROM {n}"""


VALID_SQL = {"c_acctbal": "c_acctbal >= 1000", "props": "json_valid(props)", "o_orderstatus": "o_orderstatus IN ('O', 'F')"}


@query("quality_scores", "\nUNION ALL ".join(_quality_sql(n, cols) for n, (k, cols) in STAR.items()))
def quality_scores(t):
    valid = {
        "c_acctbal": F.col("c_acctbal") >= 1000,
        "props": F.try_parse_json("props").isNotNull(),
        "o_orderstatus": F.col("o_orderstatus").isin("O", "F"),
    }
    return each(t, lambda df, n: profile.quality_scores(df, n, {c: v for c, v in valid.items() if c in df.columns}))


def _starts(v):
    return " OR ".join(f"regexp_matches({v}, '^(?:{p})')" for p in rules.PII_VALUES_FILE.values())


_NAMED = " OR ".join(f"contains(\"column\", '{w}')" for w in rules.PII_NAMES_FILE)


@query(
    "pii_columns_file",
    f"""WITH c AS ({_CELLS(None)})
        SELECT "table", "column", bool_or({_NAMED} OR (value IS NOT NULL AND ({_starts('value')}))) AS pii_flag FROM c GROUP BY ALL""",
)
def pii_columns_file(t):
    return pii.flag_cells_file(cells(t, list(STAR)))


@query(
    "pii_columns_file_probe",
    f"""WITH c AS ({_CELLS(None)}),
         r AS (SELECT *, row_number() OVER (PARTITION BY "table", "column" ORDER BY key) AS rn FROM c WHERE value IS NOT NULL)
        SELECT "table", "column", bool_or({_NAMED}
            OR ({_starts('value')})) AS pii_flag FROM r WHERE rn <= 50 GROUP BY ALL""",
)
def pii_columns_file_probe(t):
    return pii.flag_columns_file(profile.probe_values(cells(t, list(STAR))))


_MODEL_VALUE = [f"WHEN bool_or(regexp_matches(value, '{p}')) THEN '{k}'" for k, p in rules.PII_VALUES_MODEL.items()]
_MODEL_NAME = [f"WHEN contains(\"column\", '{k}') THEN '{k}'" for k in rules.PII_NAMES_MODEL]
_LABELLED = """
    SELECT event_id AS key, name, concat(event_type, ' ', CASE column_id % 12
        WHEN 0 THEN concat('mail ', event_type, '@example.com') WHEN 1 THEN '555-123-4567'
        WHEN 2 THEN '123-45-6789' WHEN 3 THEN '4111 1111 1111 1111' ELSE 'plain' END) AS value
    FROM (SELECT column_id, name, column_id AS event_id, split_part(name, '_', 1) AS event_type FROM {cat_columns})"""


@query(
    "pii_columns_model",
    f"""WITH l AS ({_LABELLED.replace('{cat_columns}', 'cat_columns')}),
         d AS (SELECT name AS "column", CASE {" ".join(_MODEL_NAME).replace('contains("column"', 'contains(name')} {" ".join(_MODEL_VALUE)} END AS pii_type FROM l GROUP BY name)
        SELECT 'labelled' AS "table", "column", pii_type IS NOT NULL AS pii_flag, pii_type FROM d""",
)
def pii_columns_model(t):
    return pii.flag_cells_model(t.sql(_LABELLED).select(F.lit("labelled").alias("table"), F.col("name").alias("column"), "key", "value"))


@query(
    "pii_columns_model_probe",
    f"""WITH l AS ({_LABELLED.replace('{cat_columns}', 'cat_columns')}),
         r AS (SELECT name AS "column", value, row_number() OVER (PARTITION BY name ORDER BY key) AS rn FROM l),
         d AS (SELECT "column", CASE {" ".join(_MODEL_NAME)} {" ".join(_MODEL_VALUE)} END AS pii_type
               FROM r WHERE rn <= 10 GROUP BY "column")
        SELECT 'labelled' AS "table", "column", pii_type IS NOT NULL AS pii_flag, pii_type FROM d""",
)
def pii_columns_model_probe(t):
    rows = t.sql(_LABELLED).select(F.lit("labelled").alias("table"), F.col("name").alias("column"), "key", "value")
    return pii.flag_columns_model(profile.probe_values(rows, 10))


def _hits(p):
    return f"len(regexp_extract_all(text, '{p}'))::BIGINT"


def _scan_sql(pats):
    cols = ", ".join(f"{_hits(p)} AS {k}_hits" for k, p in pats.items())
    any_hit = " OR ".join(f"{k}_hits > 0" for k in pats)
    return f"SELECT *, ({any_hit}) AS has_pii FROM (SELECT doc_id, {cols} FROM documents)"


@query("pii_scan_rows", _scan_sql(rules.PII_VALUES_MODEL))
def pii_scan_rows(t):
    return pii.scan_rows(t.spread("documents", "doc_id", "text"), "text").drop("text")


@query(
    "pii_scan_totals",
    f"WITH s AS ({_scan_sql(rules.PII_VALUES_CONFIG)}) "
    + " UNION ALL ".join(
        f"SELECT '{k}' AS pii_type, count(*) FILTER ({k}_hits > 0) AS rows_hit, sum({k}_hits)::BIGINT AS matches FROM s"
        for k in rules.PII_VALUES_CONFIG),
)
def pii_scan_totals(t):
    scanned = pii.scan_rows(t.spread("documents", "doc_id", "text"), "text", mode="config")
    return pii.scan_totals(scanned, mode="config")


@query(
    "business_category",
    "SELECT \"table\", \"column\", business_category, count(*) OVER (PARTITION BY business_category) AS peers FROM ("
    + union_sql(_profile_sql) + ")",
)
def business_category(t):
    from pyspark.sql import Window

    p = each(t, profile.profile_columns)
    peers = F.count(F.lit(1)).over(Window.partitionBy("business_category"))
    return p.select("table", "column", "business_category", peers.alias("peers"))


@query(
    "business_category_name",
    f"SELECT column_id, {rule_sql('lower(name)', rules.CATEGORY_NAME_RULES, chr(39) + 'attribute' + chr(39))} AS category FROM cat_columns",
)
def business_category_name(t):
    return t.cat_columns.select("column_id", profile.business_category_by_name(F.col("name")).alias("category"))


@query(
    "value_patterns",
    rf"""WITH c AS ({_CELLS(PATTERNED)}),
         p AS (SELECT "table", "column", regexp_replace(regexp_replace(value, '\p{{L}}', 'A', 'g'), '[0-9]', '9', 'g') AS pattern,
                      count(*) AS n FROM c WHERE value IS NOT NULL GROUP BY ALL),
         r AS (SELECT *, row_number() OVER (PARTITION BY "table", "column" ORDER BY n DESC, pattern) AS rank FROM p)
        SELECT "table", "column", pattern, n, rank::INTEGER AS rank FROM r WHERE rank <= 3""",
)
def value_patterns(t):
    return profile.value_patterns(cells(t, PATTERNED))


@query("value_patterns_all")
def value_patterns_all(t):
    return profile.value_patterns(cells(t, SAMPLED))


@query(
    "table_governance",
    """SELECT t.table_id, t.name, coalesce(column_count, 0) AS column_count, coalesce(pii_columns, 0) AS pii_columns,
         coalesce(nullable_columns, 0) AS nullable_columns, coalesce(primary_key_columns, 0) AS primary_key_columns,
         coalesce(table_embeddings, 0) AS table_embeddings, coalesce(column_embeddings, 0)::BIGINT AS column_embeddings,
         coalesce(table_embeddings, 0) + coalesce(column_embeddings, 0)::BIGINT AS total_embeddings
       FROM cat_tables t
       LEFT JOIN (SELECT table_id, count(*) AS column_count, count(*) FILTER (pii_flag) AS pii_columns,
                    count(*) FILTER (is_nullable) AS nullable_columns, count(*) FILTER (is_primary_key) AS primary_key_columns
                  FROM cat_columns GROUP BY 1) c ON c.table_id = t.table_id
       LEFT JOIN (SELECT object_id, count(*) AS table_embeddings FROM cat_embeddings WHERE object_type = 'table' GROUP BY 1) e
         ON e.object_id = t.table_id
       LEFT JOIN (SELECT c.table_id, count(*) AS column_embeddings FROM cat_columns c
                  JOIN cat_embeddings e ON e.object_type = 'column' AND e.object_id = c.column_id GROUP BY 1) f
         ON f.table_id = t.table_id""",
)
def table_governance(t):
    return profile.table_governance(t.cat_tables, t.cat_columns, t.cat_embeddings)


KEYED = ["customer", "supplier", "part", "orders"]


@query(
    "key_candidates",
    "SELECT \"table\", \"column\" FROM ("
    + union_sql(lambda n, c, d, k: f"""SELECT '{n}' AS "table", '{c}' AS "column",
        count({c}) = count(*) AND count(DISTINCT {c}) = count(*) AS ok FROM {n}""") + ") WHERE ok",
)
def key_candidates(t):
    profiles = each(t, profile.profile_columns)
    counts = each(t, profile.profile_table).select("table", "row_count")
    return profile.key_candidates(profiles, counts)


@query(
    "inclusion_dependencies",
    "\nUNION ALL ".join(
        f"""SELECT '{c}' AS child_column, '{p}' AS parent_column, count(*) AS child_values, count(p.v) AS matched,
            round(count(p.v)::DOUBLE / count(*), 4) AS confidence
            FROM (SELECT DISTINCT {c} AS v FROM {ct}) c LEFT JOIN (SELECT DISTINCT {p} AS v FROM {pt}) p ON c.v = p.v"""
        for ct, c, pt, p in [
            ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"),
            ("lineitem", "l_partkey", "part", "p_partkey"), ("customer", "c_custkey", "part", "p_partkey"),
            ("orders", "o_orderkey", "customer", "c_custkey"),
        ]),
)
def inclusion_dependencies(t):
    pairs = [
        (t.orders, "o_custkey", t.customer, "c_custkey"), (t.lineitem, "l_orderkey", t.orders, "o_orderkey"),
        (t.lineitem, "l_partkey", t.part, "p_partkey"), (t.customer, "c_custkey", t.part, "p_partkey"),
        (t.orders, "o_orderkey", t.customer, "c_custkey"),
    ]
    return profile.union_all([
        profile.inclusion(a, x, b, y).select(F.lit(x).alias("child_column"), F.lit(y).alias("parent_column"),
                                             "child_values", "matched", "confidence")
        for a, x, b, y in pairs])


_FAMILY = {"bigint": ("whole", "BIGINT"), "int": ("whole", "BIGINT"), "double": ("number", "DOUBLE"),
           "timestamp_ntz": ("time", "TIMESTAMP"), "string": ("text", "VARCHAR")}


def _range_sql(n, c, d, k):
    own, _ = _FAMILY[d]
    ends = ", ".join(
        f"{f'{fn}({c})' if name == own else 'NULL'}::{kind} AS {end}_{name}" for end, fn in (("lo", "min"), ("hi", "max"))
        for name, kind in dict(_FAMILY.values()).items())
    return f"""SELECT '{n}' AS t, '{c}' AS c, '{own}' AS family, count(*) AS rows, count({c}) AS filled, count(DISTINCT {c}) AS dist, {ends} FROM {n}"""


_INSIDE = " OR ".join(f"(a.lo_{n} >= b.lo_{n} AND a.hi_{n} <= b.hi_{n})" for n in dict(_FAMILY.values()))


@query(
    "relationships",
    f"""WITH col AS ({union_sql(_range_sql)}),
         v AS ({union_sql(lambda n, c, d, k: f"SELECT DISTINCT '{n}' AS t, '{c}' AS c, '{_FAMILY[d][0]}' AS family, {c}::VARCHAR AS v FROM {n} WHERE {c} IS NOT NULL")}),
         p AS (SELECT a.t AS child_table, a.c AS child_column, b.t AS parent_table, b.c AS parent_column, a.dist AS child_values
               FROM col a JOIN col b ON a.family = b.family AND b.filled = b.rows AND b.dist = b.rows AND (a.t <> b.t OR a.c <> b.c) AND ({_INSIDE})),
         m AS (SELECT x.t AS child_table, x.c AS child_column, y.t AS parent_table, y.c AS parent_column, count(*) AS matched
               FROM v x JOIN v y ON x.family = y.family AND x.v = y.v JOIN p ON p.child_table = x.t AND p.child_column = x.c
                 AND p.parent_table = y.t AND p.parent_column = y.c GROUP BY ALL)
        SELECT *, round(matched::DOUBLE / child_values, 4) AS confidence FROM (
          SELECT p.*, coalesce(matched, 0) AS matched FROM p LEFT JOIN m USING (child_table, child_column, parent_table, parent_column))""",
)
def relationships(t):
    return profile.relationships({n: getattr(t, n) for n in STAR}, folder=f"{scratch_dir(t.spark, 'values')}/values")


@query(
    "preview",
    """SELECT o_orderkey::VARCHAR AS o_orderkey, coalesce(o_orderstatus, '') AS o_orderstatus,
         coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice::VARCHAR END, '') AS total_price
       FROM orders ORDER BY orders.o_orderkey LIMIT 10""",
)
def preview(t):
    from tidemark.sources.files import preview as head

    odd = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice"))
    return head(t.orders.select("o_orderkey", "o_orderstatus", odd.alias("total price")), "o_orderkey", 10)


@query(
    "preview_nulls",
    """SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS total_price
       FROM orders ORDER BY o_orderkey LIMIT 100""",
)
def preview_nulls(t):
    from tidemark.sources.files import preview as head

    odd = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice"))
    return head(t.orders.select("o_orderkey", "o_orderstatus", odd.alias("total_price")), "o_orderkey", 100, as_text=False)
