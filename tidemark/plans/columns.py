"""Names, scalar functions and formats."""

from pyspark.sql import functions as F

from tidemark import rules
from tidemark.functions import scalar as S
from tidemark.plans.registry import query


def sql_list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _ident_sql(col: str, prefix: str) -> str:
    base = f"trim(regexp_replace(regexp_replace({col}, '[^a-zA-Z0-9_]', '_', 'g'), '_+', '_', 'g'), '_')"
    return f"CASE WHEN regexp_matches({base}, '^[0-9]') THEN '{prefix}' || {base} ELSE {base} END"


@query(
    "clean_table_name",
    f"""SELECT doc_id, coalesce(nullif(left({_ident_sql('text', 'table_')}, 50), ''), 'unnamed_table')
        AS table_name FROM documents""",
)
def clean_table_name(t):
    return t.spread("documents", "doc_id", "text").select("doc_id", S.clean_table_name("text").alias("table_name"))


@query(
    "clean_column_name",
    f"""SELECT page_id, coalesce(nullif(left({_ident_sql('url', 'col_')}, 50), ''), 'unnamed_column') AS by_url,
        coalesce(nullif(left({_ident_sql("regexp_extract(url, '[0-9].*$')", 'col_')}, 50), ''), 'unnamed_column') AS by_tail
        FROM pages""",
)
def clean_column_name(t):
    tail = F.regexp_extract("url", "[0-9].*$", 0)
    return t.pages.select(
        "page_id",
        S.clean_column_name("url").alias("by_url"),
        S.clean_column_name(tail).alias("by_tail"),
    )


@query(
    "clean_identifier",
    f"""SELECT page_id, lower(coalesce(nullif({_ident_sql('url', 'col_')}, ''), 'unnamed_column')) AS ident,
        lower(coalesce(nullif({_ident_sql("regexp_extract(html, '<title>([^<]*)', 1)", 'col_')}, ''), 'unnamed')) AS title_ident
        FROM pages""",
)
def clean_identifier(t):
    title = F.regexp_extract("html", "<title>([^<]*)", 1)
    return t.pages.select(
        "page_id",
        S.clean_identifier("url").alias("ident"),
        S.clean_identifier(title, "unnamed").alias("title_ident"),
    )


@query(
    "truncate_text",
    """SELECT doc_id, CASE WHEN length(text) <= 100 THEN text ELSE left(text, 97) || '...' END AS short
       FROM documents""",
)
def truncate_text(t):
    return t.spread("documents", "doc_id", "text").select("doc_id", S.truncate_text("text").alias("short"))


@query(
    "format_file_size",
    """WITH s AS (SELECT o_orderkey, floor(o_totalprice * (o_orderkey % 20000)) AS b FROM orders)
       SELECT o_orderkey, CASE WHEN b = 0 THEN '0B'
         WHEN b < 1024 THEN round(b, 2)::VARCHAR || ' B'
         WHEN b < 1048576 THEN round(b / 1024, 2)::VARCHAR || ' KB'
         WHEN b < 1073741824 THEN round(b / 1048576, 2)::VARCHAR || ' MB'
         ELSE round(b / 1073741824, 2)::VARCHAR || ' GB' END AS size FROM s""",
)
def format_file_size(t):
    b = F.floor(F.col("o_totalprice") * (F.col("o_orderkey") % 20000))
    return t.orders.select("o_orderkey", S.format_file_size(b).alias("size"))


@query(
    "format_duration",
    """WITH s AS (SELECT event_id, value::DECIMAL(12,2) * CASE event_id % 4 WHEN 0 THEN 0.01 WHEN 1 THEN 1
                    WHEN 2 THEN 10 ELSE 200 END AS d FROM events)
       SELECT event_id, CASE WHEN d < 1 THEN round(d::DOUBLE * 1000, 0)::BIGINT || 'ms'
         WHEN d < 60 THEN round(d, 1)::DECIMAL(12,1) || 's'
         WHEN d < 3600 THEN floor(d::DOUBLE / 60)::BIGINT || 'm ' || floor(d::DOUBLE % 60)::BIGINT || 's'
         ELSE floor(d::DOUBLE / 3600)::BIGINT || 'h ' || floor((d::DOUBLE % 3600) / 60)::BIGINT || 'm' END AS duration
       FROM s""",
)
def format_duration(t):
    k = F.col("event_id") % 4
    factor = F.when(k == 0, "0.01").when(k == 1, "1").when(k == 2, "10").otherwise("200")
    d = (F.col("value").cast("decimal(12,2)") * factor.cast("decimal(6,2)")).cast("double")
    return t.events.select("event_id", S.format_duration(d).alias("duration"))


@query(
    "sanitize_filename",
    r"""WITH s AS (SELECT doc_id, regexp_replace(regexp_replace(text, '[<>:"/\\|?*]', '_', 'g'),
                     '^[. ]+|[. ]+$', '', 'g') AS f FROM documents),
       p AS (SELECT *, contains(f, '.') AS dotted, regexp_extract(f, '[^.]*$') AS e FROM s),
       q AS (SELECT doc_id, f, CASE WHEN dotted THEN left(f, length(f) - length(e) - 1) ELSE f END AS n,
                    CASE WHEN dotted THEN e ELSE '' END AS e FROM p)
       SELECT doc_id, CASE WHEN length(f) <= 255 THEN f
         WHEN e = '' THEN left(n, 255)
         WHEN 254 - length(e) >= 0 THEN left(n, 254 - length(e)) || '.' || e
         ELSE left(n, greatest(length(n) + 254 - length(e), 0)) || '.' || e END AS filename FROM q""",
)
def sanitize_filename(t):
    return t.spread("documents", "doc_id", "text").select("doc_id", S.sanitize_filename("text").alias("filename"))


@query(
    "extract_keywords",
    rf"""WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'),
             lambda x: regexp_full_match(x, '[a-z]{{3,}}') AND x NOT IN ({sql_list(rules.KEYWORD_STOP_WORDS)})) AS ws
             FROM documents),
         u AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM w),
         d AS (SELECT doc_id, w, min(p) AS p FROM u GROUP BY ALL),
         r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS rn FROM d)
       SELECT w.doc_id, coalesce(k, '') AS keywords FROM w
       LEFT JOIN (SELECT doc_id, string_agg(w, ',' ORDER BY rn) AS k FROM r WHERE rn <= 10 GROUP BY 1) x
         ON w.doc_id = x.doc_id""",
)
def extract_keywords(t):
    return t.spread("documents", "doc_id", "text").select(
        "doc_id", F.array_join(S.extract_keywords("text"), ",").alias("keywords")
    )


CONNECTIONS = """
    SELECT c_custkey, CASE c_custkey % 5
        WHEN 0 THEN concat('postgresql://user', cast(c_custkey AS varchar(20)), ':p@ss@db', cast(c_nationkey AS varchar(20)), ':5432/', lower(c_mktsegment))
        WHEN 1 THEN concat('mysql://app:secret@host', cast(c_nationkey AS varchar(20)), '/', lower(c_mktsegment), '?ssl=1')
        WHEN 2 THEN concat('sqlite:///', lower(c_mktsegment), '.db')
        WHEN 3 THEN concat('oracle://db', cast(c_nationkey AS varchar(20)), ':1521/', c_name)
        ELSE concat('not a uri ', c_name) END AS uri
    FROM {customer}"""


@query(
    "parse_connection_string",
    rf"""WITH c AS ({CONNECTIONS.replace('{customer}', 'customer')}),
        m AS (SELECT c_custkey, regexp_matches(uri, '{S.CONNECTION}') AS ok,
                     regexp_extract(uri, '{S.CONNECTION}', ['driver','username','password','host','port','db']) AS g FROM c)
        SELECT c_custkey, CASE WHEN ok THEN g.driver END AS driver, CASE WHEN ok THEN g.username END AS username,
               CASE WHEN ok THEN g.password END AS password, CASE WHEN ok THEN g.host END AS host,
               CASE WHEN ok THEN try_cast(g.port AS INTEGER) END AS port, CASE WHEN ok THEN g.db END AS database
        FROM m""",
)
def parse_connection_string(t):
    p = t.sql(CONNECTIONS).withColumn("p", S.parse_connection_string("uri"))
    return p.select("c_custkey", "p.*")


EMAILS = """
    SELECT c_custkey, CASE c_custkey % 6
        WHEN 0 THEN concat(lower(c_mktsegment), '.', cast(c_custkey AS varchar(20)), '@example.com')
        WHEN 1 THEN concat(c_name, '@example.com')
        WHEN 2 THEN concat('a+b_', cast(c_custkey AS varchar(20)), '@mail.example.co')
        WHEN 3 THEN 'user@localhost'
        WHEN 4 THEN concat('x@y.z', cast(c_nationkey AS varchar(20)))
        ELSE concat(lower(c_mktsegment), ' at example.com') END AS email
    FROM {customer}"""


@query(
    "validate_email",
    rf"""WITH e AS ({EMAILS.replace('{customer}', 'customer')})
        SELECT c_custkey, regexp_matches(email, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}$') AS valid FROM e""",
)
def validate_email(t):
    return t.sql(EMAILS).select("c_custkey", S.validate_email("email").alias("valid"))


@query(
    "normalize_text",
    r"""SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[_\-.]+', ' ', 'g'), '[\s\p{Z}]+', ' ', 'g')) AS norm
        FROM documents""",
)
def normalize_text(t):
    return t.spread("documents", "doc_id", "text").select("doc_id", S.normalize_text("text").alias("norm"))


@query(
    "generate_slug",
    r"""WITH s AS (SELECT doc_id, regexp_replace(lower(text), '[^\p{L}\p{N}_\s\p{Z}-]', '', 'g') AS a FROM documents)
        SELECT doc_id, rtrim(left(trim(regexp_replace(a, '[\s\p{Z}_-]+', '-', 'g'), '-'), 50), '-') AS slug FROM s""",
)
def generate_slug(t):
    return t.spread("documents", "doc_id", "text").select("doc_id", S.generate_slug("text").alias("slug"))


@query(
    "safe_json",
    """WITH j AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN left(props, 5) ELSE props END AS p FROM events)
       SELECT event_id, json_valid(p) AS valid,
              CASE WHEN json_valid(p) THEN json_extract_string(p, '$.k')::BIGINT ELSE -1 END AS k,
              CASE WHEN json_valid(p) THEN '{"k":' || json_extract_string(p, '$.k') || '}' ELSE '{"k":-1}' END AS dumped
       FROM j""",
)
def safe_json(t):
    p = F.when(F.col("event_id") % 5 == 0, F.substring("props", 1, 5)).otherwise(F.col("props"))
    parsed = t.events.select(
        "event_id",
        S.safe_json_loads(p).isNotNull().alias("valid"),
        S.safe_json_loads(p, '{"k": -1}').alias("v"),
    )
    return parsed.select(
        "event_id",
        "valid",
        F.try_variant_get("v", "$.k", "bigint").alias("k"),
        S.safe_json_dumps("v").alias("dumped"),
    )


@query(
    "format_timestamp",
    "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S UTC') AS shown FROM events",
)
def format_timestamp(t):
    return t.events.select("event_id", S.format_timestamp("ts").alias("shown"))


@query("sha256_hex", "SELECT doc_id, sha256(text) AS digest FROM documents")
def sha256_hex(t):
    return t.spread("documents", "doc_id", "text").select("doc_id", S.sha256_hex("text").alias("digest"))


@query(
    "qualified_name",
    """SELECT column_id, CASE WHEN schema_name IS NULL THEN t.name ELSE schema_name || '.' || t.name END AS table_full,
         CASE WHEN schema_name IS NULL THEN t.name ELSE schema_name || '.' || t.name END || '.' || c.name AS column_full
       FROM cat_columns c JOIN cat_tables t ON c.table_id = t.table_id""",
)
def qualified_name(t):
    tables = t.cat_tables.select("table_id", S.qualified_name("schema_name", "name").alias("table_full"))
    return t.cat_columns.join(tables, "table_id").select(
        "column_id", "table_full", S.qualified_name("table_full", "name").alias("column_full")
    )


@query(
    "pii_mask",
    r"""SELECT doc_id, regexp_replace(regexp_replace(text, '\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b', '[credit_card]', 'g'),
              '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b', '[email]', 'g') AS masked,
            CASE WHEN length(source) <= 4 THEN repeat('*', length(source))
                 ELSE repeat('*', length(source) - 4) || right(source, 4) END AS tail
        FROM documents""",
)
def pii_mask(t):
    from tidemark.operators.pii import mask_values

    return t.spread("documents", "doc_id", "text", "source").select(
        "doc_id",
        mask_values("text", ["credit_card", "email"]).alias("masked"),
        S.mask_sensitive("source").alias("tail"),
    )


@query(
    "confidence_level",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_discount * 10 >= 0.9 THEN 'high'
         WHEN l_discount * 10 >= 0.7 THEN 'medium' WHEN l_discount * 10 >= 0.5 THEN 'low' ELSE 'uncertain' END AS level
       FROM lineitem""",
)
def confidence_level(t):
    from tidemark.operators.nlq import confidence_level as level

    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        level(F.col("l_discount") * 10).alias("level"),
    )
