"""Business dictionary."""

from pyspark.sql import functions as F

from tidemark import rules
from tidemark.operators import dictionary as D, ops
from tidemark.plans.columns import sql_list
from tidemark.plans.registry import query


def _pattern_values() -> str:
    rows, n = [], 0
    for group in (rules.BUSINESS_PATTERNS, rules.DOMAIN_PATTERNS):
        for cat, pats in group.items():
            for p in pats:
                rows.append(f"({n}, '{cat}', '{p}')")
                n += 1
    return ", ".join(rows)


def _map_sql(col: str, table: dict, value) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {value(v)}" for k, v in table.items()) + " END"


def _domain_sql(col: str) -> str:
    parts = []
    for table in (rules.DOMAIN_PATTERNS, rules.DOMAIN_FALLBACK):
        parts += [
            "WHEN " + " OR ".join(f"contains({col}, '{w}')" for w in words) + f" THEN '{d}'"
            for d, words in table.items()
        ]
    return "CASE " + " ".join(parts) + " END"


# the names of all tables and columns; seq puts each table before its columns
NAMES = """
    SELECT name, 'table' AS object_type, table_id AS object_id, name AS full_name,
           table_id * 10000000 AS seq FROM {cat_tables}
    UNION ALL
    SELECT c.name, 'column', c.column_id, concat(t.name, '.', c.name), c.table_id * 10000000 + 1 + c.pos
    FROM {cat_columns} c JOIN {cat_tables} t ON c.table_id = t.table_id"""
_NAMES = NAMES.replace("{", "").replace("}", "")
_HITS = f"""names AS ({_NAMES}), pats(ordinal, category, pattern) AS (VALUES {_pattern_values()}),
    hits AS (SELECT n.*, p.* FROM names n JOIN pats p ON contains(lower(n.name), p.pattern))"""
_CONF = f"""round(least(CASE WHEN lower(name) = pattern THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END
    + CASE WHEN category IN ({sql_list(rules.IMPORTANT_CATEGORIES)}) THEN 0.1::DOUBLE ELSE 0::DOUBLE END, 1.0::DOUBLE), 3)"""
_TITLE = "array_to_string(list_transform(string_split(pattern, '_'), lambda x: upper(x[1]) || lower(x[2:])), ' ')"
_SUGGESTIONS = f"""{_HITS}, sug AS (SELECT
    coalesce({_map_sql('category', rules.TERM_DEFINITIONS, lambda v: f"'{v[0]}'")}, {_TITLE}) AS term,
    coalesce({_map_sql('category', rules.TERM_DEFINITIONS, lambda v: f"'{v[1]}'")},
             'A ' || category || ' field containing ' || pattern || ' information') AS definition,
    {_domain_sql('lower(name)')} AS domain, {_CONF} AS confidence, object_type, object_id, full_name AS source_name,
    coalesce({_map_sql('category', rules.SYNONYMS, lambda v: f"'{','.join(v)}'")}, '') AS synonyms,
    coalesce({_map_sql('category', rules.ABBREVIATIONS, lambda v: f"'{','.join(v)}'")}, '') AS abbreviations,
    seq, ordinal FROM hits)"""


def suggestions(t):
    return D.compose(D.suggest(t.sql(NAMES)))


def joined(df, *cols):
    """Arrays as comma-joined text, for comparison."""
    return df.withColumns({c: F.coalesce(F.array_join(c, ","), F.lit("")) for c in cols})


@query("dict_suggest", f"WITH {_HITS} SELECT object_type, object_id, category, pattern FROM hits")
def dict_suggest(t):
    return D.suggest(t.sql(NAMES)).select("object_type", "object_id", "category", "pattern")


@query("dict_confidence", f"WITH {_HITS} SELECT object_type, object_id, pattern, category, {_CONF} AS confidence FROM hits")
def dict_confidence(t):
    return D.suggest(t.sql(NAMES)).select(
        "object_type", "object_id", "pattern", "category",
        D.confidence(F.col("name"), F.col("pattern"), F.col("category")).alias("confidence"))


@query(
    "dict_compose",
    f"WITH {_SUGGESTIONS} SELECT term, definition, coalesce(domain, '') AS domain, object_type, object_id, source_name, synonyms, abbreviations FROM sug",
)
def dict_compose(t):
    return joined(suggestions(t), "synonyms", "abbreviations").select(
        "term", "definition", F.coalesce("domain", F.lit("")).alias("domain"), "object_type", "object_id",
        "source_name", "synonyms", "abbreviations")


_TOP = f"""{_SUGGESTIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY lower(term) ORDER BY confidence DESC, seq, ordinal) AS rn,
      first_value(seq) OVER w AS s0, first_value(ordinal) OVER w AS o0 FROM sug
      WINDOW w AS (PARTITION BY lower(term) ORDER BY seq, ordinal)),
    top AS (SELECT *, row_number() OVER (ORDER BY confidence DESC, s0, o0) AS rank FROM r WHERE rn = 1)"""


@query(
    "dict_dedup_top",
    f"WITH {_TOP} SELECT rank::INTEGER AS rank, term, confidence, object_type, object_id, source_name FROM top WHERE rank <= 50",
)
def dict_dedup_top(t):
    return D.dedup_top(suggestions(t)).select("rank", "term", "confidence", "object_type", "object_id", "source_name")


def _title(col: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all({col}, '[\\p{{L}}]+|[^\\p{{L}}]+'), "
            f"lambda x: upper(x[1]) || lower(x[2:])), '')")


_COLUMN_ENTRIES = f"""named AS (SELECT c.*, t.name AS table_name FROM cat_columns c JOIN cat_tables t ON c.table_id = t.table_id),
    ce AS (SELECT column_id, table_id, pos, name, {_title("translate(name, '_-', '  ')")} AS term,
        'Data field ''' || name || ''' from table ''' || table_name || '''' ||
          CASE WHEN len(sample_values) > 0 THEN '. Sample values: ' || array_to_string(sample_values[1:5], ', ') ELSE '' END AS definition,
        CASE WHEN upper(name) IN ('ID', 'KEY', 'CODE') THEN 'technical_term'
             WHEN NOT contains(name, '_') AND upper(name) = name AND lower(name) <> name THEN 'abbreviation'
             ELSE 'business_term' END AS category FROM named)"""


@query("dict_from_columns", f"WITH {_COLUMN_ENTRIES} SELECT column_id, term, definition, category, 0.7::DOUBLE AS confidence FROM ce")
def dict_from_columns(t):
    named = t.cat_columns.join(t.cat_tables.select("table_id", F.col("name").alias("table_name")), "table_id")
    return D.from_columns(named).select("column_id", "term", "definition", "category", "confidence")


_TABLE_ENTRIES = f"""cr AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY pos) AS rn FROM cat_columns),
    ca AS (SELECT table_id, string_agg(name, ', ' ORDER BY pos) FILTER (rn <= 5) AS names, count(*) AS n FROM cr GROUP BY 1),
    te AS (SELECT t.table_id, t.name, {_title("translate(t.name, '_-', '  ')")} AS term,
        'Data entity ''' || t.name || '''' || CASE WHEN n > 0 THEN ' with attributes: ' || names ||
          CASE WHEN n > 5 THEN ' and ' || (n - 5) || ' more' ELSE '' END ELSE '' END AS definition
        FROM cat_tables t LEFT JOIN ca ON ca.table_id = t.table_id)"""


@query("dict_from_tables", f"WITH {_TABLE_ENTRIES} SELECT table_id, term, definition, 0.8::DOUBLE AS confidence FROM te")
def dict_from_tables(t):
    return D.from_tables(t.cat_tables, t.cat_columns).select("table_id", "term", "definition", "confidence")


@query(
    "dict_autogen",
    f"""WITH {_COLUMN_ENTRIES}, {_TABLE_ENTRIES},
        alle AS (SELECT term, definition, 0.8::DOUBLE AS confidence, 'entity' AS category, table_id, 0 AS kind, 0 AS pos FROM te
               UNION ALL SELECT term, definition, 0.7::DOUBLE, category, table_id, 1, pos FROM ce),
        r AS (SELECT *, row_number() OVER (PARTITION BY lower(term) ORDER BY table_id, kind, pos) AS rn FROM alle)
        SELECT term, definition, category, confidence FROM r WHERE rn = 1
          AND lower(term) NOT IN (SELECT lower(term) FROM cat_entries)""",
)
def dict_autogen(t):
    return D.autogen(t.cat_tables, t.cat_columns, t.cat_entries).select("term", "definition", "category", "confidence")


# incoming batch: one term per order, some of them known
INCOMING = """
    SELECT o_orderkey AS seq, o_custkey % 25 AS project_id,
           CASE o_orderkey % 4 WHEN 0 THEN concat('CUSTOMER ', lower(c_mktsegment)) WHEN 1 THEN 'region'
                WHEN 2 THEN concat('Term ', cast(o_custkey AS varchar(20)))
                ELSE concat('term ', cast(o_custkey AS varchar(20))) END AS term,
           concat('from order ', cast(o_orderkey AS varchar(20))) AS definition
    FROM {orders} JOIN {customer} ON o_custkey = c_custkey"""
_INCOMING = INCOMING.replace("{", "").replace("}", "")


def _bulk_sql(key):
    return f"""WITH inc AS ({_INCOMING}),
        r AS (SELECT *, row_number() OVER (PARTITION BY project_id, {key('term')} ORDER BY seq) AS rn FROM inc)
        SELECT seq, project_id, term, definition FROM r WHERE rn = 1 AND NOT EXISTS (
            SELECT 1 FROM cat_entries e WHERE e.project_id = r.project_id AND {key('e.term')} = {key('r.term')})"""


@query("dict_bulk_insert", _bulk_sql(lambda c: f"lower({c})"))
def dict_bulk_insert(t):
    return D.new_entries(t.sql(INCOMING), t.cat_entries, "seq", scope=["project_id"])


@query("dict_bulk_insert_exact", _bulk_sql(lambda c: c))
def dict_bulk_insert_exact(t):
    return D.new_entries(t.sql(INCOMING), t.cat_entries, "seq", ignore_case=False, scope=["project_id"])


MAPPING = {"seq": "entry_id", "project_id": "project_id", "term": "term", "definition": "definition"}


@query(
    "import_mapped",
    f"""WITH inc AS ({_INCOMING}),
        r AS (SELECT *, row_number() OVER (PARTITION BY project_id, lower(term) ORDER BY seq) AS rn FROM inc)
        SELECT entry_id, project_id, term, definition FROM cat_entries
        UNION ALL SELECT seq, project_id, term, definition FROM r WHERE rn = 1 AND NOT EXISTS (
            SELECT 1 FROM cat_entries e WHERE e.project_id = r.project_id AND lower(e.term) = lower(r.term))""",
)
def import_mapped(t):
    existing = t.cat_entries.select("entry_id", "project_id", "term", "definition")
    return D.import_mapped(t.sql(INCOMING), MAPPING, existing, "entry_id", scope=["project_id"])


@query(
    "import_mapped_overwrite",
    f"""WITH inc AS ({_INCOMING}),
        r AS (SELECT *, row_number() OVER (PARTITION BY project_id, lower(term) ORDER BY seq DESC) AS rn FROM inc)
        SELECT entry_id, project_id, term, definition FROM cat_entries e WHERE NOT EXISTS (
            SELECT 1 FROM inc WHERE e.project_id = inc.project_id AND lower(e.term) = lower(inc.term))
        UNION ALL SELECT seq, project_id, term, definition FROM r WHERE rn = 1""",
)
def import_mapped_overwrite(t):
    existing = t.cat_entries.select("entry_id", "project_id", "term", "definition")
    return D.import_mapped(t.sql(INCOMING), MAPPING, existing, "entry_id", overwrite=True, scope=["project_id"])


@query(
    "dict_filter_page",
    """WITH f AS (SELECT * FROM cat_entries WHERE (term ILIKE '%ma%' OR definition ILIKE '%ma%' OR coalesce(context ILIKE '%ma%', false))
           AND category = 'metric' AND status = 'approved')
       SELECT entry_id, term, category, status, (SELECT count(*) FROM f) AS total FROM f
       ORDER BY term, entry_id LIMIT 50 OFFSET 5""",
)
def dict_filter_page(t):
    found = D.filter_page(t.cat_entries, search="ma", category="metric", status="approved")
    return ops.page(found, ["term", "entry_id"], 5, 50).select("entry_id", "term", "category", "status", "total")


@query(
    "dict_filter_tag",
    "SELECT entry_id, term FROM cat_entries WHERE list_contains(domain_tags, 'building') AND status = 'draft'",
)
def dict_filter_tag(t):
    return D.filter_page(t.cat_entries, status="draft", tag="building").select("entry_id", "term")


@query(
    "dict_search_like",
    """SELECT entry_id, term, definition FROM cat_entries WHERE term ILIKE '%order%' OR definition ILIKE '%order%'""",
)
def dict_search_like(t):
    return D.search_like(t.cat_entries, "order").select("entry_id", "term", "definition")


@query(
    "dict_stats",
    "\nUNION ALL ".join(
        [f"SELECT 'status' AS kind, '{s}' AS name, count(*) FILTER (status = '{s}') AS n FROM cat_entries" for s in rules.DICTIONARY_STATUS]
        + [f"SELECT 'category', '{s}', count(*) FILTER (category = '{s}') FROM cat_entries" for s in rules.DICTIONARY_CATEGORY]
        + ["SELECT 'origin', 'auto', count(*) FILTER (is_auto_generated) FROM cat_entries",
           "SELECT 'origin', 'manual', count(*) FILTER (NOT is_auto_generated) FROM cat_entries",
           "SELECT 'total', 'entries', count(*) FROM cat_entries"]),
)
def dict_stats(t):
    return D.stats(t.cat_entries)


@query(
    "dict_top_tags",
    """SELECT tag, count(*) AS n FROM (SELECT unnest(domain_tags) AS tag FROM cat_entries) GROUP BY 1
       ORDER BY n DESC, tag LIMIT 10""",
)
def dict_top_tags(t):
    return D.top_tags(t.cat_entries)


@query(
    "dict_workflow_fold",
    """WITH m AS (SELECT entry_id, action, ts, event_id FROM workflow_log WHERE action <> 'use'),
         s AS (SELECT *, lag(action) OVER (PARTITION BY entry_id ORDER BY ts, event_id) AS prev FROM m),
         v AS (SELECT entry_id, count(*) FILTER (action = 'approve') + count(*) FILTER (action = 'edit' AND prev = 'approve') AS ups,
                 arg_max(action, (ts, event_id)) AS last_action,
                 arg_max(action, (ts, event_id)) FILTER (action <> 'edit') AS last_set FROM s GROUP BY 1)
       SELECT e.entry_id, 1 + coalesce(ups, 0) AS version, usage_count,
         CASE WHEN last_set IS NULL THEN 'draft' WHEN last_set = 'approve' AND last_action = 'edit' THEN 'draft'
              WHEN last_set = 'approve' THEN 'approved' WHEN last_set = 'reject' THEN 'rejected' ELSE 'pending_review' END AS status
       FROM (SELECT entry_id, count(*) FILTER (action = 'use') AS usage_count FROM workflow_log GROUP BY 1) e
       LEFT JOIN v ON v.entry_id = e.entry_id""",
)
def dict_workflow_fold(t):
    return D.workflow_fold(t.workflow_log)


@query(
    "dict_auto_accept",
    f"""WITH {_SUGGESTIONS}, a AS (SELECT *, row_number() OVER (PARTITION BY lower(term) ORDER BY seq, ordinal) AS rn
           FROM sug WHERE confidence > 0.8)
        SELECT term, confidence FROM a WHERE rn = 1 AND lower(term) NOT IN (SELECT lower(term) FROM cat_entries WHERE entry_id % 2 = 1)""",
)
def dict_auto_accept(t):
    return D.auto_accept(suggestions(t), t.cat_entries.where("entry_id % 2 = 1")).select("term", "confidence")


@query(
    "export_filtered",
    """SELECT entry_id, to_json({'term': term, 'status': status, 'category': category})::VARCHAR AS record
       FROM cat_entries WHERE status IN ('draft', 'approved') AND category IN ('metric', 'entity')""",
)
def export_filtered(t):
    from tidemark.sources.sinks import export_rows

    rows = export_rows(t.cat_entries, statuses=["draft", "approved"], categories=["metric", "entity"])
    return rows.select("entry_id", F.to_json(F.struct("term", "status", "category")).alias("record"))
