"""Questions, entities, SQL text and guarded SQL."""

from pyspark.sql import Window, functions as F

from tidemark import rules
from tidemark.functions import similarity as M
from tidemark.operators import match, nlq, sqlguard as G
from tidemark.plans.columns import sql_list
from tidemark.plans.profiling import rule_sql
from tidemark.plans.registry import BASE_TABLES, query

# --- similarity ---------------------------------------------------------------------------
def turn_pairs(t):
    """Every turn with the turn before it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return t.conversations.withColumn("prev", F.lag("text").over(w)).where("prev IS NOT NULL")


@query("fuzz_ratio")
def fuzz_ratio(t):
    return M.score_pairs(turn_pairs(t), "text", "prev", "indel").select("conv_id", "turn", "score")


@query("dict_search_fuzzy")
def dict_search_fuzzy(t):
    q = t.entities_raw.where("entity IS NOT NULL").select(F.col("entity").alias("query")).distinct()
    return match.dictionary_search(q, t.cat_entries).select("query", "entry_id", F.round("score", 6).alias("score"), "match_type", "rank")


@query(
    "dict_search_exact",
    """WITH q AS (SELECT DISTINCT entity AS query FROM entities_raw WHERE entity IS NOT NULL),
         f AS (SELECT DISTINCT entry_id, trim(lower(unnest(list_concat([term], list_concat(coalesce(synonyms, []), coalesce(abbreviations, [])))))) AS s
               FROM cat_entries WHERE status IN ('approved', 'draft')),
         r AS (SELECT query, entry_id, row_number() OVER (PARTITION BY query ORDER BY entry_id)::INTEGER AS rank FROM q JOIN f ON trim(lower(query)) = s)
       SELECT query, entry_id, 1.0::DOUBLE AS score, 'exact' AS match_type, rank FROM r WHERE rank <= 10""",
)
def dict_search_exact(t):
    q = t.entities_raw.where("entity IS NOT NULL").select(F.col("entity").alias("query")).distinct()
    return match.dictionary_search(q, t.cat_entries, exact=True).select("query", "entry_id", "score", "match_type", "rank")


# --- entities -----------------------------------------------------------------------------
def all_names(t):
    return (
        t.cat_tables.select(F.lit("table").alias("type"), "name", F.col("table_id").alias("seq"))
        .unionByName(t.cat_columns.select(F.lit("column").alias("type"), "name", F.col("column_id").alias("seq")))
        .unionByName(t.cat_entries.where("status = 'approved'").select(
            F.lit("business_term").alias("type"), F.col("term").alias("name"), F.col("entry_id").alias("seq")))
    )


@query(
    "extract_entities",
    """WITH n AS (SELECT 'table' AS type, name, table_id AS seq, 0.8::DOUBLE AS confidence FROM cat_tables
           UNION ALL SELECT 'column', name, column_id, 0.7 FROM cat_columns
           UNION ALL SELECT 'business_term', term, entry_id, 0.6 FROM cat_entries WHERE status = 'approved'),
         d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY confidence DESC, seq) AS rn FROM n) WHERE rn = 1),
         q AS (SELECT DISTINCT question FROM questions WHERE question <> ''),
         h AS (SELECT question, name AS entity, type, confidence, instr(lower(question), lower(name)) - 1 AS position,
                 row_number() OVER (PARTITION BY question ORDER BY confidence DESC, seq, name)::INTEGER AS rank
               FROM q JOIN d ON contains(lower(question), lower(name)))
       SELECT question_id, entity, type, confidence, position::INTEGER AS position, rank FROM questions JOIN h USING (question) WHERE rank <= 20""",
)
def extract_entities(t):
    return nlq.extract_entities(t.questions, all_names(t))


@query(
    "extract_entities_conversations",
    """WITH n AS (SELECT DISTINCT n_name AS name FROM nation UNION SELECT DISTINCT replace(p_name, ' ', '') FROM part
           UNION SELECT DISTINCT split_part(p_name, ' ', 2) FROM part UNION SELECT DISTINCT left(split_part(p_name, ' ', 1), 2) FROM part),
         h AS (SELECT concat(conv_id, ':', turn) AS question_id, name AS entity, instr(lower(text), lower(name)) - 1 AS position,
                 row_number() OVER (PARTITION BY conv_id, turn ORDER BY name) AS rank
               FROM conversations JOIN n ON contains(lower(text), lower(name)) WHERE role = 'user')
       SELECT question_id, entity, position::INTEGER AS position FROM h WHERE rank <= 20""",
)
def extract_entities_conversations(t):
    words = t.sql("""SELECT DISTINCT n_name AS name FROM {nation} UNION SELECT DISTINCT replace(p_name, ' ', '') FROM {part}
        UNION SELECT DISTINCT split_part(p_name, ' ', 2) FROM {part} UNION SELECT DISTINCT left(split_part(p_name, ' ', 1), 2) FROM {part}""")
    names = words.select(F.lit("table").alias("type"), "name", F.lit(0).cast("bigint").alias("seq"))
    asked = t.conversations.where("role = 'user'").select(
        F.concat_ws(":", "conv_id", "turn").alias("question_id"), F.col("text").alias("question"))
    return nlq.extract_entities(asked, names).select("question_id", "entity", "position")


_VALID = """SELECT session_id, entity_id, entity, coalesce(entity_type, 'unknown') AS entity_type,
      coalesce(try_cast(confidence AS DOUBLE), 0.5) AS confidence,
      row_number() OVER (PARTITION BY session_id ORDER BY entity_id)::INTEGER AS rank
    FROM entities_raw WHERE entity IS NOT NULL AND coalesce(try_cast(confidence AS DOUBLE), 0.5) >= 0.5"""


@query("validate_entities", f"SELECT * FROM ({_VALID}) WHERE rank <= 20")
def validate_entities(t):
    return nlq.validate_entities(t.entities_raw).select("session_id", "entity_id", "entity", "entity_type", "confidence", "rank")


@query(
    "query_confidence",
    f"""SELECT c_custkey AS session_id, round(coalesce(m, 0), 6) AS confidence FROM customer LEFT JOIN
        (SELECT session_id, avg(confidence) AS m FROM ({_VALID}) WHERE rank <= 20 GROUP BY 1) v ON v.session_id = c_custkey""",
)
def query_confidence(t):
    return nlq.query_confidence(t.customer.select(F.col("c_custkey").alias("session_id")), nlq.validate_entities(t.entities_raw))


def _variations(col):
    low = f"lower({col})"
    return f"""[CASE WHEN contains({low}, '_') THEN replace({low}, '_', ' ') END, CASE WHEN contains({low}, ' ') THEN replace({low}, ' ', '_') END,
        regexp_replace({low}, '[_\\s]+', '', 'g'), lower(regexp_replace({col}, '([a-z])([A-Z])', '\\1 \\2', 'g'))]"""


_KEY_TERMS = f"""list_filter(regexp_extract_all(lower(description), '[\\p{{L}}\\p{{N}}_]+'),
    lambda w: regexp_full_match(w, '[a-z]{{3,}}') AND w NOT IN ({sql_list(rules.KEY_TERM_STOP_WORDS)}))[1:10]"""
CAMEL = """
    SELECT c_custkey AS object_id, concat('customer', c_mktsegment, 'Name_', cast(c_nationkey AS varchar(10)), 'netTotal x') AS name,
           CASE WHEN c_custkey % 3 = 0 THEN c_name END AS display_name,
           CASE WHEN c_custkey % 2 = 0 THEN concat('The total of all ', lower(c_mktsegment), ' orders and items that were sent by the ', c_name, ' buyers') END AS description
    FROM {customer}"""


@query(
    "search_terms",
    f"""WITH o AS ({CAMEL.replace('{customer}', 'customer')}),
         l AS (SELECT object_id, list_concat([lower(name)], list_concat({_variations('name')},
             list_concat(CASE WHEN display_name IS NOT NULL AND display_name <> name THEN list_concat([lower(display_name)], {_variations('display_name')}) ELSE [] END,
             coalesce({_KEY_TERMS}, [])))) AS terms FROM o)
        SELECT object_id, string_agg(DISTINCT x, '|' ORDER BY x) AS terms FROM (SELECT object_id, unnest(terms) AS x FROM l)
        WHERE x IS NOT NULL AND trim(x) <> '' GROUP BY 1""",
)
def search_terms(t):
    terms = match.search_terms("name", "display_name", "description")
    return t.sql(CAMEL).select("object_id", F.array_join(terms, "|").alias("terms"))


def valid_entities(t):
    e = nlq.validate_entities(t.entities_raw)
    return e.select("entity_id", "session_id", "entity", "entity_type", "confidence")


def objects_of(t):
    return match.schema_objects(t.cat_tables, t.cat_columns, t.cat_entries)


# The longest common subsequence of two texts, with the row of its table packed into one integer: bit i stands for
# the i-th character of the first text, which may have 120 characters here.
_LCS = """list_reduce(list_prepend(((1::HUGEINT << la) - 1), list_transform(range(1, lb + 1), lambda i: coalesce(places[b[i]], 0::HUGEINT))),
    lambda r, m: ((r + (r & m)) | (r - (r & m))) & ((1::HUGEINT << la) - 1))"""
_MAPPED = f"""WITH asked AS (SELECT DISTINCT session_id, lower(entity) AS q FROM ({_VALID}) WHERE rank <= 20 AND length(entity) > 0),
    qs AS (SELECT DISTINCT q FROM asked),
    letters AS (SELECT q, substr(q, i, 1) AS ch, sum(1::HUGEINT << (i - 1)) AS m FROM (SELECT q, unnest(range(1, length(q) + 1)) AS i FROM qs) GROUP BY ALL),
    qm AS (SELECT q, length(q)::INTEGER AS la, map_from_entries(list((ch, m::HUGEINT))) AS places FROM letters GROUP BY q),
    strings AS (SELECT DISTINCT 0 AS prio, table_id AS object_id, lower(name) AS b FROM cat_tables
      UNION SELECT 1, column_id, lower(unnest([name, display_name, business_category] || coalesce(sample_values[1:5], []))) FROM cat_columns),
    pairs AS (SELECT q, b, la, length(b)::INTEGER AS lb, places FROM qm, (SELECT DISTINCT b FROM strings WHERE b <> '')),
    ratios AS (SELECT q, b, round_even(100::DOUBLE * 2 * (la - bit_count({_LCS})) / (la + lb), 0) / 100 AS score FROM pairs),
    best AS (SELECT q, prio, object_id, max(score) AS score FROM ratios JOIN strings USING (b)
      WHERE score > CASE WHEN prio = 0 THEN 0.6::DOUBLE ELSE 0.5::DOUBLE END GROUP BY ALL),
    three AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, prio, object_id) <= 3),
    named AS (SELECT h.q, h.prio, h.object_id, h.score, t.name AS "table", c.name AS "column" FROM three h
      LEFT JOIN cat_columns c ON h.prio = 1 AND c.column_id = h.object_id
      JOIN cat_tables t ON t.table_id = CASE WHEN h.prio = 0 THEN h.object_id ELSE c.table_id END),
    once AS (SELECT session_id, n.* FROM asked JOIN named n USING (q)
      QUALIFY row_number() OVER (PARTITION BY session_id, "table", "column" ORDER BY score DESC, q, prio, object_id) = 1)
    SELECT session_id, q AS entity, CASE WHEN prio = 0 THEN 'table' ELSE 'column' END AS type, "table", "column", score AS confidence, object_id,
      row_number() OVER (PARTITION BY session_id ORDER BY score DESC, q, prio, object_id)::INTEGER AS rank
    FROM once QUALIFY rank <= 10"""


@query("map_entities", _MAPPED)
def map_entities(t):
    return match.map_entities(valid_entities(t), t.cat_tables, t.cat_columns)


@query("match_candidates")
def match_candidates(t):
    c = match.match_candidates(valid_entities(t), objects_of(t))
    return c.select("q", "kind", "object_type", "object_id", F.round("max_score", 6).alias("max_score"), "method", "rank")


@query("match_scores")
def match_scores(t):
    c = match.match_candidates(valid_entities(t), objects_of(t))
    return c.select("q", "kind", "object_type", "object_id", *[F.round(s, 6).alias(s) for s in match.SCORES])


@query("rank_mappings")
def rank_mappings(t):
    e = valid_entities(t)
    mapped, _ = match.rank_mappings(e, match.match_candidates(e, objects_of(t), None))
    return mapped.withColumn("alternatives", F.array_join("alternatives", ","))


@query("rank_mappings_of_20")
def rank_mappings_of_20(t):
    """The ranking over the twenty candidates with the best single score."""
    e = valid_entities(t)
    mapped, _ = match.rank_mappings(e, match.match_candidates(e, objects_of(t)))
    return mapped.withColumn("alternatives", F.array_join("alternatives", ","))


@query("unmapped_entities")
def unmapped_entities(t):
    e = valid_entities(t)
    return match.rank_mappings(e, match.match_candidates(e, objects_of(t), None))[1]


MAPPINGS = """
    SELECT event_id AS mapping_id, user_id AS session_id,
           CASE event_id % 4 WHEN 0 THEN 'table' WHEN 1 THEN 'column' WHEN 2 THEN 'dictionary_entry' ELSE 'query' END AS target_type,
           event_id * 3 % 4000 AS target_id FROM {events}"""
_MAPPINGS = MAPPINGS.replace("{events}", "events")


@query(
    "validate_mappings",
    f"""SELECT mapping_id, target_type, target_id,
          (target_type = 'table' AND target_id IN (SELECT table_id FROM cat_tables))
          OR (target_type = 'column' AND target_id IN (SELECT column_id FROM cat_columns))
          OR (target_type = 'dictionary_entry' AND target_id IN (SELECT entry_id FROM cat_entries)) AS valid
        FROM ({_MAPPINGS})""",
)
def validate_mappings(t):
    ids = (t.cat_tables.select(F.lit("table").alias("object_type"), F.col("table_id").alias("object_id"))
           .unionByName(t.cat_columns.select(F.lit("column").alias("object_type"), F.col("column_id").alias("object_id")))
           .unionByName(t.cat_entries.select(F.lit("dictionary_entry").alias("object_type"), F.col("entry_id").alias("object_id"))))
    return match.validate_mappings(t.sql(MAPPINGS), ids).select("mapping_id", "target_type", "target_id", "valid")


_LINES = """SELECT table_id, string_agg('  ' || name || ' ' || data_type || CASE WHEN is_primary_key THEN ' PRIMARY KEY' ELSE '' END
      || CASE WHEN NOT is_nullable THEN ' NOT NULL' ELSE '' END || CASE WHEN length(description) > 0 THEN ' -- ' || description ELSE '' END,
      chr(10) ORDER BY pos) AS lines FROM cat_columns GROUP BY 1"""
_CONTEXT = f"""SELECT t.table_id, 'Table: ' || CASE WHEN schema_name IS NULL THEN t.name ELSE schema_name || '.' || t.name END || chr(10) || coalesce(lines, '')
      || CASE WHEN length(description) > 0 THEN chr(10) || 'Description: ' || description ELSE '' END AS context
    FROM cat_tables t LEFT JOIN ({_LINES}) l ON l.table_id = t.table_id"""


@query("schema_context", _CONTEXT)
def schema_context(t):
    return nlq.schema_context(t.cat_tables, t.cat_columns)


@query(
    "session_contexts",
    f"""WITH m AS ({_MAPPINGS}), s AS (SELECT session_id, target_id AS table_id FROM m WHERE target_type = 'table'
          UNION SELECT session_id, table_id FROM m JOIN cat_columns ON target_type = 'column' AND column_id = target_id)
        SELECT session_id, s.table_id, md5(context) AS context FROM s JOIN ({_CONTEXT}) c ON c.table_id = s.table_id""",
)
def session_contexts(t):
    ctx = nlq.schema_context(t.cat_tables, t.cat_columns)
    return nlq.session_contexts(t.sql(MAPPINGS), ctx, t.cat_columns).select("session_id", "table_id", F.md5("context").alias("context"))


@query(
    "foreign_key_hints",
    """SELECT c.table_id, column_id, t.name || '.' || c.name || ' references another table' AS hint
       FROM cat_columns c JOIN cat_tables t ON c.table_id = t.table_id WHERE is_foreign_key""",
)
def foreign_key_hints(t):
    return nlq.foreign_key_hints(t.cat_columns, t.cat_tables)


# --- question texts -----------------------------------------------------------------------
_LOW = "lower(question)"
_WC = r"len(list_filter(regexp_split_to_array(question, '[\s\p{Z}]+'), lambda w: length(w) > 0))"
_SUM = lambda ws: "(" + " + ".join(f"contains({_LOW}, '{w}')::INT" for w in ws) + ")"
_DIFF = f"""round(least(0.1::DOUBLE + {_SUM(rules.DIFFICULTY_INDICATORS)} * 0.15::DOUBLE + least({_SUM(rules.DIFFICULTY_CONDITIONS)} * 0.05::DOUBLE, 0.3)
    + CASE WHEN {_WC} > 30 THEN 0.2 WHEN {_WC} > 15 THEN 0.1 ELSE 0 END::DOUBLE, 1.0), 6)"""
_ANY = lambda ws: " OR ".join(f"contains({_LOW}, '{w}')" for w in ws)
ASKED = """
    SELECT cast(question_id AS varchar(20)) AS question_id, question FROM {questions}
    UNION ALL SELECT concat(cast(conv_id AS varchar(20)), ':', cast(turn AS varchar(20))), text FROM {conversations} WHERE role = 'user'"""
_ASKED = ASKED.replace("{", "").replace("}", "")


@query(
    "query_intent",
    f"""SELECT question_id, {rule_sql(_LOW, rules.INTENT_RULES, "'unknown'")} AS intent,
          CASE WHEN {_WC} > 20 OR {_ANY(rules.COMPLEX_WORDS)} THEN 'complex'
               WHEN len(list_filter(regexp_split_to_array({_LOW}, '[\\s\\p{{Z}}]+'), lambda w: w IN ({sql_list(rules.CONNECTIVES)}))) > 2 THEN 'medium'
               ELSE 'simple' END AS complexity, {_WC}::INTEGER AS word_count FROM ({_ASKED})""",
)
def query_intent(t):
    return nlq.query_intent(t.sql(ASKED)).select("question_id", "intent", "complexity", "word_count")


@query("query_difficulty", f"SELECT question_id, {_DIFF} AS difficulty FROM ({_ASKED})")
def query_difficulty(t):
    return t.sql(ASKED).select("question_id", nlq.query_difficulty("question").alias("difficulty"))


# --- SQL texts ----------------------------------------------------------------------------
def _audit_sql(has):
    up = "upper(sql_text)"
    trimmed = r"regexp_replace(upper(sql_text), '^\s+|\s+$', '', 'g')"
    blocked = " ".join(f"WHEN {has(up, w)} THEN 'Blocked keyword detected: {w}'" for w in rules.SQL_BLOCKED_SERVICE)
    allowed = " OR ".join(has(up, w) for w in rules.SQL_ALLOWED_SERVICE)
    forbidden = " OR ".join(has(up, w) for w in rules.SQL_FORBIDDEN_CHAT)
    return f"""SELECT stmt_id, starts_with({trimmed}, 'SELECT') AND NOT ({forbidden}) AS chat_ok,
        CASE WHEN {trimmed} = '' THEN 'Empty SQL query' {blocked}
             WHEN NOT ({allowed}) THEN 'Query must contain one of: SELECT, WITH, EXPLAIN' END AS service_error,
        starts_with({trimmed}, 'SELECT') AS admin_ok FROM sql_log"""


@query("sql_audit", _audit_sql(lambda c, w: f"contains({c}, '{w}')"))
def sql_audit(t):
    return G.sql_audit(t.sql_log).drop("user_id", "sql_text")


@query("sql_audit_word", _audit_sql(lambda c, w: f"regexp_matches({c}, '\\b{w}\\b')"))
def sql_audit_word(t):
    return G.sql_audit(t.sql_log, mode="word").drop("user_id", "sql_text")


_CLEAN = r"""trim(regexp_replace(regexp_replace(sql_text, '(?s)(''(?:[^'']|'''')*'')|--[^\n]*|/\*.*?\*/', '\1', 'g'), '\s+', ' ', 'g'))"""
_ENDED = f"CASE WHEN ends_with({_CLEAN}, ';') THEN {_CLEAN} ELSE {_CLEAN} || ';' END"


@query(
    "sql_normalize",
    f"""SELECT stmt_id, CASE WHEN contains(upper(s), 'LIMIT') THEN s ELSE rtrim(s, ';') || ' LIMIT 10000;' END AS sql_text
        FROM (SELECT stmt_id, {_ENDED} AS s FROM sql_log)""",
)
def sql_normalize(t):
    return t.sql_log.select("stmt_id", G.sql_normalize(F.col("sql_text"), rules.SQL_MAX_ROWS).alias("sql_text"))


@query(
    "sql_normalize_lines",
    r"""WITH l AS (SELECT stmt_id, array_to_string(list_filter(list_transform(string_split(sql_text, chr(10)), lambda x: trim(x)),
              lambda x: x <> '' AND NOT starts_with(x, '--')), ' ') AS s FROM sql_log)
        SELECT stmt_id, CASE WHEN s = '' OR ends_with(s, ';') THEN s ELSE s || ';' END AS sql_text FROM l""",
)
def sql_normalize_lines(t):
    return t.sql_log.select("stmt_id", G.sql_normalize(F.col("sql_text"), mode="lines").alias("sql_text"))


ANSWERS = """
    SELECT conv_id, turn, CASE turn % 3
        WHEN 0 THEN concat(text, chr(10), '```sql', chr(10), 'SELECT a,', chr(10), 'b FROM t', cast(conv_id AS varchar(20)), chr(10), '```', chr(10), 'Done')
        WHEN 1 THEN concat('Sure. select a,', chr(10), ' b from t', cast(conv_id AS varchar(20)), '  ', chr(10), chr(10), text)
        ELSE concat('  ', text, chr(10)) END AS answer
    FROM {conversations}"""


@query(
    "sql_extract",
    rf"""WITH a AS ({ANSWERS.replace('{conversations}', 'conversations')})
        SELECT conv_id, turn, regexp_replace(CASE WHEN regexp_matches(answer, '(?s)```sql\n(.*?)\n```') THEN regexp_extract(answer, '(?s)```sql\n(.*?)\n```', 1)
             WHEN regexp_matches(answer, '(?is)select\s') THEN string_split(regexp_extract(answer, '(?is)select\s.*'), chr(10) || chr(10))[1]
             ELSE answer END, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') AS sql_text FROM a""",
)
def sql_extract(t):
    return t.sql(ANSWERS).select("conv_id", "turn", G.sql_extract(F.col("answer")).alias("sql_text"))


KNOWN = "SELECT DISTINCT concat(event_type, '_log') AS name FROM {events} WHERE event_type <> 'error' UNION SELECT 'events' UNION SELECT 'lineitem'"


@query(
    "sql_table_refs",
    f"""WITH k AS ({KNOWN.replace('{events}', 'events')}), c AS (SELECT stmt_id, {_CLEAN} AS s FROM sql_log),
         f AS (SELECT stmt_id, unnest(regexp_extract_all(s, '(?i)\\b(?:from|join)\\s+([a-z_][a-z0-9_]*)', 1)) AS n FROM c
               UNION SELECT stmt_id, 'nation' FROM c WHERE contains(s, 'FROM customer, nation'))
        SELECT DISTINCT stmt_id, lower(n) AS table_name, lower(n) IN (SELECT name FROM k) AS known FROM f""",
)
def sql_table_refs(t):
    return G.sql_table_refs(t.sql_log, t.sql(KNOWN))


MAPPED = "SELECT DISTINCT user_id, concat(event_type, '_log') AS table_name FROM {events}"


@query(
    "sql_confidence",
    f"""WITH m AS ({MAPPED.replace('{events}', 'events')}),
         h AS (SELECT stmt_id, count(*) FILTER (contains(lower(sql_text), table_name)) AS n FROM sql_log LEFT JOIN m USING (user_id) GROUP BY 1)
        SELECT stmt_id, n AS table_matches, round(CASE WHEN trim(sql_text) = '' THEN 0 WHEN n > 0 THEN least(1.0, 0.5 + least(0.3, n * 0.1)) ELSE 0.5 END::DOUBLE, 6) AS confidence
        FROM sql_log JOIN h USING (stmt_id)""",
)
def sql_confidence(t):
    return G.sql_confidence(t.sql_log, t.sql(MAPPED))


# --- guarded SQL --------------------------------------------------------------------------
SMOKE = {
    "sql_all_customers": "SELECT c_custkey, c_name, c_mktsegment FROM customer",
    "sql_top_products_month": """SELECT l_partkey, p_name, CAST(sum(l_quantity) AS bigint) AS sold FROM lineitem JOIN part ON l_partkey = p_partkey
        WHERE l_shipdate >= TIMESTAMP '1998-03-01 00:00:00' AND l_shipdate < TIMESTAMP '1998-04-01 00:00:00'
        GROUP BY l_partkey, p_name ORDER BY sold DESC, l_partkey LIMIT 10""",
    "sql_revenue_by_region": """SELECT r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""",
    "sql_high_value_customers": """SELECT c_custkey, c_name, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON o_custkey = c_custkey
        GROUP BY c_custkey, c_name HAVING sum(o_totalprice) > 3000000""",
    "sql_top10_customers_revenue": """SELECT c_custkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
        FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
        GROUP BY c_custkey ORDER BY revenue DESC, c_custkey LIMIT 10""",
    "sql_rollup": """SELECT coalesce(l_returnflag, '*') AS flag, coalesce(l_linestatus, '*') AS status, count(*) AS n,
        round(avg(l_quantity), 4) AS avg_qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
    "sql_window_frame": """SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id
        ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS running FROM events""",
    "sql_set_ops": """SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier
        EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0""",
    "sql_semi_anti": """SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
        AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '5-LOW')""",
    "sql_correlated": """SELECT p_partkey, p_retailprice FROM part p WHERE p_retailprice > (SELECT avg(q.p_retailprice) FROM part q WHERE q.p_type = p.p_type)""",
}


def views_of(t):
    return {n: getattr(t, n) for n in BASE_TABLES}


def _smoke(name, text):
    @query(name, text)
    def run(t):
        return G.guarded_query(t.spark, text, views_of(t), max_rows=None)


for _name, _text in SMOKE.items():
    _smoke(_name, _text)

_ORDERED = "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey"


@query("run_guarded_sql", _ORDERED)
def run_guarded_sql(t):
    return G.guarded_query(t.spark, _ORDERED + ";", views_of(t))


@query("preview_sql", f"SELECT *, (SELECT count(*) > 100 FROM orders WHERE o_orderstatus = 'F') AS has_more FROM ({_ORDERED} LIMIT 100)")
def preview_sql(t):
    return G.guarded_query(t.spark, _ORDERED, views_of(t), rules.SQL_PREVIEW_ROWS)


# --- sessions and feedback ----------------------------------------------------------------
@query(
    "session_funnel",
    """SELECT status, count(*) AS sessions, count(sql_result) AS with_result, count(user_feedback) AS with_feedback,
         round(avg(CASE WHEN status = 'completed' THEN coalesce(step_extract, 0) + step_map END)::DECIMAL(28,9), 4)::DOUBLE AS avg_total_time FROM sessions GROUP BY 1""",
)
def session_funnel(t):
    return nlq.session_funnel(t.sessions, ["step_extract", "step_map"])


@query(
    "session_page",
    """SELECT session_id, status, (SELECT count(*) FROM sessions WHERE status = 'completed') AS total FROM sessions
       WHERE status = 'completed' ORDER BY created_at DESC, session_id LIMIT 50 OFFSET 100""",
)
def session_page(t):
    from tidemark.operators import ops

    done = t.sessions.where("status = 'completed'").select("session_id", "status", "created_at")
    return ops.page(done, [F.desc("created_at"), F.col("session_id")], 100, 50).drop("created_at")


@query("feedback_summary", "SELECT feedback_type, step, count(*) AS n, count(rating) AS rated, round(avg(rating)::DECIMAL(28,9), 4)::DOUBLE AS avg_rating FROM feedback GROUP BY ALL")
def feedback_summary(t):
    return nlq.feedback_summary(t.feedback)


@query(
    "latest_feedback",
    """SELECT session_id, step, feedback_id, feedback_type, rating FROM (SELECT *, row_number() OVER (PARTITION BY session_id, step
         ORDER BY created_at DESC, feedback_id DESC) AS rn FROM feedback) WHERE rn = 1""",
)
def latest_feedback(t):
    return nlq.latest_feedback(t.feedback)


TEMPLATES = [(1, "show me all {entity}"), (2, "top {value} {entity} by {entity}"), (3, "how many {entity} values"), (4, "compare {entity} versus {value}")]
_TEMPLATES = ", ".join(f"({i}, '{p.replace('{entity}', rules.TEMPLATE_ENTITY).replace('{value}', rules.TEMPLATE_VALUE)}')" for i, p in TEMPLATES)


@query(
    "template_match",
    rf"SELECT question_id, template_id FROM questions JOIN (VALUES {_TEMPLATES}) v(template_id, p) ON regexp_matches(question, '(?i)' || p)",
)
def template_match(t):
    return nlq.template_match(t.questions, TEMPLATES).select("question_id", "template_id")


@query(
    "template_success",
    rf"""SELECT template_id, count(*) AS usage_count, round(avg((status = 'completed')::INT)::DECIMAL(28,9), 6)::DOUBLE AS success_rate
        FROM questions JOIN (VALUES {_TEMPLATES}) v(template_id, p) ON regexp_matches(question, '(?i)' || p)
        JOIN sessions ON sessions.session_id = question_id GROUP BY 1""",
)
def template_success(t):
    uses = nlq.template_match(t.questions, TEMPLATES).select("template_id", F.col("question_id").alias("session_id"))
    done = t.sessions.select("session_id", (F.col("status") == "completed").alias("success"))
    return nlq.template_success(uses.join(done, "session_id"))


@query(
    "mapped_split",
    """SELECT o_orderkey AS session_id, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey::VARCHAR ELSE '' END AS tables,
         CASE WHEN o_orderkey % 3 = 0 THEN '7' ELSE o_custkey || ',7' END AS columns,
         CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '' END AS entities FROM orders""",
)
def mapped_split(t):
    kind = F.when(F.col("o_orderkey") % 3 == 0, "table").otherwise("column")
    one = lambda k, i: F.struct(k.alias("target_type"), i.cast("string").alias("target_id"))
    typed = F.when(F.col("o_orderkey") % 2 == 0, "table").otherwise("value")
    s = t.orders.select(
        F.col("o_orderkey").alias("session_id"),
        F.array(one(kind, F.col("o_custkey")), one(F.lit("column"), F.lit(7))).alias("mappings"),
        F.array(F.struct(typed.alias("type"), F.col("o_orderpriority").alias("text"))).alias("entities"))
    out = nlq.mapped_split(s)
    ids = lambda c: F.array_join(F.transform(c, lambda m: m["target_id"]), ",")
    return out.select("session_id", ids("mapped_tables").alias("tables"), ids("mapped_columns").alias("columns"),
                      F.array_join(F.transform("typed_entities", lambda e: e["text"]), ",").alias("entities"))
