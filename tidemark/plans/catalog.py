"""Catalog and operations analytics (A1-A11) and introspection."""

from pyspark.sql import functions as F

from tidemark.operators import ops
from tidemark.plans.registry import query
from tidemark.sources.introspect import introspect

_COUNTED = ["cat_projects", "cat_sources", "cat_tables", "cat_columns", "cat_entries", "cat_embeddings", "cat_indexes", "search_log", "feedback"]


@query(
    "record_counts",
    "WITH c AS (" + " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in _COUNTED)
    + ") SELECT coalesce(name, 'total') AS name, sum(n)::BIGINT AS n FROM c GROUP BY ROLLUP (name)",
)
def record_counts(t):
    return ops.record_counts({n: getattr(t, n) for n in _COUNTED})


@query("project_status", "SELECT coalesce(status, 'unknown') AS status, count(*) AS n FROM cat_projects GROUP BY 1")
def project_status(t):
    return ops.project_status(t.cat_projects)


@query(
    "project_rollup",
    """SELECT p.project_id, p.name, coalesce(s, 0) AS sources_count, coalesce(e, 0) AS entries_count, coalesce(s, 0) + coalesce(e, 0) AS total_items
       FROM cat_projects p LEFT JOIN (SELECT project_id, count(*) AS s FROM cat_sources GROUP BY 1) a ON a.project_id = p.project_id
       LEFT JOIN (SELECT project_id, count(*) AS e FROM cat_entries GROUP BY 1) b ON b.project_id = p.project_id
       ORDER BY total_items DESC, p.project_id LIMIT 10""",
)
def project_rollup(t):
    return ops.top_projects(t.cat_projects, t.cat_sources, t.cat_entries)


NOW = "2024-01-28 00:00:00"


@query(
    "usage_30d",
    f"""SELECT (SELECT count(*) FROM search_log WHERE created_at BETWEEN TIMESTAMP '{NOW}' - INTERVAL 30 DAY AND TIMESTAMP '{NOW}') AS total_searches,
          (SELECT coalesce(round(avg(coalesce(search_time_ms, 0))::DECIMAL(28,9), 2)::DOUBLE, 0) FROM search_log WHERE created_at BETWEEN TIMESTAMP '{NOW}' - INTERVAL 30 DAY AND TIMESTAMP '{NOW}') AS avg_search_ms,
          (SELECT count(*) FROM cat_sources) AS total_sources,
          (SELECT count(*) FROM cat_sources WHERE ingest_status = 'completed') AS completed_ingests,
          (SELECT count(*) FROM cat_sources WHERE ingest_status = 'failed') AS failed_ingests,
          (SELECT count(*) FROM cat_sources WHERE ingest_status = 'pending') AS pending_ingests,
          (SELECT count(*) FROM cat_embeddings) AS total_embeddings, (SELECT count(*) FROM cat_indexes) AS total_indexes,
          (SELECT count(*) FROM cat_indexes WHERE status = 'ready') AS ready_indexes""",
)
def usage_30d(t):
    return ops.usage(t.search_log, t.cat_sources, t.cat_embeddings, t.cat_indexes, F.lit(NOW).cast("timestamp_ntz"))


@query(
    "most_searched",
    """SELECT project_id, searches, c_name AS name FROM (SELECT project_id, count(*) AS searches FROM search_log GROUP BY 1
         ORDER BY searches DESC, project_id LIMIT 5) JOIN customer ON c_custkey = project_id AND c_custkey % 2 = 0""",
)
def most_searched(t):
    known = t.cat_projects.where("project_id % 2 = 0")
    return ops.most_searched(t.search_log, known)


_TREE = """WITH tb AS (SELECT t.*, s.project_id FROM cat_tables t JOIN cat_sources s ON s.source_id = t.source_id)
    SELECT project_id, NULL::BIGINT AS source_id, NULL::BIGINT AS table_id, NULL::BIGINT AS column_id, 'project' AS kind, name,
      (SELECT count(*) FROM cat_sources s WHERE s.project_id = p.project_id) AS children FROM cat_projects p
    UNION ALL SELECT s.project_id, source_id, NULL, NULL, 'source', s.name, (SELECT count(*) FROM cat_tables t WHERE t.source_id = s.source_id)
      FROM cat_sources s JOIN cat_projects p ON p.project_id = s.project_id
    UNION ALL SELECT project_id, source_id, table_id, NULL, table_type, name, (SELECT count(*) FROM cat_columns c WHERE c.table_id = tb.table_id) FROM tb
    UNION ALL SELECT project_id, source_id, tb.table_id, column_id, 'column', c.name, 0 FROM cat_columns c JOIN tb ON tb.table_id = c.table_id"""


@query("schema_tree", _TREE)
def schema_tree(t):
    return ops.schema_tree(t.cat_projects, t.cat_sources, t.cat_tables, t.cat_columns)


@query("schema_tree_totals", f"SELECT kind, count(*) AS n FROM ({_TREE}) GROUP BY 1")
def schema_tree_totals(t):
    return ops.tree_totals(ops.schema_tree(t.cat_projects, t.cat_sources, t.cat_tables, t.cat_columns))


def orphan_parts(t):
    objects = {"table": t.cat_tables.where("table_id % 3 <> 0").select("table_id"), "column": t.cat_columns.select("column_id"),
               "dictionary_entry": t.cat_entries.where("entry_id % 2 = 0").select("entry_id")}
    return ops.orphans(t.cat_embeddings, t.cat_indexes, t.search_log, t.cat_projects.where("project_id % 5 <> 0"), objects)


_GONE = """ge AS (SELECT * FROM cat_embeddings WHERE (object_type = 'table' AND object_id NOT IN (SELECT table_id FROM cat_tables WHERE table_id % 3 <> 0))
      OR (object_type = 'column' AND object_id NOT IN (SELECT column_id FROM cat_columns))
      OR (object_type = 'dictionary_entry' AND object_id NOT IN (SELECT entry_id FROM cat_entries WHERE entry_id % 2 = 0))),
    live AS (SELECT project_id FROM cat_projects WHERE project_id % 5 <> 0),
    gi AS (SELECT * FROM cat_indexes WHERE project_id NOT IN (SELECT project_id FROM live)),
    gl AS (SELECT * FROM search_log WHERE project_id NOT IN (SELECT project_id FROM live))"""


@query(
    "orphan_cleanup",
    f"""WITH {_GONE}, c AS (SELECT 'embeddings' AS name, count(*) AS n FROM ge UNION ALL SELECT 'indexes', count(*) FROM gi UNION ALL SELECT 'search_logs', count(*) FROM gl)
        SELECT coalesce(name, 'total') AS name, sum(n)::BIGINT AS n FROM c GROUP BY ROLLUP (name)""",
)
def orphan_cleanup(t):
    e, i, g = orphan_parts(t)
    return ops.cleanup_counts({"embeddings": e, "indexes": i, "search_logs": g})


@query("orphan_rewrite", f"WITH {_GONE} SELECT embedding_id FROM cat_embeddings WHERE embedding_id NOT IN (SELECT embedding_id FROM ge)")
def orphan_rewrite(t):
    return ops.keep_live(t.cat_embeddings, orphan_parts(t)[0], ["embedding_id"]).select("embedding_id")


@query(
    "project_stats",
    """SELECT p.project_id, (SELECT count(*) FROM cat_sources s WHERE s.project_id = p.project_id) AS sources_count,
         (SELECT count(*) FROM cat_tables t JOIN cat_sources s ON s.source_id = t.source_id WHERE s.project_id = p.project_id) AS tables_count,
         (SELECT count(*) FROM cat_columns c JOIN cat_tables t ON t.table_id = c.table_id JOIN cat_sources s ON s.source_id = t.source_id WHERE s.project_id = p.project_id) AS columns_count,
         (SELECT count(*) FROM cat_entries e WHERE e.project_id = p.project_id) AS entries_count,
         (SELECT count(*) FROM cat_indexes i WHERE i.project_id = p.project_id) AS indexes_count,
         (SELECT count(*) FROM sessions n WHERE n.project_id = p.project_id) AS sessions_count FROM cat_projects p""",
)
def project_stats(t):
    return ops.project_stats(t.cat_projects, t.cat_sources, t.cat_tables, t.cat_columns, t.cat_entries, t.cat_indexes, t.sessions)


@query(
    "filter_sort_page",
    """WITH f AS (SELECT * FROM cat_sources WHERE name ILIKE '%1%' AND ingest_status = 'completed')
       SELECT source_id, name, (SELECT count(*) FROM f) AS total FROM f ORDER BY created_at DESC, source_id LIMIT 50 OFFSET 200""",
)
def filter_sort_page(t):
    found = t.cat_sources.where(F.col("name").ilike("%1%") & (F.col("ingest_status") == "completed"))
    return ops.page(found, [F.desc("created_at"), F.col("source_id")], 200, 50).select("source_id", "name", "total")


@query(
    "keyset_page",
    """SELECT source_id, created_at FROM cat_sources WHERE (created_at, source_id) > (TIMESTAMP '1997-06-01 00:00:00', 5) ORDER BY created_at, source_id LIMIT 50""",
)
def keyset_page(t):
    from datetime import datetime

    return ops.page_after(t.cat_sources.select("created_at", "source_id"), ["created_at", "source_id"],
                          {"created_at": datetime(1997, 6, 1), "source_id": 5}, 50)


AUDIT = """
    SELECT event_id, user_id AS row_id, ts, CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'restore' ELSE 'update' END AS action
    FROM {events} WHERE event_type <> 'view'"""


@query(
    "live_rows",
    f"""SELECT row_id, last_action FROM (SELECT row_id, arg_max(action, (ts, event_id)) AS last_action FROM ({AUDIT.replace('{events}', 'events')})
        WHERE action <> 'update' GROUP BY 1) WHERE last_action <> 'delete'""",
)
def live_rows(t):
    return ops.live_rows(t.sql(AUDIT).where("action <> 'update'"), "row_id", ["ts", "event_id"])


@query(
    "settings_merge",
    """WITH s AS (SELECT user_id, event_type AS k, arg_max(value, (ts, event_id)) AS v FROM events GROUP BY ALL)
       SELECT user_id AS project_id, string_agg(k || '=' || v::VARCHAR, ',' ORDER BY k) AS settings FROM s GROUP BY 1""",
)
def settings_merge(t):
    log = t.events.select(F.col("user_id").alias("project_id"), "ts", "event_id",
                          F.create_map("event_type", F.col("value").cast("string")).alias("settings"))
    merged = ops.settings_merge(log, "project_id", "settings", ["ts", "event_id"])
    shown = F.transform(F.map_entries("settings"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return merged.select("project_id", F.array_join(shown, ",").alias("settings"))


SPEC = {
    "o_totalprice_min": "1000.5", "o_totalprice_max": "300000", "o_custkey_max": "many", "o_orderdate_date": "soon",
    "o_orderpriority_list": "1-URGENT, 2-HIGH,", "o_orderstatus": "F", "o_orderkey_min": None, "o_comment": "",
}


@query(
    "filter_spec",
    """SELECT o_orderkey FROM orders WHERE o_totalprice >= 1000.5 AND o_totalprice <= 300000 AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'F'""",
)
def filter_spec(t):
    return ops.apply_filters(t.orders, SPEC).select("o_orderkey")


@query("filter_spec_date", "SELECT o_orderkey FROM orders WHERE o_orderdate = TIMESTAMP '1997-05-28 00:00:00'")
def filter_spec_date(t):
    return ops.apply_filters(t.orders, {"o_orderdate_date": "1997-05-28T00:00:00"}).select("o_orderkey")


_STARS = {
    "customer": ["bigint", "string", "int", "double", "string"], "supplier": ["bigint", "string", "int", "double"],
    "nation": ["int", "string", "int"], "events": ["bigint", "timestamp_ntz", "bigint", "string", "double", "string"],
}


@query(
    "catalog_introspect",
    "SELECT table_name AS \"table\", column_name AS \"column\", ordinal_position::BIGINT - 1 AS pos, row_count FROM information_schema.columns JOIN ("
    + " UNION ALL ".join(f"SELECT '{n}' AS t, count(*) AS row_count FROM {n}" for n in _STARS)
    + ") ON t = table_name",
)
def catalog_introspect(t):
    tables, columns = introspect(t.spark, {n: getattr(t, n) for n in _STARS})
    return columns.join(tables.select("table", "row_count"), "table").select("table", "column", "pos", "row_count")
