"""Catalog and operations analytics: counts, rollups, pages, clean-up, folds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.scalar import mean


def record_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) per table and a total row, as one job."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("name"), "n") for k, df in tables.items()]
    counts = reduce(DataFrame.unionByName, parts)
    return counts.rollup("name").agg(F.sum("n").alias("n")).select(F.coalesce("name", F.lit("total")).alias("name"), "n")


def count_by(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def with_counts(base: DataFrame, key: str, counts: dict[str, DataFrame]) -> DataFrame:
    """Left-join counts that are already grouped by ``key``: no fan-out, zero where absent."""
    out = base
    for name, df in counts.items():
        out = out.join(count_by(df, key, name), key, "left")
    return out.fillna(0, list(counts))


def project_status(projects: DataFrame) -> DataFrame:
    return projects.groupBy(F.coalesce("status", F.lit("unknown")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def top_projects(projects: DataFrame, sources: DataFrame, entries: DataFrame, n: int = 10) -> DataFrame:
    out = with_counts(projects.select("project_id", "name"), "project_id",
                      {"sources_count": sources, "entries_count": entries})
    return out.withColumn("total_items", F.col("sources_count") + F.col("entries_count")).orderBy(
        F.desc("total_items"), "project_id").limit(n)


def project_stats(projects: DataFrame, sources: DataFrame, tables: DataFrame, columns: DataFrame,
                  entries: DataFrame, indexes: DataFrame, sessions: DataFrame) -> DataFrame:
    """Counts of everything below each project. Columns are counted per table before the joins."""
    t = tables.join(sources.select("source_id", "project_id"), "source_id").select("table_id", "project_id")
    per_table = count_by(columns, "table_id", "n")
    cols = t.join(per_table, "table_id").groupBy("project_id").agg(F.sum("n").alias("columns_count"))
    out = with_counts(projects.select("project_id"), "project_id",
                      {"sources_count": sources, "tables_count": t, "entries_count": entries,
                       "indexes_count": indexes, "sessions_count": sessions})
    return out.join(cols, "project_id", "left").fillna(0, ["columns_count"])


def usage(logs: DataFrame, sources: DataFrame, embeddings: DataFrame, indexes: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """One row: recent searches and their mean time, ingests by status, embedding and index totals."""
    recent = logs.where((F.col("created_at") >= now - F.expr(f"INTERVAL {days} DAYS")) & (F.col("created_at") <= now))
    parts = [
        recent.agg(F.count(F.lit(1)).alias("total_searches"),
                   F.coalesce(mean(F.coalesce("search_time_ms", F.lit(0.0)), 2), F.lit(0.0)).alias("avg_search_ms")),
        sources.agg(F.count(F.lit(1)).alias("total_sources"),
                    *[F.count_if(F.col("ingest_status") == s).alias(f"{s}_ingests") for s in ("completed", "failed", "pending")]),
        embeddings.agg(F.count(F.lit(1)).alias("total_embeddings")),
        indexes.agg(F.count(F.lit(1)).alias("total_indexes"), F.count_if(F.col("status") == "ready").alias("ready_indexes")),
    ]
    one = [p.withColumn("_k", F.lit(1)) for p in parts]
    return reduce(lambda a, b: a.join(b, "_k"), one).drop("_k")


def most_searched(logs: DataFrame, projects: DataFrame, n: int = 5) -> DataFrame:
    """Top ``n`` project ids by searches, then only those that exist."""
    top = count_by(logs, "project_id", "searches").orderBy(F.desc("searches"), "project_id").limit(n)
    return top.join(projects.select("project_id", "name"), "project_id")


def schema_tree(projects: DataFrame, sources: DataFrame, tables: DataFrame, columns: DataFrame) -> DataFrame:
    """The tree as rows, parents before children when sorted by the id path.

    One row per node with its ids and the number of direct children. Nothing is nested, so a
    project that holds a third of all tables stays spread over the cluster.
    """
    null = F.lit(None).cast("bigint")
    s_of = sources.select("source_id", "project_id")
    t_of = tables.join(s_of, "source_id").select("table_id", "source_id", "project_id", "name", "table_type")
    p = with_counts(projects.select("project_id", "name"), "project_id", {"children": sources}).select(
        "project_id", null.alias("source_id"), null.alias("table_id"), null.alias("column_id"),
        F.lit("project").alias("kind"), "name", "children")
    s = with_counts(sources.join(projects.select("project_id"), "project_id").select("project_id", "source_id", "name"), "source_id", {"children": tables}).select(
        "project_id", "source_id", null.alias("table_id"), null.alias("column_id"),
        F.lit("source").alias("kind"), "name", "children")
    tb = with_counts(t_of, "table_id", {"children": columns}).select(
        "project_id", "source_id", "table_id", null.alias("column_id"),
        F.col("table_type").alias("kind"), "name", "children")
    c = columns.join(t_of.drop("name"), "table_id").select(
        "project_id", "source_id", "table_id", "column_id", F.lit("column").alias("kind"), "name",
        F.lit(0).cast("bigint").alias("children"))
    return reduce(DataFrame.unionByName, [p, s, tb, c])


def tree_totals(tree: DataFrame) -> DataFrame:
    return tree.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def orphans(embeddings: DataFrame, indexes: DataFrame, logs: DataFrame, projects: DataFrame,
            objects: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(embeddings, indexes, logs) whose object or project is gone. ``objects``: type -> ids."""
    ids = reduce(DataFrame.unionByName, [
        df.select(F.lit(kind).alias("object_type"), F.col(df.columns[0]).cast("bigint").alias("object_id"))
        for kind, df in objects.items()])
    known = projects.select("project_id")
    return (
        embeddings.join(ids, ["object_type", "object_id"], "left_anti"),
        indexes.join(known, "project_id", "left_anti"),
        logs.join(known, "project_id", "left_anti"),
    )


def keep_live(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """The rewrite that drops orphans."""
    return df.join(gone.select(*keys), keys, "left_anti")


def cleanup_counts(gone: dict[str, DataFrame]) -> DataFrame:
    return record_counts(gone)


def page(df: DataFrame, order: list, skip: int, limit: int) -> DataFrame:
    """One page by a total order, each row with the total. The total is a scalar subquery."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return df.orderBy(*order).offset(skip).limit(limit).withColumn("total", total)


def page_after(df: DataFrame, order: list[str], last: dict, limit: int) -> DataFrame:
    """Keyset page: rows after ``last``; deep pages cost no more than the first one."""
    after, equal = F.lit(False), F.lit(True)
    for c in order:
        after = after | (equal & (F.col(c) > F.lit(last[c])))
        equal = equal & (F.col(c) == F.lit(last[c]))
    return df.where(after).orderBy(*order).limit(limit)


def live_rows(log: DataFrame, key: str, order: list[str], action: str = "action") -> DataFrame:
    """Rows whose last soft-delete or restore is not a delete."""
    last = log.groupBy(key).agg(F.max_by(action, F.struct(*order)).alias("last_action"))
    return last.where(F.col("last_action") != "delete")


def settings_merge(log: DataFrame, key: str, settings: str, order: list[str]) -> DataFrame:
    """Key-wise merge of settings maps; the latest value of each setting wins.

    Reduced to one row per (key, setting) with map-side combine before the map is built.
    """
    flat = log.select(key, *order, F.explode(settings).alias("setting", "value"))
    last = flat.groupBy(key, "setting").agg(F.max_by("value", F.struct(*order)).alias("value"))
    packed = F.array_sort(F.collect_list(F.struct("setting", "value")))
    return last.groupBy(key).agg(F.map_from_entries(packed).alias("settings"))


def _number(value) -> Column:
    return F.lit(str(value)).try_cast("double")


def _moment(value) -> Column:
    """A time; the zone of an ISO text is dropped, as the columns carry none."""
    return F.regexp_replace(F.lit(str(value)), r"(?:Z|[+-]\d{2}:?\d{2})$", "").try_cast("timestamp_ntz")


def _listed(value) -> list[str]:
    return [v.strip() for v in value.split(",") if v.strip()] if isinstance(value, str) else list(value)


#: what a suffix of a filter's name asks for: (column, value) to a predicate
FILTER_SUFFIXES = {
    "_min": lambda c, v: c >= _number(v),
    "_max": lambda c, v: c <= _number(v),
    "_date": lambda c, v: c == _moment(v),
    "_list": lambda c, v: c.isin(*_listed(v)),
}


def filter_predicates(spec: dict) -> list[Column]:
    """A predicate per filter of the map; empty filters drop out.

    A bound that cannot be read is null and would keep nothing, so such a filter is ignored instead:
    ``predicate or (bound is null)`` over literals, which Catalyst folds away before the scan.
    """
    out = []
    for name, value in spec.items():
        if value is None or value == "":
            continue
        suffix = next((s for s in FILTER_SUFFIXES if name.endswith(s) and len(name) > len(s)), None)
        if suffix is None:
            out.append(F.col(f"`{name}`") == value)
            continue
        test = FILTER_SUFFIXES[suffix](F.col(f"`{name[: -len(suffix)]}`"), value)
        readable = {"_min": _number, "_max": _number, "_date": _moment}.get(suffix)
        out.append(test if readable is None else test | readable(value).isNull())
    return out


def apply_filters(df: DataFrame, spec: dict) -> DataFrame:
    """The rows that pass all filters of the map; the predicates reach the scan."""
    for predicate in filter_predicates(spec):
        df = df.where(predicate)
    return df
