"""Search results: fusion, merging, thresholds, enrichment, suggestions, logs, statistics."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark import rules
from tidemark.functions.scalar import clip, mean
from tidemark.operators.blocks import keep_topk
from tidemark.sources.scratch import stored

OBJECT = ["object_type", "object_id"]


def hybrid_fuse(semantic: DataFrame, keyword: DataFrame, k: int = rules.SEARCH_TOP_K, alpha: float = rules.HYBRID_ALPHA) -> DataFrame:
    """Weighted sum over the union of both lists (each cut to 2k by the caller); a missing score is 0."""
    keys = ["query", *OBJECT]
    s = semantic.select(*keys, F.col("score").alias("s"))
    w = keyword.select(*keys, F.col("score").alias("w"))
    both = s.join(w, keys, "full_outer").select(
        *keys, F.coalesce("s", F.lit(0.0)).alias("semantic_score"), F.coalesce("w", F.lit(0.0)).alias("keyword_score"))
    scored = both.withColumn(
        "score", F.round(alpha * F.col("semantic_score") + (1 - alpha) * F.col("keyword_score"), 8))
    return keep_topk(scored, ["query"], [F.desc("score"), *[F.col(c) for c in OBJECT]], k)


def merge_results(lists: list[DataFrame], k: int = rules.SEARCH_TOP_K) -> DataFrame:
    """Best score per object over several indexes, ranked; equal scores go by type and id.

    Each list is top-k already, so the union is small per query; the maximum combines map-side.
    """
    union = reduce(DataFrame.unionByName, [x.select("query", *OBJECT, "score", "method") for x in lists])
    best = union.groupBy("query", *OBJECT).agg(
        F.max("score").alias("score"), F.max_by("method", F.struct("score", "method")).alias("method"))
    return keep_topk(best, ["query"], [F.desc("score"), *[F.col(c) for c in OBJECT]], k)


def search_threshold(lists: list[DataFrame], threshold: float, mode: str, k: int = rules.SEARCH_TOP_K) -> DataFrame:
    """``inside``: each list is cut by score before the merge. ``after``: the merged top k is, so fewer may stay."""
    if mode == "inside":
        return merge_results([x.where(F.col("score") >= threshold) for x in lists], k)
    if mode == "after":
        return merge_results(lists, k).where(F.col("score") >= threshold)
    raise ValueError(f"unknown mode {mode}")


METHOD = {"faiss": "semantic", "pgvector": "semantic", "tfidf": "keyword", "bm25": "keyword"}


def index_route(indexes: DataFrame, search_type: str = "hybrid", index_ids: list[int] | None = None) -> DataFrame:
    """Ready indexes a search uses, each with its method; ``hybrid`` takes every index by its own."""
    out = indexes.where(F.col("status") == "ready")
    if index_ids:
        out = out.where(F.col("index_id").isin(*index_ids))
    method = F.lit(None).cast("string")
    for kind, name in METHOD.items():
        method = F.when(F.col("type") == kind, name).otherwise(method)
    out = out.withColumn("method", method).where(F.col("method").isNotNull())
    return out if search_type == "hybrid" else out.where(F.col("method") == search_type)


def enrich(results: DataFrame, tables: DataFrame, columns: DataFrame, entries: DataFrame) -> DataFrame:
    """Display name and context per result: one left join per object kind, on typed keys."""
    text = lambda c: F.col(c).cast("string")
    meta = lambda *cs: F.to_json(F.struct(*cs))
    t = tables.select(
        F.lit("table").alias("object_type"), F.col("table_id").alias("object_id"),
        F.coalesce("display_name", "name").alias("t_name"),
        meta("schema_name", "row_count", "table_type").alias("t_meta"))
    c = columns.select(
        F.lit("column").alias("object_type"), F.col("column_id").alias("object_id"),
        F.coalesce("display_name", "name").alias("c_name"),
        meta("table_id", "data_type", "is_primary_key", "is_nullable", "pii_flag").alias("c_meta"))
    e = entries.select(
        F.lit("dictionary_entry").alias("object_type"), F.col("entry_id").alias("object_id"), F.col("term").alias("e_name"),
        meta(clip("definition", 200).alias("definition"), "category", "status").alias("e_meta"))
    out = results.join(t, OBJECT, "left").join(c, OBJECT, "left").join(e, OBJECT, "left")
    return out.withColumns({
        "object_name": F.coalesce("t_name", "c_name", "e_name", F.lit("")),
        "context": F.coalesce("t_meta", "c_meta", "e_meta", F.lit("{}")),
    }).drop("t_name", "c_name", "e_name", "t_meta", "c_meta", "e_meta")


def search(requests: DataFrame, indexes: DataFrame, engines: dict[str, Callable[[DataFrame], DataFrame]], tables: DataFrame,
           columns: DataFrame, entries: DataFrame, k: int = rules.SEARCH_TOP_K, threshold: float = rules.SEARCH_MIN_SCORE,
           search_type: str = "hybrid", mode: str = "after", index_ids: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """One search from request to log: (named results, one log row per request).

    ``requests``: query (unique), project_id and whatever the engines read. A request goes to the ready indexes of
    its project, each type of index by its engine: a function from the requests routed there to their best hits
    (query, object_type, object_id, score). Two indexes of one type in a project are one engine's run. An engine
    is given routed requests only; without one for a type its indexes are skipped. Lists are merged by the best score
    of an object, cut by ``threshold`` (see search_threshold) and named. Requests without a ready index have no
    results and a log row with zeros; so have requests without a project.
    """
    ready = index_route(indexes, search_type, index_ids).where(F.col("type").isin(*engines)).select("project_id", "type", "index_id", "method")
    lists = []
    for kind, run in engines.items():
        there = ready.where(F.col("type") == kind).select("project_id").distinct()
        hits = run(requests.join(there, "project_id", "left_semi"))
        lists.append(hits.select("query", *OBJECT, F.col("score").cast("double").alias("score"), F.lit(METHOD[kind]).alias("method")))
    results = stored(enrich(search_threshold(lists, threshold, mode, k), tables, columns, entries), "results")
    used = ready.groupBy("project_id").agg(F.count_distinct("index_id").alias("indexes_used"))
    counts = results.groupBy("query").agg(F.count(F.lit(1)).alias("results_count"))
    log = requests.select("query", "project_id").join(used, "project_id", "left").join(counts, "query", "left").select(
        "query", "project_id", F.coalesce("results_count", F.lit(0)).alias("results_count"),
        F.coalesce("indexes_used", F.lit(0)).alias("indexes_used"))
    return results, log


def browse(kind: str, objects: DataFrame, key: str, name: str, metadata: list[str], k: int = 10) -> DataFrame:
    """The first ``k`` objects of one kind by id, score 1.0, with metadata."""
    return objects.orderBy(key).limit(k).select(
        F.lit(kind).alias("object_type"), F.col(key).alias("object_id"), F.col(name).alias("text"),
        F.lit(1.0).alias("score"), F.to_json(F.struct(*metadata)).alias("metadata"))


def suggest_names(names: list[DataFrame], part: str, n: int = 5) -> DataFrame:
    """Distinct names that contain ``part`` (any case), sorted, first ``n``. One ``name`` column each."""
    union = reduce(DataFrame.unionByName, names)
    return union.where(F.contains(F.lower("name"), F.lit(part.lower()))).distinct().orderBy("name").limit(n)


def suggest_prioritized(entries: DataFrame, tables: DataFrame, columns: DataFrame, part: str, limit: int = 5) -> DataFrame:
    """Dictionary first, then tables, then columns, within one budget.

    Every source is cut to the budget on its own before the union, so the final sort is tiny.
    """
    like = f"%{part}%"
    head = lambda df, c, key: df.where(F.col(c).ilike(like)).orderBy(key).limit(limit)
    d = head(entries, "term", "entry_id").select(
        F.lit(0).alias("prio"), F.col("entry_id").alias("oid"), F.col("term").alias("text"), F.lit("dictionary_term").alias("type"),
        clip("definition", 100).alias("description"), "category")
    t = head(tables, "name", "table_id").select(
        F.lit(1).alias("prio"), F.col("table_id").alias("oid"), F.coalesce("display_name", "name").alias("text"), F.lit("table").alias("type"),
        F.concat(F.lit("Table with "), F.col("row_count").cast("string"), F.lit(" rows")).alias("description"),
        F.lit("data_source").alias("category"))
    c = head(columns, "name", "column_id").select(
        F.lit(2).alias("prio"), F.col("column_id").alias("oid"), F.coalesce("display_name", "name").alias("text"), F.lit("column").alias("type"),
        F.concat("data_type", F.lit(" column")).alias("description"), F.lit("data_field").alias("category"))
    return d.unionByName(t).unionByName(c).orderBy("prio", "oid").limit(limit)


def search_log_rows(results: DataFrame, queries: DataFrame, now: Column, elapsed_ms: Column) -> DataFrame:
    """One log row per query (also those without a hit), ready to append."""
    counts = results.groupBy("query").agg(F.count(F.lit(1)).alias("results_count"))
    return queries.join(counts, "query", "left").select(
        "query", F.coalesce("results_count", F.lit(0)).alias("results_count"),
        elapsed_ms.alias("search_time_ms"), now.alias("created_at"))


def recent(logs: DataFrame, now: Column, days: int) -> DataFrame:
    return logs.where((F.col("created_at") >= now - F.expr(f"INTERVAL {days} DAYS")) & (F.col("created_at") <= now))


def search_stats(logs: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Per project: searches, mean time (2 decimals), mean hits (1 decimal) of the last days."""
    return recent(logs, now, days).groupBy("project_id").agg(
        F.count(F.lit(1)).alias("total_searches"), mean("search_time_ms", 2).alias("avg_search_time"),
        mean("results_count", 1).alias("avg_results_count"))


def popular_queries(logs: DataFrame, now: Column, days: int = 30, n: int = 10) -> DataFrame:
    """Per project the ``n`` most frequent queries, ties by text."""
    counts = recent(logs, now, days).groupBy("project_id", "query").agg(F.count(F.lit(1)).alias("n"))
    return keep_topk(counts, ["project_id"], [F.desc("n"), F.col("query")], n)


def search_trends(logs: DataFrame, bucket: str = "1 day") -> DataFrame:
    return logs.groupBy(F.window("created_at", bucket).alias("w")).agg(
        F.count(F.lit(1)).alias("searches"), mean("search_time_ms", 2).alias("avg_ms")
    ).select(F.col("w.start").alias("bucket"), "searches", "avg_ms")


def index_status(indexes: DataFrame) -> DataFrame:
    state = lambda s: F.count_if(F.col("status") == s)
    return indexes.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("total_indexes"), state("ready").alias("ready_indexes"),
        state("building").alias("building_indexes"), state("error").alias("error_indexes"),
        F.sum("total_objects").alias("total_objects"), F.sum("indexed_objects").alias("indexed_objects"))


def drop_first(ranked: DataFrame, k: int) -> DataFrame:
    """Variant of similar objects: the first hit is taken to be the object itself and dropped."""
    w = Window.partitionBy("qid").orderBy("rank")
    return ranked.where((F.col("rank") > 1) & (F.col("rank") <= k + 1)).withColumn("rank", F.row_number().over(w))
