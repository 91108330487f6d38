"""Business dictionary: suggestions, bulk merge, search, statistics, workflow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark import rules
from tidemark.functions import scalar as S


def _lit_map(d: dict) -> Column:
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), v)])


def _lit_list(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def pattern_list() -> Column:
    """All (ordinal, category, pattern) as one literal array: business first, then domain."""
    rows, n = [], 0
    for group in (rules.BUSINESS_PATTERNS, rules.DOMAIN_PATTERNS):
        for cat, pats in group.items():
            for p in pats:
                rows.append(F.struct(F.lit(n).alias("ordinal"), F.lit(cat).alias("category"), F.lit(p).alias("pattern")))
                n += 1
    return F.array(*rows)


def suggest(names: DataFrame) -> DataFrame:
    """``names``: name, object_type, object_id, full_name, seq. One row per pattern inside the name.

    The rule list is a literal array filtered per row, so no join and no shuffle is needed.
    """
    low = F.lower("name")
    hits = F.filter(pattern_list(), lambda p: F.contains(low, p["pattern"]))
    return names.withColumn("hit", F.explode(hits)).select(
        "*", "hit.ordinal", "hit.category", "hit.pattern").drop("hit")


def confidence(name: Column, pattern: Column, category: Column) -> Column:
    base = F.when(F.lower(name) == pattern, 0.9).otherwise(0.7)
    boost = F.when(category.isin(*rules.IMPORTANT_CATEGORIES), 0.1).otherwise(0.0)
    return F.round(F.least(base + boost, F.lit(1.0)), 3)


def infer_domain(name: Column) -> Column:
    low = F.lower(name)
    return F.coalesce(
        S.first_rule(low, list(rules.DOMAIN_PATTERNS.items())),
        S.first_rule(low, list(rules.DOMAIN_FALLBACK.items())),
    )


def compose(hits: DataFrame) -> DataFrame:
    """Term, definition, domain, synonyms and abbreviations for every hit."""
    known = _lit_map({k: F.struct(F.lit(t).alias("term"), F.lit(d).alias("definition"))
                      for k, (t, d) in rules.TERM_DEFINITIONS.items()})
    entry = F.try_element_at(known, F.col("category"))
    other_term = F.replace(S.title_case("pattern"), F.lit("_"), F.lit(" "))
    other_def = F.concat(F.lit("A "), "category", F.lit(" field containing "), "pattern", F.lit(" information"))
    none = F.array().cast("array<string>")
    pick = lambda table: F.coalesce(
        F.try_element_at(_lit_map({k: _lit_list(v) for k, v in table.items()}), F.lower("category")), none)
    return hits.select(
        F.coalesce(entry["term"], other_term).alias("term"),
        F.coalesce(entry["definition"], other_def).alias("definition"),
        F.lit("business_term").alias("category"),
        infer_domain(F.col("name")).alias("domain"),
        confidence(F.col("name"), F.col("pattern"), F.col("category")).alias("confidence"),
        "object_type", "object_id", F.col("full_name").alias("source_name"),
        pick(rules.SYNONYMS).alias("synonyms"), pick(rules.ABBREVIATIONS).alias("abbreviations"),
        "seq", "ordinal",
    )


def dedup_top(suggestions: DataFrame, limit: int = rules.SUGGESTION_LIMIT, scope: list[str] = ()) -> DataFrame:
    """Per lower-case term the best suggestion (first seen on ties), best first, top ``limit``.

    Two aggregates with map-side combine: a term shared by a third of all rows never meets in one
    task. A kept suggestion ranks at the position where its term was first seen.
    """
    keys = [*scope, "term_key"]
    cols = [c for c in suggestions.columns if c not in scope]
    pos = F.struct("seq", "ordinal")
    best = suggestions.withColumn("term_key", F.lower("term")).groupBy(*keys).agg(
        F.min_by(F.struct(*cols), F.struct((-F.col("confidence")).alias("c"), "seq", "ordinal")).alias("best"),
        F.min(pos).alias("first_seen"),
    )
    flat = best.select(*scope, "best.*", "first_seen")
    w = Window.partitionBy(*scope) if scope else Window.partitionBy(F.lit(0))
    order = [F.desc("confidence"), F.col("first_seen")]
    if scope:
        return flat.withColumn("rank", F.row_number().over(w.orderBy(*order))).where(F.col("rank") <= limit)
    return flat.orderBy(*order).limit(limit).withColumn(
        "rank", F.row_number().over(Window.orderBy(*order)))


def from_columns(columns: DataFrame) -> DataFrame:
    """``columns``: name, table_name, sample_values. Term, category and definition per column."""
    spaced = F.translate("name", "_-", "  ")
    term = S.title_case(spaced)
    technical = F.upper("name").isin("ID", "KEY", "CODE")
    # one token, upper case with at least one letter
    abbreviation = ~F.contains("name", F.lit("_")) & (F.upper("name") == F.col("name")) & (F.lower("name") != F.col("name"))
    samples = F.array_join(F.slice(F.coalesce("sample_values", F.array().cast("array<string>")), 1, 5), ", ")
    some = F.size(F.coalesce("sample_values", F.array().cast("array<string>"))) > 0
    base = F.concat(F.lit("Data field '"), "name", F.lit("' from table '"), "table_name", F.lit("'"))
    return columns.select(
        "*",
        term.alias("term"),
        F.when(some, F.concat(base, F.lit(". Sample values: "), samples)).otherwise(base).alias("definition"),
        F.when(technical, "technical_term").when(abbreviation, "abbreviation").otherwise("business_term").alias("category"),
        F.when(term != F.col("name"), F.array("name")).otherwise(F.array().cast("array<string>")).alias("synonyms"),
        F.lit(0.7).alias("confidence"),
        F.lit("column_name").alias("source_type"),
    )


def first_columns(columns: DataFrame, n: int) -> DataFrame:
    """(table_id, names, n_columns): the first ``n`` names by position and the full count.

    The rank filter is pushed below the shuffle, so at most ``n`` rows per table and task move.
    """
    w = Window.partitionBy("table_id").orderBy("pos")
    top = columns.select("table_id", "pos", "name").withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)
    names = top.groupBy("table_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda s: s["name"]).alias("names"))
    counts = columns.groupBy("table_id").agg(F.count(F.lit(1)).alias("n_columns"))
    return names.join(counts, "table_id")


def from_tables(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Entity entry per table: first five attributes, then how many more."""
    t = tables.join(first_columns(columns, 5), "table_id", "left")
    term = S.title_case(F.translate("name", "_-", "  "))
    base = F.concat(F.lit("Data entity '"), "name", F.lit("'"))
    attrs = F.concat(F.lit(" with attributes: "), F.array_join("names", ", "))
    more = F.when(F.col("n_columns") > 5, F.concat(F.lit(" and "), (F.col("n_columns") - 5).cast("string"), F.lit(" more"))).otherwise("")
    return t.select(
        *tables.columns,
        term.alias("term"),
        F.when(F.col("n_columns") > 0, F.concat(base, attrs, more)).otherwise(base).alias("definition"),
        F.lit("entity").alias("category"),
        F.when(term != F.col("name"), F.array("name")).otherwise(F.array().cast("array<string>")).alias("synonyms"),
        F.lit(0.8).alias("confidence"),
        F.lit("table_name").alias("source_type"),
    )


ENTRY_FIELDS = ["term", "definition", "category", "synonyms", "confidence", "source_type"]


def autogen(tables: DataFrame, columns: DataFrame, existing: DataFrame) -> DataFrame:
    """Entries for all tables and columns whose term is not there yet, ignoring case.

    Inside a run the first wins: tables in id order, each before its own columns. ``min_by`` keeps
    one candidate per term with map-side combine.
    """
    t = from_tables(tables, columns).select(
        *ENTRY_FIELDS, F.struct(F.col("table_id"), F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("pos")).alias("at"))
    named = columns.join(tables.select("table_id", F.col("name").alias("table_name")), "table_id")
    c = from_columns(named.drop("category")).select(
        *ENTRY_FIELDS, F.struct(F.col("table_id"), F.lit(1).alias("kind"), F.col("pos")).alias("at"))
    first = t.unionByName(c).groupBy(F.lower("term").alias("term_key")).agg(
        F.min_by(F.struct(*ENTRY_FIELDS), "at").alias("e"))
    have = existing.select(F.lower("term").alias("term_key")).distinct()
    return first.join(have, "term_key", "left_anti").select("e.*")


def new_entries(incoming: DataFrame, existing: DataFrame, seq: str, ignore_case: bool = True,
                scope: list[str] = ()) -> DataFrame:
    """Incoming rows whose term does not exist; of repeats in one batch the first is kept."""
    key = F.lower("term") if ignore_case else F.col("term")
    cols = incoming.columns
    first = incoming.withColumn("term_key", key).groupBy(*scope, "term_key").agg(
        F.min_by(F.struct(*[c for c in cols if c not in scope]), seq).alias("e")).select(*scope, "term_key", "e.*")
    have = existing.select(*scope, key.alias("term_key")).distinct()
    return first.join(have, [*scope, "term_key"], "left_anti").select(*cols)


def upsert(incoming: DataFrame, existing: DataFrame, seq: str, overwrite: bool = False,
           scope: list[str] = ()) -> DataFrame:
    """Existing entries plus new ones; with ``overwrite`` the incoming row replaces an existing one."""
    if not overwrite:
        return existing.unionByName(new_entries(incoming, existing, seq, scope=scope), allowMissingColumns=True)
    keys = [*scope, "term_key"]
    inc = incoming.withColumn("term_key", F.lower("term"))
    last = inc.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in incoming.columns if c not in scope]), seq).alias("e")).select(*keys, "e.*")
    kept = existing.withColumn("term_key", F.lower("term")).join(last.select(*keys), keys, "left_anti")
    return kept.drop("term_key").unionByName(last.drop("term_key"), allowMissingColumns=True)


def import_mapped(df: DataFrame, mapping: dict[str, str], existing: DataFrame, seq: str,
                  overwrite: bool = False, scope: list[str] = ()) -> DataFrame:
    """Rename by ``mapping`` (source column to field), then merge into the dictionary."""
    renamed = df.select(*[F.col(f"`{src}`").alias(dst) for src, dst in mapping.items()])
    return upsert(renamed, existing, seq, overwrite, scope)


def filter_page(entries: DataFrame, search: str | None = None, category: str | None = None,
                status: str | None = None, tag: str | None = None) -> DataFrame:
    """Entries that pass every given filter; page with ``ops.page``."""
    out = entries
    if search:
        like = f"%{search}%"
        out = out.where(F.col("term").ilike(like) | F.col("definition").ilike(like)
                        | F.coalesce(F.col("context").ilike(like), F.lit(False)))
    if category:
        out = out.where(F.col("category") == category)
    if status:
        out = out.where(F.col("status") == status)
    if tag:
        out = out.where(F.array_contains("domain_tags", tag))
    return out


def search_like(entries: DataFrame, term: str) -> DataFrame:
    like = f"%{term}%"
    return entries.where(F.col("term").ilike(like) | F.col("definition").ilike(like)).orderBy("term", "entry_id")


def stats(entries: DataFrame) -> DataFrame:
    """(kind, name, n): counts by status and category with zeros, automatic and manual, total.

    One pass: every known value is its own conditional count.
    """
    counts = [("status", v, F.count_if(F.col("status") == v)) for v in rules.DICTIONARY_STATUS]
    counts += [("category", v, F.count_if(F.col("category") == v)) for v in rules.DICTIONARY_CATEGORY]
    counts += [
        ("origin", "auto", F.count_if("is_auto_generated")),
        ("origin", "manual", F.count(F.lit(1)) - F.count_if("is_auto_generated")),
        ("total", "entries", F.count(F.lit(1))),
    ]
    one = entries.agg(*[c.alias(f"c{i}") for i, (_, _, c) in enumerate(counts)])
    rows = [F.struct(F.lit(k).alias("kind"), F.lit(v).alias("name"), F.col(f"c{i}").alias("n"))
            for i, (k, v, _) in enumerate(counts)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def top_tags(entries: DataFrame, n: int = 10) -> DataFrame:
    return entries.select(F.explode("domain_tags").alias("tag")).groupBy("tag").agg(
        F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag").limit(n)


FINAL = {"approve": "approved", "reject": "rejected", "submit": "pending_review", "archive": "archived"}


def workflow_fold(log: DataFrame, entry: str = "entry_id", ts: str = "ts", tie: str = "event_id",
                  chunk: str = "day") -> DataFrame:
    """Replay a change log to the current state of every entry (start: draft, version 1).

    Approve raises the version; editing an approved entry makes it a draft and raises the version.
    A run is a status-setting action and what follows it; only the first edit of an approved run
    changes anything. Runs are folded per (entry, day) to one summary row, and the summaries per
    entry, so an entry that holds a third of the log is spread over its days.
    """
    sets = F.create_map(*[F.lit(x) for kv in FINAL.items() for x in kv])
    moved = F.try_element_at(sets, F.col("action"))
    inner = Window.partitionBy(entry, "chunk").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = (log.withColumn("moved", moved).withColumn("chunk", F.date_trunc(chunk, ts))
            .withColumn("run", F.count("moved").over(inner)))
    runs = step.groupBy(entry, "chunk", "run").agg(
        F.max("moved").alias("moved"), F.count_if(F.col("action") == "edit").alias("edits"),
        F.count_if(F.col("action") == "use").alias("uses"))
    approved, edited = F.col("moved") == "approved", F.col("edits") > 0
    runs = runs.withColumn("state", F.when(approved & edited, "draft").otherwise(F.col("moved")))
    parts = runs.groupBy(entry, "chunk").agg(
        F.count("moved").alias("moves"), F.count_if(approved).alias("approvals"),
        F.count_if(approved & edited).alias("demotions"), F.sum("uses").alias("uses"),
        F.bool_or(F.col("moved").isNull() & edited).alias("lead_edit"),
        F.max_by("state", "run").alias("end_state"),
    ).withColumn("end_state", F.when(F.col("moves") > 0, F.col("end_state")))
    outer = Window.partitionBy(entry).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    linked = parts.withColumn("grp", F.count_if(F.col("moves") > 0).over(outer)).withColumn(
        "start_state", F.last("end_state", ignorenulls=True).over(outer))
    groups = linked.groupBy(entry, "grp").agg(
        F.sum("approvals").alias("approvals"), F.sum("demotions").alias("demotions"), F.sum("uses").alias("uses"),
        F.bool_or("lead_edit").alias("lead_edit"), F.max("start_state").alias("start_state"),
        F.max_by("end_state", "chunk").alias("end_state"))
    late = (F.col("start_state") == "approved") & F.col("lead_edit")
    carried = F.when(late, "draft").otherwise(F.coalesce("start_state", F.lit("draft")))
    groups = groups.withColumn("state", F.coalesce("end_state", carried))
    return groups.groupBy(entry).agg(
        F.max_by("state", "grp").alias("status"),
        (F.lit(1) + F.sum("approvals") + F.sum("demotions") + F.count_if(late)).alias("version"),
        F.sum("uses").alias("usage_count"),
    )


def auto_accept(suggestions: DataFrame, existing: DataFrame, threshold: float = rules.AUTO_ACCEPT) -> DataFrame:
    return new_entries(suggestions.where(F.col("confidence") > threshold), existing, "seq")
