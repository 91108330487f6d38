"""SQL text: audit and clean-up of whole logs, and guarded execution of single statements."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark import rules


def _has(up: Column, word: str, mode: str) -> Column:
    return up.rlike(rf"\b{word}\b") if mode == "word" else F.contains(up, F.lit(word))


def sql_audit(log: DataFrame, text: str = "sql_text", mode: str = "substring") -> DataFrame:
    """Three rule sets per statement: chat_ok, service_error (null when fine), admin_ok.

    ``substring`` is the historical test, so ``created_at`` counts as CREATE; ``word`` asks for
    whole words.
    """
    up = F.upper(F.coalesce(F.col(text), F.lit("")))
    trimmed = F.regexp_replace(up, r"^\s+|\s+$", "")
    select_first = F.startswith(trimmed, F.lit("SELECT"))
    forbidden = F.lit(False)
    for w in rules.SQL_FORBIDDEN_CHAT:
        forbidden = forbidden | _has(up, w, mode)
    error = F.when(trimmed == "", "Empty SQL query")
    for w in rules.SQL_BLOCKED_SERVICE:
        error = error.when(_has(up, w, mode), f"Blocked keyword detected: {w}")
    allowed = F.lit(False)
    for w in rules.SQL_ALLOWED_SERVICE:
        allowed = allowed | _has(up, w, mode)
    error = error.when(~allowed, "Query must contain one of: " + ", ".join(rules.SQL_ALLOWED_SERVICE))
    return log.withColumns({"chat_ok": select_first & ~forbidden, "service_error": error, "admin_ok": select_first})


LITERAL_OR_COMMENT = r"(?s)('(?:[^']|'')*')|--[^\n]*|/\*.*?\*/"


def sql_normalize(c: Column, limit: int | None = None, mode: str = "full") -> Column:
    """One-line statement that ends in ``;``.

    ``full`` drops all comments (string literals are left alone); ``lines`` only whole-line ``--``.
    ``limit`` is added unless the text already mentions LIMIT.
    """
    if mode == "lines":
        kept = F.filter(F.transform(F.split(c, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")),
                        lambda x: (x != "") & ~F.startswith(x, F.lit("--")))
        body = F.array_join(kept, " ")
        out = F.when((body == "") | F.endswith(body, F.lit(";")), body).otherwise(F.concat(body, F.lit(";")))
    else:
        body = F.regexp_replace(c, LITERAL_OR_COMMENT, "$1")
        body = F.regexp_replace(F.regexp_replace(body, r"\s+", " "), "^ | $", "")
        out = F.when(F.endswith(body, F.lit(";")), body).otherwise(F.concat(body, F.lit(";")))
    if limit is None:
        return out
    has = F.contains(F.upper(out), F.lit("LIMIT"))
    return F.when(has, out).otherwise(F.concat(F.regexp_replace(out, ";+$", ""), F.lit(f" LIMIT {limit};")))


def sql_extract(c: Column) -> Column:
    """SQL out of free text: a fenced block, else the first SELECT paragraph, else the text itself."""
    fenced = F.regexp_extract(c, r"(?s)```sql\n(.*?)\n```", 1)
    plain = F.regexp_extract(c, r"(?is)SELECT\s+.*?(?=\n\n|\n$|$)", 0)
    strip = lambda x: F.regexp_replace(x, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    return F.when(c.rlike(r"(?s)```sql\n(.*?)\n```"), strip(fenced)).when(plain != "", strip(plain)).otherwise(strip(c))


_ITEM = r"[a-zA-Z_][\w.]*(?:\s+(?:as\s+)?(?!(?:where|join|on|group|order|limit|left|right|inner|cross|full|union|having)\b)[a-zA-Z_]\w*)?"
TABLE_LIST = rf"(?i)\b(?:from|join)\s+({_ITEM}(?:\s*,\s*{_ITEM})*)"


def sql_table_refs(log: DataFrame, known: DataFrame, key: str = "stmt_id", text: str = "sql_text") -> DataFrame:
    """(key, table_name, known) for names after FROM or JOIN, comma lists included."""
    lists = F.regexp_extract_all(sql_normalize(F.col(text)), F.lit(TABLE_LIST), F.lit(1))
    item = F.explode(F.split(F.array_join(lists, ","), r"\s*,\s*")).alias("item")
    names = log.select(key, item).select(key, F.lower(F.regexp_extract("item", r"^\s*([a-zA-Z_][\w.]*)", 1)).alias("table_name"))
    names = names.where("table_name <> ''").distinct()
    have = known.select(F.lower("name").alias("table_name")).distinct().withColumn("known", F.lit(True))
    return names.join(have, "table_name", "left").select(key, "table_name", F.coalesce("known", F.lit(False)).alias("known"))


def sql_confidence(statements: DataFrame, mapped: DataFrame, base: float = 0.5) -> DataFrame:
    """``statements``: stmt_id, user_id, sql_text, ``mapped``: user_id, table_name.

    0.1 more per mapped table whose name is in the text, at most 0.3; a blank text scores 0.
    """
    m = mapped.select("user_id", F.lower("table_name").alias("table_name")).distinct()
    low = statements.select("stmt_id", "user_id", F.lower("sql_text").alias("low"))
    hits = low.join(m, "user_id").where(F.contains("low", F.col("table_name"))).groupBy("stmt_id").agg(
        F.count(F.lit(1)).alias("table_matches"))
    n = F.coalesce("table_matches", F.lit(0))
    blank = F.regexp_replace(F.coalesce("sql_text", F.lit("")), r"\s+", "") == ""
    conf = F.when(blank, 0.0).when(n > 0, F.least(F.lit(1.0), base + F.least(F.lit(0.3), n * 0.1))).otherwise(F.lit(base))
    return statements.join(hits, "stmt_id", "left").select("stmt_id", n.alias("table_matches"), F.round(conf, 6).alias("confidence"))


class UnsafeSql(ValueError):
    """The statement is not a plain query over the registered views."""


def check_plan(spark: SparkSession, sql: str, views: set[str]) -> set[str]:
    """Parse without running and walk the plan by scope; returns the view names the query reads.

    Only the plan nodes of plain queries and the functions in ``rules.SQL_FUNCTIONS`` are let through; a
    relation must be a view, or a CTE that is in scope where it is named.
    """
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    loader = spark._jvm.java.lang.Thread.currentThread().getContextClassLoader()
    subquery = loader.loadClass("org.apache.spark.sql.catalyst.expressions.SubqueryExpression")
    known, read = {v.lower() for v in views}, set()

    def items(seq):
        return [seq.apply(i) for i in range(seq.size())]

    def expression(node, scope: frozenset[str]) -> None:
        kind = node.getClass().getSimpleName()
        if kind in ("UnresolvedFunction", "UnresolvedGenerator"):
            parts = items(node.nameParts()) if kind == "UnresolvedFunction" else [node.name().funcName()]
            name = ".".join(parts).lower()
            if name not in rules.SQL_FUNCTIONS:
                raise UnsafeSql(f"function {name} is not allowed")
        if subquery.isInstance(node):
            walk(node.plan(), scope)
        for child in items(node.children()):
            expression(child, scope)

    def walk(node, scope: frozenset[str]) -> None:
        kind = node.getClass().getSimpleName()
        if kind not in rules.SQL_PLAN_NODES:
            raise UnsafeSql(f"only queries are allowed, not {kind}")
        if kind == "UnresolvedRelation":
            name = ".".join(items(node.multipartIdentifier())).lower()
            if name not in scope:
                if name not in known:
                    raise UnsafeSql(f"unknown table {name}")
                read.add(name)
        if kind == "UnresolvedWith":
            for cte in items(node.cteRelations()):
                name = cte._1().lower()
                walk(cte._2(), scope | {name} if node.allowRecursion() else scope)
                scope = scope | {name}
        for e in items(node.expressions()):
            expression(e, scope)
        for child in items(node.children()):
            walk(child, scope)

    walk(plan, frozenset())
    return read


@dataclass
class GuardedResult:
    columns: list[str]
    rows: list[tuple]
    row_count: int
    has_more: bool
    is_preview: bool = False


def guarded_query(spark: SparkSession, sql: str, views: dict[str, DataFrame], max_rows: int | None = None) -> DataFrame:
    """Checked query as a lazy DataFrame over ``views`` only: all rows.

    With ``max_rows`` at most so many, and a column ``has_more`` that tells whether there are others.
    """
    text = sql.strip().rstrip(";").strip()
    if not text:
        raise UnsafeSql("empty SQL query")
    used = check_plan(spark, text, set(views))
    frames = {k.lower(): v for k, v in views.items() if k.lower() in used}
    # the views go in as CTEs over the frames, so nothing is registered in the session
    body = text.replace("{", "{{").replace("}", "}}")
    if frames:
        ctes = ", ".join(f"{k} AS (SELECT * FROM {{{k}}})" for k in sorted(frames))
        own = re.match(r"(?is)\s*with\s", body)
        body = f"WITH {ctes}, {body[own.end():]}" if own else f"WITH {ctes} {body}"
    out = spark.sql(body, **frames)
    if max_rows is None:
        return out
    head = out.limit(max_rows + 1)
    return head.limit(max_rows).withColumn("has_more", head.agg(F.count(F.lit(1)) > max_rows).scalar())


def run_guarded(spark: SparkSession, sql: str, views: dict[str, DataFrame], max_rows: int = rules.SQL_MAX_ROWS,
                preview: bool = False) -> GuardedResult:
    """Fetch at most ``max_rows`` rows; one more is asked for to know whether there are others."""
    df = guarded_query(spark, sql, views).limit(max_rows + 1)
    rows = [tuple(r) for r in df.collect()]
    return GuardedResult(df.columns, rows[:max_rows], min(len(rows), max_rows), len(rows) > max_rows, preview)


def preview_sql(spark: SparkSession, sql: str, views: dict[str, DataFrame]) -> GuardedResult:
    return run_guarded(spark, sql, views, rules.SQL_PREVIEW_ROWS, preview=True)
