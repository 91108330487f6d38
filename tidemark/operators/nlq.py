"""Questions, entities, sessions, feedback and templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark import rules
from tidemark.functions.scalar import contains_any, first_rule, mean
from tidemark.operators.blocks import keep_topk
from tidemark.sources.scratch import stored

ANCHOR = 4


def confidence_level(score: Column) -> Column:
    return (
        F.when(score >= 0.9, "high")
        .when(score >= 0.7, "medium")
        .when(score >= 0.5, "low")
        .otherwise("uncertain")
    )


def extract_entities(questions: DataFrame, names: DataFrame, limit: int = rules.MAX_ENTITIES) -> DataFrame:
    """Catalog names inside each question. ``questions``: question_id, question; ``names``: type, name, seq.

    Two equi-joins and no pair table. First every position of a text is looked up by the next four
    characters (fewer for shorter names) in the list of keys, one row per key, which tells the
    lengths of the names that start so. Then the substring of each such length is looked up among
    the distinct names. The rows in between carry a short piece of text, not the text, and a key
    shared by a third of all names adds one row per name length only. Distinct names and keys are
    stored first: Spark knows their size then, and where they are small no position of a text is shuffled.
    """
    conf = F.when(F.col("type") == "table", 0.8).when(F.col("type") == "column", 0.7).otherwise(0.6)
    n = names.where(F.length("name") > 0).withColumn("confidence", conf)
    first = n.groupBy("name").agg(F.min_by(F.struct("type", "confidence", "seq"), F.struct((-F.col("confidence")).alias("c"), "seq")).alias("b"))
    distinct = stored(first.select("name", F.lower("name").alias("low"), "b.*"), "names")
    keyed = distinct.select(F.substring("low", 1, ANCHOR).alias("key"), F.length("low").alias("size"))
    keys = stored(keyed.groupBy("key").agg(F.collect_set("size").alias("sizes")), "keys")
    known = keys.agg(F.collect_set(F.length("key")).alias("k"), F.max(F.array_max("sizes")).alias("m")).first()
    key_sizes, longest = sorted(known["k"]), known["m"] or ANCHOR
    text_id = F.unhex(F.sha2("question", 256)).alias("text_id")
    texts = questions.select("question").where(F.length("question") > 0).distinct().select(text_id, F.lower("question").alias("text"))
    at = texts.select("text_id", F.posexplode(F.transform(
        F.sequence(F.lit(1), F.length("text")), lambda i: F.substring(F.col("text"), i, F.lit(longest)))).alias("position", "piece"))
    cuts = F.explode(F.array(*[F.when(F.length("piece") >= s, F.substring("piece", 1, s)) for s in key_sizes] or [F.lit(None).cast("string")]))
    probes = at.select("text_id", "position", "piece", cuts.alias("key")).where("key IS NOT NULL").join(keys, "key")
    found = probes.select("text_id", "position", "piece", F.explode("sizes").alias("size")).where(
        F.length("piece") >= F.col("size")).select("text_id", "position", F.expr("substring(piece, 1, size)").alias("low"))
    # only what is a name goes on to its text
    held = found.join(distinct.select("low"), "low", "left_semi")
    hits = held.groupBy("text_id", "low").agg(F.min("position").alias("position")).join(distinct, "low")
    top = keep_topk(hits, ["text_id"], [F.desc("confidence"), F.col("seq"), F.col("name")], limit)
    top = top.select("text_id", F.col("name").alias("entity"), "type", "confidence", "position", "rank")
    return questions.select("question_id", text_id).join(top, "text_id").drop("text_id")


def validate_entities(raw: DataFrame, threshold: float = rules.ENTITY_CONFIDENCE, limit: int = rules.MAX_ENTITIES) -> DataFrame:
    """Entities with text; missing type or confidence get defaults; the first ``limit`` per session stay."""
    conf = F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.5))
    kept = raw.where(F.col("entity").isNotNull()).withColumns(
        {"entity_type": F.coalesce("entity_type", F.lit("unknown")), "confidence": conf}).where(F.col("confidence") >= threshold)
    return keep_topk(kept, ["session_id"], [F.col("entity_id")], limit)


def query_confidence(sessions: DataFrame, entities: DataFrame) -> DataFrame:
    """Mean entity confidence per session, 0 without entities."""
    mean = entities.groupBy("session_id").agg(F.avg("confidence").alias("m"))
    return sessions.join(mean, "session_id", "left").select("session_id", F.round(F.coalesce("m", F.lit(0.0)), 6).alias("confidence"))


def words(c: str) -> Column:
    return F.filter(F.split(F.col(c), r"[\s\p{Z}]+"), lambda w: F.length(w) > 0)


def query_intent(questions: DataFrame, text: str = "question") -> DataFrame:
    """Intent by the first matching rule, complexity, word count and difficulty."""
    low = F.lower(text)
    intent = F.coalesce(first_rule(low, rules.INTENT_RULES), F.lit("unknown"))
    n = F.size(words(text))
    links = F.size(F.filter(words(text), lambda w: F.lower(w).isin(*rules.CONNECTIVES)))
    complexity = (
        F.when(n > 20, "complex")
        .when(contains_any(low, rules.COMPLEX_WORDS), "complex")
        .when(links > 2, "medium")
        .otherwise("simple")
    )
    return questions.withColumns({"intent": intent, "complexity": complexity, "word_count": n, "difficulty": query_difficulty(text)})


def query_difficulty(text: str) -> Column:
    low = F.lower(text)
    count = lambda ws: sum((F.contains(low, F.lit(w)).cast("int") for w in ws), F.lit(0))
    n = F.size(words(text))
    size = F.when(n > 30, 0.2).when(n > 15, 0.1).otherwise(0.0)
    score = 0.1 + count(rules.DIFFICULTY_INDICATORS) * 0.15 + F.least(count(rules.DIFFICULTY_CONDITIONS) * 0.05, F.lit(0.3)) + size
    return F.round(F.least(score, F.lit(1.0)), 6)


def context_lines(columns: DataFrame) -> DataFrame:
    """(table_id, pos, line): one prompt line per column with key, null and comment marks."""
    line = F.concat(
        F.lit("  "), "name", F.lit(" "), "data_type", F.when(F.col("is_primary_key"), " PRIMARY KEY").otherwise(""),
        F.when(~F.col("is_nullable"), " NOT NULL").otherwise(""),
        F.when(F.length("description") > 0, F.concat(F.lit(" -- "), "description")).otherwise(""))
    return columns.select("table_id", "pos", line.alias("line"))


def join_lines(lines: DataFrame, key: str, sep: str = "\n", chunk: int = 1000) -> DataFrame:
    """Lines per key as one text, by position; pre-joined in chunks so that a wide key is split."""
    inner = lines.groupBy(key, F.floor(F.col("pos") / chunk).alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l")).select(
        key, "part", F.array_join(F.transform("l", lambda s: s["line"]), sep).alias("t"))
    packed = F.array_sort(F.collect_list(F.struct("part", "t")))
    return inner.groupBy(key).agg(F.array_join(F.transform(packed, lambda s: s["t"]), sep).alias("lines"))


def schema_context(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """(table_id, context): the prompt text of each table."""
    body = join_lines(context_lines(columns), "table_id")
    full = F.concat_ws(".", "schema_name", "name")
    text = F.concat(F.lit("Table: "), full, F.lit("\n"), F.coalesce("lines", F.lit("")),
                    F.when(F.length("description") > 0, F.concat(F.lit("\nDescription: "), "description")).otherwise(""))
    return tables.join(body, "table_id", "left").select("table_id", text.alias("context"))


def session_contexts(mappings: DataFrame, contexts: DataFrame, columns: DataFrame) -> DataFrame:
    """(session_id, table_id, context) for tables mapped directly or through a column."""
    direct = mappings.where("target_type = 'table'").select("session_id", F.col("target_id").alias("table_id"))
    via = mappings.where("target_type = 'column'").join(
        columns.select(F.col("column_id").alias("target_id"), "table_id"), "target_id").select("session_id", "table_id")
    return direct.unionByName(via).distinct().join(contexts, "table_id")


def mapping_lines(mappings: DataFrame) -> DataFrame:
    """``table.column (type)`` or ``table (table)`` per mapping."""
    line = F.when(F.col("column").isNotNull(), F.concat("table", F.lit("."), "column", F.lit(" ("), F.coalesce("data_type", F.lit("unknown")), F.lit(")"))
                  ).otherwise(F.concat("table", F.lit(" (table)")))
    return mappings.withColumn("line", line)


def foreign_key_hints(columns: DataFrame, tables: DataFrame) -> DataFrame:
    named = columns.where("is_foreign_key").join(tables.select("table_id", F.col("name").alias("table")), "table_id")
    return named.select("table_id", "column_id", F.concat("table", F.lit("."), "name", F.lit(" references another table")).alias("hint"))


def session_funnel(sessions: DataFrame, steps: list[str]) -> DataFrame:
    """Sessions by status: count, with result, with feedback, mean and sum of the step times."""
    times = F.filter(F.array(*steps), lambda x: x.isNotNull())
    total = F.when(F.size(times) > 0, F.aggregate(times, F.lit(0.0), lambda a, x: a + x))
    s = sessions.withColumn("total_time", F.when(F.col("status") == "completed", total))
    return s.groupBy("status").agg(
        F.count(F.lit(1)).alias("sessions"), F.count("sql_result").alias("with_result"),
        F.count("user_feedback").alias("with_feedback"), mean("total_time", 4).alias("avg_total_time"))


def feedback_summary(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy("feedback_type", "step").agg(
        F.count(F.lit(1)).alias("n"), F.count("rating").alias("rated"), mean("rating", 4).alias("avg_rating"))


def latest_feedback(feedback: DataFrame) -> DataFrame:
    """The last feedback per (session, step); ``max_by`` combines map-side."""
    order = F.struct("created_at", "feedback_id")
    return feedback.groupBy("session_id", "step").agg(
        F.max_by(F.struct("feedback_id", "feedback_type", "rating"), order).alias("f")).select("session_id", "step", "f.*")


def template_pattern(pattern: str) -> str:
    body = pattern.replace("{entity}", rules.TEMPLATE_ENTITY).replace("{value}", rules.TEMPLATE_VALUE)
    return f"(?iU){body}"


def template_match(questions: DataFrame, templates: list[tuple[int, str]], text: str = "question") -> DataFrame:
    """(…, template_id) for every template found in a question.

    Templates are a short rule list, so each is a constant pattern compiled once; there is no join.
    """
    hits = F.array_compact(F.array(*[
        F.when(F.col(text).rlike(template_pattern(p)), F.lit(i)) for i, p in templates]))
    return questions.withColumn("template_id", F.explode(hits))


def template_success(uses: DataFrame) -> DataFrame:
    """``uses``: template_id, success. The running rate ends at the mean."""
    return uses.groupBy("template_id").agg(
        F.count(F.lit(1)).alias("usage_count"), mean(F.col("success").cast("int"), 6).alias("success_rate"))


def mapped_split(sessions: DataFrame, mappings: str = "mappings", entities: str = "entities", entity_type: str = "table") -> DataFrame:
    """Mapped tables, mapped columns and entities of one type out of a session's arrays."""
    none = F.col(mappings)
    return sessions.withColumns({
        "mapped_tables": F.filter(none, lambda m: m["target_type"] == "table"),
        "mapped_columns": F.filter(none, lambda m: m["target_type"] == "column"),
        "typed_entities": F.filter(F.col(entities), lambda e: e["type"] == entity_type),
    })
