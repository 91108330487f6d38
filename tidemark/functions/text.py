"""Tokens, n-grams and object texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark import rules
from tidemark.operators.dictionary import first_columns

TOKEN = r"[\p{L}\p{N}_]{2,}"


def tokens(c, stop_words=None) -> Column:
    """Lower-case word tokens of two characters or more, stop words removed."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))
    stop = rules.KEY_TERM_STOP_WORDS if stop_words is None else stop_words
    if not stop:
        return out
    return F.filter(out, lambda w: ~w.isin(*stop))


def ngrams(toks: Column, n_max: int = 2) -> Column:
    """All 1..n_max grams of a token array, joined by a space."""
    out = toks
    for n in range(2, n_max + 1):
        shifted = [F.slice(toks, i + 1, F.greatest(F.size(toks) - (n - 1), F.lit(0))) for i in range(n)]
        grams = F.transform(F.arrays_zip(*[s.alias(f"t{i}") for i, s in enumerate(shifted)]),
                            lambda z: F.concat_ws(" ", *[z[f"t{i}"] for i in range(n)]))
        out = F.concat(out, grams)
    return out


def _different(c: str, other: str) -> Column:
    return F.when(F.col(c) != F.col(other), F.col(c))


def _non_empty(c: Column) -> Column:
    return F.when(F.length(c) > 0, c)


def table_text(tables: DataFrame, columns: DataFrame, mode: str = "short") -> DataFrame:
    """(table_id, text). ``short``: first ten column names, space-joined; ``full``: all, with bars.

    The full list is joined per (table, chunk of positions) first, then per table, so the names of
    a very wide table are pre-joined on many tasks.
    """
    if mode == "short":
        names = first_columns(columns, 10).select(
            "table_id", F.concat(F.lit("Columns: "), F.array_join("names", ", ")).alias("names"))
        sep = " "
    else:
        names = joined_names(columns, " ")
        sep = " | "
    t = tables.join(names, "table_id", "left")
    text = F.concat_ws(sep, "name", _different("display_name", "name"), _non_empty(F.col("description")), "names")
    return t.select("table_id", text.alias("text"))


def joined_names(columns: DataFrame, sep: str, chunk: int = 1000) -> DataFrame:
    part = F.floor(F.col("pos") / chunk)
    inner = columns.groupBy("table_id", part.alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("l"))
    inner = inner.select("table_id", "part", F.array_join(F.transform("l", lambda s: s["name"]), sep).alias("s"))
    packed = F.array_sort(F.collect_list(F.struct("part", "s")))
    return inner.groupBy("table_id").agg(
        F.array_join(F.transform(packed, lambda s: s["s"]), sep).alias("names"))


def column_text(columns: DataFrame, tables: DataFrame, mode: str = "short") -> DataFrame:
    """(column_id, text) with up to five sample values."""
    samples = F.slice("sample_values", 1, 5)
    head = ["name", _different("display_name", "name"), _non_empty(F.col("description"))]
    if mode == "short":
        c = columns.join(tables.select("table_id", F.col("name").alias("table_name")), "table_id")
        category = F.when(F.length("business_category") > 0, F.concat(F.lit("Category: "), "business_category"))
        shown = F.when(F.size("sample_values") > 0, F.concat(F.lit("Examples: "), F.array_join(samples, ", ")))
        text = F.concat_ws(" ", *head, F.concat(F.lit("Table: "), "table_name"), F.concat(F.lit("Type: "), "data_type"), category, shown)
        return c.select("column_id", text.alias("text"))
    shown = F.when(F.size("sample_values") > 0, F.array_join(samples, " "))
    return columns.select("column_id", F.concat_ws(" | ", *head, "data_type", shown).alias("text"))


def dictionary_text(entries: DataFrame, mode: str = "short") -> DataFrame:
    """(entry_id, text)."""
    if mode == "short":
        listed = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(f"{label}: "), F.array_join(c, ", ")))
        domain = F.when(F.length("domain") > 0, F.concat(F.lit("Domain: "), "domain"))
        text = F.concat_ws(" ", "term", "definition", listed("Synonyms", "synonyms"), listed("Abbreviations", "abbreviations"), domain)
    else:
        text = F.concat_ws(" | ", "term", _non_empty(F.col("definition")), "synonyms", "abbreviations", _non_empty(F.col("context")))
    return entries.select("entry_id", text.alias("text"))


def collect_objects(tables: DataFrame, columns: DataFrame, entries: DataFrame, mode: str = "short",
                    types=("table", "column", "dictionary_entry")) -> DataFrame:
    """(object_type, object_id, text, metadata) of everything to embed; archived entries stay out."""
    parts = []
    meta = lambda *kv: F.map_filter(F.create_map(*[x for k, v in kv for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
    if "table" in types:
        t = table_text(tables, columns, mode).join(tables.select("table_id", "name", "source_id"), "table_id")
        parts.append(t.select(F.lit("table").alias("object_type"), F.col("table_id").alias("object_id"), "text",
                              meta(("table_name", F.col("name")), ("source_id", F.col("source_id").cast("string"))).alias("metadata")))
    if "column" in types:
        c = column_text(columns, tables, mode).join(columns.select("column_id", "name", "table_id"), "column_id")
        parts.append(c.select(F.lit("column").alias("object_type"), F.col("column_id").alias("object_id"), "text",
                              meta(("column_name", F.col("name")), ("table_id", F.col("table_id").cast("string"))).alias("metadata")))
    if "dictionary_entry" in types:
        live = entries.where(F.col("status") != "archived")
        e = dictionary_text(live, mode).join(live.select("entry_id", "term", "category", "domain"), "entry_id")
        parts.append(e.select(F.lit("dictionary_entry").alias("object_type"), F.col("entry_id").alias("object_id"), "text",
                              meta(("term", F.col("term")), ("category", F.col("category")), ("domain", F.col("domain"))).alias("metadata")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
