"""File sources and sinks on files that Spark writes from the tables."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tidemark import rules
from tidemark.functions import scalar as S
from tidemark.operators import clean
from tidemark.plans.registry import ORACLES, query
from tidemark.plans import retrieval
from tidemark.sources import files, sinks
from tidemark.sources.scratch import scratch_dir


def written(t, df: DataFrame, fmt: str, name: str, **options) -> str:
    path = f"{scratch_dir(t.spark, 'files')}/{name}"
    df.write.format(fmt).options(**options).save(path)
    return path


@query("csv_sniff", "SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS o_orderstatus, o_totalprice, o_orderdate FROM orders")
def csv_sniff(t):
    src = t.orders.select("o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).otherwise("N/A").alias("o orderstatus"),
                          "o_totalprice", "o_orderdate")
    path = written(t, src, "csv", "orders.csv", header=True, sep=";")
    raw = files.read_csv(t.spark, path)
    return clean.rename_clean(clean.coerce_types(raw))


@query("csv_scan", "SELECT p_partkey::VARCHAR AS p_partkey, p_name, p_brand, p_retailprice::VARCHAR AS p_retailprice, 'part_list' AS table_name FROM part")
def csv_scan(t):
    src = t.part.select("p_partkey", "p_name", "p_brand", "p_retailprice")
    name, df = files.scan_csv(t.spark, written(t, src, "csv", "Part List.csv", header=True))
    return df.withColumn("table_name", F.lit(name))


def json_source(t) -> str:
    """One JSON record per order with two arrays and nested objects."""
    item = lambda k, p: F.struct(k.alias("k"), F.struct(p.alias("price")).alias("cost"))
    src = t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.struct(F.col("o_orderstatus").alias("status"), F.struct(F.col("o_orderpriority").alias("prio")).alias("inner")).alias("meta"),
        F.array(item(F.col("o_orderkey"), F.col("o_totalprice")), item(-F.col("o_orderkey"), F.col("o_totalprice") * 2)).alias("items"),
        F.array(F.struct(F.col("o_custkey").alias("who"))).alias("people"))
    return written(t, src, "json", "orders.json")


@query("json_scan", "SELECT o_orderkey AS k, o_totalprice AS price FROM orders UNION ALL SELECT -o_orderkey, o_totalprice * 2 FROM orders")
def json_scan(t):
    path = json_source(t)
    first = files.first_array_key_of(t.spark, path)
    rows = files.scan_json(files.read_json(t.spark, path, lines=True), first)
    return files.flatten(rows).select("k", F.col("`cost.price`").alias("price"))


@query(
    "json_multi_table",
    """SELECT 'orders_items' AS "table", o_orderkey AS v FROM orders UNION ALL SELECT 'orders_items', -o_orderkey FROM orders
       UNION ALL SELECT 'orders_people', o_custkey FROM orders""",
)
def json_multi_table(t):
    parts = files.json_tables(files.read_json(t.spark, json_source(t), lines=True), "orders")
    first = {"orders_items": "k", "orders_people": "who"}
    return reduce(DataFrame.unionByName, [df.select(F.lit(n).alias("table"), F.col(first[n]).alias("v")) for n, df in parts.items()])


@query("json_flatten", "SELECT o_orderkey AS id, o_orderpriority AS meta_inner_prio, o_orderstatus AS meta_status, 2 AS n_items FROM orders")
def json_flatten(t):
    flat = files.flatten(files.read_json(t.spark, json_source(t), lines=True))
    return clean.rename_clean(flat).select("id", "meta_inner_prio", "meta_status", F.size("items").alias("n_items"))


@query("json_text_column", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS props_k FROM events")
def json_text_column(t):
    df = t.events.select("event_id", F.from_json("props", "k bigint").alias("props"))
    return clean.rename_clean(files.flatten(df))


@query("export_json", "SELECT entry_id, term, array_to_string(synonyms, ',') AS synonyms FROM cat_entries WHERE status = 'approved'")
def export_json(t):
    path = f"{scratch_dir(t.spark, 'export')}/entries"
    sinks.export(sinks.export_rows(t.cat_entries, statuses=["approved"]), path, "json")
    return t.spark.read.schema(t.cat_entries.schema).json(path).select("entry_id", "term", F.array_join("synonyms", ",").alias("synonyms"))


@query("export_csv", "SELECT term, definition, category FROM cat_entries WHERE category = 'metric'")
def export_csv(t):
    path = f"{scratch_dir(t.spark, 'export')}/entries"
    sinks.export(sinks.export_rows(t.cat_entries, categories=["metric"], include_metadata=False), path, "csv")
    return t.spark.read.option("header", True).csv(path)


@query("index_save_load", ORACLES["tfidf_search"])
def index_save_load(t):
    path = f"{scratch_dir(t.spark, 'index')}/tfidf"
    sinks.save_index(retrieval.tfidf_parts(t), path, {"type": "tfidf"})
    index, _ = sinks.load_index(t.spark, path)
    return retrieval.tfidf_hits(index, t.benchmark, "item_id", "text", 10, rules.SEARCH_MIN_SCORE)


@query("workbook_names", "SELECT page_id, lower(trim(regexp_replace('book_' || url, '[^a-zA-Z0-9]+', '_', 'g'), '_')) AS table_name FROM pages")
def workbook_names(t):
    """Names of workbook tables: file stem and sheet, cleaned."""
    return t.pages.select("page_id", S.clean_identifier(F.concat(F.lit("book_"), "url")).alias("table_name"))
