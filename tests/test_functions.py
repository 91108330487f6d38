"""Column functions on literal rows; expected values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import match, nlq, profile, sqlguard


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()[0]


L = F.lit


@pytest.mark.parametrize("fn,arg,want", [
    (S.clean_table_name, "  my file (2).csv", "my_file_2_csv"),
    (S.clean_table_name, "2024 sales", "table_2024_sales"),
    (S.clean_table_name, "%%%", "unnamed_table"),
    (S.clean_table_name, "x" * 80, "x" * 50),
    (S.clean_column_name, "9 lives", "col_9_lives"),
    (S.clean_column_name, "   ", "unnamed_column"),
    (S.clean_column_name, "été", "t"),
    (S.clean_identifier, "Order--ID", "order_id"),
    (S.clean_identifier, "1A", "col_1a"),
    (S.normalize_text, "A_b-c..d \n e", "a b c d e"),
    (S.generate_slug, "Hello,  World! _x_", "hello-world-x"),
    (S.generate_slug, "a" * 49 + " bc", "a" * 49),
    (S.title_case, "o'neil 2nd_place", "O'Neil 2Nd_Place"),
    (S.sanitize_filename, "a<b>:c?.txt. ", "a_b__c_.txt"),
    (S.sanitize_filename, "n" * 300 + ".csv", "n" * 251 + ".csv"),
    (S.mask_sensitive, "123456789", "*****6789"),
    (S.mask_sensitive, "123", "***"),
    (S.truncate_text, "x" * 101, "x" * 97 + "..."),
    (S.truncate_text, "x" * 100, "x" * 100),
    (S.sha256_hex, "a", "ca978112ca1bbdcafac231b39a23dc4da786eff8147c4e72b9807785afee48bb"),
])
def test_text(spark, fn, arg, want):
    assert one(spark, fn(L(arg))) == want


@pytest.mark.parametrize("size,want", [
    (0, "0B"), (1, "1.0 B"), (1023, "1023.0 B"), (1024, "1.0 KB"), (1536, "1.5 KB"),
    (1024**2, "1.0 MB"), (1024**3 * 5, "5.0 GB"), (1024**4 * 3, "3.0 TB"),
])
def test_file_size(spark, size, want):
    assert one(spark, S.format_file_size(L(size))) == want


@pytest.mark.parametrize("sec,want", [(0.5, "500ms"), (1.0, "1.0s"), (59.94, "59.9s"), (61.0, "1m 1s"), (3725.0, "1h 2m")])
def test_duration(spark, sec, want):
    assert one(spark, S.format_duration(L(sec))) == want


def test_null_inputs(spark):
    null = F.lit(None).cast("string")
    assert one(spark, S.clean_table_name(null)) == "unnamed_table"
    assert one(spark, S.normalize_text(null)) == ""
    assert one(spark, S.generate_slug(null)) == ""
    assert one(spark, S.mask_sensitive(null)) == ""
    assert one(spark, S.format_timestamp(F.lit(None).cast("timestamp"))) == ""
    assert one(spark, S.format_file_size(F.lit(None).cast("bigint"))) is None
    assert one(spark, S.truncate_text(null)) is None


def test_keywords_keep_first_seen_order(spark):
    got = one(spark, S.extract_keywords(L("The cat and the dog; CAT éclair to x2y sun")))
    assert got == ["cat", "dog", "sun"]


def test_connection_string(spark):
    got = one(spark, S.parse_connection_string(L("mysql://u:p@h:99/d/e?x=1")))
    assert got.asDict() == {"driver": "mysql", "username": "u", "password": "p", "host": "h", "port": 99, "database": "d/e?x=1"}
    assert one(spark, S.parse_connection_string(L("nonsense"))) is None


@pytest.mark.parametrize("text,intent,complexity,words", [
    ("Show me customers", "retrieve", "simple", 3),
    ("count by region", "aggregate", "simple", 3),
    ("a and b or c where d", "unknown", "medium", 7),
    ("growth join", "trend", "complex", 2),
    ("", "unknown", "simple", 0),
])
def test_intent(spark, text, intent, complexity, words):
    df = nlq.query_intent(spark.createDataFrame([(text,)], "question string"))
    r = df.first()
    assert (r["intent"], r["complexity"], r["word_count"]) == (intent, complexity, words)


def test_difficulty_adds_up(spark):
    # 0.1 base, 0.15 each for join and group by, 0.05 each for and / or (inside "for")
    df = spark.createDataFrame([("join a and group by b for c",)], "question string")
    assert df.select(nlq.query_difficulty("question")).first()[0] == pytest.approx(0.5)


def test_search_terms(spark):
    got = one(spark, match.search_terms(L("orderTotal_net"), None, L("the total of all orders")))
    assert got == sorted({"ordertotal_net", "ordertotal net", "ordertotalnet", "order total_net", "total", "all", "orders"})


@pytest.mark.parametrize("name,want", [
    ("order_id", "identifier"), ("created_at", "temporal"), ("unit_price", "financial"), ("discount", "quantity"),
    ("status", "categorical"), ("title", "descriptive"), ("city", "geographic"), ("blob", "attribute"),
])
def test_business_category(spark, name, want):
    assert one(spark, profile.business_category(L(name), L(False), L(1), L(10))) == want


@pytest.mark.parametrize("distinct,rows,want", [(5, 100, "categorical"), (50, 100, "measure"), (0, 0, "categorical")])
def test_business_category_numeric(spark, distinct, rows, want):
    assert one(spark, profile.business_category(L("blob"), L(True), L(distinct), L(rows))) == want


@pytest.mark.parametrize("text,want", [
    ("before\n```sql\nSELECT 1\n```\nafter", "SELECT 1"),
    ("Use select a,\n b from t\n\nbye", "select a,\n b from t"),
    ("  nothing here ", "nothing here"),
])
def test_sql_extract(spark, text, want):
    assert one(spark, sqlguard.sql_extract(L(text))) == want


@pytest.mark.parametrize("text,want", [
    ("select '--x' -- c\n from t /* y */", "select '--x' from t LIMIT 5;"),
    ("select 1 limit 3;", "select 1 limit 3;"),
])
def test_sql_normalize(spark, text, want):
    assert one(spark, sqlguard.sql_normalize(L(text), 5)) == want


def test_normalize_is_idempotent(spark):
    for text in ["A-b__C", "  x . y ", "é_ß"]:
        once = S.normalize_text(L(text))
        assert one(spark, once) == one(spark, S.normalize_text(once))
