"""Sniffing, JSON shapes, inventories, introspection, option sets."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import clean
from tidemark.sources import files, introspect, jdbc, sinks


@pytest.mark.parametrize("data,want", [
    (b"a,b\n1,2\n", (",", "UTF-8")),
    (b"a;b\n1;2\n", (";", "UTF-8")),
    (b"a\tb\n1\t2\n", ("\t", "UTF-8")),
    (b"a|b\n1|2\n", ("|", "UTF-8")),
    ("n;v\né;2\n".encode("latin-1"), (";", "ISO-8859-1")),
    (b"only\n1\n", (",", "UTF-8")),
    (b"a,b\n", (",", "UTF-8")),
    (b"", (",", "UTF-8")),
])
def test_sniff(spark, tmp_path, data, want):
    (tmp_path / "x.csv").write_bytes(data)
    assert list(files.sniff_csv(spark, str(tmp_path / "x.csv"))) == [want]


def test_the_whole_file_decides_its_encoding(spark, tmp_path):
    late = b"a;b\n" + b"plain;1\n" * 200_000 + "Jos\u00e9;2\n".encode("latin-1")
    (tmp_path / "1.csv").write_bytes(late)
    (tmp_path / "2.csv").write_bytes("a,b\nZo\u00eb,3\n".encode())
    got = files.read_csv(spark, str(tmp_path)).where("a <> 'plain'")
    assert sorted(map(tuple, got.collect())) == [("Jos\u00e9", "2"), ("Zo\u00eb", "3")]


def test_csv_with_latin1_and_null_tokens(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes("name;n v\nJosé;1\nN/A;2.5\nnull;\n".encode("latin-1"))
    df = clean.rename_clean(clean.coerce_types(files.read_csv(spark, str(tmp_path / "x.csv"))))
    assert [tuple(r) for r in df.orderBy("n_v").collect()] == [(None, None), ("José", 1.0), (None, 2.5)]


def test_csv_quotes(spark, tmp_path):
    (tmp_path / "q.csv").write_text('a,b\n"x ""y"", z",1\n')
    assert files.read_csv(spark, str(tmp_path / "q.csv"), sep=",").first()["a"] == 'x "y", z'


def test_scan_csv_names_table(spark, tmp_path):
    (tmp_path / "My Sales.csv").write_text("Order ID,Total\n1,2\n")
    name, df = files.scan_csv(spark, str(tmp_path / "My Sales.csv"))
    assert (name, df.columns) == ("my_sales", ["order_id", "total"])


def test_json_list_and_single_object(spark, tmp_path):
    (tmp_path / "l.json").write_text('[{"a": {"b": 1}, "c": [1]}, {"a": {"b": 2}}]')
    (tmp_path / "o.json").write_text('{"a": 1, "b": "x"}')
    flat = files.flatten(files.scan_json(files.read_json(spark, str(tmp_path / "l.json")).select("a")))
    assert flat.columns == ["a.b"] and flat.count() == 2
    assert files.scan_json(files.read_json(spark, str(tmp_path / "o.json"))).count() == 1


def test_first_array_key_is_by_file_order(spark, tmp_path):
    assert files.first_array_key([b'{"meta": {"list": [1]}, "z": [{"k": 1}], "a": [2]}']) == "z"
    assert files.first_array_key([b'{"s": "x[\\"y", "n": 1}']) is None
    assert files.first_array_key([b"[1]"]) is None
    assert files.first_array_key([b'{"n": 1}\n', b'{"a": [1]}']) is None
    text = '{"meta": "' + "x\\u00e9" * 300_000 + '", "zeta": [{"k": 1}], "alpha": [{"v": 2}]}'
    assert files.first_array_key([text.encode()[i : i + 7777] for i in range(0, len(text), 7777)]) == "zeta"
    (tmp_path / "late.json").write_text(text)
    path = str(tmp_path / "late.json")
    assert files.first_array_key_of(spark, path) == "zeta"
    df = files.read_json(spark, path)
    assert files.scan_json(df, "zeta").first()["k"] == 1
    with pytest.raises(ValueError):
        files.scan_json(df)


def test_first_array_key_passes_files_without_records(spark, tmp_path):
    (tmp_path / "part-0.json").write_text("")
    (tmp_path / "part-1.json").write_text("\n" + " " * (1 << 17))
    (tmp_path / "part-2.json").write_text('{"n": 1, "z": [{"k": 1}], "a": [2]}\n')
    assert files.first_array_key_of(spark, str(tmp_path)) == "z"
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "part-0.json").write_text("")
    assert files.first_array_key_of(spark, str(tmp_path / "none")) is None


def test_json_tables(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"z": [{"k": 1}, {"k": 2}], "a": [{"v": "x"}], "n": 3}')
    df = files.read_json(spark, str(tmp_path / "m.json"))
    assert {k: v.count() for k, v in files.json_tables(df, "m").items()} == {"m_a": 1, "m_z": 2}
    assert files.scan_json(df, "z").count() == 2


def test_inventory(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x" * 10)
    (tmp_path / "b.exe").write_text("x")
    (tmp_path / "c.JSON").write_text("x" * 30)
    got = {r["filename"]: (r["extension"], r["size"], r["allowed"]) for r in files.file_inventory(spark, str(tmp_path), max_bytes=20).collect()}
    assert got == {"a.csv": ("csv", 10, True), "b.exe": ("exe", 1, False), "c.JSON": ("json", 30, False)}


def test_workbooks(spark, tmp_path):
    openpyxl = pytest.importorskip("openpyxl")
    book = openpyxl.Workbook()
    book.active.title = "One"
    book.active.append(["Order ID", "v"])
    book.active.append([1, "x"])
    book.create_sheet("Empty")
    book.save(tmp_path / "b.xlsx")
    tables = files.workbook_tables(files.read_workbooks(spark, str(tmp_path)))
    assert list(tables) == ["b_One"] and tables["b_One"].columns == ["Order_ID", "v"]


def test_jdbc_options_hide_credentials():
    o = jdbc.jdbc_options("postgresql", "shop", "db1", username="u", password="secret")
    assert o["url"] == "jdbc:postgresql://db1:5432/shop" and "secret" not in o["url"] and o["password"] == "secret"
    assert jdbc.jdbc_options("mssql", "d", "h")["url"] == "jdbc:sqlserver://h:1433;databaseName=d"
    assert jdbc.jdbc_options("oracle", "d", "h")["url"].endswith("h:1521/d")
    assert jdbc.jdbc_options("sqlite", "/x.db")["url"] == "jdbc:sqlite:/x.db"
    with pytest.raises(ValueError):
        jdbc.jdbc_options("mongo", "d")


def test_introspect_database(spark):
    spark.range(3).select("id", F.lit("x").alias("name")).createOrReplaceTempView("intro_demo")
    tables, columns = introspect.introspect_database(spark)
    got = tables.where("table = 'intro_demo'").first()
    assert (got["row_count"], got["column_count"], got["table_type"]) == (3, 2, "view")
    assert [r["column"] for r in columns.where("table = 'intro_demo'").orderBy("pos").collect()] == ["id", "name"]
    spark.catalog.dropTempView("intro_demo")


def test_introspect_keys(spark):
    df = spark.range(2)
    _, columns = introspect.introspect(spark, {"t": df}, keys={"t": ["id"]}, foreign={"t": []})
    assert columns.first()["is_primary_key"] and not columns.first()["is_foreign_key"]


def test_export_project(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "project_id int, v string")
    sinks.export_project({"sources": a, "shared": spark.range(2)}, str(tmp_path / "e"), 1)
    assert spark.read.json(str(tmp_path / "e" / "sources")).count() == 1
    assert spark.read.json(str(tmp_path / "e" / "shared")).count() == 2


def test_csv_export_keeps_spaces_and_nested(spark, tmp_path):
    df = spark.createDataFrame([(' a "q" ', ["x"])], "s string, l array<string>")
    sinks.export(df, str(tmp_path / "c"), "csv")
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).first()
    assert (back["s"], back["l"]) == (' a "q" ', '["x"]')


def test_index_round_trip(spark, tmp_path):
    sinks.save_index({"postings": spark.range(4)}, str(tmp_path / "i"), {"type": "tfidf"})
    parts, meta = sinks.load_index(spark, str(tmp_path / "i"))
    assert parts["postings"].count() == 4 and meta["type"] == "tfidf"
