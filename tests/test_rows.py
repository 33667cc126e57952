import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from rowlens.operators.documents import drop_blank, row_text, to_documents
from rowlens.operators.identity import add_row_ids, dedup_rows
from rowlens.sources.sheets import (
    ingest, merge_sheets, read_sheet_folder, read_sheets, write_original_sheets,
)

SCHEMA = "title string, year int, score double, open boolean, seen timestamp_ntz, pub_type string"
ROWS = [
    ("  On  rocks ", 2001, 1.5, True, dt.datetime(2023, 1, 2), "Book"),
    ('q"\\\t\n\x0b', None, None, None, None, None),
    ("état ", 7, 1e16, False, dt.datetime(2023, 1, 2, 3, 4, 5, 60), " Book "),
    ("", 0, float("nan"), None, None, ""),
]


def expected_id(row, names, type_text):
    cells = {}
    for name, value in zip(names, row):
        if value is None or value != value:
            cells[name] = None
        elif isinstance(value, str):
            cells[name] = value.strip()
        else:
            cells[name] = str(value)
    text = json.dumps(cells, sort_keys=True, ensure_ascii=False)
    suffix = "" if "pub_type" not in cells else str(cells["pub_type"])
    assert suffix == type_text
    return hashlib.sha256(f"{text}|{suffix}".encode()).hexdigest()


def test_row_ids(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    names = df.columns
    ids = [r.row_id for r in add_row_ids(df).collect()]
    assert ids == [expected_id(r, names, t) for r, t in zip(ROWS, ["Book", "None", "Book", ""])]
    without = df.drop("pub_type")
    assert [r.row_id for r in add_row_ids(without).collect()] == [expected_id(r[:-1], names[:-1], "") for r in ROWS]


def test_golden_id(spark):
    df = spark.createDataFrame([("a", 1)], "b string, a int")
    text = '{"a": "1", "b": "a"}|'
    assert add_row_ids(df).first().row_id == hashlib.sha256(text.encode()).hexdigest()


def test_ids_do_not_depend_on_the_zone_of_the_session(spark):
    found = set()
    for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            df = spark.sql("SELECT timestamp_micros(1699161234567890 + 3600000000 * id) AS t FROM range(48)")
            found.add(tuple(r.row_id for r in add_row_ids(df).collect()))
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert len(found) == 1 and len(set(*found)) == 48
    df = spark.sql("SELECT timestamp_micros(-1234567) AS t")
    text = '{"t": "1969-12-31 23:59:58.765433"}|'
    assert add_row_ids(df).first().row_id == hashlib.sha256(text.encode()).hexdigest()


def test_ids_leave_columns_of_any_name_alone(spark):
    df = spark.createDataFrame([("a", "b", "c", "d", "e")], "_json string, _text0 string, id_json string, ID_TEXT1 string, id_text string")
    row = add_row_ids(df).first()
    assert tuple(row)[:5] == ("a", "b", "c", "d", "e")


def test_neighbouring_numbers_stay_apart(spark):
    a = spark.createDataFrame([(2**53,), (2**53 + 1,)], "n bigint")
    b = spark.createDataFrame([(0.5,)], "n double")
    merged = merge_sheets({"a": a, "b": b})
    assert {r.n for r in merged.collect()} == {"9007199254740992", "9007199254740993", "0.5"}
    wide = merge_sheets({"a": spark.sql("SELECT 1.5BD AS n"), "b": spark.sql("SELECT 123456.789BD AS n")})
    assert wide.schema["n"].dataType.simpleString() == "decimal(9,3)"


def test_ids_ignore_column_order_and_row_id(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    shuffled = df.select(*reversed(df.columns))
    assert [r.row_id for r in add_row_ids(df).collect()] == [r.row_id for r in add_row_ids(shuffled).collect()]
    again = add_row_ids(add_row_ids(df).withColumn("row_id", F.lit(None).cast("string")))
    assert [r.row_id for r in again.collect()] == [r.row_id for r in add_row_ids(df).collect()]


def test_existing_ids_are_kept_and_length_is_a_parameter(spark):
    df = spark.createDataFrame([("mine", "x"), (None, "y")], "row_id string, a string")
    ids = [r.row_id for r in add_row_ids(df).collect()]
    assert ids[0] == "mine" and len(ids[1]) == 64
    assert len(add_row_ids(df.drop("row_id"), length=16).first().row_id) == 16


def test_dedup_keeps_the_first_and_collapses_before_the_shuffle(spark):
    df = spark.createDataFrame([("k", 3, "c"), ("k", 1, "a"), ("m", 2, "b"), ("k", 1, "z")], "row_id string, n int, t string")
    assert {tuple(r) for r in dedup_rows(df).collect()} == {("k", 1, "a"), ("m", 2, "b")}
    assert [r.t for r in dedup_rows(df, order_by=["t"]).orderBy("t").collect()] == ["a", "b"]
    plan = plan_of(dedup_rows(df))
    assert "partial_min(struct" in plan and "Window" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_dedup_of_a_hot_key(spark):
    df = spark.range(30_000).select(
        F.when(F.col("id") < 10_000, "hot").otherwise(F.col("id").cast("string")).alias("row_id"), "id"
    )
    out = dedup_rows(df, order_by=["id"])
    assert out.count() == 20_001 and out.filter("row_id = 'hot'").first().id == 0


def test_row_text(spark):
    df = spark.createDataFrame(
        [("id1", " x ", None, "  ", 2, 1e16), ("id2", None, None, None, None, None)],
        "row_id string, `co-author_name` string, b string, c string, pub_year int, f double",
    )
    out = [r.t for r in df.select(row_text(df).alias("t")).collect()]
    assert out == ["Co-Author Name:  x  | Pub Year: 2 | F: 1e+16", ""]
    assert "Python" not in plan_of(df.select(row_text(df)))


def test_documents(spark):
    df = spark.createDataFrame([("x", 1, 2.5, True, None, float("nan"))], "a string, n int, x double, b boolean, e string, z double")
    doc = to_documents(df).first()
    assert doc.text == "A: x | N: 1 | X: 2.5 | B: True"
    assert json.loads(doc.metadata) == {"a": "x", "n": 1, "x": 2.5, "b": True, "row_id": doc.row_id}
    blank = spark.createDataFrame([("r", "  "), ("s", "t")], "row_id string, text string")
    assert [r.row_id for r in drop_blank(blank).collect()] == ["s"]


def sheets_3(spark):
    return {
        "journals": spark.createDataFrame([("a", "b", 2001)], "title string, author string, year int"),
        "books": spark.createDataFrame([("c", "d"), ("e", None)], "title string, publisher string"),
        "empty": spark.createDataFrame([], "title string"),
    }


def test_merge_sheets(spark):
    out = merge_sheets(sheets_3(spark))
    assert out.columns == ["title", "author", "year", "source_sheet", "publisher"]
    assert {tuple(r) for r in out.collect()} == {
        ("a", "b", 2001, "journals", None), ("c", None, None, "books", "d"), ("e", None, None, "books", None)
    }
    assert merge_sheets({}, spark).count() == 0


def test_sheet_name_overwrites_a_column_of_that_name(spark):
    df = spark.createDataFrame([("x", 1)], "source_sheet string, n int")
    assert merge_sheets({"s": df}).first().source_sheet == "s"


def test_ingest_ids_cover_sheet_name_and_filled_columns(spark):
    row = ingest(sheets_3(spark)).filter("title = 'a'").first()
    text = json.dumps(
        {"author": "b", "publisher": None, "source_sheet": "journals", "title": "a", "year": "2001"}, sort_keys=True
    )
    assert row.row_id == hashlib.sha256(f"{text}|".encode()).hexdigest()


def test_read_and_keep_sheets(spark, tmp_path):
    raw = {"one": spark.createDataFrame([(1, "x")], "`My Id` int, Department string"), "All": spark.range(1)}
    kept = write_original_sheets(raw, str(tmp_path / "raw"))
    assert kept == ["one"]
    path = str(tmp_path / "raw" / "source_sheet=one")
    read = read_sheets(spark, {"one": path})
    assert read["one"].columns == ["my_id", "dept"] and read["one"].count() == 1
    csv = tmp_path / "sheet_a.csv"
    csv.write_text("Title,Year\nx,2001\n")
    (tmp_path / "sheet_b.csv").write_text("Title,Year\ny,2002\n")
    out = read_sheet_folder(spark, str(tmp_path / "*.csv"), "csv", header=True)
    assert {tuple(r) for r in out.collect()} == {("x", "2001", "sheet_a"), ("y", "2002", "sheet_b")}


def test_csv_files_with_other_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Title,Author\nT1,A1\n")
    (tmp_path / "b.csv").write_text("Author,Year,Title\nA2,2002,T2\n")
    (tmp_path / "c.csv").write_text("Author,Year,Title\nA3,2003,T3\n")
    (tmp_path / "d.csv").write_text("Publisher\nP4\n")
    out = read_sheet_folder(spark, str(tmp_path), "csv", header=True)
    got = {r.source_sheet: r.asDict() for r in out.collect()}
    assert got["a"] == {"title": "T1", "author": "A1", "source_sheet": "a", "year": None, "publisher": None}
    assert got["b"]["author"] == "A2" and got["c"]["title"] == "T3" and got["c"]["year"] == "2003"
    assert got["d"]["publisher"] == "P4" and got["d"]["title"] is None


def test_read_errors_are_not_hidden(spark, tmp_path):
    with pytest.raises(Exception):
        read_sheets(spark, {"x": str(tmp_path / "nowhere")})
