import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from rowlens.operators.documents import to_documents
from rowlens.operators.explore import display_strings, profile, search
from rowlens.operators.identity import add_row_ids
from rowlens.operators.store import (
    RowStore, append_rows, coerce_entries, delete_rows, find_row, find_rows, new_rows, upsert,
)
from rowlens.sources.sheets import ingest
from rowlens.sources.tables import ParquetTable

COLUMNS = ["title", "year"]


def rows_of(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def frame(spark, *rows, schema="title string, year int"):
    return spark.createDataFrame(list(rows), schema)


@pytest.fixture
def store(spark, tmp_path):
    return RowStore(spark, str(tmp_path / "store"))


@pytest.mark.parametrize("small_batch", [False, True])
def test_upsert_adds_new_rows_once(spark, small_batch):
    stored = add_row_ids(frame(spark, ("a", 1), ("b", 2), ("c", 3)))
    batch = frame(spark, ("b", 2), ("d", 4), ("d", 4), ("e", 5))
    once = upsert(stored, batch, small_batch)
    assert rows_of(once, "title", "year") == [("a", 1), ("b", 2), ("c", 3), ("d", 4), ("e", 5)]
    assert rows_of(upsert(once, batch, small_batch), *COLUMNS) == rows_of(once, *COLUMNS)
    assert new_rows(stored, batch, small_batch).count() == 2


def test_upsert_with_an_extra_column(spark):
    stored = add_row_ids(frame(spark, ("a", 1)))
    batch = spark.createDataFrame([("a", 1, "x")], "title string, year int, note string")
    out = upsert(stored, batch)
    assert out.columns == ["title", "year", "row_id", "note"] and out.count() == 2


def test_upsert_plan_shuffles_ids_of_the_store_only(spark, tmp_path):
    path = str(tmp_path / "t")
    add_row_ids(frame(spark, ("a", 1), ("b", 2))).write.parquet(path)
    plan = plan_of(new_rows(spark.read.parquet(path), frame(spark, ("c", 3))))
    assert "LeftAnti" in plan and "Python" not in plan
    assert "ReadSchema: struct<row_id:string>" in plan


def test_append_pads_computes_the_id_and_is_idempotent(spark):
    stored = add_row_ids(frame(spark, ("a", 1)))
    incoming = spark.createDataFrame([("  new ",)], "` Title ` string")
    out = append_rows(stored, incoming)
    added = out.filter("title like '%new%'").first()
    assert added.year is None and len(added.row_id) == 64
    assert append_rows(out, incoming).count() == 2


def test_delete_and_find(spark):
    stored = add_row_ids(frame(spark, ("a", 1), ("b", 2)))
    gone = stored.filter("title = 'a'").select("row_id")
    unknown = spark.createDataFrame([("nope",)], "row_id string")
    assert rows_of(delete_rows(stored, gone.union(unknown)), *COLUMNS) == [("b", 2)]
    assert rows_of(find_rows(stored, gone), *COLUMNS) == [("a", 1)]
    assert find_row(stored, gone.first().row_id).first().title == "a"


def test_lookup_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    add_row_ids(frame(spark, ("a", 1))).write.parquet(path)
    assert "EqualTo(row_id,abc)" in plan_of(find_row(spark.read.parquet(path), "abc"))


def test_row_store_life(spark, store):
    assert store.load() is None
    assert store.save(frame(spark, ("a", 1), ("a", 1), ("b", 2))) == {"added": 2, "skipped": 1}
    assert store.save(frame(spark, ("b", 2), ("c", 3))) == {"added": 1, "skipped": 1}
    first = store.append(spark.createDataFrame([("d",)], "`TITLE ` string"))
    assert (first["added"], first["skipped"]) == (1, 0)
    assert [r.row_id for r in first["ids"].collect()] == [store.load().filter("title = 'd'").first().row_id]
    again = store.append(spark.createDataFrame([("d",)], "`TITLE ` string"))
    assert (again["added"], again["skipped"]) == (0, 1)
    ids = store.load().filter("title in ('a', 'c')").select("row_id")
    assert store.delete(ids) == 2
    assert store.delete(ids) == 0
    assert [r.title for r in store.load().orderBy("title").collect()] == ["b", "d"]
    assert store.save(frame(spark, ("a", 1))) == {"added": 1, "skipped": 0}, "a removed row can come back"
    assert [r.title for r in store.load().orderBy("title").collect()] == ["a", "b", "d"]
    assert store.compact() == 3
    assert store.load().count() == 3


def test_store_gains_columns(spark, store):
    store.save(frame(spark, ("a", 1)))
    store.save(spark.createDataFrame([("b", "x")], "title string, note string"))
    assert rows_of(store.load().fillna(""), "title", "note") == [("a", ""), ("b", "x")]


def test_store_takes_a_changed_type(spark, store):
    store.save(frame(spark, ("a", 1), ("b", 2)))
    store.delete(store.load().filter("title = 'b'").select("row_id"))
    assert store.save(spark.createDataFrame([("c", "not a year")], "title string, year string")) == {"added": 1, "skipped": 0}
    assert rows_of(store.load(), "title", "year") == [("a", "1"), ("c", "not a year")]


def test_store_without_success_files(spark, store):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    try:
        assert store.save(frame(spark, ("a", 1)))["added"] == 1
        assert store.save(frame(spark, ("b", 2)))["added"] == 1
        assert rows_of(store.load(), "title") == [("a",), ("b",)]
    finally:
        conf.set("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true")


def test_an_unfinished_store_is_not_an_absent_one(spark, store):
    frame(spark, ("a", 1)).write.parquet(f"{store.table.path}/snapshot=0/rows/batch=0")
    with pytest.raises(ValueError, match="never finished"):
        store.load()
    with pytest.raises(ValueError, match="never finished"):
        store.save(frame(spark, ("b", 2)))


def test_years_held_as_numbers(spark):
    df = spark.createDataFrame([(2023.0,), (1899.0,), (2023.5,), (None,)], "pub_year double")
    good, bad = coerce_entries(df)
    assert [r.pub_year for r in good.collect()] == [2023, None] and bad.count() == 2


def test_deleting_every_row(spark, store):
    store.save(frame(spark, ("a", 1)))
    assert store.delete(store.load().select("row_id")) == 1
    assert store.load().count() == 0
    assert store.replace(frame(spark, ("z", 9))) == 1
    assert rows_of(store.load(), *COLUMNS) == [("z", 9)]


def test_unfinished_batches_are_not_read(spark, tmp_path):
    table = ParquetTable(spark, str(tmp_path / "t"))
    table.append(add_row_ids(frame(spark, ("a", 1))))
    half = tmp_path / "t" / "snapshot=0" / "rows" / "batch=1"
    add_row_ids(frame(spark, ("b", 2))).write.parquet(str(half))
    (half / "_SUCCESS").unlink()
    snapshot = tmp_path / "t" / "snapshot=1" / "rows" / "batch=0"
    add_row_ids(frame(spark, ("c", 3))).write.parquet(str(snapshot))
    (snapshot / "_SUCCESS").unlink()
    assert rows_of(table.read(), *COLUMNS) == [("a", 1)]
    table.append(add_row_ids(frame(spark, ("d", 4))))
    assert rows_of(table.read(), *COLUMNS) == [("a", 1), ("d", 4)]


def test_coerce_entries(spark):
    df = spark.createDataFrame(
        [("a", "2023", "soon"), ("b", "1899", ""), ("c", "x", "z"), ("  ", "  ", None), ("e", None, "t"),
         ("f", "2101", "t"), ("g", " 1900 ", "t"), ("h", "2100", "t"), ("i", "2023.5", "t")],
        "name string, pub_year string, pub_date string",
    )
    good, bad = coerce_entries(df)
    assert dict(good.dtypes)["pub_year"] == "int"
    assert {tuple(r) for r in good.collect()} == {
        ("a", 2023, "soon"), (None, None, None), ("e", None, "t"), ("g", 1900, "t"), ("h", 2100, "t")
    }
    assert sorted(r.name for r in bad.collect()) == ["b", "c", "f", "i"]


def test_headers_with_dots(spark, store):
    rows = ingest({"s": spark.createDataFrame([("1", "x"), ("2", None)], "`No.` string, `Vol. Nr` string")})
    assert rows.columns == ["no.", "vol._nr", "source_sheet", "row_id"]
    assert store.save(rows) == {"added": 2, "skipped": 0}
    assert store.save(rows.union(rows)) == {"added": 0, "skipped": 4}
    loaded = store.load()
    assert search(loaded, "x", ["vol._nr"]).count() == 1
    assert {r["column"]: r.non_null for r in profile(loaded).collect()} == {"no.": 2, "vol._nr": 1, "source_sheet": 2}
    assert {r.text for r in to_documents(loaded).collect()} == {"No.: 1 | Vol. Nr: x | Source Sheet: s", "No.: 2 | Source Sheet: s"}
    assert delete_rows(loaded, loaded.limit(1)).count() == 1
    good, _ = coerce_entries(loaded.select("`no.`"))
    assert good.columns == ["no."] and display_strings(good).count() == 2


@pytest.mark.parametrize("small_batch", [False, True])
def test_upsert_where_a_third_of_the_rows_is_one_row(spark, small_batch):
    ids = spark.range(9_000)
    hot = ids.select(F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("title"))
    stored = add_row_ids(hot.limit(4_000)).unionByName(add_row_ids(hot.filter("title = 'same'")))
    out = new_rows(stored, hot, small_batch)
    known = {r.title for r in stored.select("title").collect()}
    assert sorted(r.title for r in out.collect()) == sorted({r.title for r in hot.collect()} - known)
