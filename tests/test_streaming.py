import pytest

from rowlens.operators.identity import add_row_ids
from rowlens.operators.index import VectorIndex
from rowlens.operators.store import RowStore, upsert
from rowlens.plans.queries import QUERIES
from rowlens.streaming.upserts import append_stream, distinct_stream, upsert_stream

SCHEMA = "title string, year int"


def run(spark, source, store, checkpoint, index=None):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    query = upsert_stream(stream, store, checkpoint, index).trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.exception() is None


def test_stream_equals_batch_and_replay_adds_nothing(spark, tmp_path):
    source = str(tmp_path / "in")
    parts = [[("a", 1), ("b", 2), ("a", 1)], [("b", 2), ("c", 3)], [("d", 4)]]
    for rows in parts:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    store, index = RowStore(spark, str(tmp_path / "s")), VectorIndex(spark, str(tmp_path / "i"))
    run(spark, source, store, str(tmp_path / "c1"), index)
    batch = upsert(None, add_row_ids(spark.read.schema(SCHEMA).parquet(source)))
    expected = sorted(tuple(r) for r in batch.collect())
    assert sorted(tuple(r) for r in store.load().select(*batch.columns).collect()) == expected
    assert index.stats()["document_count"] == 4

    run(spark, source, store, str(tmp_path / "c2"), index)
    assert store.load().count() == 4 and index.stats()["document_count"] == 4

    spark.createDataFrame([("e", 5)], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    run(spark, source, store, str(tmp_path / "c1"), index)
    assert store.load().count() == 5 and index.stats()["document_count"] == 5


def test_rows_that_missed_the_index_are_added_on_replay(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", 1)], SCHEMA).write.parquet(source)
    store, index = RowStore(spark, str(tmp_path / "s")), VectorIndex(spark, str(tmp_path / "i"))
    run(spark, source, store, str(tmp_path / "c1"))
    assert index.is_empty()
    run(spark, source, store, str(tmp_path / "c2"), index)
    assert index.stats()["document_count"] == 1


def test_distinct_stream_over_triggers_late_rows_and_a_restart(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "seen string, title string, year int"

    def feed(*rows):
        spark.createDataFrame(list(rows), schema).selectExpr("timestamp(seen) seen", "title", "year").coalesce(
            1
        ).write.mode("append").parquet(source)
        stream = spark.readStream.schema("seen timestamp, title string, year int").parquet(source)
        rows = distinct_stream(stream, "seen", "2 days")
        query = append_stream(rows, out, str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        assert query.exception() is None
        found = spark.read.parquet(out)
        assert found.select("row_id").distinct().count() == found.select("title", "year").distinct().count()
        return sorted((r.title, r.year) for r in found.collect())

    assert feed(("2024-01-10", "a", 1), ("2024-01-10", "a", 1), ("2024-01-09", "b", None)) == [("a", 1), ("b", None)]
    # A restart from the checkpoint still knows the ids of the first trigger.
    assert feed(("2024-01-11", "a", 1), ("2024-01-10", "c", 3)) == [("a", 1), ("b", None), ("c", 3)]
    # The watermark is at 01-09: later than that is late, and is dropped.
    assert feed(("2024-01-01", "late", 0)) == [("a", 1), ("b", None), ("c", 3)]
    # After its state has expired an id comes through again.
    feed(("2024-02-01", "d", 4))
    assert feed(("2024-02-01", "a", 1)).count(("a", 1)) == 2


def test_rows_without_a_time_are_told_apart_within_a_trigger(spark, tmp_path):
    source, out, schema = str(tmp_path / "in"), str(tmp_path / "out"), "seen timestamp, title string"
    for day in (10, 11):
        rows = spark.sql(f"SELECT timestamp'2024-01-{day}' seen, 't{day}' title UNION ALL SELECT NULL, 'n' UNION ALL SELECT NULL, 'n'")
        rows.coalesce(1).write.mode("append").parquet(source)
        stream = distinct_stream(spark.readStream.schema(schema).parquet(source), "seen", "2 days")
        append_stream(stream, out, str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.title for r in spark.read.parquet(out).collect()) == ["n", "n", "t10", "t11"]


@pytest.mark.parametrize("files", [1, 3])
def test_a_table_that_is_a_folder_of_files_is_streamed_whole(spark, tmp_path, files):
    folder = str(tmp_path / "tables")
    docs = [(i, f"text {i % 5}" if i % 7 else None, "en", "web", 6) for i in range(20)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(
        files
    ).write.parquet(f"{folder}/documents.parquet")
    rows = QUERIES["stream_upsert"](spark, folder).collect()
    assert sorted((r.doc_id, r.text) for r in rows) == [(0, None), *((i, f"text {i % 5}") for i in range(1, 6))]
    events = [(i, i % 3, "view" if i % 2 else "buy") for i in range(20)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string").selectExpr(
        "*", "timestamp_seconds(event_id) ts"
    ).repartition(files).write.parquet(f"{folder}/events.parquet")
    assert QUERIES["stream_distinct"](spark, folder).count() == 6
