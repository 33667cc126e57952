import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from conftest import plan_of
from rowlens.operators.documents import metadata_field, to_documents
from rowlens.operators.embed import complete, embed, hashed_embedding
from rowlens.operators.identity import add_row_ids
from rowlens.operators.index import (
    VectorIndex, incremental_counts, missing_documents, orphans, rebuilt_index, sync_counts,
)

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def measure():
    return lambda texts: [[float(len(t)), 1.0] for t in texts]


def measured(df):
    return embed(df, measure, dim=2)


def rows(spark, *titles):
    return add_row_ids(spark.createDataFrame([(t,) for t in titles], "title string"))


@pytest.fixture
def index(spark, tmp_path):
    return VectorIndex(spark, str(tmp_path / "index"), measured, name="titles")


def test_embed_skips_blanks_and_keeps_order(spark):
    def strict():
        def fn(texts):
            assert all(t.strip() for t in texts)
            return [[float(len(t)), 0.5] for t in texts]

        return fn

    df = spark.createDataFrame([(1, "abc"), (2, " \n"), (3, None), (4, "x")], "i int, text string").coalesce(1)
    out = {r.i: r.embedding for r in embed(df, strict, 2).collect()}
    assert out == {1: [3.0, 0.5], 2: [0.0, 0.0], 3: [0.0, 0.0], 4: [1.0, 0.5]}


def test_embed_checks_the_length(spark):
    df = spark.createDataFrame([("abc",)], "text string")
    with pytest.raises(Exception, match="one vector of 3 per text"):
        embed(df, measure, 3).collect()


def test_model_runs_once_per_row(spark):
    df = embed(spark.createDataFrame([("abc",)], "text string"), measure, 2)
    plan = plan_of(df.filter(F.col("embedding")[0] > 1).withColumn("n", F.size("embedding")))
    assert plan.count("ArrowEvalPython") == 1


def test_hashed_embedding_counts_tokens(spark):
    df = spark.createDataFrame([("Red red fox",), ("",), (None,)], "text string")
    out = [r.embedding for r in hashed_embedding(df, 16).collect()]
    assert [sum(v) for v in out] == [3.0, 0.0, 0.0] and max(out[0]) >= 2.0 and len(out[0]) == 16


def test_missing_documents_come_before_the_model(spark):
    docs = spark.createDataFrame(
        [("a", "x", "{}"), ("b", "y", "{}"), ("b", "y", "{}"), ("c", " ", "{}")], "row_id string, text string, metadata string"
    )
    index = spark.createDataFrame([("a",), ("a",), ("z",)], "row_id string")
    assert [r.row_id for r in missing_documents(docs, index).collect()] == ["b"]
    assert tuple(incremental_counts(docs, index).first()) == (1, 2)
    assert [r.row_id for r in orphans(docs, index).collect()] == ["z"]
    assert tuple(sync_counts(docs, index).first()) == (1, 1, 3, 2), "the blank one is in the store and never in the index"
    assert [r.row_id for r in missing_documents(docs, index, few=True).collect()] == ["b"]
    plan = plan_of(measured(missing_documents(docs, index)))
    assert plan.index("ArrowEvalPython") < plan.index("LeftAnti"), "the model sits above the join"
    assert rebuilt_index(docs, measured).count() == 2


def test_indexed_documents_are_not_shuffled(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([("a", "x", "{}"), ("b", "y", "{}")], "row_id string, text string, metadata string").write.parquet(path)
    docs, index = spark.read.parquet(path), spark.createDataFrame([("a",)], "row_id string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(missing_documents(docs, index, few=True))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "LeftSemi, BuildRight" in plan and "ReadSchema: struct<row_id:string>" in plan
    below = plan[plan.index("LeftSemi, BuildRight"):]
    assert below.index("FileScan") < below.index("Exchange"), "the scan of the texts feeds the join directly"


def test_update_is_incremental(spark, index):
    assert index.is_empty() and index.stats() == {"name": "titles", "document_count": 0, "path": index.path}
    assert index.update(rows(spark, "a", "bb")) == {"added": 2, "skipped": 0}
    assert index.update(rows(spark, "bb", "ccc", "ccc")) == {"added": 1, "skipped": 2}
    assert index.update(rows(spark, "bb")) == {"added": 0, "skipped": 1}
    assert index.stats()["document_count"] == 3
    entry = index.read().filter("text = 'Title: a'").first()
    assert entry.embedding == [8.0, 1.0] and round(entry.norm, 4) == 8.0623
    assert index.ids().columns == ["row_id"]


def test_sync_adds_and_removes_once(spark, index):
    index.update(rows(spark, "b", "c", "d"))
    store = rows(spark, "a", "b", "c")
    assert index.sync(store) == {"added": 1, "removed": 1, "total_in_store": 3, "total_in_index": 3}
    assert index.sync(store) == {"added": 0, "removed": 0, "total_in_store": 3, "total_in_index": 3}
    assert {r.row_id for r in index.ids().collect()} == {r.row_id for r in store.collect()}


def test_delete_rebuild_clear(spark, index):
    index.update(rows(spark, "a", "b"))
    first = index.ids().limit(1)
    assert index.delete(first) == 1
    assert index.delete(spark.createDataFrame([("unknown",)], "row_id string")) == 0
    assert index.stats()["document_count"] == 1
    assert index.rebuild(rows(spark, "x", "y", "z")) == 3
    assert index.stats()["document_count"] == 3
    index.clear()
    assert index.is_empty() and index.read().columns == ["row_id", "text", "metadata", "embedding", "norm"]
    assert index.update(rows(spark, "a")) == {"added": 1, "skipped": 0}


def test_search_returns_payload(spark, tmp_path):
    index = VectorIndex(spark, str(tmp_path / "words"))
    index.update(rows(spark, "red fox", "blue whale", "red wine"))
    asked = spark.createDataFrame([(1, "title whale blue")], "query_id bigint, text string")
    hit = index.search(asked, k=1).first()
    assert hit.text == "Title: blue whale" and hit["rank"] == 1 and "blue whale" in hit.metadata
    other = index.search(asked, 1, query_embedder=lambda d: hashed_embedding(d.withColumn("text", F.lit("fox"))))
    assert "fox" in other.first().text


def test_a_failing_item_does_not_end_the_job(spark):
    def model():
        def fn(texts, system=None):
            if any("bad" in t for t in texts):
                raise RuntimeError("no")
            return [[float(len(t)), 0.0] for t in texts] if system is None else [t.upper() for t in texts]

        return fn

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "ccc"), (4, " ")], "i int, text string").coalesce(1)
    out = {r.i: (r.embedding, r.error) for r in embed(df, model, 2, error="error").collect()}
    assert out == {1: ([1.0, 0.0], None), 2: (None, "RuntimeError: no"), 3: ([3.0, 0.0], None), 4: ([0.0, 0.0], None)}
    with pytest.raises(Exception, match="no"):
        embed(df, model, 2).collect()
    said = {r.i: (r.answer, r.error) for r in complete(df, model, "text", system_prompt="s", error="error").collect()}
    assert said[2] == (None, "RuntimeError: no") and said[3] == ("CCC", None)


def test_complete(spark):
    def shout():
        return lambda prompts, system: [f"{system}:{p.upper()}" for p in prompts]

    df = spark.createDataFrame([(1, "hi"), (2, None)], "i int, prompt string")
    assert {r.i: r.answer for r in complete(df, shout, system_prompt="s").collect()} == {1: "s:HI", 2: None}


def test_each_distinct_text_is_embedded_once(spark, tmp_path):
    from rowlens.operators.embed import embed, remembered

    seen = tmp_path / "calls"
    seen.mkdir()

    def model():
        import uuid

        def fn(texts):
            for t in texts:
                (seen / uuid.uuid4().hex).write_text(t)
                if t == "bad":
                    raise OSError("no route")
            return [[float(len(t)), 1.0] for t in texts]

        return fn

    def called():
        return sorted(p.read_text() for p in seen.iterdir())

    once = remembered(spark, str(tmp_path / "texts"), lambda d: embed(d, model, dim=2))
    first = spark.createDataFrame([(1, "a"), (2, "a"), (3, "bb"), (4, " "), (5, None)], "n int, text string")
    assert {r.n: r.embedding[0] for r in once(first).collect()} == {1: 1, 2: 1, 3: 2, 4: 0, 5: 0}
    assert called() == ["a", "bb"]
    more = spark.createDataFrame([(i, "a" if i % 2 else "ccc") for i in range(40)], "n int, text string")
    assert once(more).where("embedding[0] = length(text)").count() == 40
    assert called() == ["a", "bb", "ccc"] and once(more).count() == 40 and called() == ["a", "bb", "ccc"]
    # What fails is not remembered.
    kind = remembered(spark, str(tmp_path / "texts"), lambda d: embed(d, model, dim=2, error="error"))
    rows = {r.text: (r.embedding, r.error) for r in kind(spark.createDataFrame([(1, "bad"), (2, "dddd"), (3, "a")], "n int, text string")).collect()}
    assert rows["bad"] == (None, "OSError: no route") and rows["dddd"] == ([4.0, 1.0], None) and rows["a"] == ([1.0, 1.0], None)
    once(spark.createDataFrame([(2, "dddd")], "n int, text string"))
    assert called().count("dddd") <= 2 and called().count("a") == 1


def test_hits_are_filtered_by_metadata_before_the_top_k(spark, tmp_path):
    rows = spark.createDataFrame(
        [("red fox", 1990, 1.5), ("red fox runs", 2005, None), ("red hen", 2010, 2.5), ("blue", None, float("nan"))],
        "title string, `pub 'year'` int, price double",
    )
    stored = VectorIndex(spark, str(tmp_path / "i"))
    stored.update(rows)
    asked = spark.createDataFrame([(1, "red fox")], "query_id long, text string")
    late = lambda e: metadata_field(e, "pub 'year'", "int") >= 2000
    found = [r["text"] for r in stored.search(asked, 1, where=late).collect()]
    assert len(found) == 1 and "red fox runs" in found[0]
    assert stored.search(asked, 5, where=late).count() == 2
    assert stored.search(asked, 5, where=lambda e: metadata_field(e, "none") == "x").count() == 0
    assert stored.search(asked, 5).count() == 4


def test_typed_metadata_keeps_types_through_files(spark, tmp_path):
    rows = spark.sql(
        "select 'r' row_id, 12345678901234567890 big, 1.5D price, double('nan') bad, date'2020-01-02' day, true yes, "
        "cast(null as int) gone, array(1, 2) many, 'a' word"
    )
    path = str(tmp_path / "v")
    to_documents(rows, typed=True).write.parquet(path)
    back = spark.read.parquet(path)
    kinds = {"big": "decimal(20,0)", "price": "double", "bad": "double", "day": "date", "yes": "boolean", "gone": "int", "word": "string"}
    got = back.select(*[metadata_field(back, n, k).alias(n) for n, k in kinds.items()]).first()
    expected = rows.selectExpr("big", "price", "cast(null as double) bad", "day", "yes", "gone", "word").first()
    assert tuple(got) == tuple(expected)
    text = to_documents(rows)
    assert text.select(metadata_field(text, "price", "double")).first()[0] == 1.5
    with pytest.raises(ValueError):
        metadata_field(text, "a'b\"c")
