"""Stored codes, postings and trigrams against the scans they stand for."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from rowlens.operators.explore import search
from rowlens.operators.identity import ROW_ID, add_row_ids, dedup_rows
from rowlens.operators.nearest import knn, lexical_topk
from rowlens.operators.postings import TokenIndex
from rowlens.operators.quantised import ProductIndex, _Shortlist
from rowlens.operators.store import RowStore
from rowlens.operators.trigrams import TrigramIndex, grams_of


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# -- product quantisation --------------------------------------------------------


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(20).tolist()) for i in range(900)]
    rows += [(900, [0.0] * 20), (901, None), (902, [float("nan")] * 20)]
    return spark.createDataFrame(rows, "row_id long, embedding array<double>").repartition(4)


def test_codes_find_most_of_the_exact_hits(spark, vectors, tmp_path):
    index = ProductIndex(spark, str(tmp_path / "pq"))
    index.build(vectors, parts=5)
    asked = vectors.where("row_id < 300").select(F.col("row_id").alias("query_id"), "embedding")
    exact = {(r.query_id, r.row_id): r.distance for r in knn(vectors, asked, 5).collect()}
    hits = index.search(asked, 5, shortlist=80).collect()
    found = {(r.query_id, r.row_id): r.distance for r in hits}
    assert len(set(found) & set(exact)) >= 0.9 * len(exact) and len(hits) == 5 * 300
    assert all(exact[key] == distance for key, distance in found.items() if key in exact)
    # A shortlist of all rows is an exact search; many chunks are the same search.
    assert rows_of(index.search(asked, 5, shortlist=1_000)) == rows_of(knn(vectors, asked, 5))
    assert rows_of(index.search(asked, 5, shortlist=1_000, broadcast_rows=50)) == rows_of(knn(vectors, asked, 5))


def test_codes_are_small_and_vectors_stay_unread(spark, vectors, tmp_path):
    index = ProductIndex(spark, str(tmp_path / "pq"))
    index.build(vectors, parts=5)
    assert {len(r["codes"]) for r in index.codes().collect()} == {5} and index.codes().count() == 900
    asked = vectors.where("row_id < 3").select(F.col("row_id").alias("query_id"), "embedding")
    assert "embedding" not in plan_of(index.shortlists(asked, 9)).split("FileScan")[1]


def test_questions_without_a_direction_are_searched_exactly(spark, vectors, tmp_path):
    index = ProductIndex(spark, str(tmp_path / "pq"))
    index.build(vectors, parts=50)  # no more parts than elements
    asked = vectors.where("row_id in (5, 900, 902)").select(F.col("row_id").alias("query_id"), "embedding")
    assert rows_of(index.search(asked, 4, shortlist=1_000)) == rows_of(knn(vectors.where("embedding is not null"), asked, 4))
    assert index.search(asked.limit(0), 4).collect() == []
    few = ProductIndex(spark, str(tmp_path / "few"))
    few.build(vectors.where("row_id < 3"))
    assert rows_of(few.search(asked, 9)) == rows_of(knn(vectors.where("row_id < 3"), asked, 9))


def test_a_shortlist_holds_the_best_estimates_of_all_rows():
    rng = np.random.default_rng(3)
    asked, rows = rng.standard_normal((7, 6)).astype(np.float32), rng.integers(-2, 3, (900, 6)).astype(np.float32)
    some = _Shortlist(asked, 20)
    for at in range(0, 900, 100):
        some.add(rows[at : at + 100], at)
        # Only what reaches the least of a question's shortlist is held on to.
        assert sum(len(q) for q, _, _ in some.held) <= 3 * 20 * 7 + 7 * 100
    query, row, score = some.result()
    sums = asked @ rows.T
    for q in range(7):
        assert np.allclose(np.sort(score[query == q]), np.sort(sums[q])[-20:])
        assert np.allclose(sums[q, row[query == q]], score[query == q]) and len(set(row[query == q])) == 20


# -- postings --------------------------------------------------------------------


@pytest.fixture(scope="module")
def texts(spark):
    random.seed(4)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = [(f"r{i}", " ".join(random.choices(vocabulary, [1 / (j + 1) for j in range(300)], k=random.randint(1, 60)))) for i in range(700)]
    rows += [("blank", " ,. "), ("none", None), ("copy a", "w1 w2 W2"), ("copy b", "w2 w1, w2"), ("É", "É é w299 w299")]
    return spark.createDataFrame(rows, "row_id string, text string").repartition(3)


@pytest.mark.parametrize("block_rows", [8, 256])
def test_stored_postings_give_the_hits_of_the_scan(spark, texts, tmp_path, block_rows):
    index = TokenIndex(spark, str(tmp_path / "tokens"))
    index.build(texts, block_rows=block_rows, buckets=5)
    asked = texts.sample(0.3, 1).select(F.col("row_id").alias("query_id"), "text")
    asked = asked.unionByName(spark.createDataFrame([("q", "é w1"), ("unknown", "zz yy"), ("empty", ""), ("null", None)], asked.schema))
    expected = rows_of(lexical_topk(texts, asked, 5))
    assert rows_of(index.search(asked, 5)) == expected
    assert rows_of(index.search(asked, 5, broadcast_rows=40)) == expected
    assert index.search(asked.limit(0), 5).collect() == []


def test_a_posting_is_a_few_bytes(spark, texts, tmp_path):
    index = TokenIndex(spark, str(tmp_path / "tokens"))
    many = spark.createDataFrame([("often", "w1 " * 70_000 + "w2"), ("some", "w1 " * 300)], texts.schema)
    index.build(texts.unionByName(many), block_rows=8, buckets=5)
    rows = index.postings(spark.createDataFrame([("w1",), ("w2",)], "token string")).collect()
    # A place takes two bytes, a count one, or four in a block with a count beyond 255.
    assert rows and {len(r["counts"]) * 2 / len(r["places"]) for r in rows} == {1, 4}
    asked = spark.createDataFrame([("q", "w1 w1 w2"), ("p", "w2 w5")], "query_id string, text string")
    assert rows_of(index.search(asked, 9)) == rows_of(lexical_topk(texts.unionByName(many), asked, 9))


def test_blocks_that_cannot_win_are_skipped(spark, texts, tmp_path):
    index = TokenIndex(spark, str(tmp_path / "tokens"))
    index.build(texts, block_rows=4, buckets=5)
    asked = texts.where("row_id like 'r1%'").select(F.col("row_id").alias("query_id"), "text")
    assert index.skipped(asked, 1) > 0
    assert rows_of(index.search(asked, 1)) == rows_of(lexical_topk(texts, asked, 1))


def test_a_search_reads_the_folders_of_its_tokens(spark, texts, tmp_path):
    index = TokenIndex(spark, str(tmp_path / "tokens"))
    index.build(texts)
    rows = index.postings(spark.createDataFrame([("w7",), ("w8",)], "token string"))
    plan = plan_of(rows)
    # Named folders only, and of these the row groups that may hold a token.
    assert "PartitionFilters: [bucket" in plan and "In(token" in plan
    assert {r["token"] for r in rows.collect()} == {"w7", "w8"}


# -- trigrams --------------------------------------------------------------------


def test_stored_trigrams_give_the_rows_of_the_scan(spark, tmp_path):
    random.seed(6)
    rows = [(i, "".join(random.choices("abcdeÉ ß%_", k=random.randint(0, 40))), random.choice([None, "x", "lorem IPSUM"]), i * 7) for i in range(900)]
    rows += [(None, "abc\\d'e", None, None), (5_000, "x" * 200_000 + "needle", None, 1), (5_001, "𝒳𝒴𝒵 ab", "", 2)]
    df = spark.createDataFrame(rows, "row_id long, a string, `b.c` string, n long").repartition(4)
    index = TrigramIndex(spark, str(tmp_path / "grams"))
    index.build(df, block_rows=16, buckets=5)
    cases = [(t, None) for t in ("ABC", "Éab", "xxxxxneed", "c\\d'", "630", "𝒴𝒵 A", "no such", "", None, "%_")]
    for term, columns in [*cases, ("abc", ["a"]), ("lorem ips", ["b.c", "n"])]:
        expected = rows_of(search(df, term, columns or df.columns))
        assert rows_of(index.search(term, columns).select(*[F.col(f"`{c}`") for c in df.columns])) == expected, (term, columns)
    with pytest.raises(ValueError, match="without postings"):
        index.search("abc", ["zz"])
    with pytest.raises(ValueError, match="block"):
        TrigramIndex(spark, str(tmp_path / "no")).build(df.withColumn("Block", F.lit(1)))


def test_only_the_postings_of_the_term_are_read(spark, tmp_path):
    df = spark.createDataFrame([(i, f"row {i} of many") for i in range(2_000)], "row_id long, a string")
    index = TrigramIndex(spark, str(tmp_path / "grams"))
    index.build(df, block_rows=16, buckets=5)
    grams = sorted(set(grams_of("1234").tolist()))
    rows = index.postings(grams, [1])
    assert "In(gram" in plan_of(rows) and {r["gram"] for r in rows.collect()} <= set(grams)
    assert "PartitionFilters: [bucket" in plan_of(rows) and index.candidates("1234").count() < 10
    found = index.search("1234")
    assert "IsNotNull(block), EqualTo(block" in plan_of(found) and [r["row_id"] for r in found.collect()] == [1234]


def test_an_empty_table_can_be_searched(spark, tmp_path):
    df = spark.createDataFrame([], "row_id long, a string")
    index = TrigramIndex(spark, str(tmp_path / "grams"))
    index.build(df)
    assert index.search("abc").collect() == [] and index.search("").collect() == []
    asked = spark.createDataFrame([(1, "abc")], "query_id long, text string")
    tokens = TokenIndex(spark, str(tmp_path / "tokens"))
    tokens.build(df.withColumnRenamed("a", "text"))
    assert tokens.search(asked).collect() == []
    codes = ProductIndex(spark, str(tmp_path / "codes"))
    codes.build(spark.createDataFrame([], "row_id long, embedding array<double>"))
    assert codes.search(asked.select("query_id", F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))).collect() == []


# -- rows with maps ----------------------------------------------------------------


def test_rows_with_maps_are_deduplicated_and_saved(spark, tmp_path):
    df = spark.createDataFrame([("a", {"k": 1}), ("a", {"k": 1}), ("a", {"k": 2}), ("b", None)], "t string, m map<string,int>")
    rows = dedup_rows(add_row_ids(df))
    assert sorted((r.t, r.m and r.m["k"]) for r in rows.where("m is not null").collect()) == [("a", 1), ("a", 2)] and rows.count() == 3
    assert dedup_rows(add_row_ids(df, ["t"]), ROW_ID, ["t"]).where("t = 'a'").first().m == {"k": 1}
    store = RowStore(spark, str(tmp_path / "store"))
    assert store.save(df) == {"added": 3, "skipped": 1} and store.save(df) == {"added": 0, "skipped": 4}
