import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from rowlens.functions.vectors import cosine_distance, norm, zero_vector
from rowlens.operators import nearest
from rowlens.operators.embed import embed
from rowlens.operators.nearest import (
    assign_cells, knn, knn_approx, lexical_topk, mean_centroids, train_centroids,
)

STRATEGIES = {
    "questions travel": {},
    "index travels": {"broadcast_rows": 20},
    "blocks": {"broadcast_rows": 1, "block_rows": 7},
}


def brute(index, queries, k):
    out = []
    for qid, q in queries:
        ranked = []
        for rid, v in index:
            a, b = np.array(q), np.array(v)
            scale = np.linalg.norm(a) * np.linalg.norm(b)
            d = round(1 - float(a @ b) / scale, 9) if scale else None
            ranked.append((d is None, d, rid))
        ranked.sort(key=lambda t: (t[0], t[1] or 0, t[2]))
        out += [(qid, i + 1, rid, d) for i, (_, d, rid) in enumerate(ranked[:k])]
    return sorted(out)


def frames(spark, index, queries):
    return (
        spark.createDataFrame(index, "row_id string, embedding array<float>").repartition(3),
        spark.createDataFrame(queries, "query_id bigint, embedding array<float>").repartition(2),
    )


def result(df):
    return sorted((r.query_id, r.rank, r.row_id, None if r.distance is None else round(r.distance, 6)) for r in df.collect())


def rounded(rows):
    return [(q, n, r, None if d is None else round(d, 6)) for q, n, r, d in rows]


@pytest.mark.parametrize("options", STRATEGIES.values(), ids=STRATEGIES.keys())
def test_exact_against_brute_force(spark, options):
    rng = np.random.default_rng(3)
    vectors = rng.integers(-3, 4, (20, 4)).astype(float).tolist()
    index = [(f"r{i:02d}", v) for i, v in enumerate(vectors)]
    queries = [(i, v) for i, v in enumerate(rng.integers(-3, 4, (25, 4)).astype(float).tolist())]
    ix, qs = frames(spark, index, queries)
    assert result(knn(ix, qs, 4, **options)) == rounded(brute(index, queries, 4))


@pytest.mark.parametrize("options", STRATEGIES.values(), ids=STRATEGIES.keys())
def test_ties_zero_vectors_and_large_k(spark, options):
    index = [("a", [1.0, 0.0]), ("d", [0.0, 1.0]), ("c", [1.0, 1.0]), ("b", [-1.0, 0.0]), ("e", [0.0, 0.0]), ("f", [2.0, 0.0])]
    queries = [(1, [1.0, 0.0]), (2, [0.0, 0.0])]
    ix, qs = frames(spark, index, queries)
    out = result(knn(ix, qs, 50, **options))
    assert [r[2:] for r in out if r[0] == 1] == [
        ("a", 0.0), ("f", 0.0), ("c", round(1 - math.sqrt(0.5), 6)), ("d", 1.0), ("b", 2.0), ("e", None)
    ]
    assert [r[2:] for r in out if r[0] == 2] == [(i, None) for i in "abcdef"]


@pytest.mark.parametrize("options", STRATEGIES.values(), ids=STRATEGIES.keys())
def test_a_third_of_the_index_is_one_vector(spark, options):
    rng = np.random.default_rng(5)
    index = [(f"h{i:04d}", [1.0, 2.0, 3.0]) for i in range(400)]
    index += [(f"r{i:04d}", v) for i, v in enumerate(rng.normal(size=(800, 3)).tolist())]
    queries = [(0, [1.0, 2.0, 3.0]), (1, [-1.0, 0.5, 0.0])]
    ix, qs = frames(spark, index, queries)
    if "block_rows" in options:
        options = {"broadcast_rows": 1, "block_rows": 300}
    out = result(knn(ix, qs, 5, **options))
    assert [r[2] for r in out if r[0] == 0] == [f"h{i:04d}" for i in range(5)]
    assert out == rounded(brute([(i, np.float32(v).tolist()) for i, v in index], queries, 5))


def test_missing_vectors_and_empty_sides(spark):
    ix, qs = frames(spark, [("a", None), ("b", [1.0, 0.0])], [(1, [1.0, 0.0]), (2, None)])
    for options in STRATEGIES.values():
        assert result(knn(ix, qs, 3, **options)) == [(1, 1, "b", 0.0)]
        assert result(knn(ix.limit(0), qs, 3, **options)) == []
        assert result(knn(ix, qs.limit(0), 3, **options)) == []


def test_distances_do_not_decrease_and_plan_has_no_cross_join(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    ix = rows.select(F.col("vec_id").alias("row_id"), "embedding")
    qs = rows.select(F.col("vec_id").alias("query_id"), "embedding")
    hits = knn(ix, qs, 5)
    by_query = {}
    for r in sorted(hits.collect()):
        by_query.setdefault(r.query_id, []).append(r)
    assert all(q[0].row_id == i and q[0].distance == 0 for i, q in by_query.items())
    assert all([r.distance for r in q] == sorted(r.distance for r in q) for q in by_query.values())
    plan = plan_of(hits)
    assert "MapInArrow" in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    assert "WindowGroupLimit" in plan and "label" not in plan


def test_broadcast_is_refused_by_values_too(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BROADCAST_BYTES", 3)
    ix, qs = frames(spark, [("a", [1.0, 0.0]), ("b", [0.0, 1.0])], [(1, [1.0, 0.1]), (2, [0.0, 1.0])])
    hits = knn(ix, qs, 1)
    assert "FlatMapCoGroupsInArrow" in plan_of(hits)
    assert [r[2] for r in result(hits)] == ["a", "b"]


def test_vector_expressions(spark):
    df = spark.sql("select array(3f, 4f) a, array(4f, 3f) b, array(0f, 0f) z")
    row = df.select(
        norm(F.col("a")).alias("n"), cosine_distance(F.col("a"), F.col("b")).alias("d"),
        cosine_distance(F.col("a"), F.col("z")).alias("u"), zero_vector(3).alias("zero"),
    ).first()
    assert row.n == 5 and round(row.d, 9) == 0.04 and row.u is None and row.zero == [0, 0, 0]


@pytest.mark.parametrize("options", STRATEGIES.values(), ids=STRATEGIES.keys())
def test_lexical_against_brute_force(spark, options):
    texts = ["the red fox", "red red wine", "blue fox", "", "nothing here", "The RED fox!", "wine"]
    docs = [(f"d{i}", t) for i, t in enumerate(texts)]
    questions = [(1, "red fox"), (2, "wine"), (3, "absent"), (4, "  ")]

    def counts(t):
        words = t.lower().replace("!", "").split()
        return {w: words.count(w) for w in words}

    expected = []
    for qid, q in questions:
        ranked = []
        for rid, t in docs:
            a, b = counts(q), counts(t)
            dot = sum(n * b.get(w, 0) for w, n in a.items())
            if dot:
                scale = math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values()))
                ranked.append((round(1 - dot / scale, 9), rid))
        expected += [(qid, i + 1, r, round(d, 6)) for i, (d, r) in enumerate(sorted(ranked)[:3])]
    out = lexical_topk(
        spark.createDataFrame(docs, "row_id string, text string").repartition(2),
        spark.createDataFrame(questions, "query_id bigint, text string"), 3, **options,
    )
    assert result(out) == sorted(expected)


def test_approximate_recall_and_probing_all_cells(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    ix = rows.select(F.col("vec_id").alias("row_id"), "embedding", "label")
    qs = rows.select(F.col("vec_id").alias("query_id"), "embedding")
    exact = result(knn(ix, qs, 5))
    centres = train_centroids(ix, 8)
    cells = assign_cells(ix, centres)
    assert result(knn_approx(cells, qs, centres, 5, n_probe=8)) == exact
    near = result(knn_approx(cells, qs, centres, 5, n_probe=5))
    assert len({r[::2] for r in near} & {r[::2] for r in exact}) / len(exact) >= 0.8
    assert mean_centroids(ix, "label").count() == rows.select("label").distinct().count()


def test_probes_prune_stored_cells(spark, tmp_path):
    ix, qs = frames(spark, [("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [0.9, 0.1])], [(1, [1.0, 0.05])])
    centres = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "cell int, embedding array<double>")
    assign_cells(ix, centres).write.partitionBy("cell").parquet(str(tmp_path / "ix"))
    stored = spark.read.parquet(str(tmp_path / "ix"))
    for file in (tmp_path / "ix" / "cell=1").glob("part-*"):
        file.write_bytes(b"not read")
    assert [r[2] for r in result(knn_approx(stored, qs, centres, 2, n_probe=1))] == ["a", "c"]


def test_probed_cells_with_too_few_rows(spark):
    ix, qs = frames(spark, [("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [0.9, 0.1])], [(1, [1.0, 0.05]), (2, [0.0, 1.0])])
    centres = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "cell int, embedding array<double>")
    hits = knn_approx(assign_cells(ix, centres), qs, centres, 3, n_probe=1)
    assert [r[2] for r in result(hits)] == ["a", "c", "b", "b", "c", "a"]


def test_many_cells_are_assigned_in_blocks(spark):
    rng = np.random.default_rng(3)
    ix = spark.createDataFrame([(f"r{i}", v.tolist()) for i, v in enumerate(rng.normal(size=(40, 4)))], "row_id string, embedding array<float>")
    centres = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(9, 4)))], "cell int, embedding array<double>")
    few = {r.row_id: r.cell for r in assign_cells(ix, centres).collect()}
    assert {r.row_id: r.cell for r in assign_cells(ix, centres, max_cells=2).collect()} == few


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_ragged_vectors_are_refused_and_infinite_ones_rank_last(spark, strategy):
    ix, qs = frames(spark, [("a", [1.0, 2.0, 3.0]), ("b", [1.0] * 5)], [(1, [1.0, 0.0, 0.0, 0.0])])
    with pytest.raises(Exception, match="same length|elements"):
        knn(ix.coalesce(1), qs, 2, **STRATEGIES[strategy]).collect()
    ix, qs = frames(spark, [("a", [float("inf"), 1.0]), ("b", [0.0, 1.0]), ("c", [float("nan"), 0.0])], [(1, [1.0, 0.0])])
    assert result(knn(ix, qs, 3, **STRATEGIES[strategy])) == [(1, 1, "b", 1.0), (1, 2, "a", None), (1, 3, "c", None)]


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_a_model_sees_each_question_once(spark, strategy):
    calls = spark.sparkContext.accumulator(0)

    def model():
        def fn(texts):
            calls.add(len(texts))
            return [[float(len(t)), 1.0] for t in texts]

        return fn

    ix, _ = frames(spark, [(f"r{i}", [float(i), 1.0]) for i in range(30)], [(1, [1.0, 1.0])])
    asked = embed(spark.createDataFrame([(i, "x" * i) for i in range(1, 11)], "query_id bigint, text string"), model, 2)
    hits = knn(ix, asked, 1, **STRATEGIES[strategy])
    assert hits.count() == 10 and calls.value == 10


def test_token_sums_in_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(nearest.TokenQuestions, "additions", 3)
    monkeypatch.setattr(nearest.TokenQuestions, "chunk", 2)
    docs = spark.createDataFrame([(i, " ".join(f"w{j % (i + 2)}" for j in range(12))) for i in range(8)], "row_id bigint, text string")
    asked = docs.select(F.col("row_id").alias("query_id"), "text")
    hits = lexical_topk(docs, asked, 1).collect()
    assert {r.query_id: (r.row_id, r.distance) for r in hits} == {i: (i, 0.0) for i in range(8)}


def test_candidates_of_many_tasks_merge_in_two_steps(spark, monkeypatch):
    from pyspark.sql import functions as F

    from rowlens.operators import nearest

    index = spark.range(0, 500, 1, 23).select(F.col("id").alias("row_id"), F.array(F.sin("id"), F.cos(F.col("id") * 3), F.lit(0.5)).alias("embedding"))
    asked = index.where("row_id < 40").select(F.col("row_id").alias("query_id"), "embedding")
    expected = sorted(map(tuple, nearest.knn(index, asked, 4).collect()))
    monkeypatch.setattr(nearest, "_merge_groups", lambda df: 5)
    merged = nearest.knn(index, asked, 4)
    assert sorted(map(tuple, merged.collect())) == expected and "merge_group" in str(merged._jdf.queryExecution().toString())


def test_a_scan_ranks_few_pairs_and_gives_the_hits_of_all(monkeypatch):
    rng = np.random.default_rng(8)
    rows = rng.standard_normal((9_000, 8))
    rows[4_000:6_500] = rows[7]  # copies
    rows[[5, 8_000]] = 0.0
    rows[6] = np.nan
    asked = np.concatenate([rng.standard_normal((250, 8)), rows[[7, 5]]])
    ids = rng.permutation(9_000)
    lists = lambda x: pa.array(x.tolist(), pa.list_(pa.float64()))
    batch = pa.RecordBatch.from_arrays([pa.array(ids), lists(rows)], ["row_id", "payload"])
    questions = nearest.VectorQuestions(pa.table({"query_id": pa.array(np.arange(252)), "payload": lists(asked)}))
    dense, block = [], nearest.VectorQuestions._block
    monkeypatch.setattr(
        nearest.VectorQuestions, "_block", lambda self, a, u, d: dense.append((len(a), len(u))) or block(self, a, u, d)
    )
    best = nearest._scan(questions, iter([batch.slice(i, 3_000) for i in (0, 3_000, 6_000)]), 4, pa.int64())
    assert sum(a * n for a, n in dense) < 252 * 9_000 / 4 and max(a * n for a, n in dense) <= 128 * 8_192
    ranks = block(questions, np.arange(252), *nearest._unit(rows))
    for q in range(252):
        order = np.lexsort((ids, ranks[q]))[:4]
        mine = best.filter(pc.equal(best["query"], q))
        assert mine["row_id"].to_pylist() == ids[order].tolist() and mine["rank"].to_pylist() == ranks[q, order].tolist()
