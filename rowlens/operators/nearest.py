"""Nearest rows by cosine distance, for whole tables of questions.

The index is scanned where it lies. Each task multiplies Arrow blocks of it with
the questions and keeps the best ``k`` per question, so what is shuffled is
``questions x k`` rows per task and never pairs. Which side travels depends on
size, measured with a bounded read:

* few questions: they are broadcast to the index scan;
* few index rows: they are broadcast to the questions, and nothing is shuffled;
* many of both: both sides are hashed into blocks of bounded size and every pair
  of blocks is one small co-grouped task.

Questions are computed once, when the search is built, and kept in the shared
scratch folder, so a model behind them runs once whichever way is taken.
All three give the same rows. Distances are rounded to nine decimals before
ranking, equal ones are ordered by ``row_id``, and a vector that is zero or not
finite has no distance: null, ranked last. Vectors of several lengths are refused.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from rowlens.functions.text import tokens
from rowlens.sources.scratch import kept

# A side is collected and broadcast only when a count has shown that it has at
# most this many rows and this many bytes in all.
BROADCAST_ROWS = 16_384
BROADCAST_BYTES = 128 << 20
# Up to this many hits (questions x k) carry a broadcast hint, so that fetching
# their texts scans the index without shuffling it.
BROADCAST_HITS = 500_000
# Scans of more tasks merge their candidates in two steps.
MERGE_TASKS = 256
# Limits of one block when both sides are large.
BLOCK_ROWS = 16_384
BLOCK_BYTES = 128 << 20

_SCALE = 10**9
_UNDEFINED = 2**31 - 1  # a zero vector is involved
_EXCLUDED = 2**31  # not a candidate at all


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.list_value_length(column)
    if len(column) and (column.null_count or pc.min_max(sizes)["min"] != pc.min_max(sizes)["max"]):
        raise ValueError("the vectors of a search must all have the same length")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _unit(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to length one, and which rows have a finite length above zero."""
    finite = np.isfinite(matrix).all(axis=1)
    matrix = np.where(finite[:, None], matrix, 0.0)
    lengths = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    return matrix / np.where(lengths > 0, lengths, 1.0)[:, None], lengths > 0


def _ranks(cosine: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(1.0 - cosine, 0.0, 2.0) * _SCALE).astype(np.int64)


class VectorQuestions:
    """Questions given as vectors; with ``cells``, each looks at its own cells only."""

    block_rows, chunk = 8_192, 512
    # Rows of the first block, which gives the bars; questions that are ranked against all rows of a block at once.
    first_rows, dense = 1_024, 128
    # Pairs that are measured exactly in one piece.
    pairs = 32_768

    def __init__(self, table: pa.Table):
        self.ids = table["query_id"].combine_chunks()
        self.unit, self.defined = _unit(_matrix(table["payload"]))
        self.single = self.unit.astype(np.float32)
        self.by_cell = None
        if "cells" in table.column_names:
            lists = table["cells"].combine_chunks()
            owner = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            cells = lists.flatten().to_numpy(zero_copy_only=False)
            order = np.argsort(cells, kind="stable")
            names, starts = np.unique(cells[order], return_index=True)
            self.by_cell = dict(zip(names.tolist(), np.split(owner[order], starts[1:])))

    def load(self, batch: pa.RecordBatch):
        cells = batch.column("cell").to_numpy(zero_copy_only=False) if self.by_cell is not None else None
        return *_unit(_matrix(batch.column("payload"))), cells

    def _block(self, asks: np.ndarray, unit: np.ndarray, defined: np.ndarray) -> np.ndarray:
        if len(asks):
            self._same_length(unit)
        undefined = ~self.defined[asks, None] | ~defined[None, :]
        return np.where(undefined, _UNDEFINED, _ranks(self.unit[asks] @ unit.T))

    def _groups(self, cell_of: np.ndarray | None, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(questions, rows) that are to be compared with each other."""
        if cell_of is None:
            return [(np.arange(len(self.ids)), np.arange(n))]
        order = np.argsort(cell_of, kind="stable")
        names, starts = np.unique(cell_of[order], return_index=True)
        rows_of = np.split(order, starts[1:])
        none = np.zeros(0, np.int64)
        return [(self.by_cell.get(n, none), rows) for n, rows in zip(names.tolist(), rows_of)]

    def found(self, loaded, k: int, bar: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(question, row, rank) of the pairs that may be among the first ``k``, in bounded pieces.

        ``bar`` holds the rank that ``k`` rows of a question are known not to exceed.
        Products in single precision tell which pairs may reach it, with room for
        their error; only these are measured in double precision.
        """
        unit, defined, cell_of = loaded
        single = unit.astype(np.float32)
        room = (unit.shape[1] + 8) * 2.0**-22 + 1 / _SCALE
        for asks, rows in self._groups(cell_of, len(unit)):
            for lo in range(0, len(asks), self.chunk):
                some = asks[lo : lo + self.chunk]
                barred = bar[some] < _UNDEFINED
                whole, some = some[~barred], some[barred]
                if len(some):
                    self._same_length(unit)
                    least = (1.0 - bar[some] / _SCALE - room).astype(np.float32)
                    near = self.single[some] @ (single if len(rows) == len(single) else single[rows]).T >= least[:, None]
                    if np.count_nonzero(near) * 8 > near.size:  # many copies
                        whole = np.concatenate([whole, some])
                    else:
                        query, row = np.nonzero(near)
                        query, row = some[query], rows[row]
                        for at in range(0, len(query), self.pairs):
                            q, r = query[at : at + self.pairs], row[at : at + self.pairs]
                            rank = _ranks(np.einsum("ij,ij->i", self.unit[q], unit[r]))
                            good = (rank <= bar[q]) & defined[r]
                            yield q[good], r[good], rank[good]
                for at in range(0, len(whole), self.dense):
                    part = whole[at : at + self.dense]
                    yield _first(part, rows, self._block(part, unit[rows], defined[rows]), k, bar)

    def _same_length(self, unit: np.ndarray) -> None:
        if len(unit) and self.unit.shape[1] != unit.shape[1]:
            raise ValueError(f"questions have {self.unit.shape[1]} elements, the index has {unit.shape[1]}")


def _token_counts(lists: pa.ListArray):
    """Distinct tokens, and (row, token, count) triplets of a column of token lists."""
    encoded = lists.flatten().dictionary_encode()
    width = max(1, len(encoded.dictionary))
    rows = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    cells, counts = np.unique(rows * width + codes, return_counts=True)
    return encoded.dictionary, cells // width, cells % width, counts.astype(np.float64)


class TokenQuestions:
    """Questions given as tokens; cosine of token counts, rows without a shared token are no hits.

    Questions are held as posting lists, from a token to the questions with it.
    Only tokens that a row and a question share cost anything, and they are
    added up in pieces of bounded size.
    """

    block_rows = first_rows = 1_024
    chunk = 64
    additions = 2_000_000

    def __init__(self, table: pa.Table):
        self.ids = table["query_id"].combine_chunks()
        self.words, question, word, count = _token_counts(table["payload"].combine_chunks())
        lengths = np.sqrt(np.bincount(question, count**2, len(self.ids)))
        order = np.lexsort((question, word))
        self.question, word = question[order], word[order]
        self.weight = (count / np.where(lengths > 0, lengths, 1.0)[question])[order]
        self.first = np.searchsorted(word, np.arange(len(self.words) + 1))

    def load(self, batch: pa.RecordBatch):
        words, row, word, count = _token_counts(batch.column("payload"))
        lengths = np.sqrt(np.bincount(row, count**2, batch.num_rows))
        place = np.zeros(0, np.int64)
        if len(words) and len(self.words):
            place = pc.fill_null(pc.index_in(words, self.words), -1).to_numpy(zero_copy_only=False)[word].astype(np.int64)
        hit = np.flatnonzero(place >= 0) if len(place) else np.zeros(0, np.int64)
        share = count[hit] / np.where(lengths > 0, lengths, 1.0)[row[hit]]
        return batch.num_rows, row[hit], place[hit] if len(place) else hit, share

    def found(self, loaded, k: int, bar: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        n, row, word, share = loaded
        for lo in range(0, len(self.ids), self.chunk):
            hi = min(lo + self.chunk, len(self.ids))
            cosine = np.zeros((hi - lo) * n)
            # A token's questions are sorted, so those of the chunk are one stretch.
            begin, end = self._stretch(lo, hi)
            some = end[word] - begin[word]
            cuts = np.searchsorted(np.cumsum(some), np.arange(self.additions, int(some.sum()) + 1, self.additions))
            for part in np.split(np.arange(len(some)), cuts + 1):
                sizes = some[part]
                total = int(sizes.sum())
                if total:
                    at = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(begin[word[part]], sizes)
                    place = (self.question[at] - lo) * n + np.repeat(row[part], sizes)
                    cosine += np.bincount(place, self.weight[at] * np.repeat(share[part], sizes), len(cosine))
            cosine = cosine.reshape(hi - lo, n)
            yield _first(np.arange(lo, hi), np.arange(n), np.where(cosine > 0, _ranks(cosine), _EXCLUDED), k, bar)

    def _stretch(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Where in each token's posting list the questions ``lo`` to ``hi`` stand."""
        inside = (self.question >= lo) & (self.question < hi)
        before = self.question < lo
        upto = [np.concatenate([[0], np.cumsum(x)]) for x in (before, inside)]
        begin = self.first[:-1] + upto[0][self.first[1:]] - upto[0][self.first[:-1]]
        return begin, begin + upto[1][self.first[1:]] - upto[1][self.first[:-1]]


def _best(found: list[pa.Table], k: int) -> pa.Table:
    """The first ``k`` per question of all found rows, with their place."""
    table = pa.concat_tables(found).sort_by(
        [("query", "ascending"), ("rank", "ascending"), ("row_id", "ascending")]
    )
    query = table["query"].to_numpy()
    starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.empty(0, np.int64)
    place = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
    keep = place < k
    return table.filter(pa.array(keep)).append_column("place", pa.array(place[keep] + 1, pa.int32()))


def _present(rows):
    """Rows that have a vector or tokens at all."""
    payload = rows.column("payload")
    return rows.filter(pc.is_valid(payload)) if payload.null_count else rows


def _first(asks: np.ndarray, rows: np.ndarray, ranks: np.ndarray, k: int, bar: np.ndarray):
    """(question, row, rank) of the first ``k`` of each line of ``ranks``, ties by row; lowers the bars to the last of them."""
    if not ranks.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    packed = (ranks << 31) | rows[None, :]
    if k < packed.shape[1]:
        packed = np.partition(packed, k - 1, axis=1)[:, :k]
    if k <= packed.shape[1]:
        bar[asks] = np.minimum(bar[asks], packed.max(axis=1) >> 31)
    query = np.repeat(asks, packed.shape[1])
    packed = packed.ravel()
    ok = (packed >> 31) < _EXCLUDED
    return query[ok], packed[ok] & (2**31 - 1), packed[ok] >> 31


def _pieces(rows: int, first: int, most: int, seen: int) -> Iterator[tuple[int, int]]:
    """Stretches of a batch, short ones until as many rows have been seen."""
    at = 0
    while at < rows:
        n = min(most, max(first, seen + at))
        yield at, n
        at += n


def _scan(questions, batches: Iterator[pa.RecordBatch], k: int, id_type: pa.DataType) -> pa.Table:
    empty = pa.table(
        {"query": pa.array([], pa.int64()), "rank": pa.array([], pa.int64()), "row_id": pa.array([], id_type)}
    )
    found, fresh, seen = [empty], 0, 0
    bar = np.full(len(questions.ids), _EXCLUDED, np.int64)
    for whole in batches:
        for start, n in _pieces(whole.num_rows, questions.first_rows, questions.block_rows, seen):
            batch = _present(whole.slice(start, n))
            if not batch.num_rows:
                continue
            # In row_id order the position in the block breaks ties.
            batch = batch.take(pc.sort_indices(batch.column("row_id")))
            names = batch.column("row_id").cast(id_type)
            for query, row, rank in questions.found(questions.load(batch), k, bar):
                if not len(query):
                    continue
                found.append(pa.table({"query": pa.array(query), "rank": pa.array(rank), "row_id": names.take(pa.array(row))}))
                fresh += len(query)
                if fresh > 2 * k * len(bar) + (1 << 18):
                    found, fresh = [_held(found, k, bar)], 0
            if fresh > 2 * k * len(bar):
                found, fresh = [_held(found, k, bar)], 0
        seen += whole.num_rows
    return _best(found, k)


def _held(found: list[pa.Table], k: int, bar: np.ndarray) -> pa.Table:
    """The first ``k`` per question so far; their last ranks are the new bars."""
    best = _best(found, k)
    last = best.filter(pc.equal(best["place"], k))
    query = last["query"].to_numpy()
    bar[query] = np.minimum(bar[query], last["rank"].to_numpy())
    return best.drop_columns("place")


def _answer_table(questions, best: pa.Table) -> pa.Table:
    rank = best["rank"].to_numpy()
    distance = pa.array(rank / _SCALE, mask=rank == _UNDEFINED)
    return pa.table(
        {
            "query_id": questions.ids.take(best["query"].combine_chunks()),
            "rank": best["place"],
            "row_id": best["row_id"],
            "distance": distance,
        }
    )


def _result_schema(queries: DataFrame, index: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("rank", T.IntegerType()),
            T.StructField("row_id", index.schema["row_id"].dataType),
            T.StructField("distance", T.DoubleType()),
        ]
    )


def _size(df: DataFrame) -> tuple[int, int]:
    """Rows, and bytes of all vectors or tokens."""
    element = df.schema["payload"].dataType.elementType
    each = F.octet_length(F.concat_ws(" ", "payload")) if isinstance(element, T.StringType) else F.size("payload") * 8
    return tuple(df.agg(F.count(F.lit(1)), F.coalesce(F.sum(each), F.lit(0)).cast("bigint")).first())


def _estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate, without running anything."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _merge_groups(index: DataFrame) -> int:
    """Groups of scan tasks that merge among themselves first, so that no task sees all candidates of a question.

    One while the scan is estimated to have few tasks; then about the root of their number.
    """
    per_task = index.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    tasks = _estimated_bytes(index) // max(1, per_task)
    return 1 if tasks <= MERGE_TASKS else math.isqrt(tasks)


def _top_k(partial: DataFrame, k: int, groups: int = 1) -> DataFrame:
    if groups > 1:
        own = partial.withColumn("merge_group", F.spark_partition_id() % groups)
        first = Window.partitionBy("query_id", "merge_group").orderBy(F.col("distance").asc_nulls_last(), "row_id")
        partial = own.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= k).drop("nth", "merge_group")
    order = Window.partitionBy("query_id").orderBy(F.col("distance").asc_nulls_last(), "row_id")
    return (
        partial.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "row_id", "distance")
    )


def _search(
    index: DataFrame, queries: DataFrame, k: int, kind, broadcast_rows: int, block_rows: int
) -> DataFrame:
    spark, schema = index.sparkSession, _result_schema(queries, index)
    id_type = to_arrow_type(index.schema["row_id"].dataType)

    def fits(size: tuple[int, int]) -> bool:
        return size[0] <= broadcast_rows and size[1] <= BROADCAST_BYTES

    # Whatever computes the questions, a model perhaps, runs once, here, in every plan.
    queries = kept(queries, "questions")
    query_size = _size(queries)
    if fits(query_size):
        shared = spark.sparkContext.broadcast(_present(queries.toArrow()))

        def scan_index(batches):
            questions = kind(shared.value)
            yield from _answer_table(questions, _scan(questions, batches, k, id_type)).to_batches()

        hits = _top_k(index.mapInArrow(scan_index, schema), k, _merge_groups(index))
        return F.broadcast(hits) if query_size[0] * k <= BROADCAST_HITS else hits

    # An index that may be small is counted; one that is large is not scanned to find out.
    if _estimated_bytes(index) <= 4 * BROADCAST_BYTES and fits(_size(index)):
        shared = spark.sparkContext.broadcast(index.toArrow())

        def scan_questions(batches):
            rows = shared.value.combine_chunks().to_batches()
            for batch in batches:
                if batch.num_rows:
                    questions = kind(_present(pa.Table.from_batches([batch])))
                    yield from _answer_table(questions, _scan(questions, rows, k, id_type)).to_batches()

        return queries.mapInArrow(scan_questions, schema)

    def n_blocks(size: tuple[int, int]) -> int:
        return max(1, -(-size[0] // block_rows), -(-size[1] // BLOCK_BYTES))

    parts = n_blocks(_size(index)), n_blocks(query_size)

    def blocks(df: DataFrame, key: str, mine: int):
        own = F.pmod(F.xxhash64(key), F.lit(parts[mine])).alias(f"block{mine}")
        others = F.sequence(F.lit(0).cast("bigint"), F.lit(parts[1 - mine] - 1).cast("bigint"))
        return df.select("*", own, F.explode(others).alias(f"block{1 - mine}")).groupBy("block0", "block1")

    def scan_block(rows: pa.Table, asked: pa.Table) -> pa.Table:
        questions = kind(_present(asked))
        return _answer_table(questions, _scan(questions, rows.combine_chunks().to_batches(), k, id_type))

    grid = blocks(index, "row_id", 0).cogroup(blocks(queries, "query_id", 1))
    return _top_k(grid.applyInArrow(scan_block, schema), k)


def knn(
    index: DataFrame,
    queries: DataFrame,
    k: int = 5,
    vector: str = "embedding",
    broadcast_rows: int = BROADCAST_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Exact top ``k`` of ``index(row_id, embedding)`` for each of ``queries(query_id, embedding)``.

    Returns ``query_id, rank, row_id, distance``. ``row_id`` is unique in the index.
    """
    return _search(
        index.select("row_id", F.col(vector).alias("payload")),
        queries.select("query_id", F.col(vector).alias("payload")),
        k,
        VectorQuestions,
        broadcast_rows,
        block_rows,
    )


def lexical_topk(
    documents: DataFrame,
    queries: DataFrame,
    k: int = 5,
    text: str = "text",
    broadcast_rows: int = BROADCAST_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Top ``k`` of ``documents(row_id, text)`` by cosine of token counts.

    Texts are cut in the JVM. Documents that share no token with a question are
    not returned for it.
    """
    return _search(
        documents.select("row_id", tokens(F.col(text)).alias("payload")),
        queries.select("query_id", tokens(F.col(text)).alias("payload")),
        k,
        TokenQuestions,
        broadcast_rows,
        block_rows,
    )


# -- approximate search ---------------------------------------------------


def train_centroids(
    index: DataFrame, n_cells: int, vector: str = "embedding", iterations: int = 10, seed: int = 42
) -> DataFrame:
    """Centres of ``n_cells`` k-means clusters: ``cell, embedding``."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    usable = index.filter(F.exists(vector, lambda x: x != 0))
    points = usable.select(array_to_vector(F.col(vector)).alias("features"))
    model = KMeans(k=n_cells, maxIter=iterations, seed=seed, distanceMeasure="cosine").fit(points)
    rows = [(i, [float(x) for x in centre]) for i, centre in enumerate(model.clusterCenters())]
    return index.sparkSession.createDataFrame(rows, "cell int, embedding array<double>")


def mean_centroids(index: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    """Centres from an existing grouping: the mean vector of each group, as ``cell, embedding``."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    mean = vector_to_array(Summarizer.mean(F.col("features")))
    return (
        index.select(F.col(group).alias("cell"), array_to_vector(F.col(vector)).alias("features"))
        .groupBy("cell")
        .agg(mean.alias("embedding"))
    )


def assign_cells(
    index: DataFrame, centroids: DataFrame, vector: str = "embedding", max_cells: int = BROADCAST_ROWS
) -> DataFrame:
    """Add ``cell``, the nearest centre. Write the result partitioned by ``cell`` to read probed cells only.

    Centres too many to send to every task meet the rows block by block, which
    needs ``row_id`` to bring the cells back.
    """
    centroids = kept(centroids.select("cell", "embedding"), "centres")
    rows, size = _size(centroids.select(F.col("embedding").alias("payload")))
    if rows > max_cells or size > BROADCAST_BYTES:
        asked = index.where(F.col(vector).isNotNull()).select(F.col("row_id").alias("query_id"), F.col(vector).alias("embedding"))
        best = knn(centroids.withColumnRenamed("cell", "row_id"), asked, 1, broadcast_rows=max_cells)
        cells = best.select(F.col("query_id").alias("row_id"), F.col("row_id").alias("cell"))
        return index.join(cells, "row_id", "left").select(*[F.col(f"`{c}`") for c in index.columns], "cell")
    shared = index.sparkSession.sparkContext.broadcast(
        centroids.orderBy("cell").select("cell", "embedding").toArrow()
    )

    @F.arrow_udf("int")
    def nearest_cell(vectors: pa.Array) -> pa.Array:
        centres, _ = _unit(_matrix(shared.value["embedding"]))
        cells = shared.value["cell"].to_numpy()
        known = vectors.is_valid()
        unit, _ = _unit(_matrix(vectors.filter(known)))
        out = np.full(len(vectors), -1, dtype=np.int32)
        if len(unit):
            out[known.to_numpy(zero_copy_only=False)] = cells[_ranks(unit @ centres.T).argmin(axis=1)]
        return pa.array(out, mask=out < 0)

    # Marked so that filters and joins on the cell do not compute it a second time.
    nearest_cell = nearest_cell.asNondeterministic()
    return index.withColumn("cell", nearest_cell(F.col(vector)))


def knn_approx(
    index: DataFrame,
    queries: DataFrame,
    centroids: DataFrame,
    k: int = 5,
    n_probe: int = 3,
    vector: str = "embedding",
    broadcast_rows: int = BROADCAST_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Top ``k`` within the ``n_probe`` cells nearest to each question (inverted file search).

    ``index`` carries ``cell`` from :func:`assign_cells`. Stored partitioned by
    ``cell``, only the probed folders are read. A cell is spread over as many
    tasks as its files need, so an overfull one is no hot spot. A question whose
    cells hold fewer than ``k`` rows is searched exactly.
    """
    queries = kept(queries.select("query_id", F.col(vector).alias("embedding")), "questions")
    centres = kept(centroids.select(F.col("cell").alias("row_id"), F.col("embedding")), "centres")
    nearest = kept(knn(centres, queries, n_probe), "probes")
    probes = nearest.groupBy("query_id").agg(F.collect_set("row_id").alias("cells"))
    asked = queries.select("query_id", F.col("embedding").alias("payload")).join(probes, "query_id")
    # The condition on the rank lets the planner prune the folders of the other cells.
    probed = nearest.where(F.col("rank") <= n_probe).select(F.col("row_id").alias("cell")).distinct()
    rows = index.join(probed, "cell", "left_semi").select("row_id", F.col(vector).alias("payload"), "cell")
    hits = kept(_search(rows, asked, k, VectorQuestions, broadcast_rows, block_rows), "hits")
    full = hits.where(F.col("rank") == k).select("query_id")
    short = kept(queries.where("embedding is not null").join(full, "query_id", "left_anti"), "short")
    if short.isEmpty():
        return hits
    # Their cells hold fewer than k rows: these questions look everywhere.
    rest = knn(index.select("row_id", F.col(vector).alias("embedding")), short, k, "embedding", broadcast_rows, block_rows)
    return hits.join(short.select("query_id"), "query_id", "left_anti").unionByName(rest)
