"""Approximate nearest rows over product-quantised codes.

A vector of unit length is cut into parts, and each part is replaced by the
nearest of at most 256 centres that were trained for it: one byte per part. The
estimate for a row is the product of a question with the centres that the row's
bytes name, many rows and questions at once. A search reads codes only, keeps
a shortlist per question, fetches the vectors of the shortlists and ranks them
exactly, as :func:`rowlens.operators.nearest.knn` does.

    path/codebooks   part, centres
    path/codes       row_id, codes
    path/vectors     [bucket=.../] row_id, embedding
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from rowlens.operators.nearest import BROADCAST_BYTES, _matrix, _ranks, _SCALE, _top_k, _unit, knn
from rowlens.sources.scratch import kept

CENTRES = 256
# Vectors that the centres are trained on, at most about.
SAMPLE_ROWS = 16_384
ITERATIONS = 12
# Rows per bucket of stored vectors; a search reads the buckets of its shortlists.
BUCKET_ROWS = 1 << 20
SHORTLIST = 60
SEED = 5
# Questions and rows whose estimates are summed in one piece.
ASKS_AT_ONCE, ROWS_AT_ONCE = 512, 4_096
# Questions sent to all tasks at once, at most; a task keeps a shortlist for each.
SEARCH_ROWS = 65_536


def _centres(points: np.ndarray, seed: int) -> np.ndarray:
    """Centres of at most ``CENTRES`` k-means clusters; each is some points' mean."""
    rng = np.random.default_rng([SEED, seed])
    distinct = np.unique(points, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:CENTRES]]
    for _ in range(ITERATIONS if len(distinct) > CENTRES else 0):
        nearest = _nearest(points, centres)
        counts = np.bincount(nearest, minlength=len(centres))
        sums = np.stack([np.bincount(nearest, points[:, d], len(centres)) for d in range(points.shape[1])], axis=1)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = 0.5 * (centres * centres).sum(axis=1)
    return np.concatenate(
        [(points[i : i + 8_192] @ centres.T - half).argmax(axis=1) for i in range(0, len(points), 8_192)] or [np.zeros(0, np.int64)]
    )


def train_codebooks(index: DataFrame, parts: int, vector: str = "embedding", rows: int = SAMPLE_ROWS) -> DataFrame:
    """``part, centres`` (one list of numbers after another), from a bounded sample by a hash of the id.

    The parts are trained side by side, one small task each.
    """
    usable = index.where(F.exists(vector, lambda x: x != 0) & ~F.exists(vector, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))))
    share = int((1 << 30) * min(1.0, rows / max(1, usable.count())))
    sample = usable.where(F.pmod(F.xxhash64("row_id"), F.lit(1 << 30)) <= share)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit, _ = _unit(_matrix(batch.column(0)))
            for i, piece in enumerate(np.array_split(unit, parts, axis=1)):
                lists = pa.FixedSizeListArray.from_arrays(pa.array(piece.ravel()), piece.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(piece), i, np.int32)), lists], ["part", "piece"])

    def train(rows: pa.Table) -> pa.Table:
        part = rows["part"][0].as_py()
        centres = _centres(_matrix(rows["piece"]), part)
        return pa.table({"part": pa.array([part], pa.int32()), "centres": pa.array([centres.ravel().tolist()], pa.list_(pa.float64()))})

    pieces = sample.select(vector).mapInArrow(cut, "part int, piece array<double>")
    return pieces.groupBy("part").applyInArrow(train, "part int, centres array<double>")


class _Codebooks:
    def __init__(self, table: list[tuple[int, list[float]]], dim: int):
        self.dim = dim
        widths = [len(x) for x in np.array_split(np.arange(dim), len(table))]
        self.bounds = np.concatenate([[0], np.cumsum(widths)])
        self.centres = [np.array(c).reshape(-1, w) for (_, c), w in zip(sorted(table), widths)]

    def encode(self, unit: np.ndarray) -> np.ndarray:
        cut = list(zip(self.bounds, self.bounds[1:]))
        return np.stack([_nearest(unit[:, a:b], c) for (a, b), c in zip(cut, self.centres)], axis=1).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The centres that the codes name, side by side: products with them are the estimates."""
        return np.concatenate([c[codes[:, i]] for i, c in enumerate(self.centres)], axis=1).astype(np.float32)


class _Shortlist:
    """The ``n`` best estimates of a few questions; a row must reach the least of them to be kept."""

    def __init__(self, asked: np.ndarray, n: int):
        self.asked, self.n = asked.astype(np.float32), n
        self.least = np.full(len(asked), -np.inf, np.float32)
        self.held: list[tuple] = []
        self.fresh = 0

    def add(self, decoded: np.ndarray, first: int) -> None:
        """Rows numbered from ``first``."""
        sums = self.asked @ decoded.T
        if len(decoded) > self.n and not np.isfinite(self.least).any():
            row = np.argpartition(-sums, self.n - 1, axis=1)[:, : self.n].ravel()
            query = np.repeat(np.arange(len(sums)), self.n)
        else:
            query, row = np.nonzero(sums >= self.least[:, None])
        if len(query):
            self.held.append((query, row + first, sums[query, row]))
            self.fresh += len(query)
            if self.fresh > 2 * self.n * len(self.least):
                self._cut()

    def _cut(self) -> None:
        query, row, score = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort((row, -score, query))
        query, row, score = query[order], row[order], score[order]
        starts = np.searchsorted(query, np.arange(len(self.least)))
        nth = np.arange(len(query)) - starts[query]
        last = nth == self.n - 1
        self.least[query[last]] = score[last]
        keep = nth < self.n
        self.held, self.fresh = [(query[keep], row[keep], score[keep])], 0

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self._cut()
        return self.held[0]


class ProductIndex:
    """Stored codes and vectors of ``row_id, embedding``. All vectors have one length."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, index: DataFrame, parts: int = 16, vector: str = "embedding", sample_rows: int = SAMPLE_ROWS) -> None:
        """Train, encode and store. Vectors that are null, zero or not finite have no code.

        ``row_id`` is unique. More parts make longer codes and better estimates.
        """
        rows = index.select("row_id", F.col(vector).alias("embedding"))
        first = rows.where(F.size("embedding") > 0).select(F.size("embedding").alias("dim")).first()
        dim = first["dim"] if first else 0
        parts = max(1, min(parts, dim))
        buckets = max(1, -(-rows.count() // BUCKET_ROWS))
        books = train_codebooks(rows, parts, "embedding", sample_rows)
        books.withColumns({"buckets": F.lit(buckets), "dim": F.lit(dim)}).write.parquet(f"{self.path}/codebooks")
        placed = rows.withColumn("bucket", F.pmod(F.xxhash64("row_id"), F.lit(buckets)).cast("int"))
        # One bucket is no folder, so that even an empty table has its columns written.
        writer = placed.write.partitionBy("bucket") if buckets > 1 else placed.write
        writer.parquet(f"{self.path}/vectors")
        books = self._books()
        kind = rows.schema["row_id"].dataType.simpleString()

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                batch = batch.filter(pc.is_valid(batch.column("embedding")))
                if not batch.num_rows:
                    continue
                unit, defined = _unit(_matrix(batch.column("embedding")))
                keep = np.flatnonzero(defined)
                codes = books.value.encode(unit[keep])
                data = [c.tobytes() for c in codes]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row_id").take(pa.array(keep)), pa.array(data, pa.binary())], ["row_id", "codes"]
                )

        if dim:
            rows.mapInArrow(encode, f"row_id {kind}, codes binary").write.parquet(f"{self.path}/codes")
        else:
            rows.limit(0).select("row_id", F.lit(b"").alias("codes")).write.parquet(f"{self.path}/codes")

    def _books(self):
        """Sent to all tasks: at most 256 centres of each part, as many numbers as 256 vectors hold."""
        table = self.spark.read.parquet(f"{self.path}/codebooks").collect()
        books = _Codebooks([(r["part"], r["centres"]) for r in table], table[0]["dim"]) if table else None
        return self.spark.sparkContext.broadcast(books)

    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors").select("row_id", "embedding", "bucket")

    def codes(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/codes")

    def shortlists(self, questions: DataFrame, n: int) -> DataFrame:
        """``query_id, row_id`` of the ``n`` best estimates per question; ``questions(query_id, embedding)`` are few."""
        asked = self.spark.sparkContext.broadcast(questions.toArrow())
        books = self._books()
        ids, codes = questions.schema["query_id"].dataType, self.codes()
        kinds = f"query_id {ids.simpleString()}, row_id {codes.schema['row_id'].dataType.simpleString()}, estimate double"

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = asked.value["query_id"].combine_chunks()
            unit, defined = _unit(_matrix(asked.value["embedding"]))
            known = np.flatnonzero(defined) if books.value else np.zeros(0, np.int64)
            if len(known) and unit.shape[1] != books.value.dim:
                raise ValueError(f"questions have {unit.shape[1]} elements, the index has {books.value.dim}")
            lists = [_Shortlist(unit[known[lo : lo + ASKS_AT_ONCE]], n) for lo in range(0, len(known), ASKS_AT_ONCE)]
            rows, seen = [], 0
            for whole in batches:
                for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                    batch = whole.slice(at, ROWS_AT_ONCE)
                    code = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(len(batch), -1)
                    rows.append(batch.column("row_id"))
                    if lists:
                        decoded = books.value.decode(code)
                    for some in lists:
                        some.add(decoded, seen)
                    seen += len(batch)
            if not seen or not lists:
                return
            all_rows = pa.chunked_array(rows).combine_chunks()
            for i, some in enumerate(lists):
                query, row, score = some.result()
                yield pa.RecordBatch.from_arrays(
                    [
                        names.take(pa.array(known[query + i * ASKS_AT_ONCE])),
                        all_rows.take(pa.array(row)),
                        pa.array(score.astype(np.float64)),
                    ],
                    ["query_id", "row_id", "estimate"],
                )

        found = codes.mapInArrow(scan, kinds)
        order = Window.partitionBy("query_id").orderBy(F.desc("estimate"), "row_id")
        return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= n).select("query_id", "row_id")

    def _ranked(self, questions: DataFrame, k: int, n: int) -> DataFrame:
        """Exact top ``k`` of the shortlists of a bounded number of questions."""
        pairs = kept(self.shortlists(questions, n), "shortlists")
        vectors = self.vectors()
        buckets = (self.spark.read.parquet(f"{self.path}/codebooks").agg(F.max("buckets")).first()[0]) or 1
        if buckets > 1:  # the buckets of the shortlists are all that is read of the vectors
            pairs = pairs.withColumn("bucket", F.pmod(F.xxhash64("row_id"), F.lit(buckets)).cast("int"))
            wanted = [r["bucket"] for r in pairs.select("bucket").distinct().collect()]
            vectors = vectors.where(F.col("bucket").isin(wanted))
        rows = vectors.drop("bucket")
        asked = self.spark.sparkContext.broadcast(questions.toArrow())
        schema = f"query_id {pairs.schema['query_id'].dataType.simpleString()}, row_id {pairs.schema['row_id'].dataType.simpleString()}, distance double"

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            unit, _ = _unit(_matrix(asked.value["embedding"]))
            for batch in batches:
                if batch.num_rows:
                    own, _ = _unit(_matrix(batch.column("embedding")))
                    place = pc.index_in(batch.column("query_id"), asked.value["query_id"].combine_chunks()).to_numpy()
                    cosine = np.einsum("ij,ij->i", unit[place], own)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("query_id"), batch.column("row_id"), pa.array(_ranks(cosine) / _SCALE)],
                        ["query_id", "row_id", "distance"],
                    )

        joined = rows.join(pairs.select("query_id", "row_id"), "row_id").select("query_id", "row_id", "embedding")
        return _top_k(joined.mapInArrow(measure, schema), k)

    def search(
        self, questions: DataFrame, k: int = 5, shortlist: int = SHORTLIST, vector: str = "embedding", broadcast_rows: int = SEARCH_ROWS
    ) -> DataFrame:
        """``query_id, rank, row_id, distance`` for ``questions(query_id, embedding)``.

        Questions go in chunks of bounded size. One that the codes give fewer than ``k``
        rows, or whose vector is zero or not finite, is searched exactly.
        """
        asked = kept(questions.select("query_id", F.col(vector).alias("embedding")).where("embedding is not null"), "questions")
        count, size = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("embedding") * 8), F.lit(0))).first()
        if not count:
            return knn(self.vectors().drop("bucket"), asked, k)
        # Twice as many chunks as needed, as a hash deals unevenly.
        chunks = max(-(-2 * count // broadcast_rows), -(-2 * size // BROADCAST_BYTES)) if count > broadcast_rows or size > BROADCAST_BYTES else 1
        part = F.pmod(F.xxhash64(F.lit(SEED), "query_id"), F.lit(chunks))
        found = None
        for i in range(chunks):
            some = kept(self._ranked(asked.where(part == i), k, max(k, shortlist)), "hits")
            found = some if found is None else found.unionByName(some)
        full = found.where(F.col("rank") == k).select("query_id")
        if full.count() == count:
            return found
        short = kept(asked.join(full, "query_id", "left_anti"), "short")
        rest = knn(self.vectors().drop("bucket"), short, k)
        return found.join(short.select("query_id"), "query_id", "left_anti").unionByName(rest)
