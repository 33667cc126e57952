"""Hard negatives by rotated one-bit codes.

Every vector is rotated once and kept with a code, one bit per dimension (the
sign), its length, and its alignment: the cosine between the rotated vector and
the corner of the cube that its code names. What the code does not tell of a
vector is orthogonal to that corner, so with an anchor's product ``t`` with the
corner the inner product lies, by Cauchy and Schwarz, within

    length * (alignment * t  +-  sqrt(1 - alignment**2) * sqrt(|anchor|**2 - t**2)).

The anchor is rounded to a few bits per dimension, so ``t`` is a sum of
popcounts of the code with its bit planes, and what the rounding can change is
added to the interval. Rows whose interval cannot reach what is still wanted
are left out; all others are scored with integers. So the result is exact.

Anchors are taken in chunks of bounded size. A chunk is sent to all tasks, each
scans its stored codes and gives out the best rows it has per anchor, and these
few are merged. Some anchors are scored first, so that a task gives out only
rows that beat what they reach. No pairs are built.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from rowlens.llm.common import staged

POSITIVES, NEGATIVES = 5, 10
# A negative's score is between these shares of the positive's, in hundredths.
LOW, HIGH = 30, 90
SEED = 12
# Bits per dimension that anchors are rounded to.
PLANES = 6
# Anchors of one chunk, and bytes of their vectors.
CHUNK_ROWS, CHUNK_BYTES = 16_384, 32 << 20
# Anchors and rows that are compared in one piece.
ANCHORS_AT_ONCE, ROWS_AT_ONCE = 256, 1024
# Anchors of a chunk that set the first bars of a scan.
SEEDS = 2_048
# Beyond this share of surviving pairs a piece is scored as one product.
DENSE = 0.1
NO_ID = (1 << 63) - 1
_NEVER = np.int64(-(1 << 62))


def rotation(dim: int) -> np.ndarray:
    """A random rotation, the same wherever it is made."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def coded(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes as 64-bit words, lengths, and alignments of integer vectors."""
    rows, dim = vectors.shape
    turned = vectors.astype(np.float64) @ rotation(dim)
    length = np.sqrt((turned * turned).sum(axis=1))
    aligned = np.abs(turned).sum(axis=1) / (np.sqrt(dim) * np.where(length > 0, length, 1.0))
    bits = np.zeros((rows, -(-dim // 64) * 64), np.uint8)
    bits[:, :dim] = turned > 0
    return np.packbits(bits, axis=1, bitorder="little").view("<u8"), length, np.minimum(aligned, 1.0)


_PREPARED = "key long, id long, label long, vector array<long>, anchor boolean, code array<long>, length double, aligned double"


def stored_codes(rows: DataFrame) -> DataFrame:
    """``rows(key, id, label, vector array<long>, anchor)`` with their codes, lengths and alignments."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = pc.list_value_length(batch.column("vector")).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                vectors = _matrix(part.column("vector"))
                # Any inner product, and any difference of two scores times a hundred, fits into 64 bits.
                if len(vectors) and int(dim) * float(np.abs(vectors.astype(np.float64)).max()) ** 2 >= 2.0**55:
                    raise ValueError("the components are too large for integer scores of 64 bits")
                code, length, aligned = coded(vectors)
                words = code.shape[1]
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(part) + 1, dtype=np.int32) * words), pa.array(code.ravel().view(np.int64))
                )
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, lists, pa.array(length), pa.array(aligned)],
                    [*part.schema.names, "code", "length", "aligned"],
                )

    return rows.select("key", "id", "label", "vector", "anchor").mapInArrow(each, _PREPARED)


class Anchors:
    """Anchors of one length of vector, rounded and cut into bit planes."""

    def __init__(self, key: np.ndarray, id: np.ndarray, label: np.ndarray, vectors: np.ndarray):
        self.key, self.id, self.label, self.vectors = key, id, label, vectors
        self.count, self.dim = vectors.shape
        turned = vectors.astype(np.float64) @ rotation(self.dim)
        self.square = (turned * turned).sum(axis=1)
        self.low = turned.min(axis=1)
        self.step = np.maximum(turned.max(axis=1) - self.low, 1e-300) / ((1 << PLANES) - 1)
        rounded = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.uint8)
        self.total = rounded.sum(axis=1, dtype=np.int64)
        bits = np.zeros((PLANES, self.count, -(-self.dim // 64) * 64), np.uint8)
        for b in range(PLANES):
            bits[b, :, : self.dim] = rounded >> b & 1
        self.planes = np.packbits(bits, axis=2, bitorder="little").view("<u8")
        self.largest = float(np.abs(vectors).max()) if vectors.size else 0.0

    def interval(self, some: slice, code: np.ndarray, length: np.ndarray, aligned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the inner products of some anchors with the coded rows, as (rows, anchors)."""
        ones = np.bitwise_count(code).sum(axis=1, dtype=np.int64)
        hits = np.zeros((len(code), len(self.low[some])), np.int32)
        for b in range(PLANES):
            for w in range(code.shape[1]):
                hits += np.bitwise_count(code[:, w, None] & self.planes[b, some, w][None, :]).astype(np.int32) << b
        root = np.sqrt(self.dim)
        # Sum over set bits less that over the others, of low + step * rounded.
        t = self.low[some] * (2 * ones[:, None] - self.dim) + self.step[some] * (2 * hits - self.total[some])
        t /= root
        slack = self.step[some] * (root / 2)
        square = self.square[some]
        nearest = np.maximum(np.abs(t) - slack, 0.0)
        rest = np.sqrt(np.maximum(square - nearest * nearest, 0.0))
        beside = np.sqrt(np.maximum(1.0 - aligned * aligned, 0.0))
        reach = length[:, None] * (aligned[:, None] * slack + beside[:, None] * rest)
        middle = (length * aligned)[:, None] * t
        # More than rounding in double precision can take away.
        reach += 1.0 + 1e-9 * length[:, None] * np.sqrt(square)
        return middle - reach, middle + reach

    def scores(self, some: slice, vectors: np.ndarray, row: np.ndarray, anchor: np.ndarray, largest: float) -> np.ndarray:
        """Integer inner products of the pairs ``row, anchor``."""
        own = self.vectors[some]
        if len(row) > DENSE * len(vectors) * len(own):
            if self.dim * self.largest * largest < 2.0**52:  # exact in double precision
                whole = vectors.astype(np.float64) @ own.T.astype(np.float64)
                return whole[row, anchor].astype(np.int64)
            return (vectors @ own.T)[row, anchor]
        out = np.empty(len(row), np.int64)
        for i in range(0, len(row), 1 << 15):
            part = slice(i, i + (1 << 15))
            out[part] = np.einsum("ij,ij->i", vectors[row[part]], own[anchor[part]])
        return out


class _Best:
    """The first ``k`` (score descending, id ascending) of each of a number of lists."""

    def __init__(self, lists: int, k: int):
        self.k, self.lists = k, lists
        self.list = self.score = self.id = np.zeros(0, np.int64)
        self.bar = np.full(lists, _NEVER)  # what a score must reach

    def add(self, of: np.ndarray, score: np.ndarray, id: np.ndarray) -> None:
        able = score >= self.bar[of]
        if not able.any():
            return
        of, score, id = (np.concatenate([a, b[able]]) for a, b in ((self.list, of), (self.score, score), (self.id, id)))
        order = np.lexsort((id, -score, of))
        of, score, id = of[order], score[order], id[order]
        starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        place = np.arange(len(of)) - np.repeat(starts, np.diff(np.append(starts, len(of))))
        keep = place < self.k
        self.list, self.score, self.id = of[keep], score[keep], id[keep]
        full = place == self.k - 1
        self.bar[of[full]] = score[full]

    def forget(self) -> None:
        """Keep the bars only."""
        self.list = self.score = self.id = np.zeros(0, np.int64)


def _pieces(seeds: pa.Table, batches: Iterator[pa.RecordBatch], found: list[_Best]):
    """Pieces of some anchors, which are rows too, for the bars that they set; then those of the rows to scan."""
    yield from _batches(seeds.slice(0, SEEDS).to_batches())
    for best in found:
        best.forget()
    yield from _batches(batches)


def _batches(batches: Iterator[pa.RecordBatch]):
    """Pieces of rows of one length: dim, key, id, label, vectors, codes, lengths, alignments."""
    size = 128  # the first pieces are small, so that the bars are soon high
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            piece = batch.slice(at, size)
            at, size = at + size, min(ROWS_AT_ONCE, 2 * size)
            dims = pc.list_value_length(piece.column("vector")).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                part = piece if (dims == dim).all() else piece.take(pa.array(np.flatnonzero(dims == dim)))
                key, id, label = (part.column(c).to_numpy() for c in ("key", "id", "label"))
                code = _matrix(part.column("code")).view(np.uint64)
                length, aligned = (part.column(c).to_numpy() for c in ("length", "aligned"))
                yield int(dim), key, id, label, _matrix(part.column("vector")), code, length, aligned


def _by_dim(table: pa.Table) -> dict[int, pa.Table]:
    dims = pc.list_value_length(table["vector"].combine_chunks()).to_numpy(zero_copy_only=False)
    return {int(d): table.take(pa.array(np.flatnonzero(dims == d))).combine_chunks() for d in np.unique(dims)}


def _anchors(table: pa.Table) -> Anchors:
    batch = table.to_batches()[0]
    return Anchors(*(batch.column(c).to_numpy() for c in ("key", "id", "label")), _matrix(batch.column("vector")))


def _scan_positives(table: pa.Table, batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Best other rows of the anchor's label: ``anchor`` (its key), ``id, score``."""
    asked = {dim: _anchors(t) for dim, t in _by_dim(table).items()}
    best = {dim: _Best(a.count, k) for dim, a in asked.items()}
    for dim, key, id, label, vectors, code, length, aligned in _pieces(table, batches, list(best.values())):
        if dim not in asked:
            continue
        a, found = asked[dim], best[dim]
        largest = float(np.abs(vectors).max()) if vectors.size else 0.0
        for lo in range(0, a.count, ANCHORS_AT_ONCE):
            some = slice(lo, lo + ANCHORS_AT_ONCE)
            upper = a.interval(some, code, length, aligned)[1]
            wanted = (label[:, None] == a.label[some]) & (key[:, None] != a.key[some]) & (upper >= found.bar[some])
            row, anchor = np.nonzero(wanted)
            if len(row):
                found.add(anchor + lo, a.scores(some, vectors, row, anchor, largest), id[row])
    for dim, found in best.items():
        if len(found.list):
            yield pa.RecordBatch.from_arrays(
                [pa.array(asked[dim].key[found.list]), pa.array(found.id), pa.array(found.score)], ["anchor", "id", "score"]
            )


def _scan_negatives(
    table: pa.Table, pairs: pa.Table, batches: Iterator[pa.RecordBatch], k: int, low: int, high: int
) -> Iterator[pa.RecordBatch]:
    """Best rows of another label inside the window of each pair: ``pair, id, score``."""
    asked = {dim: _anchors(t) for dim, t in _by_dim(table).items()}
    own: dict[int, tuple] = {}
    pair_anchor, pair_score = pairs["anchor"].to_numpy(), pairs["score"].to_numpy()
    for dim, a in asked.items():
        order = np.argsort(a.key)
        at = np.minimum(np.searchsorted(a.key[order], pair_anchor), len(order) - 1)
        mine = np.flatnonzero((a.key[order][at] == pair_anchor) & (low * pair_score <= high * pair_score))
        owner = order[at[mine]]
        by = np.argsort(owner, kind="stable")
        mine, owner = mine[by], owner[by]
        # The least and the largest score in a window, as integers.
        least, most = -((-low * pair_score[mine]) // 100), high * pair_score[mine] // 100
        own[dim] = mine, owner, np.searchsorted(owner, np.arange(a.count + 1)), least, most, _Best(len(mine), k)
    bests = [x[-1] for x in own.values()]
    for dim, key, id, label, vectors, code, length, aligned in _pieces(table, batches, bests):
        if dim not in asked:
            continue
        a, (mine, owner, first, least, most, found) = asked[dim], own[dim]
        largest = float(np.abs(vectors).max()) if vectors.size else 0.0
        for lo in range(0, a.count, ANCHORS_AT_ONCE):
            hi = min(lo + ANCHORS_AT_ONCE, a.count)
            some, lists = slice(lo, hi), np.arange(first[lo], first[hi])
            if not len(lists):
                continue
            lower, upper = a.interval(some, code, length, aligned)
            # What at least one list of an anchor still wants.
            bottom = np.full(hi - lo, np.iinfo(np.int64).max)
            top = np.full(hi - lo, np.iinfo(np.int64).min)
            wants = np.maximum(least[lists], found.bar[lists])
            np.minimum.at(bottom, owner[lists] - lo, wants)
            np.maximum.at(top, owner[lists] - lo, most[lists])
            maybe = (label[:, None] != a.label[some]) & (upper >= bottom) & (lower <= top)
            row, anchor = np.nonzero(maybe)
            if not len(row):
                continue
            score = a.scores(some, vectors, row, anchor, largest)
            some_rows = (score >= bottom[anchor]) & (score <= top[anchor])
            row, anchor, score = row[some_rows], anchor[some_rows], score[some_rows]
            # Each with every list of its anchor, of which there are a few.
            many = first[anchor + lo + 1] - first[anchor + lo]
            of = np.repeat(first[anchor + lo], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            which = np.repeat(np.arange(len(row)), many)
            inside = (score[which] >= least[of]) & (score[which] <= most[of])
            of, which = of[inside], which[inside]
            found.add(of, score[which], id[row[which]])
    for mine, *_, found in own.values():
        if len(found.list):
            yield pa.RecordBatch.from_arrays(
                [pa.array(pairs["pair"].to_numpy()[mine[found.list]]), pa.array(found.id), pa.array(found.score)],
                ["pair", "id", "score"],
            )


def _first(rows: DataFrame, by: str, k: int) -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _chunks(anchors: DataFrame, rows_at_once: int) -> list[DataFrame]:
    """The anchors in parts of bounded size, by a hash of their key."""
    size = F.sum(F.size("vector") * 8)
    count, bytes_ = anchors.agg(F.count(F.lit(1)), F.coalesce(size, F.lit(0))).first()
    n = max(-(-count // rows_at_once), -(-bytes_ // CHUNK_BYTES), 1)
    while n > 1:
        part = F.pmod(F.xxhash64(F.lit(n), "key"), F.lit(n))
        most = anchors.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), size.alias("b"))
        rows, bytes_ = most.agg(F.max("n"), F.max("b")).first()
        if rows <= 2 * rows_at_once and bytes_ <= 2 * CHUNK_BYTES:
            return [anchors.where(part == i) for i in range(n)]
        n *= 2
    return [anchors] if count else []


def hard_negatives(
    rows: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "vector",
    label_column: str = "label",
    anchor_column: str = "anchor",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    rows_at_once: int = CHUNK_ROWS,
) -> DataFrame:
    """For each anchor and each of its positives the hardest negatives within the window.

    ``rows`` has an integer id, an integer label, an array of integers and a flag that marks
    anchors. Returns ``anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score``. Scores are integer inner products; higher
    ones come first, ties by smaller id. Positives are the first other rows of the anchor's label, and
    negatives rows of other labels with ``low * positive_score <= 100 * score <= high * positive_score``.

    Rows without label, with a null or empty vector, or with a null component take no part. A row
    without an id is never an anchor and, among ties, is last. Rows that repeat
    an id are rows like others, each an anchor if it is marked. Vectors of
    different lengths never meet. Components must be so small that a
    hundred times a score fits into 64 bits; larger ones raise. An empty table gives no rows, a negative positive's
    score no negatives. Other columns are not read.
    """
    spark = rows.sparkSession
    vector = F.col(f"`{vector_column}`")
    usable = (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull()) & F.col(f"`{label_column}`").isNotNull()
    plain = rows.where(usable).select(
        F.monotonically_increasing_id().alias("key"),
        F.coalesce(F.col(f"`{id_column}`").cast("long"), F.lit(NO_ID)).alias("id"),
        F.col(f"`{label_column}`").cast("long").alias("label"),
        vector.cast("array<long>").alias("vector"),
        (F.col(f"`{anchor_column}`") & F.col(f"`{id_column}`").isNotNull()).alias("anchor"),
    )
    plain = staged(plain)
    codes = staged(stored_codes(plain))
    anchors = codes.where("anchor")
    done = []
    for chunk in _chunks(anchors, rows_at_once):
        table = spark.sparkContext.broadcast(chunk.toArrow())
        near = codes.mapInArrow(
            lambda it, t=table: _scan_positives(t.value, it, positives), "anchor long, id long, score long"
        )
        found = staged(
            _first(near, "anchor", positives).select("anchor", "id", "score")
        )
        pairs = staged(found.withColumn("pair", F.monotonically_increasing_id()))
        sent = spark.sparkContext.broadcast(pairs.select("pair", "anchor", "score").toArrow())
        far = codes.mapInArrow(
            lambda it, t=table, p=sent: _scan_negatives(t.value, p.value, it, negatives, low, high),
            "pair long, id long, score long",
        )
        named = pairs.join(chunk.select(F.col("key").alias("anchor"), F.col("id").alias("anchor_id")), "anchor").select(
            "pair", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")
        )
        best = _first(far, "pair", negatives).join(named, "pair")
        done.append(
            staged(
                best.select(
                    "anchor_id",
                    _id("positive_id"),
                    F.col("rank").cast("int").alias("rank"),
                    _id("id").alias("negative_id"),
                    "positive_score",
                    F.col("score").alias("negative_score"),
                )
            )
        )
    if not done:
        return spark.createDataFrame(
            [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        )
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _id(name: str):
    return F.when(F.col(name) != NO_ID, F.col(name)).alias(name)
