"""Near-duplicate embeddings: random-hyperplane sign hashing, exact cosine, components.

Vectors are hashed by the signs of their products with random hyperplanes, in
several tables. Rows that share a bucket of any table are compared exactly, in
double precision. The hyperplanes per table grow with the logarithm of the
number of vectors, so that buckets keep their size; the tables grow with them,
so that a pair right at the threshold is missed with probability ``MISS`` at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rowlens.llm.buckets import compare_in_buckets
from rowlens.llm.common import staged
from rowlens.llm.components import connected_components, local_roots

THRESHOLD = 0.9
MISS = 1e-3
BUCKET_ROWS = 64
MAX_PLANES = 30
# Vectors of one bucket that are compared in one piece.
BLOCK = 1024
SEED = 3


def table_shape(rows: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """Hyperplanes per table, and tables."""
    planes = min(MAX_PLANES, max(4, math.ceil(math.log2(max(rows, 1) / BUCKET_ROWS + 1))))
    alike = (1 - math.acos(threshold) / math.pi) ** planes
    return planes, math.ceil(math.log(MISS) / math.log1p(-alike))


def _units(column: pa.Array) -> np.ndarray:
    """Rows of unit length, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1)
    # Scaled first, so that no square is too large or too small.
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _planes(dim: int, planes: int, tables: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, planes * tables))


def bucket_rows(vectors: DataFrame, planes: int, tables: int) -> DataFrame:
    """``key, place, node, weight, vector, signs``: every vector once per table."""
    kinds = dict(vectors.dtypes)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bit = 1 << np.arange(planes, dtype=np.int64)
        for batch in batches:
            dims = np.array([len(v) for v in batch.column("vector").to_pylist()])
            for dim in np.unique(dims):
                own = batch.take(pa.array(np.flatnonzero(dims == dim)))
                for i in range(0, own.num_rows, 2048):
                    part = own.slice(i, 2048)
                    above = _units(part.column("vector")) @ _planes(int(dim), planes, tables) > 0
                    signs = above.reshape(len(part), tables, planes) @ bit
                    lists = pa.ListArray.from_arrays(
                        pa.array(np.arange(len(part) + 1, dtype=np.int32) * tables), pa.array(signs.ravel().astype(np.int32))
                    )
                    yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, "signs"])

    schema = f"node long, weight long, vector {kinds['vector']}, signs array<int>"
    hashed = vectors.select("node", "weight", "vector").mapInArrow(each, schema)
    spread = hashed.select("*", F.posexplode("signs").alias("place", "sign"))
    return spread.select(
        F.xxhash64("place", "sign", F.size("vector")).alias("key"), "place", "sign", "node", "weight", "vector", "signs"
    )


def _prepared(rows: pa.RecordBatch):
    # Rows of another table or length that fell on the same key share neither place, sign nor size.
    same = [rows.column(c).to_numpy() for c in ("place", "sign")]
    sizes = np.array([len(v) for v in rows.column("vector")])
    tables = len(rows.column("signs")[0])
    signs = rows.column("signs").flatten().to_numpy().reshape(-1, tables)
    return *same, sizes, signs, rows.column("node").to_numpy(), rows.column("weight").to_numpy()


def _links(a: pa.RecordBatch, b: pa.RecordBatch):
    """Which rows of two blocks of a bucket are linked, and which links no earlier table has."""
    place, sign, size, signs, *_ = _prepared(a)
    place_b, sign_b, size_b, signs_b, *_ = _prepared(b)
    near = np.zeros((len(a), len(b)), bool)
    for dim in np.intersect1d(size, size_b):
        i, j = np.flatnonzero(size == dim), np.flatnonzero(size_b == dim)
        cosine = _units(a.column("vector").take(pa.array(i))) @ _units(b.column("vector").take(pa.array(j))).T
        near[np.ix_(i, j)] = cosine >= THRESHOLD
    near &= (place[:, None] == place_b[None, :]) & (sign[:, None] == sign_b[None, :])
    i, j = np.nonzero(near)
    met = np.zeros(len(i), bool)
    for k in range(0, len(i), 1 << 16):
        x, y = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
        earlier = np.arange(signs.shape[1])[None, :] < place[x][:, None]
        met[k : k + (1 << 16)] = ((signs[x] == signs_b[y]) & earlier).any(axis=1)
    return i, j, ~met


def _found(node: np.ndarray, count: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
    """Rows ``a, b, links``: a node, one it is connected to, and links counted here."""
    row = np.flatnonzero((count > 0) | (root != np.arange(len(node))))
    return pa.RecordBatch.from_arrays(
        [pa.array(node[row]), pa.array(node[root[row]]), pa.array(count[row].astype(np.int64))], ["a", "b", "links"]
    )


def _compare(rows: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
    node, weight = rows.column("node").to_numpy(), rows.column("weight").to_numpy()
    bounds = [*starts.tolist(), len(rows)]
    left, right, count = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(len(rows))
    for a, b in zip(bounds, bounds[1:]):
        if b - a < 2:
            continue
        part = rows.slice(a, b - a)
        i, j, new = _links(part, part)
        off = i != j
        i, j, new = i[off] + a, j[off] + a, new[off]
        count += np.bincount(i[new], weight[j[new]], minlength=len(rows))
        left.append(i)
        right.append(j)
    return _found(node, count, local_roots(len(rows), np.concatenate(left), np.concatenate(right)))


def _compare_blocks(a: pa.RecordBatch, b: pa.RecordBatch | None) -> pa.RecordBatch:
    if b is None:
        return _compare(a, np.zeros(1, np.int64))
    i, j, new = _links(a, b)
    node = np.concatenate([x.column("node").to_numpy() for x in (a, b)])
    weight = np.concatenate([x.column("weight").to_numpy() for x in (a, b)])
    j = j + len(a)
    count = np.bincount(i[new], weight[j[new]], minlength=len(node)) + np.bincount(j[new], weight[i[new]], minlength=len(node))
    return _found(node, count, local_roots(len(node), i, j))


def embedding_groups(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """Per row: id, ``n_links, component_id, kept``.

    Equal vectors are one node and never paired; each of them counts as a link
    of the others. Vectors that are null, empty, zero or not finite, and rows
    without an id, link with nothing. Vectors of different lengths never link.
    Rows that repeat an id each come out, with the same component.
    """
    vector = F.col(f"`{vector_column}`")
    plain = rows.select(F.col(f"`{id_column}`").alias("id"), vector.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = F.col("id").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0)
    plain = staged(plain.withColumn("usable", F.coalesce(usable, F.lit(False))))

    nodes = plain.where("usable").groupBy("vector").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("weight"))
    # Two vectors may carry one id; the node of a vector is its own, the id only names it.
    nodes = staged(nodes.select(F.xxhash64("vector", "node").alias("node"), F.col("node").alias("least"), "weight", "vector"))
    planes, tables = table_shape(nodes.count())
    found = staged(
        compare_in_buckets(
            bucket_rows(nodes, planes, tables), _compare, _compare_blocks, "a long, b long, links long", BLOCK
        )
    )
    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    components = connected_components(found.select("a", "b"))
    named = nodes.join(links, "node", "left").join(components, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select(
        F.col("vector").alias("v"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), "component_id"
    )
    linked = plain.where("usable").join(named, F.col("vector") == F.col("v"))
    linked = linked.select("id", F.col("links").alias("n_links"), "component_id")
    alone = plain.where("not usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))
    return out.withColumnRenamed("id", id_column)
