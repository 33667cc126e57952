"""SimHash near-duplicates by deletion-variant signatures.

Two fingerprints that differ in at most four of 64 bits differ in at most one
bit of some one of three segments. Every segment is indexed once for each of its
bits with that bit wiped out; two segments at most one bit apart share such an
entry, so an equality join on them finds every pair, and all are verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rowlens.llm.buckets import compare_in_buckets
from rowlens.llm.common import broadcast_if_small, row_hash, staged, text_blocks
from rowlens.llm.components import connected_components, local_roots

MAX_BITS = 4
SHINGLE = 4
# (lowest bit, bits) of the segments: as many as leave one bit at most for one of them.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
# Fingerprints of one bucket that are compared in one piece.
BLOCK = 1024


def fingerprint(text: bytes, k: int = SHINGLE) -> int:
    """64 bits: each 1 if set in over half of the shingles' hashes. No word: zero."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    n = len(words)
    if n <= k:
        return xxh64_intdigest(line, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    begin = [0, *(ends[: n - k] + 1).tolist()]
    hashes = np.array([xxh64_intdigest(line[a:b], 42) for a, b in zip(begin, ends[k - 1 :].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", row: Column | None = None
) -> DataFrame:
    """``id, fp[, row]`` of every row; the fingerprint as a signed long, ``row`` as given."""
    kind = docs.schema[id_column].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            texts = block.column("text").cast(pa.large_binary()).to_pylist()
            found = pa.array(np.array([fingerprint(t or b"") for t in texts], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [block.column("id"), found, *block.columns[2:]], ["id", "fp", *block.schema.names[2:]]
            )

    rows = docs.select(
        F.col(f"`{id_column}`").alias("id"),
        F.col(f"`{text_column}`").alias("text"),
        *([] if row is None else [row.alias("row")]),
    )
    return rows.mapInArrow(each, f"id {kind}, fp long" + ("" if row is None else ", row long"))


def variants(prints: DataFrame) -> DataFrame:
    """``key, fp``: one row for each bit of ``fp`` that may differ in its segment."""
    keys = []
    for low, bits in SEGMENTS:
        segment = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
        for j in range(bits):
            rest = segment.bitwiseAND(F.lit(((1 << bits) - 1) ^ (1 << j)).cast("long"))
            keys.append(rest.bitwiseOR(F.lit((low + j) << 22).cast("long")))
    return prints.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _stars(values: np.ndarray, left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
    """Links ``a, b`` that connect what the pairs connect: each value with its smallest relative."""
    root = local_roots(len(values), left, right)
    row = np.flatnonzero(root != np.arange(len(values)))
    pairs = np.unique(np.stack([values[row], values[root[row]]], axis=1), axis=0) if len(row) else np.zeros((0, 2))
    a, b = pairs[:, 0].astype(np.int64), pairs[:, 1].astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= MAX_BITS


def _compare(rows: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
    prints = rows.column("fp").to_numpy()
    bits, n = prints.view(np.uint64), len(prints)
    sizes = np.diff(np.append(starts, n))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    # Most buckets are small: compare all rows at once with the 1st, 2nd, ... row after them.
    small = np.repeat(np.where(sizes <= 32, starts + sizes, 0), sizes)
    for step in range(1, min(32, int(sizes.max()))):
        i = np.flatnonzero(small > np.arange(n) + step)
        i = i[_near(bits[i], bits[i + step])]
        left.append(i)
        right.append(i + step)
    for s in np.flatnonzero(sizes > 32):
        own = bits[starts[s] : starts[s] + sizes[s]]
        i, j = np.nonzero(np.triu(_near(own[:, None], own[None, :]), 1))
        left.append(i + starts[s])
        right.append(j + starts[s])
    return _stars(prints, np.concatenate(left), np.concatenate(right))


def _compare_blocks(a: pa.RecordBatch, b: pa.RecordBatch | None) -> pa.RecordBatch:
    x = a.column("fp").to_numpy()
    if b is None:
        i, j = np.nonzero(np.triu(_near(x.view(np.uint64)[:, None], x.view(np.uint64)[None, :]), 1))
        return _stars(x, i, j)
    y = b.column("fp").to_numpy()
    i, j = np.nonzero(_near(x.view(np.uint64)[:, None], y.view(np.uint64)[None, :]))
    return _stars(np.concatenate([x, y]), i, j + len(x))


def near_prints(prints: DataFrame) -> DataFrame:
    """``node, component`` of the distinct fingerprints that have a neighbour."""
    links = compare_in_buckets(variants(prints), _compare, _compare_blocks, "a long, b long", BLOCK)
    return connected_components(links)


def _components(prints: DataFrame) -> DataFrame:
    """``fp, least, component``: every fingerprint, its smallest id, and the fingerprint that stands for its component."""
    nodes = staged(prints.groupBy("fp").agg(F.min("id").alias("least")))
    near = near_prints(nodes.select("fp"))
    grouped = nodes.join(near.withColumnRenamed("node", "fp"), "fp", "left")
    return grouped.withColumn("component", F.coalesce("component", "fp"))


def simhash_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, ``fp``, and ``component_id``, the smallest id reachable over links.

    Rows with one fingerprint are one node, so copies are never paired. A text
    that is null or has no word has fingerprint zero and is linked like any
    other. Rows that repeat an id each come out. A null id is never the smallest;
    the component is null only if no row of it has an id.
    """
    prints = staged(fingerprints(docs, id_column, text_column))
    grouped = _components(prints)
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = staged(grouped.join(least, "component").select("fp", "component_id"))
    return prints.join(labels, "fp").select(F.col("id").alias(id_column), "fp", "component_id")


def drop_near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Keep exactly one row of each group, as it is.

    That of the smallest id, and of several with that id (or of a group without
    any) the one with the smallest hash of its columns; a missing id comes after all others. A row is known by
    its id and that hash, so two texts that share an id are judged each by itself. Of rows that are equal
    throughout one stays.
    """
    names = [F.col(f"`{c}`") for c in docs.columns]
    taken, mark = {c.lower() for c in docs.columns}, "row"
    while mark in taken or f"{mark}_verdict" in taken or f"{mark}_id" in taken:
        mark = f"_{mark}"
    keyed = docs.withColumn(mark, row_hash(docs))
    prints = staged(fingerprints(keyed, id_column, text_column, F.col(mark)))
    labels = staged(_components(prints).select("fp", "component"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    first = prints.join(labels, "fp").groupBy("component").agg(F.min(order).alias("o"))
    first = staged(first.select(F.col("o.id").alias("first_id"), F.col("o.row").alias("first_row")))
    counts = prints.groupBy("id", "row").agg(F.count(F.lit(1)).alias("n"))
    judged = counts.join(first, F.col("id").eqNullSafe(F.col("first_id")) & (F.col("row") == F.col("first_row")), "left")
    # true: equal rows, of which one stays; false: goes. What is not listed stays as it is.
    verdict = judged.withColumn("verdict", F.col("first_row").isNotNull()).where("not verdict or n > 1")
    verdict = staged(verdict.select("id", "row", "verdict"))
    verdict = broadcast_if_small(verdict, F.octet_length(F.coalesce(F.col("id").cast("string"), F.lit(""))) + 32)
    verdict = verdict.toDF(f"{mark}_id", f"{mark}_hash", f"{mark}_verdict")
    same = F.col(f"`{id_column}`").eqNullSafe(F.col(f"{mark}_id")) & (F.col(mark) == F.col(f"{mark}_hash"))
    joined = keyed.join(verdict, same, "left")
    several = joined.where(F.col(f"{mark}_verdict")).dropDuplicates([id_column, mark])
    return joined.where(F.col(f"{mark}_verdict").isNull()).select(*names).unionByName(several.select(*names))
