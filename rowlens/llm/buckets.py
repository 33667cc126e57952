"""Comparing the rows of every bucket, however large a bucket is.

Rows are sorted by bucket within hash partitions. Buckets of at most ``limit``
rows are compared where they stand. A larger one is cut into numbered blocks,
and every two blocks of it become a task of their own, of twice the limit at
most. So all pairs are compared, memory is bounded, and what is emitted is
whatever the comparison returns, never the pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rowlens.llm.common import staged

# Rows of one or more whole buckets, and where each begins -> rows of results.
CompareBuckets = Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch]
# Two blocks of one bucket; the second is None for a block with itself.
CompareBlocks = Callable[[pa.RecordBatch, pa.RecordBatch | None], pa.RecordBatch]


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.concat_batches(parts)


def _starts(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))


def sorted_runs(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, int]]:
    """Whole runs of ``key``, as (rows, run starts, -1), or part of a longer run, as (rows, _, rows of it before)."""
    held: pa.RecordBatch | None = None
    long_key, before = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if long_key is not None:
            n = int(np.searchsorted(batch.column("key").to_numpy(), long_key, side="right"))
            if n:
                yield batch.slice(0, n), np.zeros(1, np.int64), before
                before += n
            if n == batch.num_rows:
                continue
            batch, long_key = batch.slice(n), None
        rows = batch if held is None else _joined([held, batch])
        keys = rows.column("key").to_numpy()
        starts = _starts(keys)
        tail = int(starts[-1])
        sizes = np.diff(starts)
        at = 0
        for i in np.flatnonzero(sizes > limit):
            if starts[i] > at:
                yield rows.slice(at, int(starts[i]) - at), starts[(starts >= at) & (starts < starts[i])] - at, -1
            at = int(starts[i] + sizes[i])
            yield rows.slice(int(starts[i]), int(sizes[i])), np.zeros(1, np.int64), 0
        if tail > at:
            yield rows.slice(at, tail - at), starts[(starts >= at) & (starts < tail)] - at, -1
        held = rows.slice(tail)
        if held.num_rows > limit:
            yield held, np.zeros(1, np.int64), 0
            long_key, before, held = keys[-1], held.num_rows, None
    if held is not None and held.num_rows:
        yield held, np.zeros(1, np.int64), -1


def compare_in_buckets(
    rows: DataFrame, compare: CompareBuckets, compare_blocks: CompareBlocks, result: str, limit: int
) -> DataFrame:
    """Results of comparing all rows that share ``key`` (long). ``result`` is their schema, apart from the columns of ``rows``."""
    fields = [f"{n} {k}" for n, k in rows.dtypes]
    names = [f.split()[0] for f in result.split(", ")]

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, starts, before in sorted_runs(batches, limit):
            if before < 0:
                found = compare(part, starts)
                if found.num_rows:
                    empty = [pa.nulls(found.num_rows, f.type) for f in part.schema]
                    yield pa.RecordBatch.from_arrays(
                        [*found.columns, pa.nulls(found.num_rows, pa.int32()), *empty],
                        [*names, "block", *part.schema.names],
                    )
            else:
                block = pa.array(((before + np.arange(part.num_rows)) // limit).astype(np.int32))
                empty = [pa.nulls(part.num_rows, t) for t in kinds]
                yield pa.RecordBatch.from_arrays(
                    [*empty, block, *part.columns], [*names, "block", *part.schema.names]
                )

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    kinds = [to_arrow_type(f.dataType) for f in _parse_datatype_string(result).fields]
    sorted_rows = rows.repartition("key").sortWithinPartitions("key")
    done = staged(sorted_rows.mapInArrow(within, ", ".join([result, "block int", *fields])))
    inside = done.where("block is null").select(*names)

    large = done.where("block is not null").drop(*names)
    blocks = large.groupBy("key").agg((F.max("block") + 1).alias("blocks"))
    paired = large.join(blocks, "key").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = paired.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
    paired = paired.drop("blocks", "other").repartition("key", "lo", "hi")
    paired = paired.sortWithinPartitions("key", "lo", "hi", "block")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                task = _joined(held)
                lo, hi = task.column("lo")[0].as_py(), task.column("hi")[0].as_py()
                own = task.select(task.schema.names[:-2])
                n = int(np.searchsorted(task.column("block").to_numpy(), lo, side="right"))
                found = compare_blocks(own.slice(0, n), None if lo == hi else own.slice(n))
                if found.num_rows:
                    yield pa.RecordBatch.from_arrays(found.columns, names)

        for batch in batches:
            if not batch.num_rows:
                continue
            marks = [batch.column(c).to_numpy() for c in ("key", "lo", "hi")]
            change = np.zeros(batch.num_rows, bool)
            for m in marks:
                change[1:] |= m[1:] != m[:-1]
            bounds = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            for i, j in zip(bounds, bounds[1:]):
                now = tuple(m[i] for m in marks)
                if now != at:
                    yield from flush()
                    held, at = [], now
                held.append(batch.slice(i, j - i))
        yield from flush()

    return inside.unionByName(paired.mapInArrow(across, result))
