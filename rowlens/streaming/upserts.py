"""Continuous upsert: a stream of rows into a store and, if given, its index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter

from rowlens.operators.identity import ROW_ID, add_row_ids
from rowlens.operators.index import VectorIndex
from rowlens.operators.store import RowStore


def upsert_stream(
    rows: DataFrame, store: RowStore, checkpoint: str, index: VectorIndex | None = None
) -> DataStreamWriter:
    """A writer to ``start()``; set the trigger on it as needed.

    Each micro-batch is upserted as a batch would be. Ids are content hashes, so
    a batch that is replayed after a failure adds nothing, and rows that reached
    the store but not the index are still missing there and get added.
    """

    def write(batch: DataFrame, _batch_id: int) -> None:
        identified = add_row_ids(batch)
        store.save(identified)
        if index is not None:
            index.update(identified)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def distinct_stream(
    rows: DataFrame, time_column: str, delay: str, id_columns: Sequence[str] | None = None
) -> DataFrame:
    """The stream with ``row_id``, each id once within ``delay`` of event time.

    Ids seen are Spark's own keyed state, which expires with the watermark, so a
    trigger costs what it brings and reads no store. Rows later than ``delay``
    behind the latest one of earlier triggers are dropped; an id that comes again
    after its state has expired is let through again. Rows without a time are never
    late, and their ids are forgotten as soon as the watermark moves.
    ``id_columns`` default to all columns but the time.
    """
    names = id_columns or [c for c in rows.columns if c != time_column]
    timed = rows.withColumn(time_column, F.col(f"`{time_column}`").cast("timestamp"))
    return add_row_ids(timed, id_columns=names).withWatermark(time_column, delay).dropDuplicatesWithinWatermark([ROW_ID])


def append_stream(rows: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer of plain Parquet files that commits each trigger once, replays included."""
    return (
        rows.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
    )
