"""Shared storage, bounded blocks of text, and the fold of held-out documents."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# Text bytes that one step in Python handles at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; local sessions may leave it unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master.startswith("local") and not master.startswith("local-cluster"):
        folder = f"{tempfile.gettempdir()}/checkpoints"
        spark.conf.set("spark.checkpoint.dir", folder)
        return folder
    raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts lineage, so that nothing before it runs again when an executor is lost,
    and tells the planner how large the table is: a later join broadcasts it
    only below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# A table is broadcast only if a count shows that it has at most this many bytes.
BROADCAST_BYTES = 64 << 20


def broadcast_if_small(table: DataFrame, row_bytes: Column | int) -> DataFrame:
    """A staged table with a broadcast hint if it is counted small; a large one is joined by a shuffle."""
    size = table.agg(F.coalesce(F.sum(F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes), F.lit(0))).first()[0]
    return F.broadcast(table) if size <= BROADCAST_BYTES else table


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def hash_share(doc_id: str, seed: int) -> Column:
    """A number from 0 to 1 that depends on the id alone."""
    return F.pmod(F.xxhash64(F.lit(seed), doc_id), F.lit(1_000_003)) / F.lit(1_000_003)


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns; those that hold maps, which have no hash, as JSON."""

    def holds_map(kind: T.DataType) -> bool:
        return "map<" in kind.simpleString()

    cells = [(F.col(f"`{f.name}`"), f.dataType) for f in docs.schema.fields]
    return F.xxhash64(*[F.to_json(F.struct(c)) if holds_map(kind) else c for c, kind in cells])


def text_blocks(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices of at most ``limit`` bytes of text, one row at least."""
    for batch in batches:
        start, used = 0, 0
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        for i, size in enumerate(sizes):
            if i > start and used + size > limit:
                yield batch.slice(start, i - start)
                start, used = i, 0
            used += size
        if start < len(sizes):
            yield batch.slice(start)
