"""Substring search over stored trigrams, without a scan of all cells.

Rows are dealt into blocks of some dozens by a hash of their id and stored in the order
of the blocks. Postings tell for each column and each run of three lower-case characters in
which blocks it occurs. A search reads the postings of its term's trigrams
only, intersects their blocks, reads the rows of these blocks, and makes the
same literal test as :func:`rowlens.operators.explore.search`, so the result is the same.

    path/rows       the rows and their block, in the order of blocks
    path/postings   bucket=.../ gram, column, blocks (of one range of blocks)
    path/shape      blocks, buckets
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from rowlens.functions.text import text_of
from rowlens.operators.explore import search
from rowlens.sources.scratch import kept

GRAM = 3
BLOCK_ROWS = 64
BUCKETS = 64
# Blocks in one posting list.
RANGE = 65_536
# Up to this many candidate blocks are named in the scan's filter; more are joined.
NAMED_BLOCKS = 1_000
# Characters that one step in Python handles at once.
PIECE = 1 << 20


def grams_of(text: str) -> np.ndarray:
    """Every three neighbouring characters as one number: three times 21 bits."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    if len(code) < GRAM:
        return np.zeros(0, np.int64)
    return code[:-2] << 42 | code[1:-1] << 21 | code[2:]


class TrigramIndex:
    """Stored rows that can be searched for a term; ``key`` names a column that identifies a row."""

    def __init__(self, spark: SparkSession, path: str, key: str = "row_id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def build(
        self, rows: DataFrame, columns: Sequence[str] | None = None, block_rows: int = BLOCK_ROWS, buckets: int = BUCKETS
    ) -> None:
        """Store rows and postings of ``columns`` (default: all). A column ``block`` must not be there."""
        if "block" in {c.lower() for c in rows.columns}:
            raise ValueError("the rows have a column called block")
        columns = list(columns or rows.columns)
        blocks = max(1, -(-rows.count() // block_rows))
        key = F.col(f"`{self.key}`")
        dealt = rows.withColumn("block", F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit(""))), F.lit(blocks)).cast("int"))
        # Whole blocks in order within a file, so that row groups are pruned by block.
        placed = dealt.repartition(F.pmod("block", F.lit(max(1, blocks // 64)))).sortWithinPartitions("block")
        placed.write.parquet(f"{self.path}/rows")
        stored = self.rows()

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # Distinct (column, gram, block) of neighbouring rows; a block is mostly in one batch.
            for batch in batches:
                block = batch.column("block").to_numpy().astype(np.int64)
                for i in range(len(columns)):
                    held, size = [], 0
                    cells = batch.column(f"c{i}").to_pylist()
                    for at, text in enumerate(cells):
                        if text:
                            grams = np.unique(grams_of(text))
                            held.append(np.stack([grams, np.full(len(grams), block[at])]))
                            size += len(grams)
                        if held and (size > PIECE or at == len(cells) - 1):
                            gram, own = np.unique(np.concatenate(held, axis=1), axis=1) if len(held) > 1 else held[0]
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(gram), pa.array(np.full(len(gram), i, np.int32)), pa.array(own.astype(np.int32))],
                                ["gram", "column", "block"],
                            )
                            held, size = [], 0
                    if held:
                        gram, own = np.unique(np.concatenate(held, axis=1), axis=1)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(gram), pa.array(np.full(len(gram), i, np.int32)), pa.array(own.astype(np.int32))],
                            ["gram", "column", "block"],
                        )

        texts = stored.select("block", *[F.lower(text_of(stored, c)).alias(f"c{i}") for i, c in enumerate(columns)])
        found = texts.mapInArrow(cut, "gram long, column int, block int")
        lists = found.groupBy("gram", "column", F.floor(F.col("block") / RANGE).alias("range"))
        lists = lists.agg(F.array_sort(F.collect_set("block")).alias("blocks"))
        placed = lists.withColumn("bucket", F.pmod("gram", F.lit(buckets)).cast("int"))
        placed = placed.repartition("bucket").sortWithinPartitions("bucket", "gram", "column")
        placed.write.partitionBy("bucket").parquet(f"{self.path}/postings")
        names = [(blocks, buckets, columns)]
        self.spark.createDataFrame(names, "blocks int, buckets int, columns array<string>").write.parquet(f"{self.path}/shape")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def postings(self, grams: Sequence[int], columns: Sequence[int]) -> DataFrame:
        """The stored lists of these trigrams; other folders and row groups are not read."""
        buckets = self.spark.read.parquet(f"{self.path}/shape").first()["buckets"]
        schema = "gram long, column int, range long, blocks array<int>, bucket int"
        stored = self.spark.read.schema(schema).parquet(f"{self.path}/postings")
        wanted = F.col("bucket").isin(sorted({g % buckets for g in grams})) & F.col("gram").isin(list(grams))
        return stored.where(wanted & F.col("column").isin(list(columns)))

    def candidates(self, term: str, columns: Sequence[str] | None = None) -> DataFrame:
        """``block`` of the blocks where one of the columns has all trigrams of the term."""
        indexed = self.spark.read.parquet(f"{self.path}/shape").first()["columns"]
        places = [indexed.index(c) for c in (columns or indexed)]
        grams = sorted(set(grams_of(term.lower()).tolist()))
        hits = self.postings(grams, places).select("column", "gram", F.explode("blocks").alias("block"))
        full = hits.groupBy("column", "block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(grams))
        return full.select("block").distinct()

    def search(self, term: str | None, columns: Sequence[str] | None = None) -> DataFrame:
        """Rows where a cell holds the literal term, whatever the case.

        ``columns`` are among the indexed ones (default: all of these). A term of fewer than three
        characters has no trigram; all rows are then tested. No term means all rows.
        """
        stored = self.rows()
        indexed = self.spark.read.parquet(f"{self.path}/shape").first()["columns"]
        columns = list(columns or indexed)
        if missing := [c for c in columns if c not in indexed]:
            raise ValueError(f"columns without postings: {missing}")
        if term and len(term.lower()) >= GRAM:
            blocks = kept(self.candidates(term, columns), "blocks")
            few = [r["block"] for r in blocks.limit(NAMED_BLOCKS + 1).collect()]
            if len(few) <= NAMED_BLOCKS:
                stored = stored.where(F.col("block").isin(few))
            else:
                stored = stored.join(blocks, "block", "left_semi")
        return search(stored, term, columns).drop("block")
