"""Profiles that grow with a table: one small row per column and batch, merged at read.

A batch is scanned once, when it is added. Its distinct values are kept as an HLL
sketch, so a grown table is profiled from its sketches and never scanned again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from rowlens.operators.explore import SAMPLE_LENGTH, cell_text

# Sketches of 2**14 registers; the relative standard error of a distinct count is 0.83 / sqrt(2**14).
REGISTERS_LOG = 14
STANDARD_ERROR = 0.83 / 2 ** (REGISTERS_LOG / 2)
SKETCH_SCHEMA = "column string, type string, non_null bigint, sketch binary, sample string"


def column_sketches(df: DataFrame, skip: Sequence[str] = ("row_id",)) -> DataFrame:
    """``column, type, non_null, sketch, sample`` of every column, in one pass with one row per task.

    A column without values has a null sketch. The sample is the least text, whole.
    """
    names = [c for c in df.columns if c not in skip]
    if not names:
        return df.sparkSession.createDataFrame([], SKETCH_SCHEMA)
    cells = df.select([cell_text(df, c).alias(c) for c in names])
    found = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(df.schema[c].dataType.simpleString()).alias("type"),
            F.count(f"`{c}`").alias("non_null"),
            F.when(F.count(f"`{c}`") > 0, F.hll_sketch_agg(f"`{c}`", F.lit(REGISTERS_LOG))).alias("sketch"),
            F.min(f"`{c}`").alias("sample"),
        )
        for c in names
    ]
    return cells.agg(F.array(*found).alias("found")).select(F.inline("found"))


def merged_profile(sketches: DataFrame, sample_length: int = SAMPLE_LENGTH) -> DataFrame:
    """``column, type, non_null, n_distinct, sample`` over all batches.

    A column whose type differs between batches is reported as text, as a union
    of the batches would hold it. ``n_distinct`` is an estimate; see ``STANDARD_ERROR``.
    """
    merged = sketches.groupBy("column").agg(
        F.when(F.count_distinct("type") == 1, F.min("type")).otherwise("string").alias("type"),
        F.sum("non_null").alias("non_null"),
        F.hll_union_agg("sketch", F.lit(False)).alias("sketch"),
        F.min("sample").alias("sample"),
    )
    distinct = F.when(F.col("non_null") > 0, F.hll_sketch_estimate("sketch")).otherwise(0)
    return merged.select(
        "column",
        "type",
        "non_null",
        distinct.cast("bigint").alias("n_distinct"),
        F.coalesce(F.substring("sample", 1, sample_length), F.lit("N/A")).alias("sample"),
    )


class StoredProfile:
    """Sketches of the batches of a table, in one Parquet folder that each batch is appended to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def add(self, batch: DataFrame, skip: Sequence[str] = ("row_id",)) -> None:
        """Scan the batch, and only it. Rows that a store skipped as known must not be added again."""
        column_sketches(batch, skip).coalesce(1).write.mode("append").parquet(self.path)

    def sketches(self) -> DataFrame:
        try:
            return self.spark.read.schema(SKETCH_SCHEMA).parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], SKETCH_SCHEMA)

    def read(self, sample_length: int = SAMPLE_LENGTH) -> DataFrame:
        return merged_profile(self.sketches(), sample_length)
