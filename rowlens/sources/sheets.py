"""Sheets: many tables of the same kind, unioned by column name."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rowlens.functions.names import COLUMN_ALIASES, clean_columns, clean_name, union_rows
from rowlens.operators.identity import add_row_ids

SOURCE_SHEET = "source_sheet"
CANONICAL_SHEET = "All"


def read_sheets(
    spark: SparkSession,
    paths: Mapping[str, str],
    fmt: str = "parquet",
    aliases: Mapping[str, str] = COLUMN_ALIASES,
    **options,
) -> dict[str, DataFrame]:
    """One lazy DataFrame per sheet, column names cleaned."""
    return {
        name: clean_columns(spark.read.format(fmt).options(**options).load(path), aliases)
        for name, path in paths.items()
    }


def _csv_headers(spark: SparkSession, folder: str, options: Mapping) -> list[list[str]]:
    """The files of a folder of CSV, grouped by their header line: one short row per file is collected."""
    lines = spark.read.format("text").options(**{k: v for k, v in options.items() if k in ("pathGlobFilter", "encoding", "lineSep")})
    first = lines.load(folder).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.col("value")
    )
    # Only the block at the start of a file holds its header; a task stops at the first line of it.
    heads = first.where("at = 0").mapInPandas(_first_lines, "file string, value string")
    groups: dict[str, list[str]] = {}
    for row in heads.orderBy("file").collect():
        groups.setdefault(row["value"].rstrip("\r\ufeff").lstrip("\ufeff"), []).append(row["file"])
    return list(groups.values())


def _first_lines(batches):
    seen = set()
    for rows in batches:
        new = rows[~rows["file"].isin(seen)].drop_duplicates("file")
        seen.update(new["file"])
        yield new[["file", "value"]]


def read_sheet_folder(
    spark: SparkSession,
    folder: str,
    fmt: str = "parquet",
    aliases: Mapping[str, str] = COLUMN_ALIASES,
    **options,
) -> DataFrame:
    """A folder of files of any number; the file name is the sheet name.

    Parquet and JSON carry their column names and are one scan. CSV files do not:
    those with one header are one scan, and the scans are unioned by name.
    """
    if fmt == "parquet":
        options = {"mergeSchema": True, **options}
    groups = [[folder]]
    if fmt == "csv" and str(options.get("header", "false")).lower() == "true":
        groups = _csv_headers(spark, folder, options) or groups
    frames = []
    for paths in groups:
        raw = spark.read.format(fmt).options(**options).load(paths)
        sheet = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
        columns = [c for c in raw.columns if clean_name(c, aliases) != SOURCE_SHEET]
        named = raw.select(*[F.col(f"`{c}`") for c in columns], sheet.alias(SOURCE_SHEET))
        frames.append(clean_columns(named, aliases))
    return union_rows(frames)


def merge_sheets(sheets: Mapping[str, DataFrame], spark: SparkSession | None = None) -> DataFrame:
    """UNION ALL by name with the sheet name in ``source_sheet``."""
    if not sheets:
        spark = spark or SparkSession.getActiveSession()
        return spark.createDataFrame([], T.StructType([]))
    return union_rows([df.withColumn(SOURCE_SHEET, F.lit(name)) for name, df in sheets.items()])


def ingest(sheets: Mapping[str, DataFrame], **id_options) -> DataFrame:
    """Clean names, union, add row ids: the canonical rows, as one lazy plan."""
    cleaned = {name: clean_columns(df) for name, df in sheets.items()}
    return add_row_ids(merge_sheets(cleaned), **id_options)


def write_original_sheets(sheets: Mapping[str, DataFrame], path: str) -> list[str]:
    """Keep each sheet as read, in its own folder; the name ``All`` is taken by the union."""
    kept = [name for name in sheets if name != CANONICAL_SHEET]
    for name in kept:
        sheets[name].write.mode("overwrite").parquet(f"{path.rstrip('/')}/{SOURCE_SHEET}={name}")
    return kept

