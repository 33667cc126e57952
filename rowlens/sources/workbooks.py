"""Folders of ``.xlsx`` workbooks as sheets.

Spark lists and reads the files (any Hadoop file system) and hands each task
whole workbooks; the format itself bounds a sheet at about a million rows. One
pass over the cells finds headers and types, the sheets are then plain lazy
DataFrames with one column per header.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rowlens.functions.names import COLUMN_ALIASES, clean_columns
from rowlens.sources.scratch import scratch_folder

_CELLS = "file string, sheet string, row int, col int, kind string, text string"
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# Built-in number formats that are dates or times.
_DATE_FORMATS = frozenset({14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47})
_EPOCH = dt.datetime(1899, 12, 30)


def _column_number(reference: str) -> int:
    number = 0
    for letter in re.match("[A-Z]+", reference).group():
        number = number * 26 + ord(letter) - 64
    return number - 1


def _string(node) -> str:
    """Text of a string node; phonetic hints are no part of it."""
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t")) if node.find(f"{_MAIN}rPh") is None else "".join(
        t.text or "" for run in node if run.tag != f"{_MAIN}rPh" for t in run.iter(f"{_MAIN}t")
    )


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    dates = set(_DATE_FORMATS)
    for fmt in root.iter(f"{_MAIN}numFmt"):
        code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", fmt.get("formatCode", ""))
        if re.search("[ymdhs]", code, re.IGNORECASE):
            dates.add(int(fmt.get("numFmtId")))
    styles = root.find(f"{_MAIN}cellXfs")
    return {i for i, xf in enumerate(styles if styles is not None else []) if int(xf.get("numFmtId", 0)) in dates}


def _sheet_parts(book: zipfile.ZipFile) -> Iterator[tuple[str, str]]:
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
        target = links[sheet.get(_RELATION)].lstrip("/")
        yield sheet.get("name"), target if target.startswith("xl/") else f"xl/{target}"


def _cell(cell, shared: list[str], dates: set[int]) -> tuple[str, str] | None:
    """Kind (s, n, b or d) and text of a cell, or ``None`` when it is empty."""
    kind, value = cell.get("t", "n"), cell.find(f"{_MAIN}v")
    if kind == "inlineStr":
        return "s", _string(cell.find(f"{_MAIN}is"))
    if value is None or value.text is None or kind == "e":
        return None
    if kind == "s":
        return "s", shared[int(value.text)]
    if kind == "b":
        return "b", "true" if value.text == "1" else "false"
    if kind == "str":
        return "s", value.text
    if kind == "d":
        return "d", value.text.replace("T", " ")
    if int(cell.get("s", 0)) in dates:
        return "d", str(_EPOCH + dt.timedelta(milliseconds=round(float(value.text) * 86_400_000)))
    return "n", value.text


def _workbook_cells(name: str, content: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = [_string(si) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        dates = _date_styles(book)
        for sheet, part in _sheet_parts(book):
            with book.open(part) as xml:
                row = -1
                for _, node in ElementTree.iterparse(xml):
                    if node.tag != f"{_MAIN}row":
                        continue
                    row = int(node.get("r", row + 2)) - 1
                    for at, cell in enumerate(node.iter(f"{_MAIN}c")):
                        found = _cell(cell, shared, dates)
                        if found:
                            where = cell.get("r")
                            yield name, sheet, row, _column_number(where) if where else at, *found
                    node.clear()


def workbook_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Non-empty cells of all workbooks: ``file, sheet, row, col, kind, text``."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "sheet", "row", "col", "kind", "text"]
        types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names
            )

        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows = []
                for cell in _workbook_cells(path.rsplit("/", 1)[-1], content.as_py()):
                    rows.append(cell)
                    if len(rows) == 50_000:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(folder)
    return files.select("path", "content").mapInArrow(parse, _CELLS)


def read_workbooks(spark: SparkSession, folder: str, aliases=COLUMN_ALIASES) -> dict[str, DataFrame]:
    """One DataFrame per sheet name; sheets of that name in several files are taken together.

    The first row of a sheet holds its headers. A column is bigint, double,
    boolean or timestamp when all its values are, else text. The workbooks are
    parsed once, into a table by sheet in the shared scratch folder.
    """
    path = scratch_folder(spark, "cells")
    workbook_cells(spark, folder).write.partitionBy("sheet").parquet(path)
    cells = spark.read.schema(_CELLS).parquet(path)
    # Headers that repeat within a sheet are numbered; a column without one is named by place.
    repeats = F.row_number().over(Window.partitionBy("file", "sheet", "text").orderBy("col")) - 1
    heads = cells.filter("row = 0").select(
        "file",
        "sheet",
        "col",
        F.when(repeats == 0, F.col("text")).otherwise(F.concat("text", F.lit("."), repeats)).alias("header"),
    )
    body = (
        cells.filter("row > 0")
        .join(heads, ["file", "sheet", "col"], "left")
        .withColumn("header", F.coalesce("header", F.concat(F.lit("Unnamed: "), "col")))
    )
    number = F.when(F.col("kind") == "n", F.col("text").try_cast("double"))
    whole = F.coalesce((number == F.floor(number)) & (F.abs(number) < 2**53), F.lit(False))
    kinds = (
        heads.select("sheet", "header", "col", F.lit(None).cast("string").alias("kind"), F.lit(True).alias("whole"))
        .unionByName(body.select("sheet", "header", "col", "kind", whole.alias("whole")))
        .groupBy("sheet", "header")
        .agg(
            F.min("col").alias("col"),
            F.max("kind").alias("kind"),
            F.count_distinct("kind").alias("kinds"),
            F.every("whole").alias("whole"),
        )
        .orderBy("sheet", "col", "header")
        .collect()  # headers only: one row per column of each sheet
    )

    def value(column) -> Column:
        text = F.col("values")[column.header]
        if column.kinds != 1 or column.kind == "s":
            return text
        if column.kind == "n":
            return text.cast("double").cast("bigint") if column.whole else text.cast("double")
        return text.cast("boolean" if column.kind == "b" else "timestamp_ntz")

    rows = body.groupBy("file", "sheet", "row").agg(
        F.map_from_entries(F.collect_list(F.struct("header", "text"))).alias("values")
    )
    sheets: dict[str, DataFrame] = {}
    for sheet in dict.fromkeys(k.sheet for k in kinds):
        columns = [value(k).alias(k.header) for k in kinds if k.sheet == sheet]
        # The filter on the sheet reaches the scan, which reads that folder alone.
        sheets[sheet] = clean_columns(rows.filter(F.col("sheet") == sheet).select(columns), aliases)
    return sheets
