"""Search in cells, column profile, previews."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F, types as T

from rowlens.functions.text import as_text, text_of

SAMPLE_LENGTH = 50
PREVIEW_ROWS = 100


def _matches(df: DataFrame, name: str, term: str, regex: bool) -> Column:
    text = text_of(df, name)
    if regex:
        return F.regexp_like(text, F.lit("(?iu)" + term))
    return F.contains(F.lower(text), F.lit(term.lower()))


def search(
    df: DataFrame, term: str | None, columns: Sequence[str] | None = None, regex: bool = False
) -> DataFrame:
    """Rows where a cell holds the term, whatever the case; no term means all rows.

    The term is literal unless ``regex``. Nulls never match.
    """
    if not term:
        return df
    tests = [F.coalesce(_matches(df, c, term, regex), F.lit(False)) for c in (columns or df.columns)]
    return df.filter(reduce(or_, tests))


def display_strings(df: DataFrame) -> DataFrame:
    """Every cell as text; nulls and the text ``nan`` become empty."""
    cells = []
    for name in df.columns:
        text = text_of(df, name)
        cells.append(F.coalesce(F.when(text != "nan", text), F.lit("")).alias(name))
    return df.select(cells)


def preview(df: DataFrame, order_by: Sequence[str], n: int = PREVIEW_ROWS) -> DataFrame:
    """The first ``n`` rows for display."""
    return display_strings(df.orderBy(*order_by).limit(n))


def sheet_counts(df: DataFrame, sheet: str = "source_sheet") -> DataFrame:
    return df.groupBy(sheet).agg(F.count(F.lit(1)).alias("rows"))


def cell_text(df: DataFrame, name: str) -> Column:
    """The cell as the text that values are counted by."""
    c, kind = F.col(f"`{name}`"), df.schema[name].dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        c = c + F.lit(0.0)  # -0.0 and 0.0 are one value
    return as_text(c, kind)


def profile(
    df: DataFrame, skip: Sequence[str] = ("row_id",), exact: bool = True, sample_length: int = SAMPLE_LENGTH
) -> DataFrame:
    """``column, type, non_null, n_distinct, sample`` of every column.

    Counts and samples are one pass with one row per task. Exact distinct counts
    shuffle 128-bit hashes of the cells, never their text, and a value that fills
    a third of a column collapses before that. ``exact=False`` uses sketches.
    """
    names = [c for c in df.columns if c not in skip]
    kinds = df.sparkSession.createDataFrame(
        [(c, df.schema[c].dataType.simpleString()) for c in names], "column string, type string"
    )
    cells = df.select([cell_text(df, c).alias(c) for c in names])
    distinct = [F.lit(0) if exact else F.approx_count_distinct(f"`{c}`") for c in names]
    found = cells.agg(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("column"),
                    F.count(f"`{c}`").alias("non_null"),
                    d.cast("bigint").alias("n_distinct"),
                    F.min(f"`{c}`").alias("sample"),
                )
                for c, d in zip(names, distinct)
            ]
        ).alias("found")
    ).select(F.inline("found"))
    if exact:
        hashes = cells.select([F.unhex(F.md5(F.col(f"`{c}`"))).alias(c) for c in names])
        values = hashes.unpivot([], [F.col(f"`{c}`") for c in names], "column", "value").where("value is not null")
        counts = values.distinct().groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))
        found = found.drop("n_distinct").join(counts, "column", "left")
    return kinds.join(found, "column", "left").select(
        "column",
        "type",
        F.coalesce("non_null", F.lit(0)).cast("bigint").alias("non_null"),
        F.coalesce("n_distinct", F.lit(0)).cast("bigint").alias("n_distinct"),
        F.coalesce(F.substring("sample", 1, sample_length), F.lit("N/A")).alias("sample"),
    )
