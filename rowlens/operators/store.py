"""The row store: upsert, append, delete and lookup by content id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from rowlens.functions.names import clean_columns, union_rows
from rowlens.functions.text import is_blank, strip
from rowlens.operators.identity import ROW_ID, add_row_ids, dedup_rows
from rowlens.sources.tables import ParquetTable

# Batches whose ids have at most this many bytes in all are small enough to
# broadcast them, so the store is scanned without being shuffled.
SMALL_BATCH_BYTES = 32 << 20

_YEAR_OR_BLANK = r"^(\+?0*(19[0-9]{2}|20[0-9]{2}|2100))?$"
YEARS = (1900, 2100)


def _columns(df: DataFrame) -> list[Column]:
    """All columns; cleaned headers may still hold dots."""
    return [F.col(f"`{c}`") for c in df.columns]


def _identified(rows: DataFrame) -> DataFrame:
    return rows if ROW_ID in rows.columns else add_row_ids(rows)


def count_ids(rows: DataFrame) -> tuple[int, int]:
    """Rows, and bytes of their ids."""
    size = F.coalesce(F.sum(F.octet_length(F.col(ROW_ID).cast("string")) + 16), F.lit(0))
    return tuple(rows.agg(F.count(F.lit(1)), size).first())


def new_rows(store: DataFrame, batch: DataFrame, small_batch: bool = False) -> DataFrame:
    """Rows of ``batch`` whose id the store lacks, one per id.

    The store side is reduced to distinct ids before the shuffle, and the
    distinct, the duplicate removal and the anti-join share one partitioning by
    id. Ids the batch brings along are used as they are. With ``small_batch`` the ids of the batch are broadcast to the store.
    """
    fresh = dedup_rows(_identified(batch))
    known = store.select(ROW_ID)
    if small_batch:
        known = known.join(F.broadcast(fresh.select(ROW_ID)), ROW_ID, "left_semi")
    return fresh.join(known.distinct(), ROW_ID, "left_anti").select(*_columns(fresh))


def upsert(store: DataFrame | None, batch: DataFrame, small_batch: bool = False) -> DataFrame:
    """The store with the new rows of the batch added; columns aligned by name."""
    if store is None:
        return dedup_rows(_identified(batch))
    return union_rows([store, new_rows(store, batch, small_batch)])


def pad_to_store(store: DataFrame, rows: DataFrame) -> DataFrame:
    """Clean the names of incoming rows and add the store columns they lack, as nulls."""
    rows = clean_columns(rows)
    missing = [f for f in store.schema.fields if f.name not in rows.columns and f.name != ROW_ID]
    return rows.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing])


def append_rows(store: DataFrame, rows: DataFrame) -> DataFrame:
    """The store plus incoming rows; rows it already holds are left out."""
    return upsert(store, add_row_ids(pad_to_store(store, rows)))


def delete_rows(store: DataFrame, ids: DataFrame) -> DataFrame:
    return store.join(ids.select(ROW_ID).distinct(), ROW_ID, "left_anti").select(*_columns(store))


def find_rows(store: DataFrame, ids: DataFrame) -> DataFrame:
    return store.join(ids.select(ROW_ID).distinct(), ROW_ID, "left_semi").select(*_columns(store))


def find_row(store: DataFrame, row_id: str) -> DataFrame:
    """Point lookup; the predicate reaches the Parquet scan."""
    return store.filter(F.col(ROW_ID) == row_id).limit(1)


def store_counts(store: DataFrame) -> DataFrame:
    return store.agg(F.count(F.lit(1)).alias("rows"))


def coerce_entries(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed entries and rejects, from text columns.

    A name with ``date`` is free text; one with ``year`` is an integer in
    1900-2100; all else is text. Blanks become null. A row whose year does not
    fit goes to the rejects, unchanged.
    """

    valid, typed = F.lit(True), []
    for name in entries.columns:
        c = F.col(f"`{name}`")
        is_year = "year" in name.lower() and "date" not in name.lower()
        if is_year and isinstance(entries.schema[name].dataType, T.NumericType):
            fits = c.between(*YEARS) & (c == F.floor(c))
            valid = valid & F.coalesce(fits, F.lit(True))
            typed.append(F.when(fits, c).cast("int").alias(name))
        elif is_year:
            text = strip(c.cast("string"))
            # A pattern, not a failing cast per row: those are slow.
            valid = valid & F.coalesce(text.rlike(_YEAR_OR_BLANK), F.lit(True))
            typed.append(F.when(text != "", text.try_cast("int")).alias(name))
        elif isinstance(entries.schema[name].dataType, T.StringType):
            typed.append(F.when(~is_blank(c), c).alias(name))
        else:
            typed.append(c.alias(name))
    return entries.filter(valid).select(typed), entries.filter(~valid)


class RowStore:
    """A stored table of canonical rows."""

    def __init__(self, spark: SparkSession, path: str):
        self.table = ParquetTable(spark, path)

    def load(self) -> DataFrame | None:
        return self.table.read()

    def save(self, batch: DataFrame) -> dict[str, int]:
        """Append the rows of ``batch`` that are new; ``{added, skipped}``."""
        batch = add_row_ids(batch)
        stored, (total, size) = self.load(), count_ids(batch)
        if stored is None:
            added = self.table.replace(dedup_rows(batch))
        else:
            added = self.table.append(new_rows(stored, batch, small_batch=size <= SMALL_BATCH_BYTES))
        return {"added": added, "skipped": total - added}

    def append(self, rows: DataFrame) -> dict:
        """As :meth:`save`, for rows with raw headers or missing columns; ``ids`` are those of the rows given."""
        stored = self.load()
        rows = add_row_ids(clean_columns(rows) if stored is None else pad_to_store(stored, rows))
        return {**self.save(rows), "ids": rows.select(ROW_ID)}

    def delete(self, ids: DataFrame) -> int:
        return self.table.remove(ids)

    def replace(self, rows: DataFrame) -> int:
        return self.table.replace(dedup_rows(add_row_ids(rows)))

    def compact(self) -> int:
        return self.table.compact()
