"""The vector index: incremental update, sync, rebuild, delete, search."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rowlens.functions.text import is_blank
from rowlens.functions.vectors import norm
from rowlens.operators.documents import drop_blank, to_documents
from rowlens.operators.embed import hashed_embedding
from rowlens.operators.identity import ROW_ID, dedup_rows
from rowlens.operators.nearest import knn
from rowlens.operators.store import count_ids
from rowlens.sources.scratch import kept
from rowlens.sources.tables import ParquetTable

# DataFrame with ``text`` -> the same with ``embedding``; see operators.embed.
Embedder = Callable[[DataFrame], DataFrame]
INDEX_SCHEMA = "row_id string, text string, metadata string, embedding array<float>, norm double"
# Ids of at most this many bytes in all are small enough to broadcast.
FEW_IDS_BYTES = 32 << 20
ENTRY = ["row_id", "text", "metadata", "embedding", "norm"]


def _columns(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns]


def missing_ids(documents: DataFrame, index: DataFrame) -> DataFrame:
    """Ids the index lacks; both sides are read and shuffled as ids only."""
    known = index.select(ROW_ID).distinct()
    return documents.select(ROW_ID).distinct().join(known, ROW_ID, "left_anti")


def missing_documents(documents: DataFrame, index: DataFrame, few: bool = False) -> DataFrame:
    """Documents with text whose id the index lacks, one per id. Runs before any embedding.

    With ``few`` missing ids (counted by the caller) they are broadcast, and the
    documents the index already holds are never shuffled.
    """
    ids = missing_ids(documents, index)
    if few:
        wanted = dedup_rows(drop_blank(documents.join(F.broadcast(ids), ROW_ID, "left_semi")))
    else:  # copies collapse in the map tasks, before they meet
        wanted = dedup_rows(drop_blank(documents)).join(ids, ROW_ID, "left_semi")
    return wanted.select(*_columns(documents))


def index_entries(documents: DataFrame, embedder: Embedder = hashed_embedding) -> DataFrame:
    """Documents as index rows; ``norm`` is kept so that zero vectors are known."""
    return embedder(documents).withColumn("norm", norm(F.col("embedding"))).select(*ENTRY)


def rebuilt_index(documents: DataFrame, embedder: Embedder = hashed_embedding) -> DataFrame:
    return index_entries(dedup_rows(drop_blank(documents)), embedder)


def incremental_counts(documents: DataFrame, index: DataFrame) -> DataFrame:
    """``added, skipped`` of an incremental update, in one pass."""
    flagged = drop_blank(documents).groupBy(ROW_ID).agg(F.count(F.lit(1)).alias("n"))
    known = index.select(ROW_ID).distinct().withColumn("known", F.lit(True))
    return (
        flagged.join(known, ROW_ID, "left")
        .agg(
            F.count_if(F.col("known").isNull()).alias("added"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        )
        .select("added", (F.col("total") - F.col("added")).alias("skipped"))
    )


def drift(store: DataFrame, index: DataFrame) -> DataFrame:
    """Every id with ``in_store, in_index, has_text``: one shuffle of ids, repeated ids collapse before it."""
    text = ~is_blank(F.col("text")) if "text" in store.columns else F.lit(True)
    sides = store.select(ROW_ID, F.lit(True).alias("s"), F.lit(False).alias("i"), text.alias("t")).unionByName(
        index.select(ROW_ID, F.lit(False).alias("s"), F.lit(True).alias("i"), F.lit(False).alias("t"))
    )
    return sides.groupBy(ROW_ID).agg(
        F.max("s").alias("in_store"), F.max("i").alias("in_index"), F.max("t").alias("has_text")
    )


def sync_counts(store: DataFrame, index: DataFrame) -> DataFrame:
    """``added, removed, total_in_store, total_in_index`` of a sync of ``store(row_id, text)``; blanks are never added."""
    added, removed = ~F.col("in_index") & F.col("has_text"), ~F.col("in_store")
    return drift(store, index).agg(
        F.count_if(added).alias("added"),
        F.count_if(removed).alias("removed"),
        F.count_if("in_store").alias("total_in_store"),
        F.count_if((F.col("in_index") & ~removed) | added).alias("total_in_index"),
    )


def orphans(store: DataFrame, index: DataFrame) -> DataFrame:
    """Index ids whose row has left the store."""
    stored = store.select(ROW_ID).distinct()
    return index.select(ROW_ID).distinct().join(stored, ROW_ID, "left_anti")


def delete_entries(index: DataFrame, ids: DataFrame) -> DataFrame:
    return index.join(ids.select(ROW_ID).distinct(), ROW_ID, "left_anti").select(*_columns(index))


def with_payload(hits: DataFrame, index: DataFrame, *columns: str) -> DataFrame:
    """Fetch text and metadata for the hits only; the search itself never reads them."""
    return hits.join(index.select(ROW_ID, *columns), ROW_ID)


class VectorIndex:
    """A stored index. ``embedder`` adds ``embedding`` to documents."""

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        embedder: Embedder = hashed_embedding,
        name: str = "index",
    ):
        self.spark, self.path, self.name, self.embedder = spark, path, name, embedder
        self.table = ParquetTable(spark, path)

    def read(self) -> DataFrame:
        found = self.table.read()
        if found is None:
            return self.spark.createDataFrame([], INDEX_SCHEMA)
        return found

    def ids(self) -> DataFrame:
        """Ids only: the scan reads one column."""
        return self.read().select(ROW_ID)

    def update(self, rows: DataFrame) -> dict[str, int]:
        """Embed and add the rows the index lacks; ``{added, skipped}``, blank rows being skipped ones.

        What is there already is known from its ids alone; no text of it is built.
        """
        documents, entries = to_documents(rows), self.read()
        total = documents.select(ROW_ID).count()
        missing, size = count_ids(missing_ids(documents, entries))
        if not missing:
            return {"added": 0, "skipped": total}
        fresh = missing_documents(documents, entries, few=size <= FEW_IDS_BYTES)
        added = self.table.append(index_entries(fresh, self.embedder))
        return {"added": added, "skipped": total - added}

    def rebuild(self, rows: DataFrame) -> int:
        return self.table.replace(rebuilt_index(to_documents(rows), self.embedder))

    def sync(self, store: DataFrame) -> dict[str, int]:
        """Remove entries whose row is gone, add the missing ones."""
        removed = self.table.remove(orphans(store, self.read()))
        added = self.update(store)["added"]
        return {
            "added": added,
            "removed": removed,
            "total_in_store": store.select(ROW_ID).distinct().count(),
            "total_in_index": self.read().count(),
        }

    def delete(self, ids: DataFrame) -> int:
        return self.table.remove(ids)

    def clear(self) -> None:
        self.table.replace(self.spark.createDataFrame([], INDEX_SCHEMA))

    def is_empty(self) -> bool:
        return self.read().isEmpty()

    def stats(self) -> dict:
        return {"name": self.name, "document_count": self.read().count(), "path": self.path}

    def embedded(self, questions: DataFrame, query_embedder: Embedder | None = None) -> DataFrame:
        """``query_id, embedding[, error]`` of ``questions(query_id, text)``, computed once.

        ``query_embedder`` serves models that treat questions unlike documents.
        """
        asked = (query_embedder or self.embedder)(questions)
        return kept(asked.select("query_id", "embedding", *(["error"] if "error" in asked.columns else [])), "asked")

    def nearest(
        self, asked: DataFrame, k: int = 5, where: Callable[[DataFrame], Column] | None = None
    ) -> DataFrame:
        """Hits with text and metadata for ``asked(query_id, embedding)``; one without a vector has none.

        ``where`` is a condition on the entries, such as one on
        :func:`~rowlens.operators.documents.metadata_field`; it holds before the top-k.
        """
        entries = self.read()
        if where is not None:
            entries = entries.where(where(entries))
        return with_payload(knn(entries, asked.select("query_id", "embedding"), k), entries, "text", "metadata")

    def search(
        self,
        questions: DataFrame,
        k: int = 5,
        query_embedder: Embedder | None = None,
        where: Callable[[DataFrame], Column] | None = None,
    ) -> DataFrame:
        """Hits with text and metadata for ``questions(query_id, text)``, among the entries that meet ``where``."""
        return self.nearest(self.embedded(questions, query_embedder), k, where)
