"""A growing Parquet table with removals.

Additions and removals are both plain appends, each in its own numbered batch
folder, so adding rows never rewrites the table and removing rows costs as much
as the ids removed. ``replace`` writes the next snapshot and so compacts. A
batch that fails half way is overwritten by its retry. One writer at a time.

    path/snapshot=3/rows/batch=0/*.parquet
    path/snapshot=3/removed/batch=4/*.parquet
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rowlens.functions.names import align_types, union_rows

_BATCH = "batch"
# Written into a batch once all its files are there. Spark reads no file that begins with an underscore.
COMMITTED = "_committed"


class ParquetTable:
    def __init__(self, spark: SparkSession, path: str, key: str = "row_id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    # -- folders ---------------------------------------------------------

    def _files(self, folder: str):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(folder)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at, jvm.org.apache.hadoop.fs.Path

    def _names(self, folder: str) -> list[str]:
        fs, at, _ = self._files(folder)
        return [status.getPath().getName() for status in fs.listStatus(at)] if fs.exists(at) else []

    def _committed(self, folder: str) -> bool:
        fs, at, path = self._files(folder)
        return fs.exists(path(at, COMMITTED))

    def _commit(self, folder: str) -> None:
        fs, at, path = self._files(folder)
        fs.create(path(at, COMMITTED), True).close()

    def _numbers(self, folder: str, prefix: str, inside: str = "") -> list[int]:
        """Numbers of the finished sub-folders: those with our own commit marker."""
        found = [name for name in self._names(folder) if name.startswith(prefix)]
        return sorted(int(n[len(prefix):]) for n in found if self._committed(f"{folder}/{n}{inside}"))

    def _snapshot(self) -> int | None:
        first = f"/rows/{_BATCH}=0"
        numbers = self._numbers(self.path, "snapshot=", first)
        if numbers:
            return numbers[-1]
        for name in self._names(self.path):
            if name.startswith("snapshot=") and any("part-" in f for f in self._names(f"{self.path}/{name}{first}")):
                raise ValueError(f"{self.path}/{name} holds data but was never finished; look at it and remove it")
        return None

    def _folder(self, snapshot: int, part: str) -> str:
        return f"{self.path}/snapshot={snapshot}/{part}"

    def _next_batch(self, snapshot: int) -> int:
        used = [
            n
            for part in ("rows", "removed")
            for n in self._numbers(self._folder(snapshot, part), f"{_BATCH}=")
        ]
        return max(used, default=-1) + 1

    def _load(self, snapshot: int, part: str) -> DataFrame | None:
        folder = self._folder(snapshot, part)
        batches = self._numbers(folder, f"{_BATCH}=")
        if not batches:
            return None
        return (
            self.spark.read.option("basePath", folder)
            .option("mergeSchema", True)
            .parquet(*[f"{folder}/{_BATCH}={n}" for n in batches])
        )

    # -- use -------------------------------------------------------------

    def exists(self) -> bool:
        return self._snapshot() is not None

    def read(self) -> DataFrame | None:
        """The live rows, or ``None`` when the table was never written."""
        snapshot = self._snapshot()
        if snapshot is None:
            return None
        rows = self._load(snapshot, "rows")
        removed = self._load(snapshot, "removed")
        if removed is not None:
            last = removed.groupBy(F.col(self.key).alias("_key")).agg(F.max(_BATCH).alias("_at"))
            rows = rows.join(
                last, (rows[self.key] == last["_key"]) & (rows[_BATCH] < last["_at"]), "left_anti"
            )
        return rows.drop(_BATCH)

    def _write(self, df: DataFrame, snapshot: int, part: str, batch: int) -> int:
        folder = f"{self._folder(snapshot, part)}/{_BATCH}={batch}"
        # Bloom filters let a lookup by id skip row groups.
        df.write.mode("overwrite").option(f"parquet.bloom.filter.enabled#{self.key}", "true").parquet(folder)
        self._commit(folder)
        # Counted from the written footers, so retried tasks cannot count twice.
        return self.spark.read.schema(df.schema).parquet(folder).count()

    def append(self, df: DataFrame) -> int:
        """Add rows; columns new to the table are null in older rows.

        Where a column's type changed so that the stored one cannot hold it, the
        union is written as the next snapshot.
        """
        snapshot = self._snapshot()
        if snapshot is None:
            return self.replace(df)
        stored = self._load(snapshot, "rows").drop(_BATCH)
        kinds = dict(stored.dtypes)
        aligned = align_types([stored, df])[1]
        if all(kinds.get(n, k) in (k, "void") for n, k in aligned.dtypes):
            return self._write(aligned, snapshot, "rows", self._next_batch(snapshot))
        live = self.read()
        return self._write(union_rows([live, df]), snapshot + 1, "rows", 0) - live.count()

    def remove(self, ids: DataFrame) -> int:
        """Hide the live rows with these keys; returns how many keys were there."""
        snapshot = self._snapshot()
        if snapshot is None:
            return 0
        wanted = ids.select(self.key).distinct()
        hits = wanted.join(self.read().select(self.key), self.key, "left_semi")
        return self._write(hits, snapshot, "removed", self._next_batch(snapshot))

    def replace(self, df: DataFrame) -> int:
        """Write a new snapshot; readers see it once it is complete."""
        snapshot = self._snapshot()
        return self._write(df, 0 if snapshot is None else snapshot + 1, "rows", 0)

    def compact(self) -> int:
        """Fold additions and removals into one snapshot."""
        return self.replace(self.read())
