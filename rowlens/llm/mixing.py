"""Mixing sources to target weights by weighted fair queueing.

Every source's documents stand in a shuffled queue, twice over. A document's
virtual finish time is the number of its source's words up to and including it,
divided by the source's target. All queues are merged by range-sorting on that
time, and the merged stream is cut at the total budget.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from rowlens.llm.common import WORD, row_hash, staged

WEIGHTS = (5, 2, 1)
BUDGET_PERCENT = 150
EPOCHS = 2
# Documents of one source that one window task orders, on average.
QUEUE_ROWS = 5_000
# Equal rows that one task counts out from the one row that stands for them.
CHUNK_ROWS = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: list[tuple[str | None, int]]) -> list[tuple[str | None, int, float]]:
    """``source, size, target`` for (source, size) pairs: weighted shares of the budget.

    A target stops at ``EPOCHS`` times its source; the excess is shared again by
    weight among the others, until none is above.
    """
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: WEIGHTS[i % len(WEIGHTS)] for i, (s, _) in enumerate(order)}
    size = dict(order)
    target = dict.fromkeys(size, 0.0)
    free, budget = set(size), BUDGET_PERCENT / 100 * sum(size.values())
    while free:
        share = budget / sum(weight[s] for s in free)
        full = {s for s in free if share * weight[s] >= EPOCHS * size[s]}
        if not full:
            target.update({s: share * weight[s] for s in free})
            break
        for s in full:
            target[s] = float(EPOCHS * size[s])
        budget -= sum(target[s] for s in full)
        free -= full
    return [(s, size[s], target[s]) for s, _ in order]


def repeated(rows: DataFrame, times: str, keys: list[str], number: str) -> DataFrame:
    """Each row ``times`` times, with a ``number`` from 0; a row that stands for very many is spread over tasks."""
    size = F.lit(CHUNK_ROWS)
    chunks = rows.withColumn(number, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / size))))
    most = rows.agg(F.max(times)).first()[0] or 0
    if most > CHUNK_ROWS:
        chunks = chunks.repartition(*keys, number)
    first = F.col(number) * size
    return chunks.withColumn(number, F.explode(F.sequence(first, F.least(first + size, F.col(times)) - 1))).drop(times)


def queued(docs: DataFrame, id_column: str, text_column: str, source_column: str) -> DataFrame:
    """Items of the mix, one per row: ``id, source, text_hash, row_hash, size``, and ``number``, which tells equal rows apart."""
    rows = docs.select(
        F.col(f"`{id_column}`").alias("id"),
        F.col(f"`{source_column}`").cast("string").alias("source"),
        F.xxhash64(F.col(f"`{text_column}`")).alias("text_hash"),
        row_hash(docs).alias("row_hash"),
        word_count(F.col(f"`{text_column}`")).alias("size"),
    )
    keys = ["id", "source", "text_hash", "row_hash", "size"]
    units = staged(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")))
    return repeated(units, "rows", keys, "number")


def mix_plan(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    seed: int = 7,
) -> DataFrame:
    """Per row: ``id, source, text_hash, row_hash, number, size, source_size, target, copies``.

    ``copies`` (0 to 2) is how often the mix takes the row. Equal rows are
    numbered and stand in the queue each by itself. The number of sources is taken to be small (their sizes are collected); sources,
    null included, are one queue each, and a queue of any length is ordered in
    hash ranges, so a hot source is spread over many tasks.
    """
    spark = docs.sparkSession
    units = queued(docs, id_column, text_column, source_column)
    per_source = units.groupBy("source").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("units"))
    found = per_source.collect()  # one row per source
    targets = source_targets([(r["source"], r["n"]) for r in found])
    longest = max((r["units"] for r in found), default=1)
    ranges = max(1, -(-longest // QUEUE_ROWS))
    table = spark.createDataFrame(targets, "source string, source_size long, target double")
    units = units.join(F.broadcast(table), F.equal_null(units["source"], table["source"])).drop(table["source"])

    # The shuffled order is that of a hash; its ranges are ordered apart and their sums carried on.
    place = F.xxhash64(F.lit(seed), "id", "text_hash", "source", "number")
    part = F.floor((place / F.lit(2.0**64) + F.lit(0.5)) * ranges).cast("int")
    units = units.withColumns({"place": place, "range": F.least(part, F.lit(ranges - 1))})
    units = units.withColumn("words", F.col("size"))
    sums = units.groupBy("source", "range").agg(F.sum("words").alias("words"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(
        F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base")
    )
    inside = Window.partitionBy("source", "range").orderBy("place", "id", "text_hash", "row_hash", "number")
    queue = units.withColumn("upto", F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    queue = queue.join(F.broadcast(bases) if ranges * len(found) <= 100_000 else bases,
                       F.equal_null("source", "s") & (F.col("range") == F.col("r"))).drop("s", "r", "range")
    queue = queue.withColumn("upto", F.col("base") + F.col("upto")).drop("base")
    queue = staged(queue)

    # A copy of epoch e finishes when its source's words, e whole rounds and those up to it, are done.
    copies = queue.where("words > 0").select(
        "words", "place", "id", "upto", "target", "source_size", F.explode(F.array(*map(F.lit, range(EPOCHS)))).alias("epoch")
    )
    copies = copies.select(finish_time(F.col("epoch")).alias("finish"), "place", "epoch", "words")
    budget = sum(t for _, _, t in targets)
    cut = _last_taken(copies, budget)
    taken = F.lit(0)
    if cut is not None:
        for epoch in range(EPOCHS):
            own = F.struct(finish_time(F.lit(epoch)).alias("finish"), F.col("place"), F.lit(epoch).alias("epoch"))
            last = F.struct(F.lit(cut[0]), F.lit(cut[1]).cast("long"), F.lit(cut[2]))
            taken = taken + F.when((F.col("words") > 0) & (own <= last), 1).otherwise(0)
    return _closed(queue.withColumn("copies", taken)).drop("place", "words", "upto")


def _closed(queue: DataFrame) -> DataFrame:
    """Give each source's last place to the one row, added or left out, that ends nearest to the target."""
    queue = queue.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    gaps = staged(
        queue.groupBy("key").agg((F.max("target") - F.sum(F.col("copies") * F.col("words"))).alias("gap"))
    )
    each = queue.join(F.broadcast(gaps), "key")  # one row per source
    change = F.when((F.col("gap") > 0) & (F.col("copies") < EPOCHS), 1).when((F.col("gap") < 0) & (F.col("copies") > 0), -1)
    error = F.abs(F.col("gap") - change * F.col("words"))
    best = each.where((F.col("words") > 0) & change.isNotNull() & (error < F.abs("gap")))
    best = best.groupBy("key").agg(
        F.min(F.struct(error.alias("error"), "place", "row_hash", "number", change.alias("change"))).alias("b")
    )
    best = staged(best.select("key", F.col("b").alias("best")))
    last = (F.col("place") == F.col("best.place")) & (F.col("row_hash") == F.col("best.row_hash"))
    last = last & (F.col("number") == F.col("best.number"))
    joined = queue.join(F.broadcast(best), "key", "left")  # one row per source
    changed = F.col("copies") + F.when(last, F.col("best.change")).otherwise(0)
    return joined.withColumn("copies", changed).drop("key", "best")


def finish_time(epoch: Column) -> Column:
    return (epoch * F.col("source_size") + F.col("upto")).cast("double") / F.col("target")


def _last_taken(copies: DataFrame, budget: float):
    """``finish, place, epoch`` of the last copy that the budget covers.

    The copies are range-sorted; each task adds up its own words, and one row per
    task carries the sums on.
    """
    ordered = copies.repartitionByRange("finish", "place", "epoch").sortWithinPartitions("finish", "place", "epoch")
    ordered = ordered.withColumn("part", F.spark_partition_id())

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            if batch.num_rows:
                upto = total + np.cumsum(batch.column("words").to_numpy())
                total = int(upto[-1])
                columns = [batch.column(c) for c in ("finish", "place", "epoch", "part")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(upto)], ["finish", "place", "epoch", "part", "upto"])

    summed = staged(ordered.mapInArrow(add_up, "finish double, place long, epoch int, part int, upto long"))
    parts = summed.groupBy("part").agg(F.max("upto").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    bases = staged(parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    within = summed.join(bases, "part").where(F.col("base") + F.col("upto") <= F.lit(float(budget) + 1e-6))
    last = within.agg(F.max(F.struct("finish", "place", "epoch")).alias("last")).first()["last"]
    return None if last is None else (last["finish"], last["place"], last["epoch"])


def mix(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", seed: int = 7
) -> DataFrame:
    """One row per document: id, ``size, source_size, target, taken``.

    Whole documents are taken, up to twice. Rows that are equal are taken each by
    itself; a null text has size 0 and is never taken. Reruns and other
    partitionings agree.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys((id_column, text_column, source_column))])
    plan = mix_plan(docs, id_column, text_column, source_column, seed)
    taken = (F.col("copies") * F.col("size")).cast("long").alias("taken")
    return plan.select(F.col("id").alias(id_column), "source", "size", "source_size", "target", taken)


def take_mix(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", seed: int = 7
) -> DataFrame:
    """The rows of the mix: documents not taken are gone, those taken twice stand twice.

    Of rows that are equal in all columns, some may be taken once more than
    others; which of them does not show.
    """
    names, mark = [F.col(f"`{c}`") for c in docs.columns], "mix"
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark = f"_{mark}"
    here, there, row, times, rest = (f"{mark}_{c}" for c in ("here", "id", "row", "times", "rest"))
    plan = mix_plan(docs, id_column, text_column, source_column, seed)
    units = plan.groupBy(F.col("id").alias(there), F.col("row_hash").alias(row)).agg(
        F.sum("copies").cast("long").alias("copies"), F.count(F.lit(1)).alias("rows")
    )
    units = staged(units.where("copies > 0").select(
        there, row, F.expr("copies div rows").alias(times), F.expr("copies % rows").alias(rest)
    ))
    keyed = docs.withColumn(here, row_hash(docs))
    same = F.equal_null(F.col(f"`{id_column}`"), F.col(there)) & (F.col(here) == F.col(row))
    each = keyed.join(units.where(F.col(times) > 0).drop(rest), same)
    each = each.withColumn(times, F.explode(F.array_repeat(F.lit(0), F.col(times).cast("int")))).select(*names)
    # Units of several rows that the mix takes unequally often; where there are none, their join reads nothing.
    uneven = staged(units.where(F.col(rest) > 0).drop(times))
    one = keyed.join(uneven, same).dropDuplicates([id_column, here])
    return each.unionByName(repeated(staged(one), rest, [here], times).select(*names))
