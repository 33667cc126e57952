"""Quality rules with cross-document line frequency.

Lines are normalised and hashed. For each host the number of distinct documents
that hold a line is counted; lines in more of them than the limits allow are
boilerplate. A document that has lost too much to them is rejected.

Copies with one text are one document to this count: a text that many rows
repeat is a matter for deduplication and must not make its own lines boilerplate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from rowlens.llm.common import broadcast_if_small, staged, text_blocks
from rowlens.llm.words import IS_SPACE, LOWER, keyed_hashes, mixed, raw_bytes, running, spans, window_hashes, words_of
from rowlens.llm.words import whole_windows

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
# A line is boilerplate in a host if more documents of it than both limits hold it.
MIN_DOCUMENTS = 20
MAX_DOCUMENT_PERCENT = 10
# A document is depleted if less than this share of its words, or fewer words, stay.
MIN_KEPT_PERCENT = 50
MIN_KEPT_WORDS = 25

_BLANKS = "\t\n\x0b\x0c\r "
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_DIGIT = np.arange(256, dtype=np.uint8)
_DIGIT[48:58] = 48

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between each two neighbouring bounds."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _seen_before(group: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether an earlier row has the same group and key."""
    order = np.lexsort((np.arange(len(key)), key, group))
    same = np.zeros(len(key), bool)
    if len(key) > 1:
        g, k = group[order], key[order]
        same[order[1:]] = (g[1:] == g[:-1]) & (k[1:] == k[:-1])
    return same


def block_stats(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Counts of each text of a block, and per line with a word: text, hash when normalised, words."""
    w = words_of(texts)
    n, bounds = len(texts), w.offsets
    inside = ~IS_SPACE[w.data]
    characters = _sums(inside & ((w.data & 0xC0) != 0x80), bounds)
    symbols = _sums(_SYMBOL[w.data], bounds)
    hashes = w.hashes()

    repeated = np.zeros(len(hashes), bool)
    if len(hashes) >= 3:
        whole = np.flatnonzero(whole_windows(w.first, 3))
        grams, text = window_hashes(hashes, 3)[whole], w.text[whole]
        later = _seen_before(text, grams)
        again = later | _seen_before(text[::-1], grams[::-1])[::-1]
        for k in range(3):
            repeated[whole[again] + k] = True
    repeats = _sums(repeated, w.first)

    starts, ends, first = spans(w.data, bounds, w.data == 10)
    line_text = np.repeat(np.arange(n), np.diff(first))
    word_from, word_to = np.searchsorted(w.starts, starts), np.searchsorted(w.starts, ends)
    worded = word_to > word_from
    starts, ends, line_text = starts[worded], ends[worded], line_text[worded]
    word_from, word_to = word_from[worded], word_to[worded]
    dup = _seen_before(line_text, keyed_hashes(w.data, starts, ends))
    dups = np.bincount(line_text[dup], minlength=n).astype(np.int64)

    # Normalised: A-Z lower, digits alike, blanks between words alike.
    plain = keyed_hashes(_DIGIT[LOWER[w.data]], w.starts, w.ends)
    sizes = word_to - word_from
    line_hash = np.zeros(len(starts), np.uint64)
    if len(starts):
        at = running(sizes).astype(np.uint64)
        rows = np.repeat(word_from, sizes) + running(sizes)
        parts = mixed(plain[rows] + at * np.uint64(0x9E3779B97F4A7C15))
        line_hash = mixed(np.add.reduceat(parts, np.cumsum(sizes) - sizes) ^ sizes.astype(np.uint64))
    counts = [w.counts.astype(np.int64), characters, symbols, dups, repeats]
    return counts, line_text, line_hash, sizes.astype(np.int32)


def _names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that ``df`` lacks."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name in taken:
            name = f"_{name}"
        out.append(name)
    return out


def measured(docs: DataFrame, id_column: str, text_column: str, host_column: str) -> DataFrame:
    """Per row: id, host, a hash of the text, the counts, and its lines as hash and words."""
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(
        F.col(f"`{id_column}`").alias("id"),
        F.coalesce(F.col(f"`{host_column}`").cast("string"), F.lit("")).alias("host"),
        F.xxhash64(F.col(f"`{text_column}`")).alias("text_hash"),
        F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text"),
    )

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            counts, line_text, line_hash, line_words = block_stats(block.column("text"))
            bounds = np.searchsorted(line_text, np.arange(len(block) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    *block.columns[:3],
                    *map(pa.array, counts),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(line_hash.view(np.int64))),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(line_words)),
                ],
                ["id", "host", "text_hash", *(c.split()[0] for c in STATS.split(", ")), "lines", "line_words"],
            )

    return rows.mapInArrow(
        measure, f"id {kind}, host string, text_hash long, {STATS}, lines array<long>, line_words array<int>"
    )


def boilerplate_lines(measures: DataFrame) -> DataFrame:
    """``host, line`` of the lines above the limits."""
    held = measures.select("host", "text_hash", F.explode("lines").alias("line")).distinct()
    counts = held.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    hosts = staged(
        measures.select("host", "text_hash").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("documents"))
    )
    common = counts.where(F.col("n") > MIN_DOCUMENTS).join(hosts, "host")
    return common.where(F.col("n") * 100 > F.col("documents") * MAX_DOCUMENT_PERCENT).select("host", "line")


def lost_words(measures: DataFrame, lines: DataFrame) -> DataFrame:
    """``host, text_hash, n_removed_words`` of the texts that hold such lines, one row each."""
    each = measures.groupBy("host", "text_hash").agg(F.first(F.struct("lines", "line_words")).alias("l"))
    held = each.select("host", "text_hash", F.explode(F.arrays_zip("l.lines", "l.line_words")).alias("z"))
    held = held.select("host", "text_hash", F.col("z.lines").alias("line"), F.col("z.line_words").alias("words"))
    return (
        held.join(lines, ["host", "line"])
        .groupBy("host", "text_hash")
        .agg(F.sum("words").cast("long").alias("n_removed_words"))
    )


def base_failed():
    short = F.col("n_words") < MIN_WORDS
    return short | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def depleted():
    kept = F.col("n_words") - F.col("n_removed_words")
    return (F.col("n_removed_words") > 0) & (
        (kept * 100 < F.col("n_words") * MIN_KEPT_PERCENT) | (kept < MIN_KEPT_WORDS)
    )


def quality(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source"
) -> DataFrame:
    """One row per document: the counts, ``n_removed_words, base_failed, kept``.

    A null text has no words and fails; a null host is a host of its own
    (the empty name). Rows that repeat an id are judged each by itself.
    """
    measures = staged(measured(docs, id_column, text_column, host_column))
    lost = lost_words(measures, staged(boilerplate_lines(measures)))
    joined = measures.drop("lines", "line_words").join(staged(lost), ["host", "text_hash"], "left")
    judged = joined.withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0).cast("long")))
    judged = judged.withColumn("base_failed", base_failed())
    judged = judged.withColumn("kept", ~F.col("base_failed") & ~depleted())
    return judged.drop("host", "text_hash").withColumnRenamed("id", id_column)


def without_lines(texts: pa.Array, gone: pa.Array) -> pa.Array:
    """The texts without the lines whose normalised hash is in the list of each; a text without such lines as it is."""
    some = pc.fill_null(pc.greater(pc.list_value_length(gone), 0), False).to_numpy(zero_copy_only=False)
    if not some.any():
        return texts
    rows = np.flatnonzero(some)
    _, line_text, line_hash, _ = block_stats(texts.take(pa.array(rows)))
    bounds = np.searchsorted(line_text, np.arange(len(rows) + 1))
    out = texts.to_pylist()
    for k, i in enumerate(rows.tolist()):
        lost = set(gone[i].as_py())
        hashes = iter(line_hash[bounds[k] : bounds[k + 1]].view(np.int64).tolist())
        # Lines without a word have no hash and stay.
        lines = out[i].split("\n")
        out[i] = "\n".join(x for x in lines if not x.strip(_BLANKS) or next(hashes) not in lost)
    return pa.array(out, texts.type)


def keep_quality(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    host_column: str = "source",
    size_column: str = "n_chars",
) -> DataFrame:
    """The documents that :func:`quality` keeps, without their boilerplate lines.

    A text that loses a line gets a new ``size_column``, its number of
    characters, if there is such a column; all else is as it was.
    """
    measures = staged(measured(docs, id_column, text_column, host_column))
    common = staged(boilerplate_lines(measures))
    each = measures.groupBy("host", "text_hash").agg(
        *[F.first(c).alias(c) for c in ("n_words", "n_repeat_words", "lines", "line_words")]
    )
    held = each.select("host", "text_hash", F.explode(F.arrays_zip("lines", "line_words")).alias("z"))
    held = held.select("host", "text_hash", F.col("z.lines").alias("line"), F.col("z.line_words").alias("words"))
    lost = held.join(common, ["host", "line"]).groupBy("host", "text_hash")
    lost = lost.agg(F.sum("words").cast("long").alias("n_removed_words"), F.collect_set("line").alias("gone"))
    judged = each.drop("lines", "line_words").join(staged(lost), ["host", "text_hash"], "left")
    judged = judged.withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0).cast("long")))
    failed = base_failed() | depleted()
    judged = staged(judged.where(failed | F.col("gone").isNotNull()).select("host", "text_hash", "gone", failed.alias("failed")))
    host, text, gone, bad = _names(docs, "host", "text_hash", "gone", "failed")
    keyed = docs.withColumns(
        {
            host: F.coalesce(F.col(f"`{host_column}`").cast("string"), F.lit("")),
            text: F.xxhash64(F.col(f"`{text_column}`")),
        }
    )
    # Only texts that fail or lose lines are listed; while they are few, no text is shuffled.
    size = F.octet_length("host") + F.coalesce(8 * F.size("gone"), F.lit(0)) + 48
    judged = broadcast_if_small(judged, size).toDF(host, text, gone, bad)
    kept = keyed.join(judged, [host, text], "left").where(~F.coalesce(F.col(bad), F.lit(False)))
    kept = kept.select(*[F.col(f"`{c}`") for c in (*docs.columns, gone)])
    names = list(docs.columns)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, text_column):
            *columns, lost = block.columns
            at = names.index(text_column)
            columns[at] = without_lines(columns[at], lost)
            if size_column in names:
                n = names.index(size_column)
                sizes = pc.utf8_length(columns[at]).cast(columns[n].type)
                columns[n] = pc.if_else(pc.fill_null(pc.greater(pc.list_value_length(lost), 0), False), sizes, columns[n])
            yield pa.RecordBatch.from_arrays(columns, names)

    return kept.mapInArrow(clean, docs.schema)
