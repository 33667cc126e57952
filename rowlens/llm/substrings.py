"""Substring deduplication over prefix-partitioned suffix trees.

The alphabet is words. The tree of all suffixes is never built whole: suffixes
are split by a prefix of variable length into groups, and a group's suffixes in
sorted order are the leaves of its subtree. Only the top of the tree matters
down to ``WINDOW`` words: an inner node that deep, with leaves of two documents,
is a repeat. Its smallest document keeps the words; every other leaf marks its
window for removal, and neighbouring windows join into maximal repeats.

Three steps keep the groups small:

1. Subtrees that hold one document only are pruned before they are built. Of the
   ``ANCHOR``-word strings of any window the one with the smallest hash is its
   anchor; equal windows have equal anchors, so a window whose anchor no other
   document has lies in such a subtree. About one string in five is an anchor.
2. What is left is grouped by prefix: ``PREFIX`` words, or the whole window where
   more suffixes than a group may hold begin with those.
3. Leaves that one block of documents repeats are settled where they are read;
   one leaf per block and node is sent to the group. So a passage that a third
   of all documents share sends one row per block, not one per document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from rowlens.llm.common import staged, text_blocks
from rowlens.llm.words import mixed, whole_windows, window_hashes, words_of

WINDOW = 13
ANCHOR = 5
PREFIX = 4
GROUP_SUFFIXES = 200_000
# Text bytes whose leaves are settled together; long texts are blocks of their own.
BLOCK = 2 << 20
# A null id stands for the largest document.
NO_ID = (1 << 63) - 1


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def _minima(grams: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    out, span = grams, 1
    while span < width:
        step = min(span, width - span)
        out = np.minimum(out[: len(out) - step], out[step:])
        span += step
    return out


def windows_of(texts: pa.Array):
    """Windows of a block: text of each, prefix hash, hash of the rest, anchor."""
    w = words_of(texts)
    whole = np.flatnonzero(whole_windows(w.first, WINDOW))
    none = np.zeros(0, np.uint64)
    if not len(whole):
        return w, whole, none, none, none
    hashes = w.hashes()
    prefix = window_hashes(hashes, PREFIX)[whole]
    rest = window_hashes(hashes, WINDOW - PREFIX)[whole + PREFIX]
    anchor = _minima(window_hashes(hashes, ANCHOR), WINDOW - ANCHOR + 1)[whole]
    return w, whole, prefix, rest, anchor


def _settled(doc: np.ndarray, *key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, doc) in order: their rows, the node each is under, whether a smaller doc is under it."""
    order = np.lexsort((doc, *key))
    new_key = np.ones(len(order), bool)
    new = np.ones(len(order), bool)
    if len(order) > 1:
        new_key[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in key])
        new[1:] = new_key[1:] | (doc[order[1:]] != doc[order[:-1]])
    node = np.cumsum(new_key) - 1
    rows, node, head = order[new], node[new], new_key[new]
    return rows, node, ~head


_ROUTED = "key long, sub long, doc long, known boolean"


def _routed(key: np.ndarray, sub: np.ndarray, doc: np.ndarray, known: np.ndarray, spread: np.ndarray) -> pa.RecordBatch:
    """Rows for the groups; settled ones only travel along, spread evenly."""
    key = np.where(spread, mixed(key + doc.astype(np.uint64)), key)
    return pa.RecordBatch.from_arrays(
        [pa.array(key.view(np.int64)), pa.array(sub.view(np.int64)), pa.array(doc), pa.array(known)],
        ["key", "sub", "doc", "known"],
    )


def anchor_leaves(docs: DataFrame) -> DataFrame:
    """Distinct anchors of each document; ``known`` where a document of the same block has it too."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, limit=BLOCK):
            w, whole, _, _, anchor = windows_of(block.column("text"))
            if not len(whole):
                continue
            # Neighbouring windows mostly share their anchor.
            change = np.ones(len(whole), bool)
            change[1:] = (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1] + 1)
            ids = _ids(block.column("id"))[w.text[whole[change]]]
            anchor = anchor[change]
            rows, node, later = _settled(ids, anchor)
            shared = np.bincount(node)[node] > 1
            anchor, ids = anchor[rows], ids[rows]
            yield _routed(anchor, anchor, ids, shared, later)

    return docs.mapInArrow(each, _ROUTED)


def _runs(batches: Iterator[pa.RecordBatch], pick) -> Iterator[pa.RecordBatch]:
    """``doc, sub`` of the rows that ``pick`` chooses in each run of (key, sub), sorted by doc.

    A run is never held whole: what goes on from one batch to the next is its
    first document and, while no second one has come, its one row.
    """
    last = None  # key, sub, first doc, whether its row still waits
    for batch in batches:
        if not batch.num_rows:
            continue
        key, sub, doc = (batch.column(c).to_numpy() for c in ("key", "sub", "doc"))
        known = batch.column("known").to_numpy(zero_copy_only=False)
        if last is not None:
            key, sub, doc = (np.insert(a, 0, v) for a, v in zip((key, sub, doc), last))
            known = np.insert(known, 0, last[3])
        head = np.ones(len(key), bool)
        head[1:] = (key[1:] != key[:-1]) | (sub[1:] != sub[:-1])
        run = np.cumsum(head) - 1
        chosen, state = pick(doc, known, np.flatnonzero(head), run)
        if last is not None and last[4]:
            chosen[0] = False  # it has been given out
        tail = int(np.flatnonzero(head)[-1])
        last = (key[tail], sub[tail], doc[tail], state, bool(chosen[tail]) or bool(last and tail == 0 and last[4]))
        if chosen.any():
            yield pa.RecordBatch.from_arrays([pa.array(doc[chosen]), pa.array(sub[chosen])], ["doc", "h"])


def shared_rows(doc, known, heads, run):
    """Rows of runs with a second document."""
    some = np.zeros(len(heads), bool)
    np.logical_or.at(some, run, known | (doc != doc[heads][run]))
    return some[run], bool(some[-1])


def later_rows(doc, known, heads, run):
    """Rows whose run has a smaller document."""
    return known | (doc != doc[heads][run]), False


def shared_anchors(docs: DataFrame) -> DataFrame:
    """``doc, hs``: the anchors of each document that another document has."""
    leaves = anchor_leaves(docs).repartition("key").sortWithinPartitions("key", "sub", "doc")
    found = leaves.mapInArrow(lambda it: _runs(it, shared_rows), "doc long, h long")
    return found.groupBy("doc").agg(F.collect_set("h").alias("hs"))


def suffix_leaves(texts: DataFrame, text_column: str) -> DataFrame:
    """Suffixes under shared anchors: prefix as ``key``, rest as ``sub``; ``known`` where a smaller document of the block has it."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, text_column, BLOCK):
            w, whole, prefix, rest, anchor = windows_of(block.column(text_column))
            if not len(whole):
                continue
            hit = _listed(block.column("hs"), w.text[whole], anchor)
            prefix, rest = prefix[hit], rest[hit]
            ids = _ids(block.column("doc"))[w.text[whole[hit]]]
            rows, _, later = _settled(ids, rest, prefix)
            prefix, rest, ids = prefix[rows], rest[rows], ids[rows]
            yield _routed(prefix, mixed(prefix) ^ rest, ids, later, later)

    return texts.mapInArrow(each, _ROUTED)


def _listed(lists: pa.Array, text: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Whether each value is in the list of its text."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes).astype(np.uint64)
    salt = np.uint64(0x9E3779B97F4A7C15)
    # One sorted table of (text, value); both are checked.
    keys = mixed(owner * salt) ^ flat
    order = np.argsort(keys)
    keys, owner, flat = keys[order], owner[order], flat[order]
    wanted = mixed(text.astype(np.uint64) * salt) ^ value
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    if not len(keys):
        return np.zeros(len(value), bool)
    return (keys[at] == wanted) & (owner[at] == text.astype(np.uint64)) & (flat[at] == value)


def split_groups(batches: Iterator[pa.RecordBatch], long_prefix: bool) -> Iterator[pa.RecordBatch]:
    """The suffixes of each prefix up to the size of a group, or else those beyond it.

    They come sorted, so what is beyond begins at some window; where that
    window's leaves are cut in two, its smallest document is in both parts.
    """
    last, before, head = None, 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, sub = batch.column("key").to_numpy(), batch.column("sub").to_numpy()
        starts = np.flatnonzero(np.concatenate([[key[0] != last], key[1:] != key[:-1]]))
        at = np.arange(len(key))
        rank = at + before
        if len(starts):
            run = np.searchsorted(starts, at, side="right") - 1
            rank = np.where(run >= 0, at - starts[np.maximum(run, 0)], rank)
        beyond = rank >= GROUP_SUFFIXES
        if long_prefix:
            for cut in np.flatnonzero(rank == GROUP_SUFFIXES):
                i = int(cut)
                while i > 0 and key[i - 1] == key[cut] and sub[i - 1] == sub[cut]:
                    i -= 1
                same = i == 0 and head is not None and head.column("key")[0].as_py() == key[cut]
                if same and head.column("sub")[0].as_py() == sub[cut]:
                    yield head
                elif i < cut:
                    yield batch.slice(i, 1)
        out = batch.filter(pa.array(beyond if long_prefix else ~beyond))
        if out.num_rows:
            yield out
        i = len(key) - 1
        same_run = np.flatnonzero((key == key[i]) & (sub == sub[i]))[0]
        if not (same_run == 0 and head is not None and last == key[0] and head.column("sub")[0].as_py() == sub[0]):
            head = batch.slice(int(same_run), 1)
        last, before = key[-1], int(rank[-1]) + 1


def repeated_windows(leaves: DataFrame) -> DataFrame:
    """``doc, hs``: the windows of each document that start in a smaller document too.

    A group is the suffixes that begin with the same ``PREFIX`` words. What a
    group has beyond its size goes on to groups of the longest prefix, the window.
    """
    groups = leaves.repartition("key").sortWithinPartitions("key", "sub", "doc")
    small = groups.mapInArrow(lambda it: _runs(split_groups(it, False), later_rows), "doc long, h long")
    beyond = groups.mapInArrow(lambda it: split_groups(it, True), _ROUTED)
    beyond = beyond.repartition("key", "sub").sortWithinPartitions("key", "sub", "doc")
    large = beyond.mapInArrow(lambda it: _runs(it, later_rows), "doc long, h long")
    return small.unionByName(large).groupBy("doc").agg(F.collect_set("h").alias("hs"))


_RESULT = "n_words long, n_removed long, kept_text string, kept_sha256 string"


def remove_windows(joined: DataFrame, others: str, names: list[str], text_column: str) -> DataFrame:
    """Take the listed windows' words out of each text; ``names`` are carried along."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, text_column):
            w, whole, prefix, rest, _ = windows_of(block.column(text_column))
            gone = np.zeros(len(w.starts), bool)
            if len(whole):
                hit = whole[_listed(block.column("hs"), w.text[whole], mixed(prefix) ^ rest)]
                depth = np.zeros(len(gone) + 1, np.int64)
                np.add.at(depth, hit, 1)
                np.subtract.at(depth, hit + WINDOW, 1)
                gone = np.cumsum(depth[:-1]) > 0
            removed = np.add.reduceat(np.append(gone, False), np.minimum(w.first[:-1], len(gone)), dtype=np.int64)
            removed[w.counts == 0] = 0
            texts, data = [], w.data.tobytes()
            for i in range(len(block)):
                a, b = w.first[i], w.first[i + 1]
                whole_text = data[w.offsets[i] : w.offsets[i + 1]]
                if not removed[i]:
                    texts.append(b" ".join(whole_text.split()))
                else:
                    keep = a + np.flatnonzero(~gone[a:b])
                    spans = zip(w.starts[keep].tolist(), w.ends[keep].tolist())
                    texts.append(b" ".join([data[s:e] for s, e in spans]))
            yield pa.RecordBatch.from_arrays(
                [
                    *[block.column(c) for c in names],
                    pa.array(w.counts.astype(np.int64)),
                    pa.array(removed),
                    pa.array(texts, pa.binary()).cast(pa.string()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                ],
                [*names, "n_words", "n_removed", "kept_text", "kept_sha256"],
            )

    return joined.mapInArrow(each, f"{others}, {_RESULT}")


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every column of ``docs`` as ``c0, c1, ...``, then ``n_words, n_removed, kept_text, kept_sha256``.

    A null text has no words. Windows of rows with one id never remove each
    other. A null id counts as larger than every other. Texts of fewer than 13
    words lose nothing. The text side of both joins is one and the same
    shuffle by id.
    """
    fields = [f"c{i} {k}" for i, (_, k) in enumerate(docs.dtypes)]
    names = [f"c{i}" for i in range(len(fields))]
    plain = docs.toDF(*names)
    id_name, text = names[docs.columns.index(id_column)], names[docs.columns.index(text_column)]
    doc = F.coalesce(F.col(id_name).cast("long"), F.lit(NO_ID))
    rows = plain.select("*", doc.alias("doc"))

    read = rows.select(F.col("doc").alias("id"), F.col(text).alias("text"))
    shared = staged(shared_anchors(read))
    # Both joins read all columns of `rows`, so that its shuffle by id is made once and read twice.
    leaves = suffix_leaves(rows.join(shared, "doc"), text)
    return remove_windows(rows.join(repeated_windows(leaves), "doc", "left"), ", ".join(fields), names, text)


def substring_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: id, ``n_words, n_removed, kept_text, kept_sha256``; see :func:`remove_repeats`."""
    out = remove_repeats(docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").alias("text")))
    return out.drop("c1").withColumnRenamed("c0", id_column)


def keep_unrepeated(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length_column: str = "n_chars"
) -> DataFrame:
    """The documents with their remaining text and its length; those of which nothing remains are gone."""
    out = remove_repeats(docs, id_column, text_column).where("n_words = 0 or n_removed < n_words")
    changed = F.col("n_removed") > 0
    columns = []
    for i, name in enumerate(docs.columns):
        c = F.col(f"c{i}")
        if name == text_column:
            c = F.when(changed, F.col("kept_text")).otherwise(c)
        elif name == length_column:
            c = F.when(changed, F.length("kept_text").cast(docs.schema[name].dataType)).otherwise(c)
        columns.append(c.alias(name))
    return out.select(*columns)
