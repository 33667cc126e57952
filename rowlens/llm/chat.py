"""Chat formatting by columnar byte assembly.

A turn becomes ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts
``<|`` is written with a backslash between the two characters (and one more
where backslashes already stand there), so no content can open or close a turn
and the escape can be undone. All turns of an Arrow batch are laid into one
preallocated buffer: segment lengths give offsets, offsets give the places that
headers and contents are scattered to.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from rowlens.llm.common import text_blocks
from rowlens.llm.words import raw_bytes, running

START, MIDDLE, END = b"<|im_start|>", b"\n", b"<|im_end|>\n"
TRAINED_ROLE = "assistant"
_ESCAPED = regex.compile(r"<\\(\\*)\|")
_TURN = regex.compile(r"<\|im_start\|>(.*)\n((?:(?!<\|im_end\|>)[\s\S])*+)<\|im_end\|>\n")


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, r"<(\\*)\|", r"<\\\1|")


def escape_role(roles: pa.Array) -> pa.Array:
    """As a text; a line break, which ends the role, becomes ``\\n``."""
    roles = pc.replace_substring(pc.replace_substring(roles, "\\", "\\\\"), "\n", "\\n")
    return escape(roles)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def unescape_role(role: str) -> str:
    return regex.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def _scatter(out: np.ndarray, data: np.ndarray, sizes: np.ndarray, to: np.ndarray) -> None:
    """Copy consecutive runs of ``data`` to the given places of ``out``."""
    out[np.repeat(to, sizes) + running(sizes)] = data


def assemble(roles: pa.Array, texts: pa.Array, first: np.ndarray):
    """Formatted rows that begin at the turns ``first``, and each turn's content in bytes of its row."""
    roles, role_at = raw_bytes(escape_role(roles))
    texts, text_at = raw_bytes(escape(texts))
    turns = len(role_at) - 1
    role_size, text_size = np.diff(role_at), np.diff(text_at)
    fixed = [np.frombuffer(x, np.uint8) for x in (START, MIDDLE, END)]
    sizes = np.stack(
        [np.full(turns, len(START)), role_size, np.full(turns, len(MIDDLE)), text_size, np.full(turns, len(END))], axis=1
    )
    at = np.concatenate([[0], np.cumsum(sizes.ravel())])
    places = at[:-1].reshape(turns, 5)
    out = np.empty(int(at[-1]), np.uint8)
    for column, piece in zip((0, 2, 4), fixed):
        out[places[:, column, None] + np.arange(len(piece))] = piece
    _scatter(out, roles, role_size, places[:, 1])
    _scatter(out, texts, text_size, places[:, 3])
    bounds = np.append(places[first, 0], at[-1])
    rows = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out))
    row = np.repeat(np.arange(len(first)), np.diff(np.append(first, turns)))
    begin = places[:, 3] - bounds[row]
    return rows, begin, begin + text_size


def format_conversations(turns: DataFrame) -> DataFrame:
    """Formatted stretches of conversations: ``conv_id, part, formatted, loss``.

    ``loss`` lists the spans of bytes, begin and end in turn, that a model is
    trained on. Turns are range-sorted by conversation and turn, so a long
    conversation is formatted by several tasks and comes as several stretches,
    numbered by ``part`` in order. Null roles and texts are empty, null turns come
    first, turns that tie are ordered by role and text. Other columns are not read.
    """
    empty = F.lit("")
    rows = turns.select(
        F.col("conv_id"),
        F.col("turn"),
        F.coalesce(F.col("role").cast("string"), empty).alias("role"),
        F.coalesce(F.col("text").cast("string"), empty).alias("text"),
    )
    # The start of a text bounds what is sampled and orders as the text does.
    start = F.substring("text", 1, 32)
    ordered = rows.repartitionByRange("conv_id", "turn", "role", start)
    ordered = ordered.sortWithinPartitions("conv_id", "turn", "role", "text")
    ordered = ordered.withColumn("part", F.monotonically_increasing_id())
    kind = turns.schema["conv_id"].dataType.simpleString()

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            ids, parts = block.column("conv_id"), block.column("part")
            codes = pc.fill_null(ids.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
            formatted, begin, end = assemble(block.column("role"), block.column("text"), first)
            trained = pc.equal(block.column("role"), TRAINED_ROLE).to_numpy(zero_copy_only=False)
            spans = np.stack([begin, end], axis=1)[trained].ravel()
            counts = np.add.reduceat(2 * trained.astype(np.int64), first)
            at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            take = pa.array(first)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(take),
                    parts.take(take),
                    formatted.cast(pa.string()),
                    pa.ListArray.from_arrays(pa.array(at), pa.array(spans.astype(np.int64))),
                ],
                ["conv_id", "part", "formatted", "loss"],
            )

    return ordered.mapInArrow(lay_out, f"conv_id {kind}, part long, formatted string, loss array<long>")


class _Digest:
    """What is read back from one conversation, stretch by stretch."""

    def __init__(self):
        self.turns = self.characters = self.loss_characters = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, loss: list[int]) -> None:
        data = formatted.encode()
        self.characters += len(formatted)
        for m in _TURN.finditer(formatted):
            self.turns += 1
            self.all.update(f"{unescape_role(m[1])}\n{unescape(m[2])}\n".encode())
        for a, b in zip(loss[::2], loss[1::2]):
            text = unescape(data[a:b].decode())
            self.loss_characters += len(text)
            self.loss.update(text.encode())

    def row(self) -> tuple:
        return self.turns, self.all.hexdigest(), self.loss_characters, self.loss.hexdigest(), self.characters


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, parsed from the formatted stretches alone.

    ``n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``. A digest
    has to see a conversation in order, so its stretches (few rows) pass through
    one task as a stream; none is held.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, key, begun = _Digest(), None, False
        id_type = None

        def out(keys: list, rows: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            return pa.RecordBatch.from_arrays([pa.array(keys, id_type), *columns], ["conv_id", *names])

        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            keys, rows = [], []
            for conv_id, text, loss in zip(
                batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist(), batch.column("loss").to_pylist()
            ):
                if begun and conv_id != key:
                    keys.append(key)
                    rows.append(now.row())
                    now = _Digest()
                key, begun = conv_id, True
                now.add(text, loss)
            if keys:
                yield out(keys, rows)
        if begun:
            yield out([key], [now.row()])

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return ordered.mapInArrow(
        parse,
        f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
