"""Packing token sequences by cutting-stock column generation.

Every document is tokenised once, where it is read, and cut into whole sequences
and one rest. Only the number of pieces of each length (at most ``width`` numbers,
whatever the input) reaches the driver. There a linear program over packing
patterns is solved by column generation: an exact knapsack over lengths prices
the next pattern. The solution is rounded by diving: whole uses of its patterns are
taken and the program is solved again for the pieces that remain, until no pattern
is used once; only those last pieces are packed first-fit decreasing. The pieces of
a length, ranked over the whole table, are dealt to the places that the patterns
have for that length.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from rowlens.llm.common import staged, text_blocks

WIDTH = 1024
END_ID = 0
# Encoded words kept by one Python worker.
MEMO_WORDS = 250_000
# The linear program ends when its cost is less than half a sequence above its lower
# bound, when no column pays, or after so many steps; then it is rounded as it stands.
MAX_STEPS = 3_000
# Steps between exact updates of a running solution.
REFRESH = 64
COLUMNS_AT_ONCE = 64

# Every character that some definition of white space counts as blank.
_BLANKS = {chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010))}
_BLANKS |= {chr(c) for c in (0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)}

class BlankRun(Exception):
    """A blank beside another blank: such a text is not cut at its spaces."""


def byte_tokenizer(tokenizer_path: str):
    """The vocabulary of a byte-level BPE file in the encoder that is fast on single words.

    Its ids are those of the file; tests hold the two against each other.
    """
    import tiktoken

    with open(tokenizer_path, encoding="utf-8") as f:
        model = json.load(f)
    # Byte-level files write each byte as one printable character: itself, or the next one after U+0100.
    # The bytes that stand for themselves.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = dict(zip(map(chr, plain), plain))
    letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    special = {t["content"] for t in model["added_tokens"]}
    ranks = {
        bytes(letters[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special
    }
    # The pre-tokens of this kind of tokenizer.
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), special


class WordIds(dict):
    """Ids, as little-endian bytes, of a word with the space before it."""

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        fast, self.special = byte_tokenizer(tokenizer_path)
        self.fast = fast.encode_ordinary
        self.marks = {m: self.word(m) for m in ",."}

    def ids(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.ids(text)
        return array("I", self.fast(text)).tobytes()

    def __missing__(self, word: str) -> bytes:
        if not word or word[0] in _BLANKS or word[-1] in _BLANKS:
            raise BlankRun
        if len(self) >= MEMO_WORDS:
            self.clear()
        if word[-1] in ",." and word[-2:-1].isalpha():
            return self[word[:-1]] + self.marks[word[-1]]  # a pre-token of letters ends here
        self[word] = out = self.word(" " + word)
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a whole text.

        A byte-level tokenizer begins a new pre-token at every space between two
        other characters, so the words are encoded one by one and remembered.
        """
        head, *words = text.split(" ")
        try:
            if head and head[-1] in _BLANKS:
                raise BlankRun
            return b"".join([self.word(head), *map(self.__getitem__, words)])
        except BlankRun:
            return self.ids(text)


_PIECES = "{key} {kind}, start long, length long, ids_crc32 long, doc_tokens long, part int, local_rank long"


def cut_pieces(
    docs: DataFrame,
    tokenizer_path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    width: int = WIDTH,
    end_id: int = END_ID,
) -> DataFrame:
    """One row per piece, with its rank among the pieces of its length in its task."""
    kind = docs.schema[id_column].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordIds(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        part, seen = TaskContext.get().partitionId(), [0] * (width + 1)
        for block in text_blocks(batches, "text"):
            rows: list[list] = [[] for _ in range(6)]
            for i, text in enumerate(block.column("text").to_pylist()):
                ids = encoder.encode(text or "") + end
                total = len(ids) // 4
                for start in range(0, total, width):
                    piece = ids[4 * start : 4 * (start + width)]
                    length = len(piece) // 4
                    for column, value in zip(rows, (i, start, length, zlib.crc32(piece), total, seen[length])):
                        column.append(value)
                    seen[length] += 1
            keys = block.column("id").take(pa.array(rows[0], pa.int32()))
            numbers = [pa.array(c, pa.int64()) for c in rows[1:]]
            parts = pa.array(np.full(len(keys), part, np.int32))
            yield pa.RecordBatch.from_arrays(
                [keys, *numbers[:4], parts, numbers[4]],
                ["id", "start", "length", "ids_crc32", "doc_tokens", "part", "local_rank"],
            )

    rows = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"))
    return rows.mapInArrow(cut, _PIECES.format(key="id", kind=kind))


@dataclass
class Pattern:
    """``counts[i]`` pieces of ``lengths[i]`` in each of ``times`` sequences.

    ``origin`` is ``priced`` for a column that the knapsack priced, ``seed`` for one
    of the columns the program began with, and ``rest`` for what rounding left over.
    """

    lengths: list[int]
    counts: list[int]
    times: int
    origin: str = "rest"


def padded(total: np.ndarray | int, width: int = WIDTH):
    """Length of a sequence that holds ``total`` ids: a power of two stays as it is."""
    total = np.asarray(total)
    return np.where((total & (total - 1)) == 0, total, width)


def _first_fit(lengths: np.ndarray, left: np.ndarray, width: int) -> list[tuple[np.ndarray, int]]:
    """First-fit decreasing over a histogram: (pieces of each length, times)."""
    left, found = left.copy(), []
    while left.any():
        column, room = np.zeros(len(lengths), np.int64), width
        while room > 0 and (fits := np.flatnonzero((left > column) & (lengths <= room))).size:
            i = int(fits[-1])
            n = min(int(left[i] - column[i]), room // int(lengths[i]))
            column[i] += n
            room -= n * int(lengths[i])
        used = column > 0
        times = int((left[used] // column[used]).min())
        left -= times * column
        found.append((column, times))
    return found


def _priced_columns(prices: np.ndarray, lengths: np.ndarray, width: int, cost: np.ndarray):
    """Knapsack over lengths: the best patterns for each total, those that pay only, and the best price per cost."""
    best = np.full(width + 1, -np.inf)
    best[0] = 0.0
    last = np.zeros(width + 1, np.int64)
    for room in range(int(lengths[0]), width + 1):
        n = np.searchsorted(lengths, room, side="right")
        values = best[room - lengths[:n]] + prices[:n]
        last[room] = i = int(values.argmax())
        best[room] = values[i]
    ratio = float(np.max(best[1:] / cost[1:]))
    columns = []
    for total in np.argsort(cost[1:] - best[1:], kind="stable")[:COLUMNS_AT_ONCE] + 1:
        if cost[total] - best[total] > -1e-7:
            break
        column, room = np.zeros(len(lengths)), int(total)
        while room > 0:
            column[last[room]] += 1
            room -= int(lengths[last[room]])
        columns.append(column)
    return columns, ratio


def _flat(columns: list[np.ndarray], lengths: np.ndarray, cost: np.ndarray) -> list[np.ndarray]:
    at = [np.flatnonzero(c) for c in columns]
    counts = [c[i] for c, i in zip(columns, at)]
    first = np.concatenate([[0], np.cumsum([len(i) for i in at])[:-1]])
    totals = [int((lengths[i] * n).sum()) for i, n in zip(at, counts)]
    return [np.concatenate(at), np.concatenate(counts), first, cost[totals]]


def _solved(lengths: np.ndarray, amounts: np.ndarray, width: int, cost: np.ndarray):
    """Basis of the linear program over patterns: (columns, uses of each, which of them the knapsack priced).

    Revised simplex. The first basis packs each length by itself; the first-fit
    patterns enter it one after the other, then whatever the knapsack prices.
    """
    demand = amounts.astype(float)
    alone = width // lengths
    basis = np.diag(alone.astype(float))
    inverse = np.diag(1.0 / alone)
    costs = cost[alone * lengths]
    pool = [column.astype(float) for column, _ in _first_fit(lengths, amounts, width)]
    n_seeds, prices, x = len(pool), costs / alone, demand / alone
    # The same columns flat, as they hold few lengths: which, how many, where each begins, cost.
    flat = _flat(pool, lengths, cost)
    basis_priced = np.zeros(len(lengths), bool)
    bound = float(lengths @ demand)  # a sequence is no shorter than what it holds
    for n in range(n_seeds + MAX_STEPS):
        if n % REFRESH == 0 or n == n_seeds:
            x, prices = np.einsum("ij,j->i", inverse, demand), np.einsum("i,ij->j", costs, inverse)
            np.maximum(x, 0, out=x)
        held_lengths, held_counts, first, pool_cost = flat
        reduced = pool_cost - np.add.reduceat(held_counts * prices[held_lengths], first)
        j = n if n < n_seeds else int(np.argmin(reduced))
        if n >= n_seeds and costs @ x <= bound + width / 2:
            break
        if n >= n_seeds and reduced[j] > -1e-7:
            prices = np.einsum("i,ij->j", costs, inverse)
            columns, ratio = _priced_columns(prices, lengths, width, cost)
            bound = max(bound, float(prices @ demand) / max(ratio, 1.0))
            if not columns or costs @ x <= bound + width / 2:
                break
            more = _flat(columns, lengths, cost)
            more[2] += len(held_lengths)
            flat = [np.concatenate(both) for both in zip(flat, more)]
            pool += columns
            continue
        held = np.flatnonzero(pool[j])
        step = np.einsum("ij,j->i", inverse[:, held], pool[j][held])
        out = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        ties = np.flatnonzero(out <= out.min() + 1e-9)
        row = int(ties[np.argmax(step[ties])])  # the largest pivot of equal ones loses the least precision
        basis[:, row], costs[row], basis_priced[row] = pool[j], pool_cost[j], j >= n_seeds
        inverse[row] /= step[row]
        used = out[row]
        x = np.maximum(x - used * step, 0)
        x[row] = used
        step[row] = 0
        touched = np.flatnonzero(np.abs(step) > 1e-12)
        inverse[touched] -= step[touched, None] * inverse[row]
        prices = prices + reduced[j] * inverse[row]
    x = np.einsum("ij,j->i", inverse, demand)
    return basis.astype(np.int64), np.maximum(x, 0), basis_priced


def solve_patterns(counts: dict[int, int], width: int = WIDTH) -> list[Pattern]:
    """Patterns whose places are exactly the given number of pieces of each length.

    Time depends on the number of lengths alone, not on the counts. Of the depths
    of the dive the one with the least padding is kept, the deepest of equal ones;
    depth 0 is first-fit alone, so padding never exceeds that of first-fit.
    """
    counts = {k: n for k, n in sorted(counts.items()) if n > 0}
    lengths = np.array(list(counts), np.int64)
    left = np.array(list(counts.values()), np.int64)
    cost = padded(np.arange(width + 1), width).astype(float)

    def use(column: np.ndarray, times: int, origin: str) -> list[Pattern]:
        at = np.flatnonzero(column)
        held, full, found = column[at], int(column @ lengths), []
        while 2 * full <= width and times > 1:  # two half sequences are one
            if times % 2:
                found.append(Pattern(lengths[at].tolist(), held.tolist(), 1, origin))
            held, full, times = 2 * held, 2 * full, times // 2
        return [*found, Pattern(lengths[at].tolist(), held.tolist(), times, origin)]

    def finished(dive: list[Pattern]) -> list[Pattern]:
        return dive + [p for column, times in _first_fit(lengths, left, width) for p in use(column, times, "rest")]

    dive: list[Pattern] = []
    best = finished(dive)
    while left.any():
        taken, rows = len(dive), np.flatnonzero(left)
        basis, uses, priced = _solved(lengths[rows], left[rows], width, cost)
        for i in np.argsort(-uses, kind="stable"):
            column = np.zeros_like(left)
            column[rows] = basis[:, i]
            at = column > 0
            times = int(min(np.floor(uses[i] + 1e-6), (left[at] // column[at]).min()))
            if times > 0:
                left -= times * column
                dive = dive + use(column, times, "priced" if priced[i] else "seed")
        if len(dive) == taken:
            break
        best = min(finished(dive), best, key=lambda patterns: padding(patterns, width))
    return best


def padding(patterns: list[Pattern], width: int = WIDTH) -> int:
    """Ids of padding in all sequences of these patterns."""
    totals = ((int(np.dot(p.lengths, p.counts)), p.times) for p in patterns)
    return sum((int(padded(total, width)) - total) * times for total, times in totals)


def place_table(patterns: list[Pattern]) -> np.ndarray:
    """Rows (length, first rank, places in a sequence, first sequence, offset), by length and rank."""
    rows, sequence = [], 0
    taken: dict[int, int] = {}
    for p in patterns:
        offset = 0
        for length, n in zip(p.lengths, p.counts):
            rows.append((length, taken.get(length, 0), n, sequence, offset))
            taken[length] = taken.get(length, 0) + n * p.times
            offset += length * n
        sequence += p.times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    width: int = WIDTH,
    end_id: int = END_ID,
) -> DataFrame:
    """Pieces of all documents with their place: ``sequence_id, offset``.

    A null text is empty and still holds its end id. Every row is packed, rows
    that repeat an id or a text included; ids may be null. Other columns are
    not read. An empty table gives no rows.
    """
    pieces = staged(cut_pieces(docs, tokenizer_path, id_column, text_column, width, end_id))
    in_task = staged(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    lengths = in_task.groupBy("length").agg(F.sum("n").alias("n")).collect()  # `width` rows at most
    table = place_table(solve_patterns({r["length"]: r["n"] for r in lengths}, width))

    # One row per task and length, so the window never sees the pieces themselves.
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = in_task.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["part", "length"]).select(
        "id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("local_rank")).alias("rank")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.int64(1) << np.int64(44)
        keys = table[:, 0] * shift + table[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            row = table[np.searchsorted(keys, length * shift + rank, side="right") - 1]
            at = rank - row[:, 1]
            sequence, offset = row[:, 3] + at // row[:, 2], row[:, 4] + at % row[:, 2] * length
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return ranked.mapInArrow(place, schema).withColumnRenamed("id", id_column)
