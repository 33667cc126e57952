"""A static range asymmetric numeral system over token ids, in numpy.

One table of frequencies, which add up to a power of two, serves all blocks. A
block holds its ids in ``LANES`` interleaved states of 64 bits: id ``i`` belongs
to lane ``i % LANES``. States that grow too large spill words of 32 bits. At every
``STEPS`` ids of a lane the block keeps a checkpoint: the states, the place in the
words, and the CRC-32 of the ids up to the next one. A decoder may begin at
any checkpoint, so the segments of a block are decoded side by side, or only
those that are wanted. The last four bytes are the CRC-32 of the block itself.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

LANES, STEPS, SEGMENTS = 128, 256, 8
SEGMENT_IDS = LANES * STEPS
BLOCK_IDS = SEGMENT_IDS * SEGMENTS
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
MAX_BITS = 24
_MAGIC = b"RNS1"
_HEADER = "<4sBBHHIII"  # magic, bits, 0, lanes, steps, ids, segments, words


@dataclass
class Table:
    """``frequency`` and ``start`` of every id below ``len(frequency)``."""

    frequency: np.ndarray
    start: np.ndarray
    bits: int
    ids: np.ndarray  # the id of each slot

    @classmethod
    def of(cls, frequency: np.ndarray) -> Table:
        frequency = frequency.astype(np.uint64)
        total = int(frequency.sum())
        bits = total.bit_length() - 1
        if total != 1 << bits or bits > MAX_BITS:
            raise ValueError("frequencies must add up to a power of two")
        start = np.cumsum(frequency) - frequency
        return cls(frequency, start, bits, np.repeat(np.arange(len(frequency), dtype=np.uint32), frequency.astype(np.int64)))

    @property
    def filler(self) -> int:
        """The id that costs least."""
        return int(self.frequency.argmax())


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies for counts: a power of two in all, and at least one for every id that occurs."""
    occurring = int((counts > 0).sum())
    if not occurring:
        return np.zeros(len(counts), np.int64)
    bits = min(MAX_BITS, max(12, (16 * occurring).bit_length()))
    if occurring > 1 << bits:
        raise ValueError(f"more than {1 << MAX_BITS} different ids")
    total = 1 << bits
    share = counts.astype(np.float64) * (total / float(counts.sum()))
    out = np.where(counts > 0, np.maximum(1, np.floor(share)), 0).astype(np.int64)
    while (surplus := int(out.sum()) - total) != 0:
        if surplus < 0:
            out[int(out.argmax())] -= surplus
        else:  # taken from all in proportion to what they have above one
            spare = np.maximum(out - 1, 0)
            take = np.floor(spare * (surplus / spare.sum())).astype(np.int64)
            if not take.any():
                take[np.argsort(-spare, kind="stable")[:surplus]] = 1
            out -= np.minimum(take, spare)
    return out


def _encode(ids: np.ndarray, table: Table) -> list[bytes]:
    """Blocks of the same length, ``ids`` as (blocks, steps, lanes), encoded side by side; without their headers."""
    blocks, steps, lanes = ids.shape
    bits, shift = np.uint64(table.bits), np.uint64(63 - table.bits)
    state = np.full((blocks, lanes), LOW, np.uint64)
    words = np.empty((steps, blocks, lanes), np.uint32)
    spilt = np.empty((steps, blocks, lanes), bool)
    marks = []
    for t in range(steps - 1, -1, -1):
        now = ids[:, t, :]
        f = table.frequency[now]
        np.greater_equal(state, f << shift, out=spilt[t])
        words[t] = state.astype(np.uint32)
        state = np.where(spilt[t], state >> WORD, state)
        q = state // f
        state = (q << bits) + (state - q * f) + table.start[now]
        if t % STEPS == 0:
            marks.append(state)
    marks = np.stack(marks[::-1], axis=1)
    out = []
    for b in range(blocks):
        per_step = spilt[:, b].sum(axis=1)
        at = np.concatenate([[0], np.cumsum(per_step)])
        firsts = at[np.arange(0, steps, STEPS)].astype("<u4")
        flat = ids[b].ravel()
        out.append((marks[b], firsts, words[:, b][spilt[:, b]], flat))
    return out


def encode_blocks(ids: np.ndarray, table: Table) -> list[tuple[int, bytes]]:
    """``(number of ids, block)`` for consecutive blocks of at most ``BLOCK_IDS`` ids."""
    whole = len(ids) // BLOCK_IDS * BLOCK_IDS
    parts = []
    if whole:
        shaped = ids[:whole].reshape(-1, STEPS * SEGMENTS, LANES)
        parts += [(BLOCK_IDS, p) for p in _encode(shaped, table)]
    rest = ids[whole:]
    if len(rest):
        steps = -(-len(rest) // LANES)
        filled = np.full(steps * LANES, table.filler, ids.dtype)
        filled[: len(rest)] = rest
        parts += [(len(rest), p) for p in _encode(filled.reshape(1, steps, LANES), table)]
    out = []
    for n, (marks, firsts, words, flat) in parts:
        sums = [zlib.crc32(flat[i : min(i + SEGMENT_IDS, n)].astype("<u4")) for i in range(0, n, SEGMENT_IDS)]
        body = struct.pack(_HEADER, _MAGIC, table.bits, 0, LANES, STEPS, n, len(marks), len(words))
        body += firsts.tobytes() + np.array(sums, "<u4").tobytes() + marks.astype("<u8").tobytes() + words.astype("<u4").tobytes()
        out.append((n, body + struct.pack("<I", zlib.crc32(body))))
    return out


def decode_blocks(blocks: list[bytes], table: Table, segments: list[tuple[int, int]] | None = None) -> list[np.ndarray]:
    """The ids of each block, all segments of all blocks side by side.

    ``segments`` limits each block to its segments from the first to before the second number.
    """
    bits = np.uint64(table.bits)
    mask = np.uint64((1 << table.bits) - 1)
    jobs, words, at = [], [], 0  # block, segment, ids, states, word, checksum
    for b, block in enumerate(blocks):
        magic, own_bits, _, lanes, steps, n, count, n_words = struct.unpack_from(_HEADER, block)
        if magic != _MAGIC or own_bits != table.bits or (lanes, steps) != (LANES, STEPS):
            raise ValueError("not a block of this format and table")
        if zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
            raise ValueError("a block's checksum is wrong")
        where = struct.calcsize(_HEADER)
        firsts = np.frombuffer(block, "<u4", count, where)
        sums = np.frombuffer(block, "<u4", count, where + 4 * count)
        states = np.frombuffer(block, "<u8", count * lanes, where + 8 * count).reshape(count, lanes)
        words.append(np.frombuffer(block, "<u4", n_words, where + 8 * count + 8 * count * lanes))
        low, high = segments[b] if segments else (0, count)
        for s in range(low, min(high, count)):
            jobs.append((b, s, min(SEGMENT_IDS, n - s * SEGMENT_IDS), states[s], at + int(firsts[s]), int(sums[s])))
        at += n_words
    found: list[list[np.ndarray]] = [[] for _ in blocks]
    if not jobs:
        return [np.zeros(0, np.uint32) for _ in blocks]
    # A word more, as lanes that need none look at the next one too.
    words = np.concatenate([*words, np.zeros(1, np.uint32)]).astype(np.uint64)
    order = sorted(range(len(jobs)), key=lambda i: -jobs[i][2])
    need_steps = np.array([-(-jobs[i][2] // LANES) for i in order])
    state = np.stack([jobs[i][3] for i in order]).astype(np.uint64)
    place = np.array([jobs[i][4] for i in order], np.int64)
    out = np.empty((int(need_steps[0]), len(jobs), LANES), np.uint32)
    live = len(jobs)
    for t in range(int(need_steps[0])):
        while need_steps[live - 1] <= t:
            live -= 1
        x = state[:live]
        slot = x & mask
        now = table.ids[slot]
        out[t, :live] = now
        x = table.frequency[now] * (x >> bits) + slot - table.start[now]
        short = x < LOW
        taken = np.cumsum(short, axis=1)
        word = words[np.minimum(place[:live, None] + taken - 1, len(words) - 1)]
        state[:live] = np.where(short, (x << WORD) | word, x)
        place[:live] += taken[:, -1]
    results = {}
    for row, i in enumerate(order):
        b, s, n, _, _, checksum = jobs[i]
        ids = out[: int(need_steps[row]), row].reshape(-1)[:n]
        if zlib.crc32(ids.astype("<u4")) != checksum:
            raise ValueError("a segment's checksum is wrong")
        results[b, s] = ids
    for b, s in sorted(results):
        found[b].append(results[b, s])
    return [np.concatenate(x) if x else np.zeros(0, np.uint32) for x in found]


def _times(a: int, b: int) -> int:
    """Product of two polynomials over two elements, modulo that of CRC-32 (bits reversed)."""
    out = 0
    for i in range(31, -1, -1):
        if a >> i & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def joined_crc(first: int, second: int, second_bytes: int) -> int:
    """CRC-32 of two stretches of bytes from the CRC-32 of each."""
    power, step = 1 << 31, 1 << 23  # x**0 and x**8
    while second_bytes:
        if second_bytes & 1:
            power = _times(power, step)
        step = _times(step, step)
        second_bytes >>= 1
    return _times(power, first) ^ second
