"""Words of a block of texts as numpy arrays: spans, hashes, windows.

A word is a run of bytes other than space and 0x09-0x0D. Where equal hashes stand
for equal words, a word's hash is a multilinear function of its bytes with random
keys, drawn by the driver and sent along with the tasks, so no text
can be made to collide. A window of words is a polynomial over the
hashes of its words, taken from one prefix sum per block, then mixed.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C55  # any odd number
_INVERSE = pow(_BASE, -1, 1 << 64)

# Drawn once per driver. Tasks get the driver's value with the pickled functions that use it.
KEY = int.from_bytes(os.urandom(8), "little")

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_STEP = 1 << 16
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64, up to the ``n``-th."""
    if len(_powers[0]) <= n:
        size = (n // _STEP + 1) * _STEP + 1
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and ``n + 1`` offsets of a column of texts; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(offsets):
        offsets = np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte span, the same in every run; for features, where a collision does no harm."""
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts])


def _keys(n: int, key: int, stream: int) -> np.ndarray:
    """The first ``n`` of a stream of random 64-bit keys."""
    at = np.arange(1, 2 * n + 1, 2, dtype=np.uint64) + np.uint64(stream)
    return mixed(mixed(at * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key)) ^ np.uint64(key))


def keyed_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int = None) -> np.ndarray:
    """Hash of each byte span, none of them empty.

    Chunks of four bytes times a random key each, added up with the length; the
    upper halves of two such sums. Two spans that differ have the same hash with
    probability 2**-64, whatever they are, as long as the key is not known.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    chunks = (sizes + 3) >> 2
    bounds = np.cumsum(chunks) - chunks
    place = np.arange(int(chunks.sum())) - np.repeat(bounds, chunks)
    at = np.repeat(starts, chunks) + 4 * place
    padded = np.concatenate([data, np.zeros(4, np.uint8)])
    value = np.ndarray((len(data) + 1,), "<u4", padded, strides=(1,))[at].astype(np.uint64)
    last = bounds + chunks - 1
    over = (4 * chunks - sizes).astype(np.uint64) * np.uint64(8)
    value[last] &= np.uint64(0xFFFFFFFF) >> over
    keys = [_keys(int(chunks.max()) + 1, KEY if key is None else key, stream) for stream in (0, 1)]
    sums = [np.add.reduceat(value * k[1:][place], bounds) + sizes.astype(np.uint64) * k[0] for k in keys]
    return mixed((sums[0] >> np.uint64(32) << np.uint64(32)) | (sums[1] >> np.uint64(32)))


def spans(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes outside ``gap``, none across texts: starts, ends, and where each text's runs begin."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~gap
    first, last = inside.copy(), inside.copy()
    first[1:] &= gap[:-1]
    last[:-1] &= gap[1:]
    begin, end = offsets[:-1], offsets[1:]
    begin, end = begin[begin < end], end[begin < end]
    first[begin] = inside[begin]
    last[end - 1] = inside[end - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


@dataclass
class Words:
    data: np.ndarray  # bytes of the block
    offsets: np.ndarray  # of the texts
    starts: np.ndarray  # of the words, in bytes
    ends: np.ndarray
    first: np.ndarray  # index of each text's first word; one more at the end

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        return keyed_hashes(LOWER[self.data] if lower else self.data, self.starts, self.ends)


def words_of(texts: pa.Array) -> Words:
    data, offsets = raw_bytes(texts)
    starts, ends, first = spans(data, offsets, IS_SPACE[data])
    return Words(data, offsets, starts, ends, first)


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each ``k`` neighbours; windows across texts are for the caller to leave out."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(len(hashes))
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return mixed((sums[k:] - sums[:n]) * down[:n])


def whole_windows(first: np.ndarray, k: int) -> np.ndarray:
    """Which windows of ``k`` words lie in one text, given each text's first word."""
    total = int(first[-1])
    if total < k:
        return np.zeros(0, bool)
    left = np.repeat(first[1:], np.diff(first)) - np.arange(total)
    return left[: total - k + 1] >= k


def running(lengths: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... for each of the runs of the given lengths."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - lengths, lengths)
