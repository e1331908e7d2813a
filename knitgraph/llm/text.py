"""Vectorised text helpers that work on the buffers of an Arrow string column.

A word is a run of bytes other than 0x20 and 0x09-0x0D, which are exactly the words
`[^\\x20\\x09-\\x0D]+` of the text. Null texts are treated as empty. Words, windows and lines
are compared by 64-bit hashes: a polynomial over random byte values, mixed at the end. Polynomials modulo 2**64
have equal values on some long words for any base (those of Thue and Morse), so spans of more than `LONG_SPAN` bytes are hashed
by a digest instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes handled at once inside a task; one longer document is handled alone.
SLICE_BYTES = 1 << 20
LONG_SPAN = 255
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BYTE_BASE = 0xD1342543DE82EF95
_WORD_BASE = 0xA0761D6478BD642F


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values whose every bit depends on every input bit."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUES = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _STEP)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept for slices of the usual size only."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= SLICE_BYTES + (1 << 16):
            _powers[base] = have
    return have[:n]


class SpanHash:
    """Hashes of spans [start, end) of a sequence of 64-bit values, from one prefix sum."""

    def __init__(self, values: np.ndarray, base: int) -> None:
        n = len(values)
        self._sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * powers(base, n), out=self._sums[1:])
        self._inverse = powers(pow(base, -1, 1 << 64), n + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[start]) * self._inverse[start])


class Texts:
    """The words of a slice of texts, as flat arrays.

    `data` are the bytes, `offsets[i]:offsets[i+1]` those of text i; `start`, `end` the bytes
    of each word and `word_offsets[i]:word_offsets[i+1]` the words of text i.
    """

    def __init__(self, column: pa.Array) -> None:
        self.data, self.offsets = buffers(column)
        self.n = len(self.offsets) - 1
        inside = ~_SPACE[self.data]
        self.inside = inside
        before = np.zeros(len(inside), dtype=bool)
        before[1:] = inside[:-1]
        cuts = self.offsets[self.offsets < len(inside)]
        before[cuts] = False
        after = np.zeros(len(inside), dtype=bool)
        after[:-1] = inside[1:]
        after[cuts[cuts > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.word_offsets = np.searchsorted(self.start, self.offsets)
        self.n_words = np.diff(self.word_offsets)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.n_words)

    def byte_hash(self, data: np.ndarray | None = None) -> SpanHash:
        return SpanHash(_BYTE_VALUES[self.data if data is None else data], _BYTE_BASE)

    def word_hashes(self, lower: bool = False) -> np.ndarray:
        return self.span_hashes(self.start, self.end, lower)

    def span_hashes(self, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
        """Hashes of byte spans: equal for equal bytes, whatever their length and place."""
        data = _LOWER[self.data] if lower else self.data
        out = self.byte_hash(data)(start, end)
        for at in np.flatnonzero(end - start > LONG_SPAN).tolist():
            digest = hashlib.blake2b(data[start[at] : end[at]], digest_size=8).digest()
            out[at] = int.from_bytes(digest, "little")
        return out

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows of `width` words, and how many each text has."""
        counts = np.maximum(self.n_words - width + 1, 0)
        return ranges(self.word_offsets[:-1], counts), counts


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The concatenation of start .. start+count-1 over all pairs."""
    total = int(counts.sum())
    shift = starts - (np.cumsum(counts) - counts)
    return np.arange(total) + np.repeat(shift, counts)


def word_window_hashes(words: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """Hash of `width` consecutive word hashes from each place in `first`."""
    out = np.zeros(len(first), dtype=np.uint64)
    for step in range(width):
        out = out * np.uint64(_WORD_BASE) + words[first + step]
    return mix(out)


def _table(members: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(members)] = True
    return out


_SPACE = _table(b"\x20\x09\x0a\x0b\x0c\x0d")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
table = _table


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z made lower case; all other bytes unchanged."""
    return _LOWER[data]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, with nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if n == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.zeros(0, dtype=np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a part hold at most `size` bytes, or one row does."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + size, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def binary_rows(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column whose row i holds the bytes of values[offsets[i]:offsets[i+1]]."""
    width = values.dtype.itemsize
    places = pa.py_buffer(np.ascontiguousarray(offsets * width, dtype=np.int64))
    data = pa.py_buffer(np.ascontiguousarray(values))
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, places, data]).cast(pa.binary())
