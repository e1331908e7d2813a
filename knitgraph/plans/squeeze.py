"""Integers as few bytes, for columns that Python tasks shuffle or stage."""

from __future__ import annotations

import struct
from functools import cache

import numpy as np
import pyarrow as pa

_HEAD = struct.Struct("<qqBB")  # the smallest value, their number, bytes of each, whether compressed


@cache
def _codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=1)


def squeezed(values: np.ndarray) -> bytes:
    """64-bit integers as offsets from the smallest in as many bytes as the largest needs, byte by byte and compressed."""
    if not len(values):
        return b""
    least = values.min()
    offsets = values.astype(np.int64, copy=False).view(np.uint64) - np.uint64(int(least) & 0xFFFFFFFFFFFFFFFF)
    width = next(w for w in (1, 2, 4, 8) if w == 8 or offsets.max() < 1 << 8 * w)
    plain = np.ascontiguousarray(offsets.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes()
    packed = _codec().compress(plain, asbytes=True)
    head = (int(least), len(values), width)
    return _HEAD.pack(*head, 1) + packed if len(packed) < len(plain) else _HEAD.pack(*head, 0) + plain


def restored(packed) -> np.ndarray:
    """The integers of :func:`squeezed`."""
    if not len(packed):
        return np.zeros(0, np.int64)
    least, count, width, small = _HEAD.unpack_from(packed)
    rest = memoryview(packed)[_HEAD.size :]
    plain = _codec().decompress(pa.py_buffer(rest), count * width) if small else rest
    planes = np.frombuffer(plain, np.uint8).reshape(width, count)
    offsets = np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(-1).astype(np.uint64)
    return (offsets + np.uint64(least & 0xFFFFFFFFFFFFFFFF)).view(np.int64)


def flat(column: pa.Array | pa.ChunkedArray, kind: type = np.int64) -> np.ndarray:
    """The integers of all rows of a column: of lists or squeezed."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    none = [np.zeros(0, kind)]
    if pa.types.is_binary(column.type):
        return np.concatenate(none + [restored(value.as_buffer()) for chunk in chunks for value in chunk]).astype(kind, copy=False)
    return np.concatenate(none + [chunk.flatten().to_numpy(zero_copy_only=False) for chunk in chunks])


def as_bytes(column: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    """The integers that the rows of a binary column hold as they are."""
    parts = [np.zeros(0, kind)]
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        _, ends, data = chunk.buffers()
        if len(chunk) and data is not None:
            ends = np.frombuffer(ends, np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
            parts.append(np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(kind))
    return np.concatenate(parts)


def bytes_of(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column with so many of the values in each row."""
    ends = np.r_[0, np.cumsum(sizes) * values.itemsize].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])
