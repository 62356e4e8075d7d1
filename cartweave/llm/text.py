"""Vectorised tokenising of Arrow string columns.

Texts are handled as one byte buffer with offsets, as Arrow holds them, so splitting into words and hashing them costs a few
numpy passes per chunk and no Python object per word. A chunk is a slice of whole texts of about ``CHUNK`` bytes; a longer text
is a chunk of its own and is still handled whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK = 2_000_000
_POWERS = np.multiply.accumulate(np.full(65536, 0x9E3779B97F4A7C15 | 1, np.uint64))


def table(separators: bytes, lower: bool) -> np.ndarray:
    """For each byte: 0 if it separates words, else its value plus one (of the lower-case letter, for A-Z)."""
    out = np.arange(1, 257, dtype=np.uint64)
    if lower:
        out[65:91] += 32
    out[list(separators)] = 0
    return out


#: Words of anything but white space: as they are, and with A-Z in lower case.
EXACT = table(b"\x20\x09\x0a\x0b\x0c\x0d", lower=False)
FOLDED = table(b"\x20\x09\x0a\x0b\x0c\x0d", lower=True)
#: Words of digits, ASCII letters and all that is not ASCII, with A-Z in lower case.
ALNUM = table(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]), lower=True)


class Words(NamedTuple):
    start: np.ndarray  #: byte offset of each word in the chunk
    end: np.ndarray  #: and its end
    first: np.ndarray  #: for each text the index of its first word, and the number of words at the end
    hash: np.ndarray  #: 64-bit hash of each word's bytes

    def doc(self) -> np.ndarray:
        """For each word the index of its text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls count as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of slices of whole texts."""
    data, offsets = buffers(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray, of: np.ndarray, hashed: bool = True) -> Words:
    """The words of a chunk, by a table of ``table()``."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(len(offsets), np.int64), none.astype(np.uint64))
    value = of[data]
    inside = value != 0
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets)
    if not hashed or not len(start):
        return Words(start, end, first, np.zeros(len(start), np.uint64))
    at = np.arange(n - start[0], dtype=np.int32) - np.repeat((start - start[0]).astype(np.int32), np.diff(start, append=n))
    value = value[start[0] :]
    value *= _POWERS[at & 0xFFFF]
    long = np.flatnonzero(at > 0xFFFF)
    if len(long):  # powers come again, but not with this factor
        value[long] *= mix((at[long] >> 16).astype(np.uint64)) | np.uint64(1)
    return Words(start, end, first, mix(np.add.reduceat(value, start - start[0])))


def rolled(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive hashes; there are len(h) - k + 1, over the borders of texts too."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    n, out = len(h) - k + 1, np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += h[i : i + n]
    return mix(out)
