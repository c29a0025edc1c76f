"""Texts of an Arrow batch as one array of bytes: rows in runs, words, and arrays built from them."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def runs_of_rows(column: pa.Array, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, bytes, offsets) of rows that lie one behind the other, of about `most` bytes or one row at least."""
    if not len(column):
        return
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = min(len(column), max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1))
        yield at, to, data[offs[at] : offs[to]], (offs[at : to + 1] - offs[at]).astype(np.int64)
        at = to


def bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts that lie one behind the other."""
    word, first = ~SPACE[data], np.zeros(len(data) + 1, bool)
    first[offsets] = True  # no word goes on into the next text
    starts = np.flatnonzero(word & (first[:-1] | ~np.concatenate([[False], word[:-1]])))
    return starts, np.flatnonzero(word & (first[1:] | ~np.concatenate([word[1:], [False]]))) + 1


CHUNK = 1 << 16  # words whose bytes are moved at a time


def _moved(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, to: np.ndarray, out: np.ndarray) -> None:
    """out[to:] = data[starts:ends] for each word."""
    for at in range(0, len(starts), CHUNK):
        size = (ends - starts)[at : at + CHUNK]
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        out[inside + np.repeat(to[at : at + CHUNK], size)] = data[inside + np.repeat(starts[at : at + CHUNK], size)]


def pieces_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """data[starts:ends] of each pair as a binary array."""
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    out = np.empty(offsets[-1], np.uint8)
    _moved(data, starts, ends, offsets[:-1], out)
    return binary(out, offsets)


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of texts whose words are data[starts:ends], joined by one space; first: of each text, and an end."""
    size = ends - starts + 1
    size[first[1:][np.diff(first) > 0] - 1] -= 1
    offsets = np.concatenate([[0], np.cumsum(size)])
    out = np.full(offsets[-1], 0x20, np.uint8)
    _moved(data, starts, ends, offsets[:-1], out)
    return out, offsets[first]


def binary(data: np.ndarray, offsets: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """Values that lie one behind the other."""
    return pa.Array.from_buffers(kind or pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def stretches(mask: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the runs of True along which the arrays of `same` don't change."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.zeros(len(mask), bool)
    change[0] = True
    for x in same:
        change[1:] |= x[1:] != x[:-1]
    starts = np.flatnonzero(mask & (change | ~np.concatenate([[False], mask[:-1]])))
    ends = np.flatnonzero(mask & np.concatenate([change[1:] | ~mask[1:], [True]])) + 1
    return starts, ends - starts


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in some [start, end)."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge[:-1]) > 0
