"""Vectorised scans of whole Arrow text columns: words, hashes and shingles as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text makes a block of its own.
BLOCK = 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ONE = np.uint64(1)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII letters, digits and every byte of a longer character make words; the rest separates.
PUNCT = np.zeros(256, bool)
PUNCT[:128] = [not chr(i).isalnum() for i in range(128)]
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd(n: int, seed: int = 1) -> np.ndarray:
    """n fixed odd multipliers."""
    return mix(np.arange(seed * 1000 + 1, seed * 1000 + n + 1, dtype=np.uint64) * _ODD) | _ONE


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_M = odd(1, 7)[0]
_INV = np.uint64(pow(int(_M), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base modulo 2**64, and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, BLOCK + 1)
        for k, m in enumerate((_M, _INV)):
            p = np.full(size, m, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def prefix_hash(b: np.ndarray) -> np.ndarray:
    """H of length len(b)+1; piece(H, i, j) is a hash of b[i:j] alone."""
    h = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(BYTE[b] * powers(len(b))[0], out=h[1:])
    return h


def piece(h: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return (h[j] - h[i]) * powers(len(h))[1][i]


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows; a null reads as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def words(b: np.ndarray, at: np.ndarray, sep: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes outside sep; none crosses rows."""
    inside = ~sep[b]
    edge = np.zeros(len(b) + 1, bool)
    edge[at] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


def hashed(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each piece b[start:end]; pieces are in order and disjoint. Works in blocks, so long texts need little memory."""
    if len(b) <= BLOCK:
        return mix(piece(prefix_hash(b), start, end) + (end - start).astype(np.uint64) * _ODD)
    out, i = np.empty(len(start), np.uint64), 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + BLOCK, "right")))
        a, z = start[i], end[j - 1]
        out[i:j] = mix(piece(prefix_hash(b[a:z]), start[i:j] - a, end[i:j] - a) + (end[i:j] - start[i:j]).astype(np.uint64) * _ODD)
        i = j
    return out


def shingles(word: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word's index of every n consecutive words of one row."""
    if len(word) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m, c = len(word) - n + 1, odd(n)
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h += word[k : k + m] * c[k]
    i = np.flatnonzero(row[:m] == row[n - 1 :])
    return mix(h[i]), i


def columns(**values: object) -> pa.RecordBatch:
    """A batch of the named columns."""
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in values.values()], names=list(values))
