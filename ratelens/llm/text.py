"""Vectorised text helpers for Arrow batches: word and shingle hashes over the raw UTF-8 bytes.

Words are runs of bytes other than space and 0x09-0x0D; A-Z count as a-z. Hashes are 64 bits."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at once: bounds a task's memory (about 50 bytes of arrays a byte of text).
CHUNK = 1 << 19

_rng = np.random.default_rng(20_240_501)
_TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_TABLE[65:91] = _TABLE[97:123]
#: Bytes between words: white space alone, or with ASCII punctuation.
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
LOOSE = _SPACE.copy()
LOOSE[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_R = int(_rng.integers(1 << 40, 1 << 62)) * 4 + 3
_R_INV = pow(_R, -1, 1 << 64)
_STEP = _rng.integers(1 << 40, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: tuple[np.ndarray, np.ndarray] | None = None


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (one for each seed)."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _geometric(r: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(r))
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        n = max(n, CHUNK + 1)
        _powers = _geometric(_R, n), _geometric(_R_INV, n)
    return _powers


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and 64-bit offsets of a string column; nulls are empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    column = column.fill_null(b"") if column.null_count else column
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def give_back() -> None:
    """What the C library holds in store goes back to the system."""
    with contextlib.suppress(OSError, AttributeError):  # other C libraries than glibc have no such function
        ctypes.CDLL(None).malloc_trim(0)


def returned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``batches``; between them the memory that Arrow holds in store, and at the end that of the C library, goes back to the
    system: workers live on between tasks, and several share an executor's memory."""
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()
    give_back()


def chunks(at: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` bytes together (a longer row comes alone)."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, at: np.ndarray, i: int, j: int, space: np.ndarray = _SPACE,
          cut: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, ...]:
    """Of rows i..j: the hash, row (from 0), first byte and end byte (in ``data``) of every word, in order.
    ``cut`` tells from the bytes where words begin without white space before."""
    base = int(at[i])
    b = data[base:int(at[j])]
    if not len(b):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    edge = (at[i:j + 1] - base).astype(np.int64)
    solid = ~space[b]
    before, after = np.empty_like(solid), np.empty_like(solid)
    before[0], before[1:] = False, solid[:-1]
    after[-1], after[:-1] = False, solid[1:]
    inner = edge[(edge > 0) & (edge < len(b))]
    if cut is not None:
        inner = np.concatenate([inner, np.flatnonzero(cut(b))])
    before[inner] = False
    after[inner - 1] = False
    first = np.flatnonzero(solid & ~before)
    end = np.flatnonzero(solid & ~after) + 1
    up, down = power_tables(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_TABLE[b] * up[:len(b)], out=total[1:])
    h = mix((total[end] - total[first]) * down[first], 1)
    return h, np.searchsorted(edge, first, "right") - 1, first + base, end + base


def shingles(h: np.ndarray, row: np.ndarray, rows: int, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of k words within a row, their rows and first words' positions in ``h``. A row of 1 to k-1 words
    gives its whole sequence as one; a row without words gives none."""
    n = len(h)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    count = np.bincount(row, minlength=rows)
    first = np.cumsum(count) - count
    left = count[row] - (np.arange(n) - first[row])  # words from here to the row's end
    start = np.flatnonzero((left >= k) | ((left == count[row]) & (count[row] < k)))
    got = np.zeros(len(start), np.uint64)
    padded = np.concatenate([h, np.zeros(k, np.uint64)])
    size = np.minimum(left[start], k)
    for x in range(k):
        got += np.where(size > x, mix(padded[start + x], 2) * _STEP[x], np.uint64(0))
    return mix(got + size.astype(np.uint64), 3), row[start], start


def text_sets(column: pa.Array, k: int = 5) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """By chunk of rows i..j: i, j, the distinct shingle hashes of each row (sorted within the row), their rows
    (from 0) and the number of each row."""
    data, at = utf8(column)
    for i, j in chunks(at):
        h, row, _, _ = words(data, at, i, j)
        s, r, _ = shingles(h, row, j - i, k)
        order = np.lexsort((s, r))
        s, r = s[order], r[order]
        if len(s):
            keep = np.ones(len(s), bool)
            keep[1:] = (s[1:] != s[:-1]) | (r[1:] != r[:-1])
            s, r = s[keep], r[keep]
        yield i, j, s, r, np.bincount(r, minlength=j - i)


def beginnings(data: np.ndarray, first: np.ndarray, end: np.ndarray, sizes: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size: hashes of the words' first bytes, and which words are longer than that."""
    up, _ = power_tables(1)
    total = np.zeros(len(first), np.uint64)
    for x in range(max(sizes)):
        there = first + x < end
        total[there] += _TABLE[data[first[there] + x]] * up[x]
        if x + 1 in sizes:
            yield mix(total + np.uint64(x + 1), 31), end - first > x + 1
