"""Numpy kernels over the bytes of many texts at once: words, word hashes and
hashes of word windows. All are pure functions used inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled by one kernel call; a longer text is handled alone.
SLICE_BYTES = 4 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BYTE_KEYS = np.random.default_rng(20240917).integers(1, 2**64 - 1, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """BASE ** 0 .. BASE ** (n - 1) modulo 2 ** 64."""
    global _POWERS
    if len(_POWERS) < n:
        steps = np.full(max(n, 1024), BASE, np.uint64)
        steps[0] = 1
        _POWERS = np.multiply.accumulate(steps)
    return _POWERS[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its n + 1 borders."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays([c.cast(pa.large_string()) for c in column.chunks]) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``limit`` bytes together, or of one text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word (run of bytes other than the six white
    space characters) and, per text, the number of its first word."""
    n = len(data)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, solid[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, solid[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """64-bit hash of every word, of its lower-cased A-Z form with ``fold``."""
    if len(starts) == 0:
        return np.empty(0, np.uint64)
    lengths = ends - starts
    at = np.concatenate(([0], np.cumsum(lengths)))
    keys = _BYTE_KEYS[_FOLD] if fold else _BYTE_KEYS
    place = np.arange(at[-1]) - np.repeat(at[:-1], lengths)
    values = keys[data[~_SPACE[data]]] * powers(int(lengths.max()))[place]
    return mix(np.add.reduceat(values, at[:-1]) + lengths.astype(np.uint64))


def window_hashes(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hash of every window of ``size`` consecutive words of one
    text, and the word it starts at. ``first``: number of each text's first word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = np.flatnonzero(text[:n] == text[size - 1:])
    rolled = np.zeros(n, np.uint64)
    for j in range(size):
        rolled *= BASE
        rolled += hashes[j:n + j]
    return mix(rolled[inside]), inside


def byte_keys(data: np.ndarray) -> np.ndarray:
    """A random 64-bit key for every byte."""
    return _BYTE_KEYS[data]
