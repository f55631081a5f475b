"""Numpy kernels for terms of a given byte class: their places, their bytes in
lower case (A-Z only) without what stands between, and hashes of their runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from millrace.llm import textkernel as tk

#: Bytes of letters: A-Z, a-z and every byte of characters beyond ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True
#: Letters and the digits 0-9.
ALNUM = LETTERS.copy()
ALNUM[48:58] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def locate(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every maximal run of ``inside`` bytes that crosses
    no border of a text and, per text, the number of its first run."""
    n = len(data)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = inside[data]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    head = offsets[:-1][np.diff(offsets) > 0]
    begins[head] = solid[head]
    tail = offsets[1:][np.diff(offsets) > 0] - 1
    ends[tail] = solid[tail]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def folded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The terms' bytes one after the other, A-Z lower-cased, and the n + 1
    borders between them."""
    return _FOLD[data[inside[data]]], np.concatenate(([0], np.cumsum(ends - starts)))


def hashes(letters: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit hash of every term."""
    if len(at) < 2:
        return np.empty(0, np.uint64)
    lengths = np.diff(at)
    place = np.arange(at[-1]) - np.repeat(at[:-1], lengths)
    values = tk.byte_keys(letters) * tk.powers(int(lengths.max()))[place]
    return tk.mix(np.add.reduceat(values, at[:-1]) + lengths.astype(np.uint64))


def runs(term_hashes: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """Per size, ascending, the hash of every run of so many consecutive terms
    (over all texts; the caller leaves out those that cross a border)."""
    rolled = np.zeros(len(term_hashes), np.uint64)
    for j in range(max(sizes, default=0)):
        n = len(term_hashes) - j
        if n <= 0:
            return
        rolled = rolled[:n] * tk.BASE + term_hashes[j:]
        if j + 1 in sizes:
            yield j + 1, tk.mix(rolled)
