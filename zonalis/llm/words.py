"""Vectorised word boundaries and 64-bit hashes over UTF-8 buffers.

A word is a maximal run of bytes other than the space and 9 to 13; a row's end also ends a word. A hash is a polynomial
over the bytes modulo 2**64 with an odd base, taken from prefix sums, then finalised; the same sums give the hash of any
run of words from the words' own hashes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from .common import mix

BASES = np.array([0x5851F42D4C957F2D, 0x9FB21C651E98DF25], np.uint64)
INVERSES = np.array([pow(int(b), -1, 2**64) for b in BASES], np.uint64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Powers and inverse powers of a base for exponents below n; kept for the largest n so far."""
    if which not in _powers or len(_powers[which][0]) < n:
        n = 1 << max(16, int(n - 1).bit_length())
        both = []
        for base in (BASES[which], INVERSES[which]):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            np.multiply.accumulate(x, out=x)
            both.append(x)
        _powers[which] = both[0], both[1]
    return _powers[which]


def release() -> None:
    """Give back what earlier tasks left in this reused Python worker: powers, Arrow's free memory and the C heap's."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, giving back its memory when a task ends: a reused worker that waits shares its executor's limit with later steps."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def boundaries(raw: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word."""
    n = len(raw)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    gap = space[raw]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = True, gap[:-1]
    before |= cut[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, gap[1:]
    after |= cut[1:]
    word = ~gap
    start = np.flatnonzero(word & before)
    end = np.flatnonzero(word & after) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def prefix_sums(values: np.ndarray, which: int = 0) -> np.ndarray:
    up, _ = powers(len(values) + 1, which)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def run_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of the runs [start, end) of the values under `sums`; equal runs anywhere hash alike. `which` chooses one of two
    independent bases, that of the sums."""
    _, down = powers(len(sums), which)
    x = (sums[end] - sums[start]) * down[start]
    x += (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(x)


def byte_sums(raw: np.ndarray, which: int = 0) -> np.ndarray:
    return prefix_sums(raw.astype(np.uint64) + np.uint64(1), which)


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row, start and end of every word."""
    start, end, row = boundaries(raw, offsets)
    return (run_hashes(byte_sums(raw), start, end) if len(start) else np.zeros(0, np.uint64)), row, start, end


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
