"""Words and word shingles of many texts at once, on UTF-8 bytes with numpy.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, which are the
words ``[^\\x20\\x09-\\x0D]+`` of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype="u1")
LOWER[65:91] += 32
BASE = U(0x9E3779B97F4A7C15)
_powers = np.ones(1, U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTE = mix(np.arange(1, 257, dtype=U))


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            _powers = np.concatenate([[U(1)], np.cumprod(np.full(max(64, 2 * n), BASE, U))])
    return _powers


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column without nulls, and its offsets."""
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    off = np.frombuffer(col.buffers()[1], kind, len(col) + 1, col.offset * kind().itemsize).astype("i8")
    data = col.buffers()[2]
    data = np.frombuffer(data, "u1") if data is not None else np.zeros(0, "u1")
    return data[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, col: int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``most`` bytes of text each, a longer text alone."""
    _, off = buffers(batch.column(col))
    lo, n = 0, batch.num_rows
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the number of words before it (n + 1)."""
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = off[(off > 0) & (off < len(data))]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words."""
    if not len(starts):
        return np.zeros(0, U)
    n = ends - starts
    total = int(n.sum())
    first = np.cumsum(n) - n
    pos = np.arange(total) - np.repeat(first, n)
    own = data[np.repeat(starts, n) + pos]
    with np.errstate(over="ignore"):
        h = np.add.reduceat(BYTE[own] * powers(int(n.max()) + 1)[pos], first)
        return mix(h + n.astype(U) * BASE)


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles, A-Z lower-cased.

    A text of fewer than k words, but one, has its whole sequence as one.
    """
    data = LOWER[data]
    starts, ends, before = word_spans(data, off)
    h = word_hashes(data, starts, ends)
    out = []
    with np.errstate(over="ignore"):
        mult = mix(np.arange(77, 77 + k, dtype=U)) | U(1)
        run = np.zeros(max(0, len(h) - k + 1), U)
        for j in range(k if len(run) else 0):
            run += h[j : j + len(run)] * mult[j]
        run = mix(run)
        for a, b in zip(before[:-1].tolist(), before[1:].tolist()):
            if b - a >= k:
                out.append(np.unique(run[a : b - k + 1]))
            elif b > a:
                out.append(mix((h[a:b] * mult[: b - a]).sum(dtype=U, keepdims=True) + U(b - a)))
            else:
                out.append(np.zeros(0, U))
    return out
