"""Terms of many texts at once: maximal runs of given bytes, A-Z lower-cased, as
Arrow arrays. Bytes from 0x80 on belong to every term, so runs of bytes are runs
of code points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .bytewords import LOWER, buffers, slices

LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True
LETTERS_DIGITS = LETTERS.copy()
LETTERS_DIGITS[48:58] = True


def even_slices(batch: pa.RecordBatch, col: int, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of about equal bytes of text, ``most`` each or a little less; a longer text alone."""
    _, off = buffers(batch.column(col))
    n = -(-int(off[-1]) // most) or 1
    return slices(batch, col, int(off[-1]) // n + 1)


def terms(texts: pa.Array, kept: np.ndarray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """All terms of the texts, one after the other, and for each text the number of terms before it (n + 1)."""
    data, off = buffers(texts)
    inside = kept[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = off[(off > 0) & (off < len(data))]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    at = np.flatnonzero(first)
    starts = np.append(0, np.cumsum(np.flatnonzero(last) + 1 - at))
    own = LOWER[data[inside]]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(starts), pa.py_buffer(own)]), np.searchsorted(at, off)


def counted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and how often each is there."""
    key = np.sort(key)
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, "i8")
    return key[at], np.diff(np.append(at, len(key)))
