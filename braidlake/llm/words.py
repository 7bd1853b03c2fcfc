"""Words of whole Arrow columns at once: maximal runs of bytes other than space and \\x09 to \\x0D."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_B = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets) of an Arrow string column; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word starts, word mask by byte); texts are apart even if no space ends them."""
    word = ~_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    at = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[at] = word[at]
    return np.flatnonzero(first), word


def word_counts(column) -> np.ndarray:
    """Words of each text as int64."""
    data, offsets = text_bytes(column)
    starts, _ = _starts(data, offsets)
    return np.diff(np.searchsorted(starts, offsets)).astype(np.int64)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hash of each word, first word of each text and one more, byte start of each word)."""
    starts, word = _starts(data, offsets)
    bounds = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), bounds, starts
    # Polynomial in the place within the word, so that equal words hash alike wherever they stand.
    place = np.arange(len(data), dtype=np.int64)
    place -= np.repeat(starts, np.diff(np.append(starts, len(data)))) if starts[0] == 0 else np.concatenate([place[: starts[0]], np.repeat(starts, np.diff(np.append(starts, len(data))))])
    powers = powers_of(int(place[word].max()) + 1)
    value = (data.astype(np.uint64) + np.uint64(1)) * powers[np.where(word, place, 0)]
    value[~word] = 0
    return mix64(np.add.reduceat(value, starts)), bounds, starts


def powers_of(n: int) -> np.ndarray:
    out = np.full(n, _B, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each run of `width` words, first one of each text and one more).

    A text of fewer words, one at least, has one shingle of them all; one without words has none.
    """
    words, bounds, _ = word_hashes(data, offsets)
    n = np.diff(bounds)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    first = np.concatenate([[0], np.cumsum(count)])
    at = np.repeat(bounds[:-1] - first[:-1], count) + np.arange(first[-1])
    last = np.repeat(bounds[1:], count)
    total = np.zeros(len(at), np.uint64)
    for k in range(width):
        there = at + k < last
        w = words[np.where(there, at + k, 0)] if len(words) else np.zeros(len(at), np.uint64)
        total = total * _B + np.where(there, w, np.uint64(k + 1))
    return mix64(total), first


def blocks(column, limit: int = 1 << 20):
    """Slices of an Arrow column of about `limit` bytes of text at most, one text at least: (start, slice)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets = text_bytes(column)
    start = 0
    while start < len(column):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield start, column.slice(start, end - start)
        start = end
