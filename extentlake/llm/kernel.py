"""Words, word hashes and shingles of whole Arrow text columns, as numpy arrays.

Everything here works on slices of a batch that end between documents, so that what is held is a few
times SLICE_BYTES, or the longest text where one text is longer.  Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20
#: Values whose running sum is held at once.
BLOCK = 1 << 18
_ROOT = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit words (the finisher of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def byte_class(members: str, inverted: bool = False, high: bool = True) -> np.ndarray:
    """A table of 256 booleans; high: whether bytes of characters beyond ASCII belong."""
    table = np.zeros(256, bool)
    table[[ord(c) for c in members]] = True
    if inverted:
        table = ~table
    table[128:] = high
    return table


#: Words between white space, and words of letters and digits.
SPACED = byte_class(" \t\n\x0b\x0c\r", inverted=True)
ALNUM = byte_class("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _values(lower: bool) -> np.ndarray:
    table = mix(np.arange(1, 257, dtype=np.uint64) * _ROOT)
    if lower:
        table[65:91] = table[97:123]
    return table


def slices(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets into them) of runs of rows with about SLICE_BYTES of text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    at = np.frombuffer(where, np.int64, n + 1, column.offset * 8)
    text = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(at, at[first] + SLICE_BYTES, "right")) - 1)
        end = min(end, n)
        yield first, end, text[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


def word_bounds(text: np.ndarray, at: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and how many words lie before each document (one entry more than documents)."""
    if not len(text):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(at), np.int64)
    inside = members[text]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    cut = at[(at > 0) & (at < len(text))]
    start[cut] = inside[cut]
    end[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    return start, end, np.searchsorted(start, at)


def run_hashes(values: Callable[[int, int], np.ndarray], n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of some runs of n values, in order and apart: a polynomial over the values, scrambled with its length.

    Taken as differences of running sums over BLOCK values at a time; a run that crosses an edge adds up its parts.
    """
    (power, inverse), out, sums = _powers(BLOCK), np.zeros(len(start), np.uint64), np.zeros(BLOCK + 1, np.uint64)
    for low in range(0, n, BLOCK):
        high = min(low + BLOCK, n)
        i, k = np.searchsorted(end, low, "right"), np.searchsorted(start, high, "left")
        if i < k:
            np.cumsum(values(low, high) * power[: high - low], out=sums[1 : high - low + 1])
            s = np.maximum(start[i:k], low) - low
            part = (sums[np.minimum(end[i:k], high) - low] - sums[s]) * inverse[s]
            if start[i] < low:
                part[:1] *= np.uint64(pow(_BASE, low - int(start[i]), 1 << 64))
            out[i:k] += part
    return mix(out + (end - start).astype(np.uint64) * _B)


def word_hashes(text: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    table = _values(lower)
    return run_hashes(lambda low, high: table[text[low:high]], len(text), start, end)


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _BASE below n modulo 2**64, and their inverses."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(n, np.uint64(base))
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


@cache
def _factors(k: int) -> list[np.uint64]:
    return [np.uint64(int(x) | 1) for x in mix(np.arange(1, k + 1, dtype=np.uint64) * _A)]


def windows(words: np.ndarray, before: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every k words in a row within a document, and how many such windows lie before each document."""
    count = np.diff(before)
    n = np.maximum(count - (k - 1), 0)
    starts = np.cumsum(n) - n
    at = np.arange(int(n.sum())) + np.repeat(before[:-1] - starts, n)
    value = np.full(len(at), np.uint64(k))
    for j, factor in enumerate(_factors(k)):
        value += words[at + j] * factor
    return mix(value), np.append(starts, len(at))


def shingle_sets(text: np.ndarray, at: np.ndarray, k: int, members: np.ndarray = SPACED, lower: bool = True) -> list[np.ndarray]:
    """Each document's sorted distinct hashes of k words in a row; of all its words together where it has fewer; none without words."""
    start, end, before = word_bounds(text, at, members)
    words = word_hashes(text, start, end, lower)
    value, cut = windows(words, before, k)
    out = []
    for d in range(len(at) - 1):
        n = int(before[d + 1] - before[d])
        if n >= k:
            own = np.sort(value[cut[d] : cut[d + 1]])
            out.append(own[np.append(True, own[1:] != own[:-1])])
        elif n:
            out.append(windows(words[before[d] : before[d + 1]], np.array([0, n]), n)[0])
        else:
            out.append(np.zeros(0, np.uint64))
    return out
