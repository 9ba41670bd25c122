"""Words and 64-bit hashes of a batch of texts, as array operations.

A batch is the UTF-8 bytes of its texts one after the other. Both word rules
used here cut at ASCII bytes only, so no byte of a longer character is a cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that one array operation works on, unless one text has more.
BATCH_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit integers that scatters all bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def salt(n: int) -> np.uint64:
    with np.errstate(over="ignore"):
        return mix(np.array([n], U64) * U64(0x9E3779B97F4A7C15) + U64(0x632BE59BD9B4E019))[0]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _flags(cuts) -> np.ndarray:
    out = np.ones(256, bool)
    out[list(cuts)] = False
    return out


#: Cut at white space: a word is [^\x20\x09-\x0D]+.
SPACE_CUT = _flags([0x20, *range(0x09, 0x0E)])
#: Cut at all ASCII but letters and digits, after lower-casing.
ALNUM_CUT = _flags([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])

_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))
_POWERS = [np.ones(1, U64), np.ones(1, U64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << int(n).bit_length()
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base & (2**64 - 1), U64)
            p[0] = 1
            _POWERS[i] = np.multiply.accumulate(p)
    return _POWERS


class Words:
    """The words of some texts: their hashes, byte ranges and counts by text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, cut: np.ndarray):
        """data: bytes of all texts; offsets: where each begins, and the end."""
        low = LOWER[data]
        inside = np.zeros(len(low) + 2, bool)
        inside[1:-1] = cut[low]
        first = np.zeros(len(low) + 1, bool)
        first[offsets] = True
        begins = inside[1:] & (~inside[:-1] | first)
        ends = inside[:-1] & (~inside[1:] | first)
        self.low, self.start, self.end = low, np.flatnonzero(begins), np.flatnonzero(ends)
        power, inverse = _powers(len(low) + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(len(low) + 1, U64)
            np.cumsum(_BYTE[low] * power[: len(low)], out=total[1:])
            self.hash = mix((total[self.end] - total[self.start]) * inverse[self.start])
        #: Text i has the words first[i] to first[i + 1].
        self.first = np.searchsorted(self.start, offsets)


def pieces(column: pa.Array, most: int = BATCH_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Texts i to j of a string column, with their bytes and offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    _, where, content = column.buffers()
    at = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    content = np.frombuffer(content, np.uint8) if content is not None and content.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j, content[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """For each text its distinct word shingles, as sorted 64-bit hashes.

    A text of fewer words has one, its whole sequence; one without words none.
    """
    w = Words(data, offsets, SPACE_CUT)
    h, out = w.hash, []
    with np.errstate(over="ignore"):
        n = max(0, len(h) - size + 1)
        runs = np.zeros(n, U64)
        for k in range(size):
            runs += mix(h[k : k + n] + salt(k))
        runs = mix(runs)
        for a, b in zip(w.first[:-1], w.first[1:]):
            if b - a >= size:
                out.append(np.unique(runs[a : b - size + 1]))
            elif b > a:
                short = mix(h[a:b] + np.array([salt(64 + 8 * int(b - a) + k) for k in range(b - a)], U64))
                out.append(mix(short.sum(dtype=U64, keepdims=True) + salt(32 + int(b - a))))
            else:
                out.append(np.zeros(0, U64))
    return out
