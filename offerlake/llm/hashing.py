"""Numpy helpers over Arrow text columns: words, their 64-bit hashes, and shingles.

A word is a maximal run of bytes that are not ASCII white space. All words of a run
of rows are hashed at once: the hash is a difference of two prefix sums of a
polynomial, so no text is copied or looped over in Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text that are hashed at once; a longer text is cut at white space.
PIECE = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_STEP = {False: U64(_BASE), True: U64(pow(_BASE, -1, 1 << 64))}
_powers: dict[bool, np.ndarray] = {}


def powers(n: int, inverse: bool) -> np.ndarray:
    """1, b, b^2, ... modulo 2^64, for the base or its inverse."""
    if inverse not in _powers or len(_powers[inverse]) < n:
        out = np.full(max(n, PIECE + 1), _STEP[inverse], U64)
        out[0] = 1
        _powers[inverse] = np.cumprod(out)
    return _powers[inverse][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser: a bijection that spreads every bit."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(_BASE)) | U64(1)
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32
_VALUE = {False: _BYTE, True: _BYTE[_LOWERED]}
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


class Words(NamedTuple):
    """Words of the rows [low, high) of a batch, in order."""

    low: int
    high: int
    row: np.ndarray    # row of each word, from 0 at ``low``
    hash: np.ndarray   # 64-bit hash of each word
    start: np.ndarray  # first byte of each word in ``data``
    end: np.ndarray    # byte after the word
    data: np.ndarray   # bytes of these rows

    def counts(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.high - self.low)


def _words(data: np.ndarray, starts: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of the words of ``data``; no word goes over one of ``starts``."""
    inside = ~_BLANK[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = starts[(starts > 0) & (starts < len(data))]
    first[cut] |= inside[cut]
    last[cut - 1] |= inside[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(_VALUE[lower][data] * powers(len(data), False), out=total[1:])
    return start, end, mix((total[end] - total[start]) * powers(len(data) + 1, True)[start] + (end - start).astype(U64))


def words_of(texts: pa.Array, lower: bool = True, piece: int = PIECE) -> Iterator[Words]:
    """Words of a string column, for runs of rows of about ``piece`` bytes. Null: no words."""
    texts = (pc.fill_null(texts, "") if texts.null_count else texts).cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    whole = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + piece, "right")) - 1)
        data, starts = whole[offsets[low]:offsets[high]], offsets[low:high] - offsets[low]
        parts, at = [], 0
        while len(data) - at > 2 * piece:  # one long text
            blank = np.flatnonzero(_BLANK[data[at + piece:at + 2 * piece]])
            stop = at + piece + int(blank[0]) if len(blank) else len(data)
            parts.append((at, _words(data[at:stop], starts[(starts >= at) & (starts < stop)] - at, lower)))
            at = stop
        parts.append((at, _words(data[at:], starts[starts >= at] - at, lower)))
        start = np.concatenate([p[0] + at for at, p in parts])
        end = np.concatenate([p[1] + at for at, p in parts])
        value = np.concatenate([p[2] for _, p in parts])
        # empty rows share their start with the next one: the last of them holds the words
        row = np.searchsorted(starts, start, "right") - 1
        yield Words(low, high, row, value, start, end, data)
        low = high


_PLACE = mix(np.arange(101, 165, dtype=U64) * U64(_BASE)) | U64(1)


def shingles(words: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, row bounds): sorted distinct ``width``-word shingles, row after row. A row with
    fewer words has its whole sequence as its only shingle; a row without words has none."""
    rows, count = words.high - words.low, words.counts()
    first = np.zeros(rows + 1, np.int64)
    np.cumsum(count, out=first[1:])
    n = max(len(words.hash) - width + 1, 0)
    joined = np.zeros(n, U64)
    for k in range(width):
        joined += words.hash[k:k + n] * _PLACE[k]
    joined = mix(joined)
    out = []
    for i in range(rows):
        a, b = first[i], first[i + 1]
        if b - a >= width:
            s = np.sort(joined[a:b - width + 1])
            out.append(s[np.r_[True, s[1:] != s[:-1]]])
        elif b > a:
            short = np.append(words.hash[a:b], U64(b - a)) * np.append(_PLACE[:b - a], _PLACE[-1])
            out.append(mix(short.sum(dtype=U64, keepdims=True)))
        else:
            out.append(np.zeros(0, U64))
    bounds = np.zeros(rows + 1, np.int64)
    np.cumsum([len(s) for s in out], out=bounds[1:])
    return (np.concatenate(out) if out else np.zeros(0, U64)), bounds


def long_array(values: np.ndarray) -> pa.Array:
    """64-bit hashes as a signed Arrow column."""
    return pa.array(values.view(np.int64))
