"""Words of Arrow text columns and their 64-bit hashes, as whole-array numpy work.

A word is a run of bytes other than space and 0x09-0x0D; as those are ASCII,
runs of bytes are runs of code points. A word's hash is a polynomial over its
bytes modulo 2**64, taken from prefix sums over the whole buffer, then mixed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_powers = {1: np.ones(1, dtype=np.uint64), -1: np.ones(1, dtype=np.uint64)}
#: Powers kept between calls; those of a longer text are made anew.
_KEPT = 1 << 21


def _power(n: int, sign: int) -> np.ndarray:
    """base**0, base**1 ... or of its inverse modulo 2**64, at least n of them."""
    have = _powers[sign]
    if len(have) < n:
        size = 1 << int(n - 1).bit_length()
        base = _BASE if sign == 1 else pow(_BASE, -1, 1 << 64)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= _KEPT:
            _powers[sign] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each output bit depends on all input bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a large_string array without nulls."""
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None:
        return np.zeros(0, dtype=np.uint8), offs - offs[0]
    return np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def runs(keep: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, broken at row starts."""
    n = len(keep)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    first = np.zeros(n + 1, dtype=bool)
    first[offs] = True
    start, end = keep.copy(), keep.copy()
    start[1:] &= ~keep[:-1] | first[1:n]
    end[:-1] &= ~keep[1:] | first[1:n]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for each span."""
    n = len(data)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(n, 1)[:n], out=total[1:])
    h = (total[ends] - total[starts]) * _power(n + 1, -1)[starts] if n else total[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lower-cased, and the first word's index of each row (rows + 1 values)."""
    data, offs = buffers(texts)
    data = LOWER[data]
    starts, ends = runs(~SPACE[data], offs)
    return span_hash(data, starts, ends), np.searchsorted(starts, offs)


def combine(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every window of n successive hashes."""
    out = h[: len(h) - n + 1].copy() if len(h) >= n else h[:0]
    for k in range(1, n):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + h[k : k + len(out)])
    return out


def row_of(bounds: np.ndarray) -> np.ndarray:
    """The row of each item, from the rows' bounds."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def named(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.DictionaryArray:
    """The spans data[start:end], in order and apart from each other, as numbers of distinct byte strings."""
    cuts = np.empty(2 * len(starts) + 1, dtype=np.int64)
    cuts[0:-1:2], cuts[1::2], cuts[-1] = starts, ends, len(data)
    pieces = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)])
    return pieces.take(pa.array(np.arange(0, 2 * len(starts), 2))).dictionary_encode()
