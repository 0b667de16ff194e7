"""Words of many texts at once: numpy over the UTF-8 bytes of an Arrow array."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Odd multipliers of the polynomial hashes, modulo 2**64.
BASE, GRAM_BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def data_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of strings, and the n + 1 offsets of its texts in them."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def word_table(chars: str) -> np.ndarray:
    """True for the bytes of words that are ASCII `chars` or not ASCII at all."""
    table = np.zeros(256, dtype=bool)
    table[128:] = True
    table[np.frombuffer(chars.encode(), dtype=np.uint8)] = True
    return table


def lower_table() -> np.ndarray:
    """Lower-cases the bytes A-Z."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, cut at the texts' borders, and for each
    text the number of runs before it (n + 1 numbers)."""
    n = len(inside)
    prev = np.zeros(n, dtype=bool)
    prev[1:] = inside[:-1]
    heads = offsets[:-1][offsets[:-1] < n]
    prev[heads] = False
    starts = np.flatnonzero(inside & ~prev)
    after = np.zeros(n, dtype=bool)
    if n:
        after[:-1] = inside[1:]
        tails = offsets[1:] - 1
        after[tails[tails >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), dtype=np.uint64)
    np.multiply.accumulate(np.full(max(n - 1, 0), base), out=out[1:]) if n > 1 else None
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each span, mixed; equal spans have equal hashes."""
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(BASE, n), out=sums[1:])
    back = _powers(_INVERSE, n + 1)
    return mix((sums[ends] - sums[starts]) * back[starts])


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words, borders of texts not regarded."""
    m = len(words) - k + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = words[:m].copy()
    for j in range(1, k):
        out *= GRAM_BASE
        out += words[j : j + m]
    return mix(out ^ np.uint64(k))


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Whether each value is the least, the last of equal ones, of some window of
    `width` values."""
    m = len(values) - width + 1
    chosen = np.zeros(len(values), dtype=bool)
    if m <= 0:
        return chosen
    least, at = values[:m].copy(), np.arange(m)
    for j in range(1, width):
        later = values[j : j + m]
        better = later <= least
        least = np.where(better, later, least)
        at[better] = np.flatnonzero(better) + j
    chosen[at] = True
    return chosen
