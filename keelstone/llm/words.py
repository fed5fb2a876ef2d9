"""Words, their hashes and their shingles for whole Arrow slices at once.

A word is a maximal run of bytes other than the space and 0x09-0x0D, after A-Z became a-z.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from keelstone.llm.batches import byte_view, ragged, texts_of

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Multiplier of the word hashes and its inverse modulo 2**64.
_BASE = 0xD1342543DE82EF95
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes whose powers are tabled; those of later places are a block's times one within it.
_BLOCK = 1 << 16


def _table(base: int, count: int) -> np.ndarray:
    """``base ** 0 .. base ** (count - 1)`` modulo 2**64."""
    table = np.full(max(count, 1), np.uint64(base))
    table[0] = 1
    return np.cumprod(table)[:count]


_within, _within_inverse = _table(_BASE, _BLOCK), _table(_BASE_INVERSE, _BLOCK)
_NEXT_BLOCK = pow(_BASE, _BLOCK, 1 << 64)
_NEXT_BLOCK_INVERSE = pow(_BASE_INVERSE, _BLOCK, 1 << 64)


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def rolling(data: np.ndarray) -> np.ndarray:
    """Prefix sums ``S`` of byte hashes: ``(S[j] - S[i]) * base**-i`` is the hash of ``i..j``."""
    byte = mixed(np.arange(1, 257, dtype=np.uint64))
    sums = np.zeros(len(data) + 1, np.uint64)
    steps = _table(_NEXT_BLOCK, len(data) // _BLOCK + 1)
    for step, at in zip(steps, range(0, len(data), _BLOCK), strict=False):
        codes = byte[data[at : at + _BLOCK]]
        codes *= _within[: len(codes)]
        codes *= step
        block = sums[at + 1 : at + 1 + len(codes)]
        np.cumsum(codes, out=block)
        block += sums[at]
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of every byte span, independent of where it stands."""
    blocks = _table(_NEXT_BLOCK_INVERSE, len(sums) // _BLOCK + 1)
    out = np.empty(len(starts), np.uint64)
    for at in range(0, len(starts), _BLOCK):
        low, high = starts[at : at + _BLOCK], ends[at : at + _BLOCK]
        value = sums[high] - sums[low]
        value *= _within_inverse[low & (_BLOCK - 1)]
        value *= blocks[low >> 16]
        out[at : at + _BLOCK] = mixed(value)
    return out


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z become a-z, other bytes stay."""
    return np.where((data >= 65) & (data <= 90), data | np.uint8(32), data)


def word_bounds(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each document the number of its first word.

    ``ends`` are the ``n + 1`` document offsets; words never cross them.
    """
    solid = np.zeros(len(data) + 1, bool)
    solid[:-1] = (data != 32) & ((data < 9) | (data > 13))
    fresh = solid.copy()
    fresh[1:] &= ~solid[:-1]
    inner = ends[(ends > 0) & (ends < len(data))]
    fresh[inner] = solid[inner]
    starts = np.flatnonzero(fresh[:-1])
    # A word ends where the next byte is a gap, a new document or the end of all.
    stop = solid[:-1] & (~solid[1:] | fresh[1:])
    return starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, ends)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash for every word, and for each text the number of its first word (``n + 1``)."""
    data, ends = byte_view(texts_of(texts))
    data = lower_ascii(data)
    starts, stops, first = word_bounds(data, ends)
    return span_hashes(rolling(data), starts, stops), first


def shingle_sets(texts: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, ascending, and their offsets (``n + 1``).

    A text with fewer words than ``width`` has its whole sequence as one shingle, one
    without words an empty set.
    """
    words, first = word_hashes(texts)
    counts = np.diff(first)
    grams = np.maximum(counts - width + 1, 0)
    at = ragged(first[:-1], grams)
    hashes = np.zeros(len(at), np.uint64)
    for k in range(width):
        hashes = hashes * _ODD + words[at + k] if len(at) else hashes
    hashes = mixed(hashes)
    short = np.flatnonzero((counts > 0) & (counts < width))
    whole = np.array(
        [_sequence_hash(words[first[i] : first[i + 1]]) for i in short], np.uint64
    )
    sizes = grams.copy()
    sizes[short] = 1
    out = np.zeros(int(sizes.sum()), np.uint64)
    bounds = np.r_[0, np.cumsum(sizes)]
    out[ragged(bounds[:-1], grams)] = hashes
    out[bounds[:-1][short]] = whole
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        out[a:b].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[bounds[:-1][sizes > 0]] = True
    return out[keep], np.r_[0, np.cumsum(keep)][bounds]


def _sequence_hash(words: np.ndarray) -> int:
    value = len(words)
    for word in words.tolist():
        value = (value * int(_ODD) + word) % (1 << 64)
    return int(mixed(np.array([value], np.uint64))[0])
