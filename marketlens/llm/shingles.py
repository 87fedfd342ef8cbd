"""Word shingles of whole texts as sorted sets of 64-bit numbers."""

from __future__ import annotations

from array import array

import numpy as np
from xxhash import xxh3_64_intdigest

#: The top bits of a shingle number name its counting bin; a fixed number of bins, whatever the input.
BIN_BITS = 16
BINS = 1 << BIN_BITS
_REST = np.uint64(64 - BIN_BITS)
_LOW = np.uint64((1 << (64 - BIN_BITS)) - 1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, as UTF-8."""
    return text.encode().lower().split() if text else []


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct numbers of all runs of ``words`` words; of fewer words, the whole sequence
    is one; no words, no shingles."""
    found = words_of(text)
    if not found:
        return np.empty(0, np.uint64)
    if len(found) < words:
        return np.array([xxh3_64_intdigest(b" ".join(found), seed=len(found))], np.uint64)
    numbers = np.frombuffer(array("Q", map(xxh3_64_intdigest, found)), np.uint64)
    count = len(found) - words + 1
    h = numbers[:count].copy()
    for i in range(1, words):
        h *= _STEP
        h += numbers[i : i + count]
    return np.unique(_mixed(h))


def bin_of(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> _REST).astype(np.int64)


def in_order(shingles: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The set renumbered one to one, so that numbers of rare bins come first, and sorted."""
    return np.sort((rank[bin_of(shingles)] << _REST) | (shingles & _LOW))


def set_number(shingles: np.ndarray) -> int | None:
    """A signed 64-bit number of the whole set, null for the empty one."""
    if not len(shingles):
        return None
    number = xxh3_64_intdigest(shingles.tobytes())
    return number - (1 << 64) if number >> 63 else number
