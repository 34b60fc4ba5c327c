"""Word shingles of whole texts as sorted sets of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

from linemill.llm._memo import claim

#: Words that a worker remembers the hashes of.
MEMO_WORDS = 100_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


_hashes = _WordHashes()


def word_hashes(text: bytes | None) -> np.ndarray:
    """One hash for each word; A-Z are lower-cased, words are parted by ASCII white space."""
    words = (text or b"").lower().split()
    claim("shingles", _hashes.clear)
    if len(_hashes) > MEMO_WORDS:
        _hashes.clear()
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def mix(value: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a bijection)."""
    value = (value ^ (value >> _SHIFT)) * _ODD
    return value ^ (value >> np.uint64(32))


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of so many words.

    A text with fewer words has its whole sequence as the only shingle; a text
    without words has none.
    """
    words = word_hashes(text)
    if not len(words):
        return words
    width = min(size, len(words))
    found = np.full(len(words) - width + 1, width, np.uint64)
    for at in range(width):
        found = mix(found * _ODD + words[at : len(words) - width + 1 + at])
    return np.unique(found)
