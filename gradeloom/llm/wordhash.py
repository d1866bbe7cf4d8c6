"""Whole texts to 64-bit word and shingle hashes, vectorised with NumPy.

A word is a run of bytes other than ASCII white space (``[^\\x20\\x09-\\x0D]+``); as UTF-8 never
uses those bytes inside a longer character, working on bytes is exact.
"""

from __future__ import annotations

import numpy as np

SEGMENT = 1 << 21  # bytes hashed at a time, so that memory stays bounded for any length of text
TOGETHER = 1 << 18  # bytes of several texts hashed at a time; few enough for the processor's cache

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_STEP = _rng.integers(1, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_power = np.array([1], np.uint64)
_inverse = np.array([1], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    global _power
    if n > len(_power):
        grown = np.full(max(64, 1 << (n - 1).bit_length()), _BASE, np.uint64)
        grown[0] = 1
        _power = np.multiply.accumulate(grown)
    return _power


def _inverses(n: int) -> np.ndarray:
    """Powers of what ``_BASE`` gives 1 with, modulo 2 to the power 64."""
    global _inverse
    if n > len(_inverse):
        grown = np.full(max(64, 1 << (n - 1).bit_length()), pow(int(_BASE), -1, 1 << 64), np.uint64)
        grown[0] = 1
        _inverse = np.multiply.accumulate(grown)
    return _inverse


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = (data - np.uint8(9) > 4) & (data != 32)  # below 9 it wraps around
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def _hashed(data: np.ndarray, fold: bool) -> np.ndarray:
    starts, ends = spans(data)
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = ends - starts
    data, starts = data[starts[0]:], starts - starts[0]
    inside = np.arange(len(data)) - np.repeat(starts, np.diff(starts, append=len(data)))
    value = (_FOLDED if fold else _BYTE)[data]
    value[_SPACE[data]] = 0
    value *= _powers(int(inside.max()) + 1)[inside]
    return mixed(np.add.reduceat(value, starts) + lengths.astype(np.uint64))


def word_hashes(text: bytes, fold: bool = False) -> np.ndarray:
    """One 64-bit hash for each word; ``fold`` lower-cases A-Z first."""
    data = np.frombuffer(text, np.uint8)
    if len(data) <= SEGMENT:
        return _hashed(data, fold)
    parts, at = [], 0
    while at < len(data):
        end = min(at + SEGMENT, len(data))
        while end < len(data) and not _SPACE[data[end]]:  # cut at white space only
            far = np.flatnonzero(_SPACE[data[end:end + SEGMENT]])
            end += int(far[0]) if len(far) else min(SEGMENT, len(data) - end)
        parts.append(_hashed(data[at:end], fold))
        at = end
    return np.concatenate(parts)


def hashes_of_texts(texts: list[bytes], fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The ``word_hashes`` of all texts, one text after the other, and how many words each has.

    Texts of ``TOGETHER`` bytes in all are hashed at once: each byte times the power of its place among
    them, so that a word's sum is its own times the power of its first place, which is taken off again.
    """
    table = (_FOLDED if fold else _BYTE) * ~_SPACE
    hashes, counts, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
    while at < len(texts):
        end, size = at + 1, len(texts[at])
        while end < len(texts) and size + 1 + len(texts[end]) <= TOGETHER:
            size += 1 + len(texts[end])
            end += 1
        if size > TOGETHER:
            hashes.append(word_hashes(texts[at], fold))
            counts.append(np.array([len(hashes[-1])]))
        else:
            data = np.frombuffer(b" ".join(texts[at:end]), np.uint8)
            starts, ends = spans(data)
            if len(starts):
                value = table[data]
                value *= _powers(len(data))[: len(data)]
                value = np.add.reduceat(value, starts) * _inverses(len(data))[starts]
                hashes.append(mixed(value + (ends - starts).astype(np.uint64)))
            counts.append(np.diff(np.searchsorted(starts, np.cumsum([0] + [len(x) + 1 for x in texts[at:end]]))))
        at = end
    return np.concatenate(hashes), np.concatenate(counts)


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` words, in order."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out += words[k:k + n] * _STEP[k]
    return mixed(out)


def shingle_set(text: bytes | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles; a shorter text is one shingle, no words give none."""
    words = word_hashes(text, fold=True) if text else np.empty(0, np.uint64)
    if 0 < len(words) < size:
        return mixed(np.array([(words * _STEP[: len(words)]).sum() + np.uint64(len(words))], np.uint64))
    return np.unique(windows(words, size))
