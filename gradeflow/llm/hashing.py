"""Word and shingle hashes of many texts at once, on UTF-8 bytes in numpy.

A word is a longest run without space, tab and the line ends U+000A to U+000D. These are ASCII, so
words can be cut in UTF-8 bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
# What cuts letter words: every ASCII character that isn't a letter.
_NO_LETTER = np.ones(256, bool)
_NO_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_RANDOM = np.random.default_rng(20_240_601)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)
# Words that are hashed at once: what a long text takes meanwhile is some 40 bytes for each of their bytes.
WORDS_AT_ONCE = 1 << 15


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of an odd number modulo 2**64."""
    global _powers
    if len(_powers) < n:
        row = np.full(max(n, 2 * len(_powers), 64), _STEP, np.uint64)
        row[0] = 1
        _powers = np.multiply.accumulate(row)
    return _powers[:n]


@dataclass
class Words:
    """Words of several texts: byte ranges, and where each text's words begin in them."""

    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def words_of(data: np.ndarray, offsets: np.ndarray, letters: bool = False, cuts: np.ndarray | None = None) -> Words:
    """The words of each text; with ``letters``, runs of ASCII letters and other characters beyond ASCII.

    ``cuts`` marks the byte values that cut words otherwise; all of them are ASCII.
    """
    if cuts is None:
        cuts = _NO_LETTER if letters else _SPACE
    inside = np.zeros(len(data) + 1, bool)
    np.logical_not(cuts[data], out=inside[:-1])
    fresh = inside[:-1].copy()
    fresh[1:] &= ~inside[:-2]
    last = inside[:-1] & ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    fresh[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    start = np.flatnonzero(fresh)
    return Words(start, np.flatnonzero(last) + 1, np.searchsorted(start, offsets))


def word_hashes(data: np.ndarray, words: Words, lower: bool = False, letters: bool = False, prefix: int = 0) -> np.ndarray:
    """A 64-bit hash of each word, or of its first ``prefix`` bytes; with ``lower``, A to Z count as a to z."""
    made = np.empty(len(words.start), np.uint64)
    for at in range(0, len(made), WORDS_AT_ONCE):
        own = slice(at, at + WORDS_AT_ONCE)
        made[own] = _word_hashes(data, words.start[own], words.end[own], lower, _NO_LETTER if letters else _SPACE, prefix)
    return made


def _word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool, cuts: np.ndarray, prefix: int) -> np.ndarray:
    lengths = end - start
    first = np.zeros(len(lengths), np.int64)
    np.cumsum(lengths[:-1], out=first[1:])
    total = int(first[-1] + lengths[-1])
    within = np.arange(total) - np.repeat(first, lengths)
    chars = data[start[0] : end[-1]]
    chars = chars[~cuts[chars]]
    if lower:
        chars = LOWER[chars]
    terms = _BYTE[chars] * powers(int(lengths.max()))[within]
    if prefix:
        terms[within >= prefix] = 0
        lengths = np.minimum(lengths, prefix)
    sums = np.add.reduceat(terms, first)
    return mixed(sums + lengths.astype(np.uint64) * _STEP)


def shingle_hashes(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``k`` words in a row, and each text's bounds in them; fewer words make one shingle."""
    n = len(hashes)
    counts = np.diff(bounds)
    left = np.repeat(bounds[1:], counts) - np.arange(n)
    made = np.zeros(n, np.uint64)
    weights = mixed(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    for j in range(min(k, n)):
        here = hashes[j:] * weights[j]
        if j:
            here[left[: n - j] <= j] = 0
        made[: n - j] += here
    whole = left >= k
    starts = bounds[:-1][(counts > 0) & (counts < k)]
    whole[starts] = True
    return mixed(made[whole]), np.concatenate(([0], np.cumsum(whole)))[bounds]


def gram_hashes(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``n`` bytes in a row, for ``n`` up to 8, and each text's bounds in them; none cross texts."""
    size = len(data)
    if size < n:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    packed = np.zeros(size - n + 1, np.uint64)
    for k in range(n):
        packed = (packed << np.uint64(8)) | data[k : size - n + 1 + k]
    ends = np.maximum(offsets[1:] - n + 1, offsets[:-1])
    whole = np.zeros(size + 1, np.int8)
    np.add.at(whole, offsets[:-1], 1)
    np.add.at(whole, ends, -1)
    inside = np.cumsum(whole[: len(packed)]) > 0
    return mixed(packed[inside] + np.uint64(n)), np.concatenate(([0], np.cumsum(np.maximum(ends - offsets[:-1], 0))))
