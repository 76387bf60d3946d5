"""Lower-cased words of digits, letters and characters beyond ASCII, as Arrow arrays of their bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from gradeflow.llm.hashing import LOWER, words_of

# What cuts terms: every ASCII character that is neither a letter nor a digit.
_CUTS = np.ones(256, bool)
_CUTS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of several texts in a row, A to Z as a to z, and where each text's terms begin in them."""
    words = words_of(data, offsets, cuts=_CUTS)
    ends = np.concatenate(([0], np.cumsum(words.end - words.start))).astype(np.int32)
    chars = LOWER[data[~_CUTS[data]]]
    return pa.Array.from_buffers(pa.binary(), len(words.start), [None, pa.py_buffer(ends), pa.py_buffer(chars)]), words.bounds


def distinct(terms: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The different terms, by their bytes, and the place of each term's own among them."""
    coded = terms.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy()


def parts_of(terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of terms and where each begins."""
    _, starts, data = terms.buffers()
    offsets = np.frombuffer(starts, np.int32)[terms.offset : terms.offset + len(terms) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), offsets
