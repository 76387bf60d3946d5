"""Greedy word-piece token counts by a linear longest-match automaton.

The vocabulary's trie has a failure link at each node: what is left when the longest pieces that are sure by
then are taken off the front. How many pieces that pops is stored beside the link, so counting reads each byte
once and never builds a piece.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeflow.llm.common import map_texts

# Words that a worker remembers; it only bounds memory.
REMEMBERED = 500_000
LONGEST_REMEMBERED = 48


class LongestMatch:
    """Counts the pieces of greedy longest-match segmentation. Every single byte must be a piece."""

    def __init__(self, pieces: Iterable[bytes]) -> None:
        self.step: dict[int, int] = {}  # node * 256 + byte to node
        ends, parents, depth = [False], [(0, 0)], [0]
        for piece in sorted(pieces):
            node = 0
            for byte in piece:
                key = node << 8 | byte
                if key not in self.step:
                    self.step[key] = len(ends)
                    ends.append(False)
                    parents.append((node, byte))
                    depth.append(depth[node] + 1)
                node = self.step[key]
            ends[node] = True
        lacking = [b for b in range(256) if b not in self.step or not ends[self.step[b]]]
        if lacking:
            raise ValueError(f"the vocabulary lacks {len(lacking)} single bytes")
        self.link, self.popped = [0] * len(ends), [0] * len(ends)
        for node in sorted(range(1, len(ends)), key=depth.__getitem__):
            if ends[node]:
                self.popped[node] = 1  # the whole piece is taken; nothing is left
                continue
            parent, byte = parents[node]
            count, at = self.popped[parent], self.link[parent]
            while (at << 8 | byte) not in self.step:
                count += self.popped[at]
                at = self.link[at]
            self.link[node], self.popped[node] = self.step[at << 8 | byte], count

    def count(self, text: bytes) -> int:
        step, link, popped = self.step, self.link, self.popped
        node = total = 0
        for byte in text:
            key = node << 8 | byte
            while key not in step:
                total += popped[node]
                node = link[node]
                key = node << 8 | byte
            node = step[key]
        while node:
            total += popped[node]
            node = link[node]
        return total


class _Counts(dict):
    """Word to token count, found on demand."""

    def __init__(self, automaton: LongestMatch) -> None:
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(b" " + word)
        if len(word) <= LONGEST_REMEMBERED and len(self) < REMEMBERED:
            self[word] = n
        return n


def read_pieces(path: str) -> list[bytes]:
    """The pieces of a rank file: a base64 piece and its rank on each line."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


@lru_cache(maxsize=2)
def counts_of(path: str) -> _Counts:
    return _Counts(LongestMatch(read_pieces(path)))


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, n_words, n_tokens`` of every row by its whole text.

    A word is a run without space, tab and the line ends; with a space before it, its bytes are cut from the left
    into the longest pieces of the vocabulary. Null and empty texts have 0 of both. Null ids and repeated rows
    stay. Other columns are ignored.
    """

    def work(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        known = counts_of(vocabulary)
        # bytes.split() cuts at space, tab and U+000A to U+000D, no more.
        words = [data[a:b].tobytes().split() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        tokens = [sum(map(known.__getitem__, w)) for w in words]
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(map(len, words), pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, "doc_id long, n_words long, n_tokens long")
