"""Token ids of whole texts by a tokenizer file of the tokenizers library, one white-space chunk at a time.

The tokenizers used here cut a text before they merge, and never join what a space or line end between
two other characters separates. So a text's ids are those of its chunks in a row, and each worker encodes
a chunk that it has met before by lookup. Where every piece of a text ends with an id that marks a word's end, the words
that are new to a batch of texts are encoded in one call and cut after those ids. The strings of the file's special tokens are cut out first, as the library does,
and give their own ids. Tests hold the result against the library on whole texts.
"""

from __future__ import annotations

import json
import re
import string
import struct
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

# Chunks that a worker remembers, some 200 bytes each; those met later are encoded each time. It only bounds memory.
REMEMBERED = 1_000_000
LONGEST_REMEMBERED = 48
# New words that are encoded in one call.
AT_ONCE = 5_000
# Types of the ids and their letters in struct.
_PACKED = {"<u2": "H", "<u4": "I"}
_OTHER_BLANK = re.compile(r"[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_LINE_END = re.compile(r"(?<=\S)\n(?=\S)")
_SPACE = re.compile(r"(?<=\S) (?=\S)")
# What is cut off the end of a word: an apostrophe isn't, as it may begin a piece with letters.
_MARKS = string.punctuation.replace("'", "")


def _neat(text: str) -> bool:
    """Every blank is a space or line end between two other characters."""
    if "  " in text or " \n" in text or "\n " in text or "\n\n" in text or _OTHER_BLANK.search(text):
        return False
    return not (text[0].isspace() or text[-1].isspace())


def _word_ends(tokenizer: Tokenizer) -> np.ndarray | None:
    """Which ids end a piece, if each piece has just one that does, the last; else None."""
    suffix = json.loads(tokenizer.to_str())["model"].get("end_of_word_suffix")
    vocabulary = tokenizer.get_vocab()
    if not suffix or not all(c in vocabulary and c + suffix in vocabulary for c in ByteLevel.alphabet()):
        return None  # bytes without an id would be left out
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    ends[[i for text, i in vocabulary.items() if text.endswith(suffix)]] = True
    return ends


class _Ids(dict):
    """Chunk to ids as little-endian bytes, found on demand. ``before`` is put in front of the chunk.

    A mark after letters alone, in lower case too, is a chunk of its own to both tokenizers.
    """

    def __init__(self, tokenizer: Tokenizer, before: str, kind: str, remembered: int) -> None:
        super().__init__()
        self.encode, self.before, self.kind, self.remembered = tokenizer.encode, before, kind, remembered
        self.batch = tokenizer.encode_batch_fast
        self.lowers = tokenizer.normalizer is not None and tokenizer.normalizer.normalize_str("AZ") == "az"
        self.marks = {m: self._ids(m) for m in ",.;:!?"}

    def _ids(self, text: str) -> bytes:
        ids = self.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}{_PACKED[self.kind]}", *ids)

    def learn(self, chunks: set[str], ends: np.ndarray) -> dict[str, bytes]:
        """The ids of chunks that aren't remembered; words, with or without marks behind, are encoded in one call."""
        words, tails, made = {}, {"": b""}, {}
        for chunk in chunks:
            word = chunk.rstrip(_MARKS)
            if word and (word + word.lower()).isalpha():
                words[chunk] = word.lower() if self.lowers and word.isascii() else word
        known = {word: self.get(word) for word in words.values()}
        new = [word for word, ids in known.items() if ids is None]
        for at in range(0, len(new), AT_ONCE):
            own = new[at : at + AT_ONCE]
            ids = np.array(self.batch([" ".join(own)], add_special_tokens=False)[0].ids, self.kind)
            bounds = ((np.flatnonzero(ends[ids]) + 1) * ids.itemsize).tolist()
            if len(bounds) == len(own):
                packed = ids.tobytes()
                known.update((word, packed[a:b]) for word, a, b in zip(own, [0, *bounds], bounds, strict=False))
            else:  # a letter that isn't one to the tokenizer
                known.update((word, self._ids(self.before + word)) for word in own)
        for chunk, word in words.items():
            tail = chunk[len(word) :]
            if tail not in tails:
                tails[tail] = self._ids(tail)
            made[chunk] = known[word] + tails[tail]
        made.update((chunk, self._ids(self.before + chunk)) for chunk in chunks if chunk not in words)
        self.update((chunk, made[chunk]) for chunk in list(made)[: max(0, self.remembered - len(self))] if len(chunk) <= LONGEST_REMEMBERED)
        return made

    def __missing__(self, chunk: str) -> bytes:
        if chunk[-1:] in self.marks and (chunk[:-1] + chunk[:-1].lower()).isalpha():
            ids = self[chunk[:-1]] + self.marks[chunk[-1]]
        else:
            ids = self._ids(self.before + chunk)
        if len(chunk) <= LONGEST_REMEMBERED and len(self) < self.remembered:
            self[chunk] = ids
        return ids


class Subwords:
    """``kind`` is the numpy type of the ids. ``drops_space``: white space gives no ids; else it is part of them."""

    def __init__(self, path: str, drops_space: bool, kind: str, remembered: int = REMEMBERED) -> None:
        tokenizer = Tokenizer.from_file(path)
        special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.special = {text: np.array([i], kind).tobytes() for text, i in special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.mark = next(iter(special))[:2] if len({text[:2] for text in special}) == 1 else ""
        self.drops_space, self.kind = drops_space, kind
        self.ends = _word_ends(tokenizer) if drops_space else None
        self.plain, self.spaced = (_Ids(tokenizer, before, kind, remembered) for before in ("", " "))

    def encode(self, text: str) -> bytes:
        """The ids of a whole text; none are added for its ends."""
        if self.cut and self.mark in text:
            parts = self.cut.split(text)
            return b"".join(self._ordinary(p) if k % 2 == 0 else self.special[p] for k, p in enumerate(parts))
        return self._ordinary(text)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """:meth:`encode` of each text."""
        if self.ends is None:
            return [self.encode(text) for text in texts]
        made, unknown = [], []
        for k, text in enumerate(texts):
            if self.cut and self.mark in text:
                made.append([self.encode(text)])
                continue
            chunks = text.replace("\n", " ").split(" ")
            made.append(list(map(self.plain.get, chunks)))
            unknown += [(k, at, chunks[at]) for at, ids in enumerate(made[-1]) if ids is None]
        learned = self.plain.learn({chunk for _, _, chunk in unknown}, self.ends)
        for k, at, chunk in unknown:
            made[k][at] = learned[chunk]
        return [b"".join(ids) for ids in made]

    def _ordinary(self, text: str) -> bytes:
        if self.drops_space:
            return b"".join(map(self.plain.__getitem__, text.replace("\n", " ").split(" ")))
        if not text:
            return b""
        neat = _neat(text)
        lines = text.split("\n") if neat else _LINE_END.split(text)
        made = []
        for line in lines:
            first, *rest = line.split(" ") if neat else _SPACE.split(line)
            made.append(self.plain[first] + b"".join(map(self.spaced.__getitem__, rest)))
        return self.plain["\n"].join(made)


@lru_cache(maxsize=4)
def subwords(path: str, drops_space: bool, kind: str = "<u4", remembered: int = REMEMBERED) -> Subwords:
    """One encoder for each worker and file."""
    return Subwords(path, drops_space, kind, remembered)
