"""Packing, id files, token counts and the mix against brute force and the tokenizers library."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import oracle
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gradeflow.llm import id_files, mixing, packing, queries, subwords, token_counts
from gradeflow.session import fresh_path


def library_ids(path, texts):
    tokenizer = Tokenizer.from_file(path)
    return [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize(("path", "drops", "kind"), [(queries.BYTE_TOKENIZER, False, "<u4"), (queries.WORD_TOKENIZER, True, "<u2")])
def test_chunks_give_the_ids_of_the_whole_text(small, path, drops, kind):
    marks = ["a", "B", "é", "ß", "'s", "'", "ll", " ", "  ", "\n", "\t", " ", "　", "\x1c", "9", "½", ",", ".", "!", "%%", "İ", "́", "한", "👍", "\r\n", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "?", "ſ", "Σ", "ς"]
    pick = random.Random(3)
    texts = [r["text"] for r in small.collect()] + ["".join(pick.choices(marks, k=pick.randint(0, 25))) for _ in range(4000)]
    coder = subwords.Subwords(path, drops, kind)
    assert [np.frombuffer(coder.encode(t), kind).tolist() for t in texts] == library_ids(path, texts)


@pytest.mark.parametrize(("path", "drops", "kind"), [(queries.BYTE_TOKENIZER, False, "<u4"), (queries.WORD_TOKENIZER, True, "<u2")])
def test_chunks_with_a_mark_are_worked_out_once(path, drops, kind):
    coder = subwords.Subwords(path, drops, kind)
    words = ["Oval,", "oval", "oval.", "ßaá!"]
    first = coder.encode(" ".join(words))
    assert set(words) <= {*coder.plain, *coder.spaced}
    coder.plain.encode = coder.spaced.encode = None
    assert coder.encode(" ".join(words)) == first and np.frombuffer(first, kind).tolist() == library_ids(path, [" ".join(words)])[0]


@pytest.mark.parametrize(("path", "drops", "kind"), [(queries.BYTE_TOKENIZER, False, "<u4"), (queries.WORD_TOKENIZER, True, "<u2")])
@pytest.mark.parametrize("remembered", [50, 1_000_000])
def test_texts_encoded_together_have_the_ids_of_the_library(small, path, drops, kind, remembered):
    marks = ["a", "B", "é", "É", "ß", "'s", "'", "ll", " ", " ", "\n", "\t", "\xa0", "9", "½", ",", "...", "!", "%%", "</w>", "İ", "\u0301", "한", "ᄀ", "ᅡ", "👍", "<|endoftext|>", "<|", "ſ", "Σ", "ς", "\U0002ebf0", "ª"]
    pick = random.Random(4)
    texts = ["", " ", *["".join(pick.choices(marks, k=pick.randint(0, 25))) for _ in range(2000)], *[r["text"] for r in small.limit(200).collect()]]
    coder = subwords.Subwords(path, drops, kind, remembered)
    made = [ids for size in (1, 7, len(texts)) for at in range(0, len(texts), size) for ids in coder.encode_all(texts[at : at + size])]
    assert [np.frombuffer(ids, kind).tolist() for ids in made] == library_ids(path, texts) * 3
    assert coder.encode_all([]) == [] and len(coder.plain) <= remembered


def test_new_words_are_encoded_in_one_call():
    coder = subwords.Subwords(queries.WORD_TOKENIZER, True, "<u2")
    texts = [" ".join(f"{a}{b}ovél{end}" for b in "abcdefgh") for a in "KLMNOP" for end in ("", ",", "###")]
    one, batch, calls = coder.plain.encode, coder.plain.batch, []
    coder.plain.encode = lambda text, **how: calls.append(text) or one(text, **how)
    coder.plain.batch = lambda texts, **how: calls.append(texts) or batch(texts, **how)
    assert [np.frombuffer(ids, "<u2").tolist() for ids in coder.encode_all(texts)] == library_ids(queries.WORD_TOKENIZER, texts)
    assert len(calls) <= 4


def test_packing(messy, none):
    rows = [((r["doc_id"] or 0), r["text"] or "") for r in messy.collect()]
    ids = Counter()
    for (doc, _), own in zip(rows, library_ids(queries.BYTE_TOKENIZER, [t for _, t in rows]), strict=True):
        own = [*own, 2]
        at, size, piece = 0, (len(own) - 1) % 1024 + 1, 0
        while at < len(own):
            ids[(doc, piece, at, size, zlib.crc32(np.array(own[at : at + size], "<u4").tobytes()))] += 1
            at, size, piece = at + size, 1024, piece + 1
    made = packing.pack(messy, queries.BYTE_TOKENIZER).collect()
    assert Counter(((r["doc_id"] or 0), *tuple(r)[1:5]) for r in made) == ids
    bins = defaultdict(list)
    for r in made:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 1024
    assert packing.pack(none, queries.BYTE_TOKENIZER).count() == 0


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30)))
@settings(max_examples=100, deadline=None)
def test_best_fit_places_every_piece_as_one_by_one(counts):
    capacity, room = 40, []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [k for k, r in enumerate(room) if r >= length]
            if fits:
                room[min(fits, key=room.__getitem__)] -= length
            else:
                room.append(capacity - length)
    spans, placed = defaultdict(list), Counter()
    for length, first_rank, pieces, first_bin, per_bin, start in packing.best_fit(counts.items(), capacity):
        assert placed[length] == first_rank
        placed[length] += pieces
        for k in range(pieces):
            spans[first_bin + k // per_bin].append((start + k % per_bin * length, length))
    assert placed == Counter(counts) and len(spans) == len(room)
    for places in spans.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= capacity


@given(st.lists(st.integers(1, 10_000), min_size=1, max_size=60))
@settings(max_examples=60, deadline=None)
def test_codes(counts):
    lengths = id_files.code_lengths(np.array(counts), 7)
    assert lengths.max() <= 7 and (len(counts) == 1 or sum(2.0**-n for n in lengths.tolist()) == 1)
    ids = np.random.default_rng(1).integers(0, len(counts), 700) * 3
    code = id_files.Code(np.arange(len(counts)) * 3, lengths)
    payload, marks = code.encode(ids)
    assert code.decode(payload, marks, len(ids)).tolist() == ids.tolist()


def test_id_files(spark, messy, none):
    rows = sorted(((r["doc_id"] or 0), r["text"] or "") for r in messy.collect())
    own = [[*x, 2] for x in library_ids(queries.WORD_TOKENIZER, [t for _, t in rows])]
    made = sorted(((r["doc_id"] or 0), r["start"], r["n_tokens"], r["ids_crc32"]) for r in id_files.round_trip(messy, queries.WORD_TOKENIZER, fresh_path(spark, "t")).collect())
    starts = np.cumsum([0, *map(len, own)]).tolist()
    assert made == [(d, s, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (d, _), s, x in zip(rows, starts, own, strict=False)]
    assert id_files.round_trip(none, queries.WORD_TOKENIZER, fresh_path(spark, "t")).count() == 0


def test_token_counts(messy, none):
    pieces = set(token_counts.read_pieces(queries.PIECES))
    longest = max(map(len, pieces))

    def greedy(word):
        n = 0
        while word:
            word, n = word[next(k for k in range(min(longest, len(word)), 0, -1) if word[:k] in pieces) :], n + 1
        return n

    rows = [((r["doc_id"] or 0), r["text"] or "") for r in messy.collect()]
    expected = [(d, len(t.encode().split()), sum(greedy(b" " + w) for w in t.encode().split())) for d, t in rows]
    made = [((r["doc_id"] or 0), r["n_words"], r["n_tokens"]) for r in token_counts.token_counts(messy, queries.PIECES).collect()]
    assert sorted(made) == sorted(expected) and token_counts.token_counts(none, queries.PIECES).count() == 0


def test_mix_equals_sql(spark, folder):
    con = oracle.connect(folder)
    assert oracle.differences(queries.mixed(spark, folder), con, queries.MIX_SQL) == []


def test_messy_mix(messy, none):
    made = mixing.mix(messy).collect()
    sources = {r["source"]: (r["source_size"], r["target"]) for r in made}
    assert abs(sum(t for _, t in sources.values()) - 1.5 * sum(n for n, _ in sources.values())) < 1e-6
    assert all(t <= 2 * n for n, t in sources.values()) and all(r["taken"] <= 2 * r["size"] for r in made)
    assert mixing.mix(none).count() == 0
    mixture = mixing.mixture(messy)
    assert mixture.columns == messy.columns and mixture.count() == sum(r["copies"] for r in made)
    assert {r["size"] for r in mixture.collect()} == {"extra"}
