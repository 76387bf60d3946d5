"""Each stage of the pipeline on what the one before kept, against brute force."""

from __future__ import annotations

import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from test_pairs import least_reachable, shingles, windows_of, words
from test_tokens import library_ids

import corpus_pipeline
from gradeflow.llm import queries, toxicity
from gradeflow.llm.common import stored


def rows_of(docs):
    return [tuple(r) for r in docs.select("doc_id", "text").collect()]


def not_toxic(model, text):
    data = np.frombuffer((text or "").encode(), np.uint8)
    made, _ = toxicity.feature_places(data, np.array([0, len(data)]))
    buckets = {int(b) for kind in made for b in kind}
    raw = sum(float(model.weights[b]) for b in buckets) + model.offset
    return 1 / (1 + np.exp(-(model.slope * raw + model.shift))) < 0.5


def kept_of_each_group(rows):
    sets = [(doc, shingles(text, 5)) for doc, text in rows if doc is not None]
    linked = [(a, b) for n, (a, x) in enumerate(sets) for b, y in sets[:n] if x and y and 100 * len(x & y) >= 80 * len(x | y)]
    least = least_reachable([a for a, _ in sets], linked)
    return {a for a in least if least[a] == a}


def cut_words(rows):
    own = [(doc, words(text)) for doc, text in rows]
    seen = windows_of(own)
    cut = {doc: {w for k in range(len(x) - 49) if min(seen[tuple(x[k : k + 50])]) < doc for w in range(k, k + 50)} for doc, x in own}
    return {doc: [w for k, w in enumerate(x) if k not in cut[doc]] for doc, x in own if not x or len(cut[doc]) < len(x)}


def taken(docs, path):
    docs.write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    return {doc: total // size for doc, size, total in con.execute(f"SELECT doc_id, size, taken FROM ({queries.MIX_SQL})").fetchall() if size}


def pieces_of(rows):
    made = Counter()
    for (doc, _), own in zip(rows, library_ids(queries.BYTE_TOKENIZER, [t or "" for _, t in rows]), strict=True):
        ids, at, piece = [*own, 2], 0, 0
        size = (len(ids) - 1) % 1024 + 1
        while at < len(ids):
            made[(doc, piece, at, size, zlib.crc32(np.array(ids[at : at + size], "<u4").tobytes()))] += 1
            at, size, piece = at + size, 1024, piece + 1
    return made


def test_stages_equal_brute_force(spark, small, folder, tmp_path):
    stage = dict(corpus_pipeline.STAGES)
    model = toxicity.train(small, spark.read.parquet(f"{folder}/labels.parquet"))
    clean = stored(stage["toxicity"](spark, small, folder), "t")
    assert sorted(rows_of(clean)) == sorted((d, t) for d, t in rows_of(small) if not_toxic(model, t))
    one = stored(stage["near_dedup"](spark, clean, folder), "t")
    assert sorted(d for d, _ in rows_of(one)) == sorted(kept_of_each_group(rows_of(clean))) and one.count() < clean.count()
    cut = stored(stage["passage_dedup"](spark, one, folder), "t")
    assert {d: words(t) for d, t in rows_of(cut)} == cut_words(rows_of(one))
    mixed = stored(stage["mix"](spark, cut, folder), "t")
    copies = taken(cut, str(tmp_path / "cut"))
    found = Counter(d for d, _ in rows_of(mixed))
    assert all(found[d] == n for d, n in copies.items()) and sum(copies.values()) > 0
    packed = stage["pack"](spark, mixed, folder).collect()
    assert Counter(tuple(r)[:5] for r in packed) == pieces_of(rows_of(mixed))
    ends = Counter()
    for r in packed:
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 1024


@pytest.mark.parametrize("name", ["messy", "none"])
def test_stages_take_any_rows(spark, request, folder, name):
    docs = request.getfixturevalue(name)
    columns, before = docs.columns, {(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()}
    for label, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, folder), label)
        assert docs.columns == columns
        rows = rows_of(docs)
        if label in ("toxicity", "near_dedup"):
            assert set(rows) <= before
        if label == "near_dedup" and name == "messy":
            ids = [d for d, _ in rows if d is not None]
            assert len(ids) == len(set(ids)) and {5, 6, 7} <= set(ids) and None in {d for d, _ in rows}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert pieces.where("piece = 0").count() == docs.count()
