"""Hard negatives, importance resampling and decontamination against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import oracle
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gradeflow.llm import decontamination, hard_negatives, importance, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_importance", "op13_decontamination"])
def test_equal_to_sql(spark, name):
    folder = "/root/testdata/sf0.01"
    assert oracle.differences(queries.QUERIES[name](spark, folder), oracle.connect(folder), queries.ORACLES[name]) == []


@given(st.lists(st.binary(max_size=40), max_size=30))
@settings(max_examples=60, deadline=None)
def test_crcs(features):
    assert importance.crc32s(pa.array(features, pa.binary())).tolist() == [zlib.crc32(f) for f in features]


def drawn(rows, target, longest, buckets, least, percent):
    runs = lambda own: [" ".join(own[k : k + n]) for n in range(1, longest + 1) for k in range(len(own) - n + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    texts = [(doc, words(text)) for doc, text in rows]
    s = Counter(bucket(f) for _, own in texts for f in runs(own))
    t = Counter(bucket(f) for text in target for f in runs(words(text)))
    made = []
    for doc, own in texts:
        gains = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in map(bucket, runs(own))]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        made.append([doc, len(gains), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(own)])
    able = sorted((r for r in made if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in made)


@pytest.mark.parametrize(("longest", "buckets"), [(1, 10_000), (3, 70_000)])
def test_resampling(spark, messy, none, folder, longest, buckets):
    target = spark.read.parquet(f"{folder}/benchmark.parquet")
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    made = importance.resample(messy, target, longest, buckets, least_words=2, percent=40)
    assert Counter(map(tuple, made.collect())) == drawn(rows, [r["text"] for r in target.collect()], longest, buckets, 2, 40)
    assert importance.resample(none, target, longest, buckets).count() == 0
    empty = importance.resample(messy, none, longest, buckets, least_words=2, percent=40)
    assert Counter(map(tuple, empty.collect())) == drawn(rows, [], longest, buckets, 2, 40)


def brute_hits(rows, items, size, stretch):
    windows = {}
    for item, text in items:
        own = words(text)
        for k in range(max(1, len(own) - size + 1) if own else 0):
            windows.setdefault(tuple(own[k : k + size]), set()).add(item or "")
    made = []
    for doc, text in rows:
        own = words(text)
        hit, exact, near = set(), set(), set()
        for window, of in windows.items():
            n = len(window)
            places = [k for k in range(len(own) - n + 1) if tuple(own[k : k + n]) == window]
            hit.update(k + j for k in places for j in range(n))
            exact |= of if places else set()
            if set(window) <= set(own) and any(set(window) <= set(own[k : k + stretch]) for k in range(len(own))):
                near |= of
        made.append((doc, len(own), len(hit), tuple(sorted(exact)), tuple(sorted(near - exact)), len(hit) > 0))
    return Counter(made)


def found(docs, items, **how):
    made = decontamination.decontaminated(docs, items, **how).collect()
    for r in made:
        assert sum(s["end"] - s["start"] for s in r["spans"] or []) >= r["n_hit"]
    return Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), tuple(r["near"]), r["contaminated"]) for r in made)


@pytest.mark.parametrize(("size", "stretch", "block"), [(10, 20, 500_000), (3, 7, 500_000), (4, 4, 40), (1, 2, 40)])
def test_decontamination_with_few_different_words(spark, size, stretch, block):
    """Few words make many windows that nearly match, repeated terms, and windows that several items share."""
    pick = random.Random(size)
    text = lambda n: " ".join(pick.choices("A b Cc d1 é f g 0".split(), k=n))
    rows = [(k % 50, text(pick.choice([0, 1, 3, 12, 60]))) for k in range(60)] + [(None, text(30)), (77, None)]
    items = [(f"i{k % 17}", text(pick.choice([0, 1, 2, 5, 12]))) for k in range(20)] + [(None, text(4)), ("none", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(items, "item_id string, text string")
    assert found(docs, asked, window=size, stretch=stretch, block_words=block) == brute_hits(rows, items, size, stretch)


def test_messy_decontamination(spark, messy, none, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    items = [("a", rows[0][1]), ("b", "one"), ("c", "w " * 12), ("d", None), ("e", ""), ("f", "x39990 x39991 x39992 x39993 x39994 x39995 x39996 x39997 x39998 x39999 END")]
    asked = spark.createDataFrame(items, "item_id string, text string").selectExpr("*", "'extra' AS segment", "'extra' AS spans")
    expected = brute_hits(rows, items, 10, 20)
    assert found(messy, asked) == expected
    monkeypatch.setattr(decontamination, "vocabulary", lambda items: None)  # an index of all terms gives the same
    assert found(messy, asked) == expected
    assert found(none, asked) == Counter() and all(not r[5] for r in found(messy, none.withColumnRenamed("doc_id", "item_id")))


def brute_negatives(rows, every, positives, negatives):
    kept = {}
    for key, vector, label in rows:
        if key is None or vector is None or label is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        row = ((label + 1) % 10 if key % 7 == 0 else label, [math.floor(256 * x) for x in vector])
        kept[key] = min(row, kept.get(key, row))
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    made = []
    for anchor in (k for k in kept if k % every == 0):
        label, vector = kept[anchor]
        others = sorted((-score(vector, v), k, own == label) for k, (own, v) in kept.items() if k != anchor)
        for down, positive, _ in [o for o in others if o[2]][:positives]:
            fits = [o for o in others if not o[2] and -30 * down <= -100 * o[0] <= -90 * down]
            made += [(anchor, positive, n + 1, o[1], -down, -o[0]) for n, o in enumerate(fits[:negatives])]
    return Counter(made)


@pytest.mark.parametrize(("every", "block"), [(5, 1024), (3, 60)])
def test_hard_negatives(spark, every, block):
    pick = np.random.default_rng(block)
    centres = pick.normal(size=(4, 6))
    vectors = [[float(x) for x in np.float32(centres[k % 4] + 0.4 * pick.normal(size=6))] for k in range(240)]
    rows = [(k, v, k % 4) for k, v in enumerate(vectors)]
    rows += [(300 + k, vectors[5], k % 2) for k in range(60)]  # equal vectors, ties
    rows += [(400, None, 1), (405, vectors[0], None), (410, [1.0, None, 0.0], 1), (415, [math.nan] * 6, 1), (420, [math.inf] * 6, 2), (None, vectors[1], 1)]
    rows += [(425, [], 1), (430, [2.0, 1.0], 1), (435, [9.0] * 8, 2), (440, [0.0] * 6, 3), (445, [-9.0] * 6, 3), rows[10], (10, vectors[3], 3)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5).selectExpr("*", "'extra' AS vector", "'extra' AS slot", "'extra' AS row")
    made = hard_negatives.hard_negatives(table, every=every, positives=3, negatives=4, block=block)
    expected = brute_negatives(rows, every, 3, 4)
    assert Counter(map(tuple, made.collect())) == expected and expected
    assert hard_negatives.hard_negatives(table.limit(0)).count() == 0


def test_bounds_leave_rows_unscored():
    pick = np.random.default_rng(1)
    centres = np.repeat(pick.normal(size=(8, 16)) * 2000, 40, axis=0)
    vectors = np.floor(centres + 20 * pick.normal(size=centres.shape))
    labels, ids = np.arange(320) // 40 % 2, np.arange(320)
    tree = hard_negatives.spanning_tree(ids[::4], labels[::4], vectors[::4])
    assert sorted(tree.ids.tolist()) == ids[::4].tolist() and all(p < k for k, p in enumerate(tree.parent))
    best, n = hard_negatives.Best(80, 1, 3), np.full((80, 1), 1e18)
    scored = sum(hard_negatives._offer_rows(tree, ids[k::2], labels[k::2], vectors[k::2], True, -n, n, best) for k in range(2))
    assert scored < 0.7 * 80 * 320
    for k in range(80):
        scores = vectors @ tree.vectors[k]
        allowed = [i for i in range(320) if labels[i] == tree.labels[k] and ids[i] != tree.ids[k]]
        assert best.ids[k, 0].tolist() == sorted(allowed, key=lambda i: (-scores[i], i))[:3]
