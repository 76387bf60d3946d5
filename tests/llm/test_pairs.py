"""Near duplicates, components, passages and fingerprints against brute force."""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gradeflow.llm import common, components, fingerprints, hashing, near_dedup, passages

LOWER = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, k):
    found = words((text or "").translate(LOWER))
    return {tuple(found[j : j + k]) for j in range(max(1, len(found) - k + 1))} if found else set()


def least_reachable(ids, linked):
    root = {i: i for i in ids}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize(("k", "numerator"), [(3, 85), (5, 80)])
def test_components_equal_all_pairs(small, k, numerator):
    rows = [(r["doc_id"], shingles(r["text"], k)) for r in small.select("doc_id", "text").collect()]
    linked = [
        (a, b) for n, (a, x) in enumerate(rows) for b, y in rows[:n] if x and y and 100 * len(x & y) >= numerator * len(x | y)
    ]
    expected = least_reachable([a for a, _ in rows], linked)
    made = {r["doc_id"]: r for r in near_dedup.near_duplicates(small, k, numerator).collect()}
    assert {a: (len(x), expected[a], expected[a] == a) for a, x in rows} == {a: (r["n_shingles"], r["component_id"], r["kept"]) for a, r in made.items()}
    assert any(expected[a] != a for a in expected)


def test_many_near_copies_are_one_component(spark):
    base = [f"t{k}" for k in range(200)]
    rows = [(i, " ".join([*base[: i % 190], f"new{i}", *base[i % 190 + 1 :]])) for i in range(400)]
    made = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert {r["component_id"] for r in made} == {0} and sum(r["kept"] for r in made) == 1


def template_rows(n, changed, at):
    """Texts of one template with ``changed`` words of their own each: similar, though seldom enough for a link."""
    base, rng = [f"t{k}" for k in range(150)], np.random.default_rng(5)
    rows = []
    for i in range(n):
        own = list(base)
        for k in rng.choice(150, changed, replace=False):
            own[k] = f"new{at + i}x{k}"
        rows.append((at + i, " ".join(own)))
    return rows


def test_sets_of_a_template_meet_once(spark, monkeypatch):
    rows = template_rows(300, 5, 0)
    rows += [(300 + i, f"{rows[i][1]} end{i}") for i in range(0, 300, 30)]
    rows += [(i, text) for i, (_, text) in zip(range(5, 300, 60), template_rows(5, 2, 1000), strict=True)]  # ids with two texts
    seen, meetings = [], near_dedup._meetings

    def counted(*given):
        made = near_dedup.stored(meetings(*given), "counted")
        seen.append(made.count())
        return made

    monkeypatch.setattr(near_dedup, "_meetings", counted)
    made = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    sets = [(i, shingles(text, 3)) for i, text in rows]
    linked = [(a, b) for n, (a, x) in enumerate(sets) for b, y in sets[:n] if 100 * len(x & y) >= 85 * len(x | y)]
    assert made == least_reachable(sorted({i for i, _ in rows}), linked)
    assert len(set(made.values())) > 200 and sum(seen) <= 9 * len(rows)


def test_messy_near_duplicates(messy, none):
    made = {r["doc_id"]: r for r in near_dedup.near_duplicates(messy, 3, 85).collect()}
    assert [made[k]["component_id"] for k in (1, 2, 3, 4, 5, 6, 7, 10, 11, 14)] == [1, 1, 1, 1, 5, 6, 7, 10, 10, 14]
    assert made[5]["n_shingles"] == 0 and made[8]["n_shingles"] == 1 and made[None]["kept"]
    assert near_dedup.near_duplicates(none).count() == 0
    left = near_dedup.without_near_duplicates(messy)
    assert left.columns == messy.columns
    assert sorted(r["doc_id"] or 0 for r in left.select("doc_id").collect()) == [0, 1, 5, 6, 7, 8, 9, 10, 12, 13, 14, 15, 16, 17]


@pytest.fixture
def tables(spark, tmp_path, monkeypatch):
    """Every intermediate table written in a test, by label: how many files each has; with 64 shuffle partitions that stay as they are."""
    own = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    monkeypatch.setattr(common, "fresh_path", lambda spark, label: f"{tmp_path}/shared/{label}-{uuid.uuid4().hex}")
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)

    def found():
        made = defaultdict(list)
        for folder in (tmp_path / "shared").iterdir():
            made[folder.name.split("-")[0]].append(len([*folder.glob("part-*")]))
        return made

    yield found
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_levels_write_few_tables_in_few_files(spark, tables):
    rows = template_rows(1200, 1, 0)
    made = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 3, 85).collect()
    assert {r["component_id"] for r in made} == {0}
    found = tables()
    assert all(n <= spark.sparkContext.defaultParallelism for label, files in found.items() if label != "sets" for n in files)
    levels = len(found["inside"])
    assert all(len(found[label]) <= levels for label in ("placed", "meetings", "labels")) and found.keys() <= {
        "sketches", "reps", "roots", "close", "candidates", "sets", "placed", "inside", "meetings", "stars", "labels"
    }


def test_links_that_are_stars_need_no_round(spark, tables):
    links = [(k, k % 7) for k in range(7, 300)]
    made = components.stars(spark.createDataFrame([*links, (3, 3), (9, 2), (2, 9)], "a long, b long"), rows=300)
    assert {(r["a"], r["b"]) for r in made.collect()} == {*links}
    files = tables()["stars"]
    assert len(files) == 1 and files[0] <= spark.sparkContext.defaultParallelism


def test_linked_parts_lead_to_the_least(spark):
    rows = [(k, k, np.sort(np.r_[np.arange(40), 1000 + k].astype(np.uint64))) for k in (9, 5, 7, 2)] + [(1, 1, np.arange(60, 90, dtype=np.uint64))]
    assert sorted(near_dedup._joined(rows[:1], rows[1:], 85, 100)) == [(5, 2), (7, 2), (9, 2)]


@pytest.mark.parametrize("links", [[], [(1, 2)], [(k, k + 1) for k in range(60)], [(5, 1), (5, 9), (9, 3), (7, 8), (8, 7), (4, 4)]])
def test_stars(spark, links):
    made = components.stars(spark.createDataFrame(links, "a long, b long"))
    expected = least_reachable(sorted({x for link in links for x in link}), links)
    assert {(r["a"], r["b"]) for r in made.collect()} == {(a, b) for a, b in expected.items() if a != b}


def test_passages_equal_all_windows(spark, small):
    rows = [(r["doc_id"], words(r["text"])) for r in small.collect()]
    seen = defaultdict(set)
    for doc, own in rows:
        for k in range(len(own) - 49):
            seen[tuple(own[k : k + 50])].add(doc)
    expected, made = defaultdict(set), defaultdict(set)
    for doc, own in rows:
        for k in range(len(own) - 49):
            if len(seen[tuple(own[k : k + 50])]) > 1:
                expected[doc].update(range(k, k + 50))
    for r in passages.repeated_passages(small).collect():
        made[r["doc_id"]].update(range(r["start"], r["end"]))
    assert made == expected and expected


def windows_of(rows, n=50):
    """The documents of each window."""
    seen = defaultdict(set)
    for doc, own in rows:
        for k in range(len(own) - n + 1):
            seen[tuple(own[k : k + n])].add(doc)
    return seen


def spans_by_windows(rows):
    """The spans by brute force: windows of 50 words that touch, each with its own least document."""
    seen, expected = windows_of(rows), set()
    for doc, own in rows:
        for is_first in (False, True):
            runs = []
            for k in range(len(own) - 49):
                docs = seen[tuple(own[k : k + 50])]
                if len(docs) == 1 or (min(docs) == doc) != is_first:
                    continue
                if runs and k <= runs[-1][1]:
                    runs[-1] = (runs[-1][0], k + 50, min(runs[-1][2], min(docs)))
                else:
                    runs.append((k, k + 50, min(docs)))
            expected |= {(doc, *run, is_first) for run in runs}
    return expected


def fresh_words(pick, n):
    return [f"f{x:x}" for x in pick.integers(0, 2**60, n)]


@pytest.mark.parametrize("partitions", [4, 40])
def test_passages_behind_shared_beginnings(spark, partitions):
    """Hundreds of documents hold the same 30 to 45 words; a few pairs share 55 with these at the end or the start."""
    pick = np.random.default_rng(3)
    common, texts = fresh_words(pick, 45), {}
    for doc in range(600):
        n = int(pick.integers(30, 46))
        texts[doc] = [*fresh_words(pick, 40), *common[:n], *fresh_words(pick, 60)]
    for pair in range(60):
        n = int(pick.integers(38, 46))
        lead = fresh_words(pick, 55 - n)
        for doc in (600 + pair, 700 + pair):
            ends = [*lead, *common[:n]] if pair % 2 else [*common[-n:], *lead]
            texts[doc] = [*fresh_words(pick, 30), *ends, *fresh_words(pick, 60)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        docs = spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()], "doc_id long, text string")
        made = {tuple(r) for r in passages.repeated_passages(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {r[0] for r in made} >= {*range(600, 660), *range(700, 760)}
    assert made == spans_by_windows([*texts.items()])


def shared_cores() -> dict[int, list[str]]:
    """Different passages with the same 30 words within, passages that one document has only in part, chains, copies."""
    pick = np.random.default_rng(5)
    fresh = lambda n: fresh_words(pick, n)
    core, long, chain = fresh(30), fresh(75), fresh(200)
    passages_of = [[*fresh(15), *core, *fresh(15)] for _ in range(2)]
    texts = {doc: [*fresh(20), *passages_of[doc // 2], *fresh(20)] for doc in range(4)}
    texts |= {4: [*fresh(9), *long[:50], *fresh(9)], 5: [*fresh(9), *long, *fresh(9)], 6: [*fresh(30), *long]}
    texts |= {7 + k: [*fresh(9), *chain[20 * k : 20 * k + 80], *fresh(9)] for k in range(6)}
    copy = [*fresh(30), *passages_of[0], *fresh(30)]
    return texts | {20: copy, 21: copy, 22: copy[::-1], 23: [*copy, "end"]}


def test_passages_have_the_first_document_of_each_window(spark):
    texts = shared_cores()
    docs = spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()], "doc_id long, text string")
    made = {tuple(r) for r in passages.repeated_passages(docs).collect()}
    assert made == spans_by_windows([*texts.items()])
    assert {r[3] for r in made if r[0] == 3} == {2}


def test_what_is_cut_stays_elsewhere(spark, small):
    for docs in (spark.createDataFrame([(k, " ".join(v)) for k, v in shared_cores().items()], "doc_id long, text string"), small):
        rows = [(r["doc_id"], words(r["text"])) for r in docs.collect()]
        seen, left = windows_of(rows), {r["doc_id"]: words(r["text"]) for r in passages.without_repeats(docs).collect()}
        for doc, own in rows:
            cut = {w for k in range(len(own) - 49) if min(seen[tuple(own[k : k + 50])]) < doc for w in range(k, k + 50)}
            assert left.get(doc, []) == [w for k, w in enumerate(own) if k not in cut]
        assert {w for _, own in rows for w in own} == {w for own in left.values() for w in own}


def test_messy_passages(messy, none):
    spans = {(r["doc_id"], r["is_first"]): (r["start"], r["end"], r["first_doc_id"]) for r in passages.repeated_passages(messy).collect()}
    assert spans[(2, False)] == (0, 120, 1)
    assert spans[(11, False)] == (0, 40_000, 10) and spans[(10, True)] == (0, 40_000, 10)
    assert spans[(13, False)][2] in (1, 12) and spans[(13, False)][:2] == (0, 60)
    assert passages.repeated_passages(none).count() == 0
    left = passages.without_repeats(messy)
    assert left.columns == messy.columns and passages.without_repeats(none).count() == 0
    texts = {r["doc_id"]: r["text"] for r in left.collect()}
    assert 2 not in texts and texts[11].strip() == "end" and texts[6] == "" and texts[5] is None and None in texts


TEXT = st.text(alphabet="ab é👍\n", max_size=60)


@given(TEXT, TEXT)
@settings(max_examples=60, deadline=None)
def test_prefix_hashes(x, y):
    a, b = fingerprints.PrefixHashes(x), fingerprints.PrefixHashes(y)
    for i in range(len(x)):
        for j in range(0, len(y), 3):
            common = next((k for k in range(min(len(x) - i, len(y) - j)) if x[i + k] != y[j + k]), min(len(x) - i, len(y) - j))
            assert fingerprints.common_extension(a, i, b, j) == common
    f, g = fingerprints.fingerprint(x), fingerprints.fingerprint(y)
    assert (f == g) == (x == y) and 0 <= fingerprints.likeness(f, g) <= 1 and fingerprints.likeness(f, f) == 1


@pytest.mark.parametrize("slices", [0, 3])
def test_neighbours(messy, small, none, slices):
    for docs in (small, messy):
        rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
        expected = []
        for k, (doc, text) in enumerate(rows):
            other, half = rows[(k + 1) % len(rows)][1], len(text) // 2
            edited = text[: len(text) - half] + other[:half]
            own, changed, following = map(fingerprints.fingerprint, (text, edited, other))
            expected.append((doc or 0, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, changed, fingerprints.likeness(own, changed), fingerprints.likeness(own, following), len(os.path.commonprefix([text, edited])), len(os.path.commonprefix([text, other]))))
        made = [(r["doc_id"] or 0, *tuple(r)[1:]) for r in fingerprints.neighbour_fingerprints(docs, slices).collect()]
        assert sorted(made) == sorted(expected)
    assert fingerprints.neighbour_fingerprints(none).count() == 0


def test_likeness_is_that_of_the_spans():
    """Against the share of different spans that both texts have; 64 least hashes estimate it to about 0.06."""
    pick = np.random.default_rng(8)
    text = "".join(pick.choice(list("abcdefgh é"), 4000))
    errors = []
    for cut in range(0, 4001, 400):
        other = text[:cut] + "".join(pick.choice(list("abcdefgh é"), 4000 - cut))
        spans = [{t[k : k + fingerprints.SPAN] for k in range(len(t) - fingerprints.SPAN + 1)} for t in (text, other)]
        true = len(spans[0] & spans[1]) / len(spans[0] | spans[1])
        errors.append(abs(fingerprints.likeness(*map(fingerprints.fingerprint, (text, other))) - true))
    assert max(errors) < 0.2 and sum(errors) / len(errors) < 0.07


@given(st.lists(st.text(alphabet="aB é\n\t　한", max_size=30), min_size=1, max_size=5))
@settings(max_examples=80, deadline=None)
def test_word_hashes(texts):
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    found = hashing.words_of(data, offsets)
    each = [words(t) for t in texts]
    assert found.counts.tolist() == [len(w) for w in each]
    flat = [w for own in each for w in own]
    hashes = hashing.word_hashes(data, found).tolist()
    assert len({*zip(flat, hashes, strict=True)}) == len({*flat}) == len({*hashes})
    grams, bounds = hashing.gram_hashes(data, offsets, 3)
    assert np.diff(bounds).tolist() == [max(0, len(r) - 2) for r in raw]
    assert len({*grams.tolist()}) == len({r[k : k + 3] for r in raw for k in range(len(r) - 2)})
