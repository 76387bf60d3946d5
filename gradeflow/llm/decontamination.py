"""Benchmark decontamination by a positional inverted index that is split by documents.

A segment of the index is a run of whole documents: its different terms, and for each of them the sorted list of places where it
stands (:func:`index`). A search takes the windows of the benchmark items to every segment, so no postings are shuffled
and no term, however frequent, gathers in one task. In a segment a window's terms are taken from the rarest to the most
frequent: the places of the rarest, less its offset in the window, are where the window may begin, and each further list,
less its own offset, is intersected with what is left. What is left at the end are exact phrases. For matches by proximity
the lists are asked for the nearest places instead, so that all terms lie in one stretch of words, in any order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeflow.llm.common import map_texts, ship, stored
from gradeflow.llm.terms import distinct, terms_of

WINDOW = 10
# Words in which all terms of a window must lie for a match by proximity.
STRETCH = 20
# Places left free between documents, so that nothing reaches from one into the next: the bound of windows and stretches.
GAP = 1 << 10
# An index keeps the terms of the items alone if they are at most so many, else all terms; the matches are the same.
VOCABULARY = 200_000
# Words of items that one pass over the index searches for; more items take more passes.
BLOCK_WORDS = 500_000
# Candidate places that a task holds at once.
CANDIDATES = 1 << 20

INDEX = "doc_ids array<long>, n_words array<long>, terms array<binary>, starts binary, places binary"


def vocabulary(items: DataFrame, most: int = VOCABULARY) -> pa.Array | None:
    """The different terms of the items, or nothing if they are more than ``most``."""

    def work(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([distinct(terms_of(data, offsets)[0])[0]], ["term"])

    found = map_texts(items.select("text"), work, "term binary").distinct().limit(most + 1).collect()
    return pa.array([bytes(r["term"]) for r in found], pa.binary()) if len(found) <= most else None


def index(docs: DataFrame, only: pa.Array | None = None) -> DataFrame:
    """A stored table of segments: ``segment``, its documents in order with their numbers of words, its terms, and ``places``.

    ``places`` has the places of all terms in a row, ``starts`` where each term's begin, both as little-endian 32-bit numbers. A
    document's words stand at running places, ``GAP`` after those of the one before. With ``only`` other terms are left out.
    """

    def work(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        terms, bounds = terms_of(data, offsets)
        counts = np.diff(bounds)
        different, code = distinct(terms)
        place = np.arange(len(terms)) + np.repeat(np.arange(len(counts)) * GAP, counts)
        if only is not None:
            known = pc.is_in(different, value_set=only).to_numpy(zero_copy_only=False)
            kept = known[code]
            code, place = (np.cumsum(known) - 1)[code[kept]], place[kept]
            different = different.filter(pa.array(known))
        order = np.argsort(code, kind="stable")
        starts = np.searchsorted(code[order], np.arange(len(different) + 1))
        columns = [rows.column("doc_id"), pa.array(counts), different]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]
        raw = [pa.array([x.astype("<i4").tobytes()], pa.binary()) for x in (starts, place[order])]
        return pa.RecordBatch.from_arrays([*lists, *raw], ["doc_ids", "n_words", "terms", "starts", "places"])

    made = map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, INDEX)
    return stored(made.withColumn("segment", F.monotonically_increasing_id()), "index")


@dataclass
class Windows:
    """The different windows of some items: places of their terms in ``terms``, padded with -1, and whose they are."""

    terms: pa.Array
    window: np.ndarray
    items: list[str]
    item: np.ndarray
    item_starts: np.ndarray


def windows_of(rows: list[tuple[str, str]], size: int) -> Windows | None:
    """The windows of items ``(id, text)``; an item of fewer terms is one window, one without terms has none."""
    raw = [(text or "").encode() for _, text in rows]
    terms, bounds = terms_of(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    if not len(terms):
        return None
    different, code = distinct(terms)
    counts = np.diff(bounds)
    each = np.where(counts > 0, np.maximum(counts - size + 1, 1), 0)
    item = np.repeat(np.arange(len(rows)), each)
    start = np.arange(len(item)) - np.repeat(np.cumsum(each) - each, each) + bounds[item]
    place = start[:, None] + np.arange(size)
    window = np.where(place < bounds[item + 1][:, None], code[np.minimum(place, len(code) - 1)], -1)
    unique, which = np.unique(window, axis=0, return_inverse=True)
    names = sorted({name for name, _ in rows})
    number = {name: k for k, name in enumerate(names)}
    owner = np.array([number[name] for name, _ in rows])[item]
    pairs = np.unique(np.stack((which.ravel(), owner)), axis=1)
    return Windows(different, unique, names, pairs[1], np.searchsorted(pairs[0], np.arange(len(unique) + 1)))


class Segment:
    """One row of the index, with its postings as sorted numbers: term first, place second."""

    def __init__(self, row: dict) -> None:
        self.starts = np.frombuffer(row["starts"], "<i4").astype(np.int64)
        self.places = np.frombuffer(row["places"], "<i4").astype(np.int64)
        counts = row["n_words"]
        self.first = np.concatenate(([0], np.cumsum(counts)[:-1])) + np.arange(len(counts)) * GAP
        self.span = int(self.places.max(initial=0)) + 4 * GAP
        term = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        self.keys = term * self.span + self.places + GAP
        self.terms = row["terms"]

    def after(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The first place of each term from a place on; beyond the segment where there is none."""
        at = np.searchsorted(self.keys, term * self.span + place + GAP)
        return np.where(at < self.starts[term + 1], self.places[np.minimum(at, len(self.places) - 1)], self.span)

    def before(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The last place of each term up to a place; far before the segment where there is none."""
        at = np.searchsorted(self.keys, term * self.span + place + GAP, "right") - 1
        return np.where(at >= self.starts[term], self.places[np.maximum(at, 0)], -4 * GAP)

    def document(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, place, "right") - 1


def _matches(segment: Segment, windows: Windows, stretch: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows and places of exact phrases; windows and documents of further matches by proximity."""
    found = [np.empty(0, np.int64)] * 4
    if not len(segment.places):
        return tuple(found)
    own = pc.index_in(windows.terms, value_set=segment.terms).fill_null(-1).to_numpy().astype(np.int64)
    padded = windows.window < 0
    term = np.where(padded, -1, own[windows.window])
    here = np.flatnonzero(((term >= 0) | padded).all(axis=1))
    term = term[here]
    n = np.append(np.diff(segment.starts), np.iinfo(np.int64).max)[term]  # padding comes last
    order = np.argsort(n, axis=1, kind="stable")
    least = np.take_along_axis(n, order[:, :1], axis=1)[:, 0]
    cuts = np.flatnonzero(np.diff(np.cumsum(least) // CANDIDATES)) + 1
    parts = [_search(segment, term[k], order[k], least[k], here[k], stretch) for k in np.split(np.arange(len(here)), cuts) if len(k)]
    return tuple(np.concatenate(x) for x in zip(found, *parts, strict=True))


def _search(segment: Segment, term: np.ndarray, order: np.ndarray, least: np.ndarray, name: np.ndarray, stretch: int) -> tuple:
    rarest = np.take_along_axis(term, order[:, :1], axis=1)[:, 0]
    window = np.repeat(np.arange(len(term)), least)
    at = segment.places[np.arange(len(window)) - np.repeat(np.cumsum(least) - least, least) + segment.starts[rarest][window]]
    size = term.shape[1]
    # Exact phrases: offset-adjusted lists, the rarest first.
    begin, whose = at - order[window, 0], window
    for k in range(1, size):
        offset = order[whose, k]
        other = term[whose, offset]
        kept = (other < 0) | (segment.after(other, begin + offset) == begin + offset)
        begin, whose = begin[kept], whose[kept]
    exact = np.unique(np.stack((whose, begin)), axis=1)
    # Proximity: every list has a place near the rarest one's; then all in one stretch, in documents without the phrase.
    far = segment.span
    told = np.unique(exact[0] * far + segment.document(exact[1]))
    new = ~np.isin(window * far + segment.document(at), told)
    window, at = window[new], at[new]
    for k in range(1, size):
        other = term[window, order[window, k]]
        kept = (other < 0) | (segment.after(other, at - stretch + 1) < at + stretch)
        window, at = window[kept], at[kept]
    near = np.zeros(len(at), bool)
    # The stretch may begin at the last place, up to this one, of one of the terms.
    for first in range(size if len(at) else 0):
        opening = term[window, first]
        start = np.where(opening < 0, -4 * GAP, segment.before(opening, at))
        holds = start > at - stretch
        for k in range(size):
            other = term[window, k]
            holds &= (other < 0) | (segment.after(other, start) < start + stretch)
        near |= holds
    close = np.unique(np.stack((window[near], segment.document(at[near]))), axis=1)
    return name[exact[0]], exact[1], name[close[0]], close[1]


FOUND = "segment long, ordinal int, spans array<struct<start:long,end:long>>, items array<string>, near array<string>"


def _found(row: dict, windows: Windows, stretch: int) -> pa.RecordBatch:
    """The documents of a segment that hold a window: where, of which items, and which items are only near."""
    segment = Segment(row)
    window, place, near_window, near_doc = _matches(segment, windows, stretch)
    doc = segment.document(place)
    docs = np.unique(np.concatenate((doc, near_doc)))
    start = place - segment.first[doc]
    end = start + (windows.window[window] >= 0).sum(axis=1)

    def items(of: np.ndarray, which: np.ndarray) -> list[set[int]]:
        named: list[set[int]] = [set() for _ in docs]
        for k, w in np.unique(np.stack((np.searchsorted(docs, of), which)), axis=1).T.tolist():
            named[k].update(windows.item[windows.item_starts[w] : windows.item_starts[w + 1]].tolist())
        return named

    spans: list[list[dict]] = [[] for _ in docs]
    for k, a, b in sorted(zip(np.searchsorted(docs, doc).tolist(), start.tolist(), end.tolist(), strict=True)):
        if spans[k] and a <= spans[k][-1]["end"]:
            spans[k][-1]["end"] = max(b, spans[k][-1]["end"])
        else:
            spans[k].append({"start": a, "end": b})
    exact, near = items(doc, window), items(near_doc, near_window)
    names = lambda own: [[windows.items[i] for i in sorted(x)] for x in own]
    columns = [
        pa.array([row["segment"]] * len(docs), pa.int64()),
        pa.array(docs, pa.int32()),
        pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        pa.array(names(exact), pa.list_(pa.string())),
        pa.array(names([n - e for n, e in zip(near, exact, strict=True)]), pa.list_(pa.string())),
    ]
    return pa.RecordBatch.from_arrays(columns, ["segment", "ordinal", "spans", "items", "near"])


def search(indexed: DataFrame, items: DataFrame, window: int = WINDOW, stretch: int = STRETCH, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``segment, ordinal, spans, items, near`` of the documents that hold a window of an item.

    ``spans`` are the word ranges that exact windows cover, ``items`` the sorted ids of these, ``near`` those of items that only have a window
    whose terms lie in ``stretch`` words. Items are dealt by hash into blocks of about ``block_words`` words, each of which is read on the
    driver and searched for in one pass over the index.
    """
    if not 0 < window <= stretch <= GAP:
        raise ValueError(f"windows and stretches have 1 to {GAP} words, and no stretch is shorter than a window")
    spark = indexed.sparkSession
    named = stored(items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").where("text is not null"), "items")
    blocks = 1 + (named.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))).first()[0] or 0) // block_words
    made = []
    ship(spark)
    for block in range(blocks):
        own = named.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        plan = windows_of([(r["item_id"], r["text"]) for r in own], window)
        if plan is None:
            continue

        def run(batches: Iterator[pa.RecordBatch], plan: Windows = plan) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    row = {c: batch.column(c)[k] for c in ("segment", "n_words", "terms", "starts", "places")}
                    row = {c: v.values if c in ("n_words", "terms") else v.as_py() for c, v in row.items()}
                    yield _found(row | {"n_words": row["n_words"].to_numpy()}, plan, stretch)

        made.append(stored(indexed.select("segment", "n_words", "terms", "starts", "places").mapInArrow(run, FOUND), "found"))
    if not made:
        return spark.createDataFrame([], FOUND)
    found = made[0]
    for other in made[1:]:
        found = found.union(other)
    merged = found.groupBy("segment", "ordinal").agg(
        F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"),
    )
    return merged.withColumn("near", F.sort_array(F.array_except("near", "items")))


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, stretch: int = STRETCH, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, n_words, n_hit, spans, items, near, contaminated`` for every row of ``docs``.

    Words are lower-cased (A to Z) runs of ASCII letters and digits and of characters beyond ASCII. A window is ``window`` consecutive words of an
    item (``item_id, text``), or all of one that has fewer; ``n_hit`` counts the document words inside an occurrence of one. See
    :func:`search` for ``spans``, ``items`` and ``near``.

    Null and empty texts have no words, as documents and as items. Rows that repeat a ``doc_id`` are looked at one by one, and null ids are
    kept. Items that repeat an ``item_id`` are one item with the windows of all its texts; a null ``item_id`` counts as an empty one. Empty tables give no
    rows and no hits. Other columns are ignored. A text, however long, is one segment's.
    """
    indexed = index(docs, vocabulary(items))
    every = indexed.select("segment", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("ordinal", "doc"))
    found = search(indexed, items, window, stretch, block_words)
    # Spans are sorted and may overlap where they come from several blocks.
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("hit"))
    further = lambda s, x: F.struct(F.greatest(s["end"], x["end"]).alias("end"), (s["hit"] + F.greatest(x["end"] - F.greatest(s["end"], x["start"]), F.lit(0))).alias("hit"))
    hit = F.coalesce(F.aggregate("spans", start, further)["hit"], F.lit(0).cast("long"))
    no_names = F.array().cast("array<string>")
    return every.join(found, ["segment", "ordinal"], "left").select(
        F.col("doc.doc_ids").alias("doc_id"),
        F.col("doc.n_words").alias("n_words"),
        hit.alias("n_hit"),
        "spans",
        F.coalesce("items", no_names).alias("items"),
        F.coalesce("near", no_names).alias("near"),
        (hit > 0).alias("contaminated"),
    )
