"""Repeated passages by hashed windows at minimisers of words.

A suffix is kept where a minimiser begins: the position of the least hash of ``GRAM`` words among ``WINDOW`` positions
in a row. Equal passages choose equal positions, so a window of ``LEAST`` words holds a kept suffix that runs on for at
least ``SURE = LEAST - WINDOW + 1`` of its words: the one chosen for its first ``WINDOW`` positions. Suffixes whose first
``SURE`` words no other text has are dropped. Every window that chose one of the others is hashed as a whole, and equal
windows are brought together by a sort over all partitions. No number of texts that begin alike hides a match, and
each window has an owner of its own, the least document that has it. The windows of a document together cover its
repeated passages to both ends.

Windows are equal if 64 bits of their suffix's first words and 64 bits of all their words are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeflow.llm.common import map_texts, ship, small_side, stored
from gradeflow.llm.hashing import mixed, shingle_hashes, word_hashes, words_of

LEAST = 50
WINDOW = 24
GRAM = 6
SURE = LEAST - WINDOW + 1
_WEIGHTS = mixed(np.arange(101, 101 + SURE, dtype=np.uint64)) | np.uint64(1)
_WHOLE = mixed(np.arange(201, 201 + LEAST, dtype=np.uint64)) | np.uint64(1)
# More than any text has words.
_FAR = np.int64(1) << np.int64(40)


def _chosen(grams: np.ndarray) -> np.ndarray:
    """For each run of ``WINDOW`` positions the place of its least hash."""
    windows = np.lib.stride_tricks.sliding_window_view(grams, WINDOW)
    return windows.argmin(axis=1) + np.arange(len(windows))


def _sums(hashes: np.ndarray, places: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A hash of as many words from each place on as there are weights."""
    sums = np.zeros(len(places), np.uint64)
    for j, weight in enumerate(weights):
        sums += hashes[places + j] * weight
    return mixed(sums)


def kept_suffixes(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the kept suffixes among the words of several texts, and hashes of their first ``SURE`` words."""
    grams, gram_bounds = shingle_hashes(hashes, bounds, GRAM)
    found = []
    for (a, b), (g, h) in zip(zip(bounds[:-1], bounds[1:], strict=True), zip(gram_bounds[:-1], gram_bounds[1:], strict=True), strict=True):
        if b - a < LEAST:
            continue
        chosen = np.unique(_chosen(grams[g:h]))
        found.append(chosen[chosen <= b - a - SURE] + a)
    places = np.concatenate(found) if found else np.empty(0, np.int64)
    return places, _sums(hashes, places, _WEIGHTS)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def suffixes(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, at, start``: each kept suffix's word position and the hash of its first words.

    Texts of the same words have the same ``text_hash``.
    """

    def work(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        words = words_of(data, offsets)
        hashes = word_hashes(data, words)
        places, starts = kept_suffixes(hashes, words.bounds)
        doc = np.searchsorted(words.bounds, places, "right") - 1  # of rows with the same bound, only the last has words
        texts = np.array([int.from_bytes(hashlib.blake2b(hashes[a:b].tobytes(), digest_size=8).digest(), "little", signed=True) for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True)], np.int64)
        ids = rows.column("doc_id").take(pa.array(doc))
        at = (places - words.bounds[doc]).astype(np.int32)
        return pa.RecordBatch.from_arrays([ids, pa.array(texts[doc]), pa.array(at), _signed(starts)], ["doc_id", "text_hash", "at", "start"])

    return map_texts(_narrow(docs), work, "doc_id long, text_hash long, at int, start long")


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")


def copies(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, first_doc_id`` of texts of ``LEAST`` words or more that other documents have in full."""

    def work(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        words = words_of(data, offsets)
        hashes = word_hashes(data, words)
        texts = [hashlib.blake2b(hashes[a:b].tobytes(), digest_size=16).digest() for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True)]
        made = pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(words.counts.astype(np.int64)), pa.array(texts, pa.binary())], ["doc_id", "n_words", "whole"])
        return made.filter(pa.array(words.counts >= LEAST))

    texts = stored(map_texts(_narrow(docs), work, "doc_id long, n_words long, whole binary"), "texts")
    several = texts.groupBy("whole").agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last")).where("first_doc_id < last").drop("last")
    return texts.join(several, "whole").select("doc_id", "n_words", "first_doc_id")


def _windows(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``doc_id, at, start, whole``: the windows of ``LEAST`` words that chose a wanted suffix, with two hashes each."""

    def work(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        words = words_of(data, offsets)
        hashes = word_hashes(data, words)
        grams, gram_bounds = shingle_hashes(hashes, words.bounds, GRAM)
        docs, places, suffixes = [], [], []
        for k, spots in enumerate(rows.column("spots")):
            (a, b), (g, h) = words.bounds[k : k + 2], gram_bounds[k : k + 2]
            if b - a < LEAST:  # another text under the same id
                continue
            chosen = _chosen(grams[g:h])[: b - a - LEAST + 1]
            found = np.flatnonzero(np.isin(chosen, spots.values.to_numpy()))
            docs.append(np.full(len(found), k))
            places.append(found + a)
            suffixes.append(chosen[found] + a)
        doc, place, suffix = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (docs, places, suffixes))
        columns = [pa.array((place - words.bounds[doc]).astype(np.int32)), _signed(_sums(hashes, suffix, _WEIGHTS)), _signed(_sums(hashes, place, _WHOLE))]
        return pa.RecordBatch.from_arrays([rows.column("doc_id").take(pa.array(doc)), *columns], ["doc_id", "at", "start", "whole"])

    # A document has at most as many suffixes as words.
    spots = wanted.groupBy("doc_id").agg(F.collect_list("at").alias("spots"))
    few = small_side(wanted.select("doc_id").distinct())
    texts = _narrow(docs).join(few, "doc_id", "left_semi")
    return map_texts(texts.join(spots, "doc_id").select("doc_id", "spots", "text"), work, "doc_id long, at int, start long, whole long")


MARKS = "doc_id long, at int, first_doc_id long, start long, whole long"
_NAMES = [f.split()[0] for f in MARKS.split(", ")]


def _owned(windows: DataFrame) -> DataFrame:
    """Windows that several documents have, with the least of these as ``first_doc_id``.

    Equal windows follow each other, by document. What a partition can't tell alone has no ``first_doc_id`` but its
    hashes: the rows of its first window, which may go back into the partition before, and of its last one while one document
    has it. A row without ``at`` names the owner of the last one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opening = None  # the first window of the partition
        # The rows of the last window so far: of its owner alone, or, when others have been met, one without place.
        held = np.empty((4, 0), np.int64)

        def table(rows: np.ndarray, owner: np.ndarray | None) -> pa.RecordBatch:
            n = rows.shape[1]
            none = pa.nulls(n, pa.int64())
            at = pa.array(rows[3].astype(np.int32), mask=rows[3] < 0)
            keys = [none, none] if owner is not None else [pa.array(rows[0]), pa.array(rows[1])]
            return pa.RecordBatch.from_arrays([pa.array(rows[2]), at, none if owner is None else pa.array(owner), *keys], _NAMES)

        for batch in batches:
            if not batch.num_rows:
                continue
            fresh = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("start", "whole", "doc_id", "at")])
            if opening is None:
                opening = fresh[:2, :1].copy()
            rows = np.concatenate((held, fresh), axis=1)
            n = rows.shape[1]
            first = np.flatnonzero(np.concatenate(([True], (rows[:2, 1:] != rows[:2, :-1]).any(axis=0))))
            counts = np.diff(np.append(first, n))
            owner = rows[2, first]
            several = owner != rows[2, first + counts - 1]
            is_opening = (rows[:2, first] == opening).all(axis=0)
            placed = rows[3] >= 0
            unsure = np.repeat(is_opening, counts) & placed
            sure = np.repeat(several & ~is_opening, counts) & placed
            yield table(rows[:, sure], np.repeat(owner, counts)[sure])
            yield table(rows[:, unsure], None)
            held = rows[:, first[-1] :]
            if several[-1] or is_opening[-1]:
                held = held[:, :1].copy()
                held[3] = -1
        yield table(held, None)

    ship(windows.sparkSession)
    # The document is part of the key, so that a window of any number of documents is dealt to many tasks.
    keys = ["start", "whole", "doc_id", "at"]
    return windows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(run, MARKS)


def _settled(marks: DataFrame) -> DataFrame:
    """``doc_id, at, first_doc_id`` of all windows, also of those that no partition could tell alone.

    There are at most two of these per partition, with any number of rows; their owners come to the driver.
    """
    unsure = marks.where("first_doc_id is null").groupBy("start", "whole")
    owners = unsure.agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last")).where("first_doc_id < last")
    known = {(r["start"], r["whole"]): r["first_doc_id"] for r in owners.collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("first_doc_id")
            if found.null_count:
                rows = zip(*(batch.column(c).to_pylist() for c in ("first_doc_id", "start", "whole")), strict=True)
                found = pa.array([known.get((start, whole)) if owner is None else owner for owner, start, whole in rows], pa.int64())
            made = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("at"), found], ["doc_id", "at", "first_doc_id"])
            yield made.filter(found.is_valid())

    ship(marks.sparkSession)
    return marks.where("at is not null").mapInArrow(run, "doc_id long, at int, first_doc_id long")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """``doc_id, start, end, first_doc_id, is_first``: the passages of ``LEAST`` words or more that other documents share.

    ``start`` and ``end`` count words, runs without space, tab and line ends. Each window of ``LEAST`` words belongs to the
    least document that has it. A span is a run of windows that touch, those of the document itself (``is_first``) apart from
    those of documents before it; ``first_doc_id`` is the least owner in it. Null texts and texts of fewer words have none. Rows that repeat a ``doc_id``
    are one document, and rows without one are left out. Other columns are ignored.
    """
    spark = docs.sparkSession
    every = suffixes(docs)
    shared = every.groupBy("start").agg(F.min("text_hash").alias("least"), F.max("text_hash").alias("most")).where("least <> most").select("start")
    wanted = stored(every.join(shared, "start", "left_semi").select("doc_id", "at"), "suffixes")
    marks = stored(_owned(_windows(docs, wanted)), "marks")
    found = _settled(marks)
    spans = found.select("doc_id", F.col("at").cast("long").alias("start"), (F.col("at") + LEAST).cast("long").alias("end"), "first_doc_id")
    whole = copies(docs).select("doc_id", F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end"), "first_doc_id")
    return _merged(spans.union(whole).withColumn("is_first", F.col("first_doc_id") == F.col("doc_id")))


def _merged(spans: DataFrame) -> DataFrame:
    """Spans of a document that touch or overlap become one."""
    names = ["doc_id", "start", "end", "first_doc_id", "is_first"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((5, 0), np.int64)

        def table(rows: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*map(pa.array, rows[:4]), pa.array(rows[4].astype(bool))], names)

        for batch in batches:
            rows = np.concatenate((held, np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names])), axis=1)
            if not rows.shape[1]:
                continue
            other = (rows[0, 1:] != rows[0, :-1]) | (rows[4, 1:] != rows[4, :-1])
            far = np.concatenate(([0], np.cumsum(other))) * _FAR
            reach = np.maximum.accumulate(rows[2] + far)
            first = np.flatnonzero(np.concatenate(([True], rows[1, 1:] + far[1:] > reach[:-1])))
            made = rows[:, first]
            made[2], made[3] = np.maximum.reduceat(rows[2], first), np.minimum.reduceat(rows[3], first)
            yield table(made[:, :-1])
            held = made[:, -1:]
        yield table(held)

    ship(spans.sparkSession)
    dealt = spans.select(*names).repartition("doc_id").sortWithinPartitions("doc_id", "is_first", "start")
    return dealt.mapInArrow(run, "doc_id long, start long, end long, first_doc_id long, is_first boolean")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` without the passages that an earlier document (by ``doc_id``) has; the first one keeps them.

    A word is cut where an earlier document has one of the windows of ``LEAST`` words around it, so each word that is cut stays
    among the same words in an earlier document, or there was cut for the same reason.
    A text is cut from the first character of a span's first word to the last of its last word. Documents of which no
    word is left are dropped; those that had none before stay. ``n_chars`` follows the text if there is such a column.
    """
    cuts = repeated_passages(docs).where("not is_first").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__cuts"))
    cuts = stored(cuts, "cuts").withColumnRenamed("doc_id", "__cut_id")
    others = [c for c in docs.columns if c != "text"]
    marked = docs.join(small_side(cuts), F.col("doc_id").cast("long") == F.col("__cut_id"), "left").drop("__cut_id")
    whole, cut = marked.where("__cuts is null").drop("__cuts"), marked.where("__cuts is not null")
    left_over = cut.select(*docs.columns, "__cuts").mapInArrow(_cutter(docs.columns), docs.schema)
    if "n_chars" in others:
        left_over = left_over.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    ship(docs.sparkSession)
    return whole.select(*docs.columns).union(left_over.select(*docs.columns))


def _cutter(columns: list[str]):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("__cuts").to_pylist(), strict=True):
                data = np.frombuffer((text or "").encode(), np.uint8)
                words = words_of(data, np.array([0, len(data)]))
                raw, parts, at, gone = data.tobytes(), [], 0, 0
                for span in spans:
                    first, end = min(span["start"], len(words.start)), min(span["end"], len(words.start))
                    if first >= end:  # a shorter text under the same id
                        continue
                    parts.append(raw[at : words.start[first]])
                    at, gone = int(words.end[end - 1]), gone + end - first
                parts.append(raw[at:])
                kept.append(None if gone == len(words.start) and gone else b"".join(parts).decode())
            texts = pa.array(kept, pa.string())
            made = [texts if c == "text" else batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays(made, columns).filter(texts.is_valid())

    return cut
