"""Importance resampling towards a target: hashed feature counts of corpus and target, seeded draws without repeats.

Features are runs of consecutive terms. The different features of a run of texts are grouped by their length in bytes; each
group is a two-dimensional array of bytes, and one step per column brings the CRC-32 of all its features forward.
Bucket counts of the whole corpus and of the target give each bucket a gain; a document's weight is the mean
gain of its features, and a hash of its id adds noise, so that the greatest scores are a draw by weight.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeflow.llm.common import map_texts, ship, stored
from gradeflow.llm.terms import distinct, parts_of, terms_of
from gradeflow.operators.ordering import row_index

BUCKETS = 10_000
LONGEST = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = "2024"
# Cells of the largest matrix of bytes: what a matrix takes meanwhile is some ten bytes for each.
CELLS = 1 << 21


def _crc_table() -> np.ndarray:
    """The CRC-32 of each byte value, by eight steps of the reflected polynomial."""
    values = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        values = np.where(values & 1, (values >> 1) ^ np.uint32(0xEDB88320), values >> 1)
    return values


_TABLE = _crc_table()


def crc32s(features: pa.Array) -> np.ndarray:
    """The unsigned CRC-32 of every feature's bytes."""
    data, offsets = parts_of(features)
    lengths = np.diff(offsets)
    made = np.empty(len(lengths), np.uint32)
    order = np.argsort(lengths, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else []:
        length = int(lengths[rows[0]])
        step = max(1, CELLS // max(length, 1))
        for at in range(0, len(rows), step):
            own = rows[at : at + step]
            matrix = data[offsets[own][:, None] + np.arange(length, dtype=np.int32)]
            crc = np.full(len(own), 0xFFFFFFFF, np.uint32)
            for column in range(length):
                crc = _TABLE[(crc ^ matrix[:, column]) & 0xFF] ^ (crc >> 8)
            made[own] = ~crc
    return made


def feature_buckets(data: np.ndarray, offsets: np.ndarray, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of all features, text by text, each text's bounds in them, and its number of terms."""
    terms, bounds = terms_of(data, offsets)
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(terms))  # terms from here to the text's end
    found, texts = [], []
    for run in range(1, min(longest, len(terms)) + 1):
        n = len(terms) - run + 1
        whole = left[:n] >= run
        features = terms if run == 1 else pc.binary_join_element_wise(*[terms.slice(k, n) for k in range(run)], b" ").filter(pa.array(whole))
        different, place = distinct(features)
        found.append((crc32s(different) % np.uint32(buckets))[place])
        texts.append(np.searchsorted(bounds, np.flatnonzero(whole), "right") - 1)
    if not found:
        return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64), np.diff(bounds)
    text = np.concatenate(texts)
    order = np.argsort(text, kind="stable") if len(found) > 1 else slice(None)
    return np.concatenate(found)[order], np.searchsorted(text[order], np.arange(len(offsets))), np.diff(bounds)


def features(docs: DataFrame, key: str, key_type: str, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """``key, n_words, n_features, buckets``: the bucket of each feature of each whole text, as little-endian numbers.

    They have 16 bits each if there are at most 65,536 buckets, else 32. A null text has no features.
    """
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def work(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        found, bounds, words = feature_buckets(data, offsets, longest, buckets)
        ends = pa.py_buffer((bounds * kind.itemsize).astype(np.int32))
        packed = pa.Array.from_buffers(pa.binary(), len(words), [None, ends, pa.py_buffer(found.astype(kind))])
        return pa.RecordBatch.from_arrays([rows.column(key), pa.array(words), pa.array(np.diff(bounds)), packed], [key, "n_words", "n_features", "buckets"])

    schema = f"{key} {key_type}, n_words long, n_features long, buckets binary"
    return map_texts(docs.select(F.col(key).cast(key_type).alias(key), "text"), work, schema)


def _numbers(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """All buckets of a column made by :func:`features`, and each row's bounds in them."""
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")
    data, offsets = parts_of(column.cast(pa.binary()))
    return data[offsets[0] : offsets[-1]].view(kind), (offsets - offsets[0]) // kind.itemsize


def bucket_counts(made: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features each bucket has in a table of :func:`features`.

    Every task sends a row per bucket at most, and so many numbers come to the driver: their bound is ``buckets``.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(_numbers(batch.column("buckets"), buckets)[0], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    ship(made.sparkSession)
    counts = np.zeros(buckets, np.int64)
    for r in made.select("buckets").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[r["bucket"]] = r["n"]
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each bucket 1000 times the logarithm of its smoothed share of the target over that of the corpus, floored."""
    n, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(((t + 1) * (s_all + n)) / ((s + 1) * (t_all + n)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weights(made: DataFrame, gain: np.ndarray, key: str = "doc_id") -> DataFrame:
    """``key, n_words, n_features, weight``: the floored mean gain of each document's features, 0 without any."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, bounds = _numbers(batch.column("buckets"), len(gain))
            sums = np.concatenate(([0], np.cumsum(gain[found])))
            n = np.diff(bounds)
            weight = (sums[bounds[1:]] - sums[bounds[:-1]]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("n_words"), batch.column("n_features"), pa.array(weight)], [key, "n_words", "n_features", "weight"])

    ship(made.sparkSession)
    return made.mapInArrow(weigh, f"{key} long, n_words long, n_features long, weight long")


def resample(
    docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``docs``; ``rank`` is null where a row isn't drawn.

    Terms are lower-cased (A to Z) runs of ASCII letters and digits and of characters beyond ASCII; features are all runs of 1 to ``longest``
    of them, over whole texts. ``target`` has a ``text`` column. Of the rows with at least ``least_words`` terms ``percent`` in a hundred are
    drawn, by falling score, ties by smaller ``doc_id`` (null first), then by fewer features.

    Null and empty texts have no features, weight 0, and aren't drawn. Rows that repeat a ``doc_id`` count and are
    drawn one by one, with the same noise; a null ``doc_id`` has the noise of an empty one. An empty table gives no rows, an empty target leaves all target
    counts 0. Other columns are ignored. A text is held whole by one task, with some 60 bytes for each of its terms.
    """
    made = stored(features(docs, "doc_id", "long", longest, buckets), "features")
    aimed = features(target.select(F.lit(None).cast("string").alias("item"), "text"), "item", "string", longest, buckets)
    weighed = weights(made, gains(bucket_counts(made, buckets), bucket_counts(aimed, buckets)))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    noise = F.floor(F.lit(-1000.0) * F.ln(-F.ln(share)))
    scored = stored(weighed.withColumn("score", F.col("weight") + noise), "scores")
    able = scored.where(F.col("n_words") >= least_words)
    drawn = percent * able.count() // 100
    order = ["_down", "doc_id", "n_features"]
    ranked = row_index(able.withColumn("_down", -F.col("score")), order, carry=["weight", "score"])
    rank = F.when(F.col("index") < drawn, F.col("index") + 1)
    columns = ["doc_id", "n_features", "weight", "score"]
    rest = scored.where(F.col("n_words") < least_words)
    return ranked.select(*columns, rank.alias("rank")).union(rest.select(*columns, F.lit(None).cast("long").alias("rank")))
