"""Quality rules: counts by rule, and hashed word and character n-gram logistic regression.

The regression learns from labelled quality rows. A feature is a hash bucket; its value is the share of a text's
words, or of its runs of bytes, that fall into it. Probabilities are calibrated on the training rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeflow.llm.common import map_texts
from gradeflow.llm.hashing import gram_hashes, mixed, shingle_hashes, word_hashes, words_of
from gradeflow.llm.toxicity import calibrate

BITS = 15
GRAMS = (3, 4)
KINDS = 1 + len(GRAMS)
# The bound of the labelled sample, a part of it for each label.
SAMPLE = 4_000
STEPS, RATE, RIDGE = 150, 0.5, 1e-6
SCALE = 100.0
# Fixed thresholds.
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
LEAST_PROBABILITY = 0.5
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_LEAD = np.ones(256, bool)
_LEAD[128:192] = False  # bytes that continue a character


def places_of(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For words and each n-gram size: the bucket of each, and each text's bounds in them."""
    words = words_of(data, offsets)
    made = [(word_hashes(data, words), words.bounds), *[gram_hashes(data, offsets, n) for n in GRAMS]]
    return [((mixed(h + np.uint64(k)) >> np.uint64(64 - BITS)).astype(np.int32), b) for k, (h, b) in enumerate(made)]


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum of the values of each text."""
    return np.diff(np.concatenate(([0], np.cumsum(values)))[bounds])


@dataclass
class Quality:
    weights: np.ndarray
    offset: float
    slope: float = 1.0
    shift: float = 0.0

    def probability(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        raw = np.full(len(offsets) - 1, self.offset)
        for weights, (places, bounds) in zip(self.weights, places_of(data, offsets), strict=True):
            raw += SCALE * _sums(weights[places], bounds) / np.maximum(np.diff(bounds), 1)
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.shift, -40, 40)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Quality:
    """Fit on a sample by hash order, half good and half bad as far as there are such rows.

    The calibration weighs both labels as often as they are labelled. Without rows of both labels all are good.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where("doc_id is not null and quality is not null")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    known = known.join(ids, "doc_id", "left_semi")
    order = F.xxhash64("doc_id", F.lit("quality"))
    drawn = [known.where(F.col("quality") == q).orderBy(order, "doc_id").limit(sample // 2) for q in (0, 1)]
    counts = {int(r["quality"]): int(r["n"]) for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}

    def work(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        made = places_of(data, offsets)
        places, values = [], []
        for k in range(len(rows)):
            seen = [np.unique(p[b[k] : b[k + 1]], return_counts=True) for p, b in made]
            places.append(np.concatenate([p + (kind << BITS) for kind, (p, _) in enumerate(seen)]).astype(np.int32))
            values.append(np.concatenate([c / max(c.sum(), 1) for _, c in seen]).astype(np.float32))
        columns = [rows.column("quality"), pa.array(places, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))]
        return pa.RecordBatch.from_arrays(columns, ["quality", "places", "shares"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(drawn[0].union(drawn[1])), "doc_id")
    table = map_texts(texts.select(F.col("quality").cast("int").alias("quality"), "text"), work, "quality int, places array<int>, shares array<float>").toArrow()
    truth = np.array(table["quality"].to_pylist(), np.int64)
    if truth.min(initial=1) == truth.max(initial=0) or not len(truth):
        return Quality(np.zeros((KINDS, 1 << BITS)), 40.0)
    places = np.concatenate([x.values.to_numpy() for x in table["places"]]).astype(np.int64)
    shares = np.concatenate([x.values.to_numpy() for x in table["shares"]]).astype(np.float64) * SCALE
    row = np.repeat(np.arange(len(truth)), [len(x) for x in table["places"]])
    order_ = np.lexsort((places, row))  # sums don't depend on how rows arrived within a text
    places, shares, row = places[order_], shares[order_], row[order_]
    size, n = KINDS << BITS, len(truth)
    share_of = np.where(truth == 1, counts.get(1, 1) / (truth == 1).sum(), counts.get(0, 1) / (truth == 0).sum())
    w, offset, first, second = np.zeros(size), 0.0, np.zeros(size), np.zeros(size)
    for t in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, shares * w[places], n) + offset, -40, 40)))
        slope = (p - truth) / n
        down = np.bincount(places, np.repeat(slope, np.bincount(row, minlength=n)) * shares, size) + RIDGE * w
        first, second = 0.9 * first + 0.1 * down, 0.99 * second + 0.01 * down * down
        w = w - RATE * 0.01 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-6)
        offset -= RATE * slope.sum()
    raw = np.bincount(row, shares * w[places], n) + offset
    repeat = np.maximum(1, np.round(share_of / share_of.min())).astype(np.int64)
    slope, shift = calibrate(np.repeat(raw, repeat), np.repeat(truth, repeat))
    return Quality(w.reshape(KINDS, 1 << BITS), float(offset), slope, shift)


def _repeated_words(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per text: words in 3-word windows that occur twice or more in it."""
    made = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        n = b - a
        if n < 4:
            made.append(0)
            continue
        windows, _ = shingle_hashes(hashes[a:b], np.array([0, n]), 3)
        order = np.argsort(windows, kind="stable")
        same = windows[order[1:]] == windows[order[:-1]]
        hit = np.zeros(n, bool)
        at = np.concatenate((order[1:][same], order[:-1][same]))
        hit[at] = hit[at + 1] = hit[at + 2] = True
        made.append(int(hit.sum()))
    return np.array(made, np.int64)


def _repeated_lines(data: np.ndarray, first: int, end: int) -> int:
    lines = [x for x in data[first:end].tobytes().split(b"\n") if x.strip(b" \t\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def rule_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    words = words_of(data, offsets)
    lead = np.concatenate(([0], np.cumsum(_LEAD[data])))
    chars = lead[words.end] - lead[words.start]
    return {
        "n_words": words.counts,
        "word_chars": _sums(chars, words.bounds),
        "n_symbols": _sums(_SYMBOL[data], offsets),
        "n_dup_lines": np.array([_repeated_lines(data, a, b) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.int64),
        "n_repeat_words": _repeated_words(word_hashes(data, words), words.bounds),
    }


def quality(docs: DataFrame, model: Quality, least: float = LEAST_PROBABILITY) -> DataFrame:
    """``doc_id``, the counts of the rules, ``base_failed``, ``probability`` and ``kept`` for every row.

    A text fails the base with fewer than 50 words, or with over half of them in repeated 3-word windows; it is
    kept if it doesn't and its probability of being good is at least ``least``. Null is empty and fails. Equal
    texts get equal results; null ids and repeated rows stay. Other columns are ignored.
    """

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def work(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        counts = rule_counts(data, offsets)
        failed = (counts["n_words"] < LEAST_WORDS) | (100 * counts["n_repeat_words"] > MOST_REPEATED_PERCENT * counts["n_words"])
        good = model.probability(data, offsets)
        columns = [rows.column("doc_id"), *[pa.array(counts[k].astype(np.int64)) for k in names], pa.array(failed), pa.array(good), pa.array(~failed & (good >= least))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", *names, "base_failed", "probability", "kept"])

    schema = "doc_id long, " + ", ".join(f"{k} long" for k in names) + ", base_failed boolean, probability double, kept boolean"
    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, schema)
