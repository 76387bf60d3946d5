"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier learns from confirmed toxic documents and unlabelled ones. Unlabelled text holds some toxic
documents as well, so its risk is corrected by the class prior: what the toxic ones contribute to it is taken
off, and while the corrected part is negative, a step undoes it instead of fitting on (non-negative risk). A
lasso step keeps few features. Features are hashed: whether a word occurs, by its letters in lower case and by its
first bytes, for words that change their endings. Scores are calibrated on labelled rows of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeflow.llm.common import fold, give_back, map_texts
from gradeflow.llm.hashing import mixed, word_hashes, words_of

BITS = 18
PREFIXES = (4, 5, 6)
# Bounds of the sample that the classifier is fitted on.
POSITIVES, UNLABELLED, CALIBRATION = 3_000, 5_000, 5_000
# One in so many documents of the training folds calibrates the scores and isn't fitted on.
CALIBRATING = 5
STEPS, RATE, LASSO, LEAST_USED = 200, 0.05, 1e-3, 4
# Texts of the sample that a step works on at once; it only bounds the driver's memory.
AT_ONCE = 256


def feature_places(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For each kind of feature the bucket of every word, and each text's bounds in them."""
    words = words_of(data, offsets, letters=True)
    made = []
    for prefix in (0, *PREFIXES):
        hashes = word_hashes(data, words, lower=True, letters=True, prefix=prefix)
        made.append((mixed(hashes + np.uint64(prefix)) >> np.uint64(64 - BITS)).astype(np.int32))
    return made, words.bounds


def features(docs: DataFrame) -> DataFrame:
    """``doc_id, kind, places``: the distinct buckets of each text; ``kind`` is carried along."""

    def work(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        made, bounds = feature_places(data, offsets)
        places = [np.unique(np.concatenate([m[a:b] for m in made])) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("kind"), pa.array(places, pa.list_(pa.int32()))], ["doc_id", "kind", "places"])

    return map_texts(docs.select("doc_id", "kind", "text"), work, "doc_id long, kind string, places array<int>")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Linear:
    """Weights by bucket, an offset, and the calibration's slope and offset."""

    weights: np.ndarray
    offset: float
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, places: np.ndarray) -> float:
        return float(self.weights[places].sum()) + self.offset

    def score(self, raw: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * raw + self.shift)


def fit_positive_unlabelled(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Linear:
    """The classifier with the least corrected risk; ``prior`` is the share of positives in unlabelled data."""
    size = 1 << BITS
    weights = np.zeros(size)
    used = np.zeros(size, np.int32)
    for places in positive:  # distinct in a text
        used[places] += 1
    keep = np.flatnonzero(used >= min(LEAST_USED, max(2, len(positive) // 10)))
    if not len(keep) or not unlabelled:
        return Linear(weights, -40.0)
    place = np.full(size, -1, np.int32)
    place[keep] = np.arange(len(keep))
    texts, blocks = [*positive, *unlabelled], []
    for at in range(0, len(texts), AT_ONCE):
        part = [p[p >= 0] for p in (place[f] for f in texts[at : at + AT_ONCE])]
        blocks.append((slice(at, at + len(part)), np.concatenate(part), np.array([len(p) for p in part])))
    n, m = len(positive), len(unlabelled)
    is_positive = np.arange(n + m) < n
    w, first, second = np.zeros(len(keep)), np.zeros(len(keep)), np.zeros(len(keep))
    offset, first_o, second_o = -2.0, 0.0, 0.0
    for t in range(1, STEPS + 1):
        g = np.concatenate([np.bincount(np.repeat(np.arange(len(k)), k), w[column], len(k)) for _, column, k in blocks]) + offset
        s, as_negative = _sigmoid(g), np.logaddexp(0, g)
        if as_negative[~is_positive].mean() >= prior * as_negative[is_positive].mean():
            slope = np.where(is_positive, -prior * (1 - s) / n - prior * s / n, s / m)
        else:
            slope = np.where(is_positive, prior * s / n, -s / m)
        down, down_o = np.zeros(len(keep)), slope.sum()
        for own, column, k in blocks:
            down += np.bincount(column, np.repeat(slope[own], k), len(keep))
        first, second = 0.9 * first + 0.1 * down, 0.99 * second + 0.01 * down * down
        first_o, second_o = 0.9 * first_o + 0.1 * down_o, 0.99 * second_o + 0.01 * down_o * down_o
        fix_first, fix_second = 1 - 0.9**t, 1 - 0.99**t
        step = RATE / (np.sqrt(second / fix_second) + 1e-4)
        w = w - step * first / fix_first
        w = np.sign(w) * np.maximum(np.abs(w) - step * LASSO, 0)
        offset -= RATE / (np.sqrt(second_o / fix_second) + 1e-4) * first_o / fix_first
    weights[keep] = w
    return Linear(weights, float(offset))


def calibrate(raw: np.ndarray, truth: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through the scores (Platt), with softened truths, by Newton's method."""
    ones, zeros = int(truth.sum()), int(len(truth) - truth.sum())
    if not ones or not zeros:
        return 1.0, 0.0
    aim = np.where(truth == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    scale = max(float(raw.std()), 1e-9)
    x = np.stack([(raw - raw.mean()) / scale, np.ones(len(raw))], axis=1)
    at = np.array([1.0, np.log((ones + 1) / (zeros + 1))])
    for _ in range(50):
        p = _sigmoid(x @ at)
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - aim))
        at = at - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(at[0] / scale), float(at[1] - at[0] * raw.mean() / scale)


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0) -> Linear:
    """Fit on documents whose CRC-32 fold isn't ``held_out``; a bounded sample by hash order of each kind.

    Unlabelled text is drawn from all documents of the other folds, whether they have a label or not. One in ``CALIBRATING`` of these folds' documents, by a
    hash, only calibrates; the classifier is fitted on the others. An empty table or one without toxic labels gives a model that
    scores everything about 0.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where("doc_id is not null and toxic is not null")
    learnt = known.where(fold(F.col("doc_id"), folds) != held_out).join(ids.distinct(), "doc_id", "left_semi")
    order = F.xxhash64("doc_id", F.lit("toxicity"))
    counts = learnt.agg(F.count("*").alias("n"), F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")).first()
    if not counts["n"] or not counts["toxic"]:
        return Linear(np.zeros(1 << BITS), -40.0)
    draw = lambda rows, kind, n: rows.select("doc_id").orderBy(order, "doc_id").limit(n).select("doc_id", F.lit(kind).alias("kind"))
    calibrates = F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(CALIBRATING)) == 0
    free = ids.where(fold(F.col("doc_id"), folds) != held_out).distinct()
    # At most POSITIVES + UNLABELLED + CALIBRATION ids.
    sample = (
        draw(learnt.where("toxic = 1").where(~calibrates), "positive", POSITIVES)
        .union(draw(free.where(~calibrates), "unlabelled", UNLABELLED))
        .union(draw(learnt.where("toxic = 1").where(calibrates), "toxic", CALIBRATION // 5))
        .union(draw(learnt.where("toxic <> 1").where(calibrates), "clean", CALIBRATION - CALIBRATION // 5))
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    found: dict[str, list[np.ndarray]] = {"positive": [], "unlabelled": [], "toxic": [], "clean": []}
    table = features(texts).toArrow()
    for kind, places in sorted(zip(table["kind"].to_pylist(), table["places"], strict=True), key=lambda r: (r[0], len(r[1]))):
        found[kind].append(places.values.to_numpy())
    prior = counts["toxic"] / counts["n"]
    model = fit_positive_unlabelled(found["positive"], found["unlabelled"], prior)
    raw = np.array([model.raw(p) for p in [*found["toxic"], *found["clean"]]])
    truth = np.array([1] * len(found["toxic"]) + [0] * len(found["clean"]))
    model.slope, model.shift = calibrate(raw, truth)
    del table, found, places
    give_back()
    return model


def _scores(model: Linear, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    made, bounds = feature_places(data, offsets)
    n = len(bounds) - 1
    doc = np.repeat(np.arange(n), np.diff(bounds)).astype(np.int64)
    hits = [np.flatnonzero(model.weights[m]) for m in made]
    # A feature counts once per text; few words have any weight.
    pairs = np.unique(np.concatenate([doc[h] << BITS | m[h] for m, h in zip(made, hits, strict=True)]))
    return model.score(np.bincount(pairs >> BITS, model.weights[pairs & ((1 << BITS) - 1)], n) + model.offset)


def toxicity(docs: DataFrame, model: Linear, folds: int = 5, held_out: int = 0) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row by its whole text; null is empty.

    A text without words has the score of no evidence. Equal texts have equal scores. A null ``doc_id`` is
    kept, with ``held_out`` false. Without toxic training rows every score is about 0. Other columns are ignored.
    """

    def work(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        score = _scores(model, data, offsets)
        columns = [rows.column("doc_id"), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "predicted"])

    scored = map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, "doc_id long, score double, predicted int")
    is_held = F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False))
    return scored.select("doc_id", is_held.alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, model: Linear) -> DataFrame:
    """The rows of ``docs``, with all their columns, that aren't predicted toxic."""

    def work(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        return rows.filter(pa.array(_scores(model, data, offsets) < 0.5))

    return map_texts(docs, work, docs.schema)
