"""Language by string kernels: kernel ridge regression on n-gram presence, with Nyström landmarks.

A text's blended spectrum is the set of its runs of 1 to 4 bytes (ASCII letters in lower case), hashed into
buckets. The kernel of two texts is the size of their common part over the geometric mean of their sizes.
Some training texts are landmarks; a text is described by its kernels with these, and one ridge regression per
language separates it from the rest.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeflow.llm.common import fold, map_texts
from gradeflow.llm.hashing import LOWER, gram_hashes
from gradeflow.operators.ordering import top_per_group

SIZES = (1, 2, 3, 4)
BITS = 14
# Bounds of what the model is fitted on: texts per language, and landmarks in all.
PER_LANGUAGE = 300
LANDMARKS = 192
RIDGE = 1e-2
ROWS = 128
UNKNOWN = "und"


def spectra(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row per text: 1 for every bucket that occurs."""
    made = np.zeros((len(offsets) - 1, 1 << BITS), np.float32)
    data = LOWER[data]
    for n in SIZES:
        hashes, bounds = gram_hashes(data, offsets, n)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
        made.ravel()[(row << BITS) + (hashes >> np.uint64(64 - BITS)).astype(np.int64)] = 1
    return made


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1))


@dataclass
class Languages:
    names: list[str]
    landmarks: np.ndarray  # buckets by landmark
    weights: np.ndarray  # landmark by language, and an offset in the last row

    def outputs(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        made = []
        for a in range(0, len(offsets) - 1, ROWS):
            part = offsets[a : a + ROWS + 1]
            kernels = _unit(spectra(data[part[0] : part[-1]], part - part[0])) @ self.landmarks
            made.append(kernels @ self.weights[:-1] + self.weights[-1])
        return np.concatenate(made) if made else np.empty((0, len(self.names)), np.float32)


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def train(docs: DataFrame, folds: int = 4, held_out: int = 2, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS) -> Languages | None:
    """Fit on up to ``per_language`` texts of each language, by hash order, outside the held-out fold.

    None if no text has a language.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").where("lang is not null and text is not null and doc_id is not null")
    narrow = known.where(fold(F.col("doc_id"), folds) != held_out).select("doc_id", "lang").distinct()
    sample = top_per_group(narrow, ["lang"], [F.xxhash64("doc_id", F.lit("language")), F.col("doc_id")], per_language)

    def work(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        bits = [np.packbits(x > 0).tobytes() for a in range(len(rows)) for x in spectra(data[offsets[a] : offsets[a + 1]], offsets[a : a + 2] - offsets[a])]
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("lang"), pa.array(bits, pa.binary())], ["doc_id", "lang", "bits"])

    # At most ``per_language`` rows of each language.
    texts = known.join(F.broadcast(sample), ["doc_id", "lang"]).select("doc_id", "lang", "text")
    rows = sorted((r["lang"], r["doc_id"], bytes(r["bits"])) for r in map_texts(texts, work, "doc_id long, lang string, bits binary").collect())
    if not rows:
        return None
    names = sorted({r[0] for r in rows})
    truth = np.array([names.index(r[0]) for r in rows])
    x = _unit(np.stack([np.unpackbits(np.frombuffer(r[2], np.uint8)) for r in rows]).astype(np.float32))
    # Landmarks in turn from each language.
    nth = np.array([(truth[:k] == truth[k]).sum() for k in range(len(truth))])
    chosen = np.lexsort((truth, nth))[:landmarks]
    marks = x[chosen]
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    root = vectors[:, values > 1e-6] / np.sqrt(values[values > 1e-6])
    z = np.hstack([(x @ marks.T) @ root, np.ones((len(x), 1))])
    aims = np.where(truth[:, None] == np.arange(len(names)), 1.0, -1.0)
    balance = (1 / np.bincount(truth, minlength=len(names)))[truth][:, None] * len(truth) / len(names)
    ridge = RIDGE * np.eye(z.shape[1])
    ridge[-1, -1] = 0
    w = np.linalg.solve(z.T @ (z * balance) + ridge + 1e-9 * np.eye(len(ridge)), z.T @ (aims * balance))
    weights = np.vstack([root @ w[:-1], w[-1:]]).astype(np.float32)
    return Languages(names, np.ascontiguousarray(marks.T), weights)


def languages(docs: DataFrame, model: Languages | None, folds: int = 4, held_out: int = 2) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row by its whole text.

    Texts that are null or have no letter are ``und`` with score 0, as are all where there is no model. Ties go to
    the first name. Equal texts get equal results; null ids are kept, not held out. Other columns are ignored.
    """

    def work(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        letters = np.array([has_letter(t) for t in rows.column("text").to_pylist()])
        if model is None:
            letters[:] = False
        names, scores = np.full(len(rows), UNKNOWN, object), np.zeros(len(rows))
        if letters.any():
            out = model.outputs(data, offsets)
            best = out.argmax(axis=1)
            names[letters] = np.array(model.names, object)[best[letters]]
            scores[letters] = np.clip((out[np.arange(len(out)), best] + 1) / 2, 0, 1)[letters]
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    made = map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, "doc_id long, lang_pred string, score double")
    is_held = F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False))
    return made.select("doc_id", is_held.alias("held_out"), "lang_pred", "score")
