"""Classifiers by held-out accuracy, quality counts by brute force, and the pipeline."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from gradeflow.llm import language, quality, toxicity

FOLDER = "/root/testdata/sf0.1"


def test_corrected_risk_finds_the_positives():
    pick = np.random.default_rng(2)
    noise = [np.unique(pick.integers(100, 2000, 30)) for _ in range(1200)]
    bad = [np.append(x, pick.integers(0, 5)) for x in noise[:400]]
    free = [*noise[400:1000], *[np.append(x, pick.integers(0, 5)) for x in noise[1000:1100]]]
    model = toxicity.fit_positive_unlabelled(bad, free, 1 / 7)
    high = np.array([model.raw(np.append(x, 3)) for x in noise[1100:]])
    assert high.min() > np.array([model.raw(x) for x in noise[1100:]]).max()


def test_held_out_toxicity(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.toxicity(docs, toxicity.train(docs, labels)).join(labels, "doc_id").where("held_out")
    found = {r["toxic"]: r["rate"] for r in scored.groupBy("toxic").agg(F.avg("predicted").alias("rate")).collect()}
    assert found[1] > 0.7 and found[0] < 0.03


def test_toxicity_with_labels_for_all_documents(spark):
    pick = np.random.default_rng(4)
    rows = [(k, " ".join([f"n{x}" for x in pick.integers(0, 400, 40)] + ["vile", "slur"] * (k % 5 == 0))) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k, _ in rows], "doc_id long, toxic int")
    made = toxicity.toxicity(docs, toxicity.train(docs, labels)).where("held_out").collect()
    assert {r["doc_id"] for r in made if r["predicted"]} == {r["doc_id"] for r in made if r["doc_id"] % 5 == 0} != set()


def test_held_out_language(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    made = language.languages(docs, language.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert made.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    held = F.col("doc_id") % 5 == 0
    made = quality.quality(docs, quality.train(docs, labels.where(~held))).where(held & ~F.col("base_failed")).join(labels, "doc_id")
    rates = {r["quality"]: r["rate"] for r in made.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("rate")).collect()}
    assert rates[1] > 0.9 and rates[1] > rates[0] + 0.5, rates


def test_quality_counts(spark, small, messy, none, folder):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = quality.train(small, labels)
    for docs in (small, messy):
        expected = []
        for r in docs.collect():
            text = r["text"] or ""
            words, lines, seen = word.findall(text), [x for x in text.split("\n") if word.search(x)], {}
            for k in range(len(words) - 2):
                seen.setdefault(tuple(words[k : k + 3]), []).append(k)
            hit = {k + e for at in seen.values() if len(at) > 1 for k in at for e in range(3)}
            failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
            expected.append((r["doc_id"] or 0, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed))
        made = quality.quality(docs, model).collect()
        assert sorted((r["doc_id"] or 0, *tuple(r)[1:7]) for r in made) == sorted(expected)
        assert not any(r["kept"] and r["base_failed"] for r in made)
    assert quality.quality(none, quality.train(none, labels)).count() == 0


def test_messy_learned(spark, messy, none):
    labels = spark.createDataFrame([(None, 1, 1), (1, None, None), (10, 0, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")
    for docs in (messy, none):
        scores = toxicity.toxicity(docs, toxicity.train(docs, labels)).collect()
        assert len(scores) == docs.count() and all(0 <= r["score"] <= 1 for r in scores)
        found = language.languages(docs, language.train(docs)).collect()
        assert len(found) == docs.count() and all(0 <= r["score"] <= 1 for r in found)
        by_id = {r["doc_id"]: r["lang_pred"] for r in found}
        assert not by_id or [by_id[k] for k in (5, 6, 7, 16)] == ["und"] * 4
        assert toxicity.without_toxic(docs, toxicity.train(docs, labels)).columns == docs.columns


def test_pipeline_counts(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before, columns, counts = docs.count(), docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, folder), name)
        assert docs.columns == columns
        counts.append(docs.count())
    assert before > counts[0] > counts[1] >= counts[2] and counts[3] > 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert pieces.where("piece = 0").count() == counts[3]
    assert corpus_pipeline.run(spark, folder).count() == pieces.count()
