"""Mix sources to target weights: whole repetitions and one hash-seeded Bernoulli copy of each document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeflow.llm.common import small_side, stored
from gradeflow.operators.frames import join_on
from gradeflow.operators.ordering import with_row_index

WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"
# Digits of the hash that make a document's number in [0, 1): 48 bits.
DIGITS = 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def chance(key: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(key.cast("string"), F.lit("")))), 1, DIGITS)
    return F.conv(digits, 16, 10).cast("long") / F.lit(16**DIGITS)


def targets(sizes: DataFrame, share: float = 1.5, most: int = 2, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """``source, source_size`` to the same with ``target``.

    Sources in code-point order, null last, weigh ``weights``, repeating. They share ``share`` of all sizes
    by weight; no target exceeds ``most`` times its source's size, and what is above is shared again by
    weight among the others until none is above. Each round is one aggregate of the source table.
    """
    if share > most:
        raise ValueError("the sources can't give so much")
    ordered = with_row_index(sizes.withColumn("last", F.col("source").isNull()), ["last", "source"], name="place")
    place = F.pmod("place", F.lit(len(weights))).cast("int")
    weighed = stored(
        ordered.select("source", "source_size", F.get(F.array(*[F.lit(w) for w in weights]), place).cast("long").alias("weight")), "sources"
    )
    cap = F.col("source_size") * F.lit(most)
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level = None  # words for each unit of weight
    while True:
        full = F.lit(False) if level is None else cap.cast("double") <= F.col("weight") * F.lit(level)
        given, open_weight = weighed.agg(F.sum(F.when(full, cap).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight")))).first()
        if not open_weight:
            return weighed.select("source", "source_size", cap.cast("double").alias("target"))
        fresh = (share * total - given) / open_weight
        if fresh == level:
            by_weight = F.col("weight") * F.lit(level)
            return weighed.select("source", "source_size", F.when(full, cap.cast("double")).otherwise(by_weight).alias("target"))
        level = fresh


def mix(
    docs: DataFrame, share: float = 1.5, most: int = 2, weights: Sequence[int] = WEIGHTS, seed: str = "mix"
) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``copies`` (how often the mix takes it) and ``taken`` (its words).

    A source's repetition rate is its target over its size. A document is taken ``floor(rate)`` times, and once
    more with the fraction as its probability, by a number that its ``doc_id`` and the seed fix; so reruns
    agree, and no document is taken more than ``most`` times. A null text has size 0; a null source is a
    source; rows that repeat a ``doc_id`` share its number. Sources without words have target 0 and are not
    taken. Columns of ``docs`` with the names added here are replaced.
    """
    added = ["size", "source_size", "target", "copies", "taken"]
    sized = docs.drop(*added).withColumn("size", word_count(F.col("text")))
    narrow = docs.select("source", word_count(F.col("text")).alias("size"))
    aimed = targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), share, most, weights)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    extra = (chance(F.col("doc_id"), seed) < rate - F.floor(rate)).cast("long")
    # One row per source: broadcast if they are few enough, else joined on the source.
    return (
        join_on(sized, small_side(aimed), ["source"])
        .withColumn("copies", F.floor(rate) + extra)
        .withColumn("taken", F.col("copies") * F.col("size"))
    )


def mixture(docs: DataFrame, **how) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as :func:`mix` says, with its own columns, whatever their names."""
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "source", "text")
    taken = mix(rows, **how).where("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")
