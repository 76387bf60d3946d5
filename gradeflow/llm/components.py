"""Connected components over links of any number, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeflow.llm.common import stored


def _state(links: DataFrame) -> tuple[int, int]:
    """How many links ``a, b`` there are, and how many ids have several ``b`` or are both an ``a`` and a ``b``: none, if all are stars."""
    ends = links.select(F.col("a").alias("u"), F.lit(1).alias("up")).union(links.select("b", F.lit(0)))
    each = ends.groupBy("u").agg(F.sum("up").alias("up"), F.count("*").alias("ends"))
    return tuple(each.agg(F.coalesce(F.sum("up"), F.lit(0)), F.count_if((F.col("up") > 0) & (F.col("ends") > 1))).first())


def _with_least(pairs: DataFrame) -> DataFrame:
    """``u, v`` with ``m``, the least of ``u`` and all its ``v``. A hot ``u`` is combined before its shuffle."""
    least = pairs.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return pairs.join(least, "u")


def stars(links: DataFrame, label: str = "stars", rows: int | None = None) -> DataFrame:
    """Links ``a, b`` of ids to links ``a, b`` from every id but the least to the least of its component.

    Null ends and loops are dropped. Each round is written to the shared folder; links that are stars already need none. ``rows``: about how
    many links there are at most, if known.
    """
    links = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label, rows)
    count, crossed = _state(links)
    while crossed:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _with_least(large.distinct()).select(F.explode(F.array("u", "v")).alias("a"), F.col("m").alias("b"))
        links = stored(small.where("a <> b").distinct(), label, 2 * count)
        count, crossed = _state(links)
    return links
