"""A checkpoint against its base on the same items: difference, intervals, bootstrap and gate."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NORMAL = 1.959963984540054
REPLICATES = 200
DIGITS = 8


def _poisson_shares(terms: int = 9) -> list[float]:
    """Shares of a Poisson variable of mean 1 that are at most 0, 1, 2, ...: a number beyond k of them counts k times."""
    shares, term = [], math.exp(-1)
    for k in range(terms):
        shares.append(term + (shares[-1] if shares else 0.0))
        term /= k + 1
    return shares



def poisson_weight(key: Column, replicate: Column, seed: str) -> Column:
    """How often a replicate of the bootstrap draws the item: Poisson of mean 1 by a hash, so reruns and retries agree."""
    digest = F.md5(F.concat(F.lit(f"{seed}/"), key.cast("string"), F.lit("/"), replicate.cast("string")))
    share = F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("long") / F.lit(16.0**DIGITS)
    weight = F.lit(0)
    for limit in _poisson_shares():
        weight = weight + (share >= limit).cast("int")
    return weight


def compared(base: DataFrame, other: DataFrame, key: str, by: str, metric: str, least_gain: float = 0.0, most_loss: float = 0.0, seed: str = "bootstrap", replicates: int = REPLICATES) -> DataFrame:
    """``by, items, base_mean, other_mean, gain, low, high, boot_low, boot_high, gate`` for each suite ``by``.

    Items are joined on ``key``; those that only one side has, or with a null metric, take no part. ``low`` and ``high`` are the normal interval of the mean
    gain, ``boot_low`` and ``boot_high`` the middle 95 in a hundred of the means of ``replicates`` Poisson bootstraps. The gate is ``promote`` if the whole
    normal interval is above ``least_gain``, ``reject`` if it is below ``-most_loss``, else ``hold``; it is ``hold`` for fewer than two items.

    A replicate is two sums over all items, merged before the shuffle; no item is kept or sorted.
    """
    paired = base.select(key, by, F.col(metric).cast("double").alias("_base")).join(other.select(key, F.col(metric).cast("double").alias("_other")), key)
    paired = paired.where("_base is not null and _other is not null").withColumn("_gain", F.col("_other") - F.col("_base"))
    error = NORMAL * F.stddev_samp("_gain") / F.sqrt(F.count("*"))
    exact = paired.groupBy(by).agg(
        F.count("*").alias("items"), F.avg("_base").alias("base_mean"), F.avg("_other").alias("other_mean"), F.avg("_gain").alias("gain"),
        (F.avg("_gain") - error).alias("low"), (F.avg("_gain") + error).alias("high"),
    )
    replicate = F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("_replicate")
    drawn = paired.select(by, key, "_gain", replicate).withColumn("_w", poisson_weight(F.col(key), F.col("_replicate"), seed))
    means = drawn.groupBy(by, "_replicate").agg((F.sum(F.col("_w") * F.col("_gain")) / F.nullif(F.sum("_w"), F.lit(0))).alias("_mean"))
    ends = means.groupBy(by).agg(F.percentile("_mean", 0.025).alias("boot_low"), F.percentile("_mean", 0.975).alias("boot_high"))
    gate = F.when(F.col("low") > least_gain, "promote").when(F.col("high") < -most_loss, "reject").otherwise("hold")
    same = exact[by].eqNullSafe(ends[by])
    return exact.join(ends, same).select(exact[by], "items", "base_mean", "other_mean", "gain", "low", "high", "boot_low", "boot_high", gate.alias("gate"))
