"""Groups of sampled responses: advantages, sampling filters, evaluation figures, per-token divergence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeflow.operators.frames import join_on
from gradeflow.operators.ordering import with_running

# Bounds of the per-token divergence and of the policy ratio.
LOGPROB_FLOOR = -10.0
DIVERGENCE_CLAMP = 10.0
CLIP = 0.2
STD_EPSILON = 1e-6
LENGTH_SHARES = (0.5, 0.9, 0.99)


def group_advantages(responses: DataFrame, group: str, reward: str = "reward") -> DataFrame:
    """``responses`` with ``grpo``, ``centred`` and ``leave_one_out``: each reward against those of its group.

    ``grpo`` is the distance from the group's mean in sample deviations, ``centred`` the distance itself,
    ``leave_one_out`` the distance from the mean of the others. A lone response keeps its reward. Groups are
    aggregated and joined back, so a hot one is never sorted or held in one task. A null reward gets nulls.
    """
    value = F.col(reward).cast("double")
    stats = responses.groupBy(group).agg(
        F.count(value).alias("_n"), F.sum(value).alias("_sum"), F.stddev_samp(value).alias("_std")
    )
    alone, mean = F.col("_n") == 1, F.col("_sum") / F.col("_n")
    return join_on(responses, stats, [group]).select(
        *responses.columns,
        F.when(alone, value).otherwise((value - mean) / (F.col("_std") + STD_EPSILON)).alias("grpo"),
        F.when(alone, value).otherwise(value - mean).alias("centred"),
        F.when(alone, value).otherwise(value - (F.col("_sum") - value) / (F.col("_n") - 1)).alias("leave_one_out"),
    )


def with_spread(responses: DataFrame, group: str, reward: str = "reward") -> DataFrame:
    """The responses of groups whose rewards differ; the others teach nothing."""
    spread = responses.groupBy(group).agg(F.min(reward).alias("_low"), F.max(reward).alias("_high")).where("_low < _high")
    return join_on(responses, spread, [group]).select(*responses.columns)


def fresh(responses: DataFrame, step: str, sampled: str, most: int = 3) -> DataFrame:
    """The responses sampled at most so many steps before the step that uses them."""
    return responses.where(F.col(step) - F.col(sampled) <= most)


def pass_at_k(responses: DataFrame, group: str, passed: Column, k: int) -> DataFrame:
    """``group, responses, passes, pass_at_k``: the chance that k responses drawn without repeats hold one that passed.

    Null where the group has fewer than k.
    """
    counted = responses.groupBy(group).agg(F.count("*").alias("responses"), F.count_if(passed).alias("passes"))
    n, failed = F.col("responses"), F.col("responses") - F.col("passes")
    missed = F.aggregate(
        F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda p, i: p * F.greatest(failed - i, F.lit(0)) / (n - i)
    )
    return counted.withColumn("pass_at_k", F.when(n >= k, 1 - missed))


def evaluation_figures(scored: DataFrame, by: str, reward: Column, valid: Column, length: Column) -> DataFrame:
    """``by, responses, mean_reward, std_reward, invalid_rate`` and the response lengths at ``LENGTH_SHARES``.

    Means and deviations come from merged counts, means and squared distances, so large rewards cancel nothing. Lengths are
    counted first, so the quantiles are exact and no task holds more than the distinct lengths.
    """
    figures = scored.groupBy(by).agg(
        F.count("*").alias("responses"),
        F.avg(reward.cast("double")).alias("mean_reward"),
        F.stddev_samp(reward.cast("double")).alias("std_reward"),
        (F.count_if(~F.coalesce(valid, F.lit(False))) / F.count("*")).alias("invalid_rate"),
    )
    counted = scored.groupBy(by, length.alias("_length")).agg(F.count("*").alias("_n"))
    shares = [F.percentile("_length", share, F.col("_n")).alias(f"length_p{share * 100:.0f}") for share in LENGTH_SHARES]
    return join_on(figures, counted.groupBy(by).agg(*shares), [by])


def clipped_advantages(rows: DataFrame, run: str, step: str, advantage: str, times: float = 3.0) -> DataFrame:
    """``rows`` with ``limit``, so many times the mean size of the run's advantages up to this step, and ``clipped``.

    The running mean is over the sums of each step, carried from partition to partition, so a run of any length is no single sort.
    """
    per_step = rows.groupBy(run, step).agg(F.sum(F.abs(F.col(advantage).cast("double"))).alias("_size"), F.count(advantage).alias("_n"))
    running = with_running(per_step, [step], [run], {"_sizes": "_size", "_count": "_n"})
    limits = running.select(run, step, F.when(F.col("_count") > 0, times * F.col("_sizes") / F.col("_count")).alias("limit"))
    clipped = F.greatest(F.least(F.col(advantage), F.col("limit")), -F.col("limit"))
    return join_on(rows, limits, [run, step]).select(*rows.columns, "limit", F.when(F.col(advantage).isNotNull(), clipped).alias("clipped"))


def implicit_feedback(responses: DataFrame, group: Sequence[str], key: str, response: str, reward: str, passed: Column) -> DataFrame:
    """The responses that didn't pass, with ``feedback``: the best one of their group that did, by reward, then by the smaller key.

    Null where no response of the group passed. One row per group is joined, so a hot group is only aggregated.
    """
    marked = responses.withColumn("_passed", F.coalesce(passed, F.lit(False)))
    best = F.max_by(response, F.struct(F.col(reward), -F.col(key)))
    told = marked.where("_passed").groupBy(*group).agg(best.alias("feedback"))
    return join_on(marked.where("not _passed").drop("_passed"), told, list(group), "left")


def used_fraction(records: DataFrame, by: str, feedback: str) -> DataFrame:
    """``by, records, feedback_used``: the share of records that carry feedback."""
    used = F.coalesce(F.col(feedback), F.lit("")) != ""
    return records.groupBy(by).agg(F.count("*").alias("records"), (F.count_if(used) / F.count("*")).alias("feedback_used"))


def _mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    return F.when(F.size(values) > 0, total / F.size(values))


def mean_divergence(tokens: Column) -> Column:
    """Mean over tokens of student minus teacher log-probability, both floored and the difference clamped."""

    def one(token: Column) -> Column:
        student, teacher = (F.greatest(token[name], F.lit(LOGPROB_FLOOR)) for name in ("student_logprob", "teacher_logprob"))
        return F.greatest(F.least(student - teacher, F.lit(DIVERGENCE_CLAMP)), F.lit(-DIVERGENCE_CLAMP))

    return _mean(F.transform(tokens, one))


def clip_fraction(tokens: Column, new: str, old: str, clip: float = CLIP) -> Column:
    """Share of tokens whose probability ratio leaves the interval of ``clip`` around 1."""
    return _mean(F.transform(tokens, lambda t: (F.abs(F.exp(t[new] - t[old]) - 1) > clip).cast("double")))
