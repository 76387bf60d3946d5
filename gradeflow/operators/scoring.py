"""Scoring responses with any reward: a Column function, built in or the user's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeflow.functions.reward import RewardFn, graded_score, routed_score


def _has(info_type: T.DataType, name: str) -> bool:
    return isinstance(info_type, T.StructType) and name in info_type.names


def _member(info: Column, info_type: T.DataType, name: str, default: Column) -> Column:
    """A field of ``extra_info``, or the default where records have no such field."""
    return info[name] if _has(info_type, name) else default


def routed_reward(info_type: T.DataType) -> RewardFn:
    """The reward chosen by the record's source; a lone text as ``reward_terms`` counts as one term."""

    def reward(source: Column, solution: Column, truth: Column, info: Column) -> Column:
        terms = _member(info, info_type, "reward_terms", F.lit(None).cast("array<string>"))
        if _has(info_type, "reward_terms") and info_type["reward_terms"].dataType == T.StringType():
            terms = F.when(terms.isNotNull(), F.array(terms))
        feedback = _member(info, info_type, "feedback_raw", F.lit(""))
        return routed_score(source, solution, truth, terms, feedback)

    return reward


def graded_reward(info_type: T.DataType) -> RewardFn:
    """Full marks for an exact answer and half for a response that holds it."""

    def reward(source: Column, solution: Column, truth: Column, info: Column) -> Column:
        return graded_score(solution, truth, _member(info, info_type, "feedback_raw", F.lit("")))

    return reward


def score(rows: DataFrame, reward: RewardFn | None = None) -> DataFrame:
    """``rows`` with the reward's fields added; without a reward, the one their source asks for.

    ``rows`` have ``data_source, solution_str, ground_truth, extra_info``, the arguments of a reward.
    """
    chosen = reward or routed_reward(rows.schema["extra_info"].dataType)
    result = chosen(F.col("data_source"), F.col("solution_str"), F.col("ground_truth"), F.col("extra_info"))
    return rows.withColumn("_reward", result).select(*rows.columns, "_reward.*")


def score_responses(
    responses: DataFrame, records: DataFrame, key: str, reward: RewardFn | None = None
) -> DataFrame:
    """Responses (``key, solution_str``) scored against their chat records, one record per key."""
    asked = records.select(
        key, "data_source", F.col("reward_model.ground_truth").alias("ground_truth"), "extra_info"
    )
    return score(responses.join(asked, key), reward)
