"""Trace and token tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeflow.operators.records import teacher_prompt
from gradeflow.functions.tokens import selected_count, token_fields


def with_tokens(traces: DataFrame, deltas: str, words: str | None = None) -> DataFrame:
    """Traces with a ``tokens`` array made from per-token deltas, and the count the judge selected."""
    text = (lambda i: F.get(F.col(words), i)) if words else (lambda i: F.lit(""))
    tokens = F.transform(F.col(deltas), lambda d, i: token_fields(text(i), d.cast("double")))
    return traces.withColumn("tokens", tokens).withColumn("judge_selected", selected_count(F.col("tokens")))


def with_teacher_prompt(traces: DataFrame, prompt: str = "prompt", hint: str = "hint") -> DataFrame:
    return traces.withColumn("teacher_prompt", teacher_prompt(F.col(prompt), F.col(hint)))


def token_table(traces: DataFrame, key: str) -> DataFrame:
    """One row per token: ``key, position`` and the token's fields."""
    return traces.select(key, F.posexplode("tokens").alias("position", "_t")).select(key, "position", "_t.*")
