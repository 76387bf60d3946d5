"""Tall turn tables to one record's worth of fields per conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeflow.functions import conversation as conv
from gradeflow.operators.frames import join_on

def _shaped(turns: DataFrame, key: str, position: str, role: str, text: str) -> DataFrame:
    return turns.select(
        F.col(key),
        F.col(position).alias("_pos"),
        F.lower(F.coalesce(F.col(role), F.lit(""))).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )


def _arrays(shaped: DataFrame, keys: list[str | Column]) -> DataFrame:
    return shaped.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_pos", "role", "text"))).alias("turns"))


def _segment(segment_turns: int) -> Column:
    return F.floor(F.col("_pos") / segment_turns).alias("segment")


def turn_arrays(
    turns: DataFrame,
    key: str = "conv_id",
    position: str = "turn",
    role: str = "role",
    text: str = "text",
    segment_turns: int | None = None,
) -> DataFrame:
    """``key, turns``: one row per conversation, its turns as an ordered array of ``role, text``.

    With ``segment_turns`` it is ``key, segment, turns``, one row per so many positions, for conversations that no
    single cell could hold; ``key, segment`` is then the key to join on.
    """
    shaped = _shaped(turns, key, position, role, text)
    return _arrays(shaped, [key] if segment_turns is None else [key, _segment(segment_turns)])


def conversation_fields(
    turns: DataFrame,
    key: str = "conv_id",
    position: str = "turn",
    role: str = "role",
    text: str = "text",
    segment_turns: int | None = None,
) -> DataFrame:
    """``key, prompt, answer, trajectory``, one row per conversation of any length.

    With ``segment_turns`` there is a ``segment`` after the key; see :func:`turn_arrays`. Prompt and answer are
    then those of the whole conversation in each of its segments.
    """
    parts = turn_arrays(turns, key, position, role, text, segment_turns)
    parts = parts.withColumn("_f", conv.conversation_fields(F.col("turns")))
    if segment_turns is None:
        return parts.select(key, "_f.prompt", "_f.answer", "_f.trajectory")
    trajectories = parts.select(key, "segment", "_f.trajectory")
    ends = _ends(_shaped(turns, key, position, role, text), key)
    return join_on(trajectories, ends, [key]).select(key, "segment", "prompt", "answer", "trajectory")


def _ends(shaped: DataFrame, key: str) -> DataFrame:
    asked = F.col("role").isin(*conv.ASKING_ROLES)
    answered = F.col("role").isin(*conv.ANSWERING_ROLES)
    first_asked = F.min_by("text", _at(asked))
    return shaped.groupBy(key).agg(
        F.coalesce(first_asked, F.min_by("text", "_pos"), F.lit("")).alias("prompt"),
        F.coalesce(F.max_by("text", _at(answered)), F.lit("")).alias("answer"),
    )


def _at(condition: Column) -> Column:
    return F.when(condition, F.col("_pos"))


def with_hints(turns: DataFrame, hints: DataFrame, placement: str, wrong: Column, key: str = "conv_id", position: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``key, position, role, text`` of all turns with the hints of ``key, hint`` as turns of their own, in the tall form.

    The same as :func:`gradeflow.functions.conversation.with_hint` on arrays, with ``wrong`` saying which turns are mistakes. Turns from the hint's place on move up by
    one. A conversation is never gathered: one row of numbers for each of them is aggregated and joined back.
    """
    ends = turns.groupBy(key).agg(F.min(position).alias("_first"), F.max(position).alias("_last"), F.min(F.when(wrong, F.col(position))).alias("_mistake"))
    at = {"before-mistake": F.col("_mistake"), "after-trace": F.col("_last") + 1, "system": F.col("_first")}[placement]
    told = hints.where("hint is not null").groupBy(key).agg(F.min("hint").alias("_hint"))
    placed = join_on(ends, told, [key]).select(key, at.alias("_at"), "_hint").where("_at is not null")
    later = (F.col(position) >= F.col("_at")).cast("int")
    moved = join_on(turns, placed, [key], "left").select(key, (F.col(position) + F.coalesce(later, F.lit(0))).alias(position), F.col(role).alias(role), F.col(text).alias(text))
    added = placed.select(key, F.col("_at").alias(position), F.lit(conv.hint_role(placement)).alias(role), F.col("_hint").alias(text))
    return moved.union(added)
