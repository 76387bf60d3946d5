"""Reading a conversation: prompt, answer and trajectory out of an array of turns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Role names as they appear in conversation exports, and the label of a nameless turn.
ASKING_ROLES = ("human", "user")
ANSWERING_ROLES = ("gpt", "assistant", "agent")
ROLE_KEYS = ("from", "role", "speaker")
TEXT_KEYS = ("value", "content", "message")
NAMELESS = "turn"
# Where a hint may stand.
HINT_PLACEMENTS = ("before-mistake", "after-trace", "system")


def turn_line(role: Column, text: Column) -> Column:
    return F.concat(F.when(role == "", NAMELESS).otherwise(role), F.lit(": "), text)


def prompt_of(turns: Column) -> Column:
    asked = F.filter(turns, lambda t: t["role"].isin(*ASKING_ROLES))
    return F.coalesce(F.get(asked, F.lit(0))["text"], F.get(turns, F.lit(0))["text"], F.lit(""))


def answer_of(turns: Column) -> Column:
    answered = F.filter(turns, lambda t: t["role"].isin(*ANSWERING_ROLES))
    return F.coalesce(F.try_element_at(answered, F.lit(-1))["text"], F.lit(""))


def trajectory_of(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: turn_line(t["role"], t["text"])), "\n")


def conversation_fields(turns: Column) -> Column:
    """``struct<prompt, answer, trajectory>`` of an ``array<struct<role, text>>``."""
    return F.struct(
        prompt_of(turns).alias("prompt"),
        answer_of(turns).alias("answer"),
        F.coalesce(trajectory_of(turns), F.lit("")).alias("trajectory"),
    )


def _member(turn: Column, key: str, kind: str) -> Column:
    return F.try_variant_get(turn, f"$.{key}", kind)


def normalize_turn(turn: Column) -> Column:
    """One exported turn of any shape (``variant``) as ``struct<role, text>``.

    A text key that is present but null counts as present, so later keys are not tried.
    """
    is_object = F.try_variant_get(turn, "$", "map<string,variant>").isNotNull()
    role = F.coalesce(*[F.nullif(_member(turn, k, "string"), F.lit("")) for k in ROLE_KEYS], F.lit(""))
    text = F.lit("")
    for key in reversed(TEXT_KEYS):
        here = F.coalesce(_member(turn, key, "string"), F.lit(""))
        text = F.when(_member(turn, key, "variant").isNotNull(), here).otherwise(text)
    return F.struct(
        F.when(is_object, F.lower(role)).otherwise("").alias("role"),
        F.when(is_object, text).otherwise(F.coalesce(F.try_variant_get(turn, "$", "string"), F.lit(""))).alias("text"),
    )


def exported_conversation_fields(conversation: Column) -> Column:
    """``struct<prompt, answer, trajectory>`` of a ``variant`` holding a list of turns or plain text."""
    listed = F.try_variant_get(conversation, "$", "array<variant>")
    plain = F.try_variant_get(conversation, "$", "string")
    turns = F.transform(F.coalesce(listed, F.array().cast("array<variant>")), normalize_turn)
    is_object = F.try_variant_get(conversation, "$", "map<string,variant>").isNotNull()
    whole = F.struct(plain.alias("prompt"), plain.alias("answer"), F.lit("").alias("trajectory"))
    return F.when(listed.isNull() & plain.isNotNull() & ~is_object, whole).otherwise(conversation_fields(turns))


def first_turn(turns: Column, wrong: Callable[[Column], Column]) -> Column:
    """The place, from 0, of the first turn that is wrong; null where none is."""
    return F.nullif(F.array_position(F.transform(turns, lambda t: F.coalesce(wrong(t), F.lit(False))), True), F.lit(0)) - 1


def hint_role(placement: str) -> str:
    if placement not in HINT_PLACEMENTS:
        raise ValueError(f"no such placement: {placement}")
    return "system" if placement == "system" else "user"


def with_hint(turns: Column, hint: Column, placement: str, mistake: Column) -> Column:
    """``turns`` (``array<struct<role, text>>``) with a turn that holds the hint.

    ``before-mistake`` puts it in front of the turn at ``mistake`` (from 0), ``after-trace`` behind all turns, ``system`` in front of
    all as a turn of the system. Without a hint, or without a mistake to put it before, turns stay as they are.
    """
    told = F.array(F.struct(F.lit(hint_role(placement)).alias("role"), hint.alias("text")))
    at = {"before-mistake": mistake, "after-trace": F.size(turns), "system": F.lit(0)}[placement].cast("int")
    spliced = F.concat(F.slice(turns, F.lit(1), at), told, F.slice(turns, at + 1, F.size(turns)))
    return F.when(hint.isNull() | at.isNull(), turns).otherwise(spliced)
