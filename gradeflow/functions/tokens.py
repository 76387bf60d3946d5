"""Teacher and student log-probabilities of a token."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The base log-probability, and the preference from which a token counts as selected.
BASE_LOGPROB = -1.7
SELECTED_FROM = 0.25


def token_fields(text: Column, delta: Column) -> Column:
    """A token's preference delta with the log-probabilities and the selection flag it implies."""
    return F.struct(
        text.alias("text"),
        delta.alias("delta"),
        F.round(F.lit(BASE_LOGPROB) + delta, 3).alias("student_logprob"),
        F.round(F.lit(BASE_LOGPROB) + 2 * delta, 3).alias("teacher_logprob"),
        is_selected(delta).alias("selected"),
    )


def preference(student: Column, teacher: Column) -> Column:
    """The delta of measured log-probabilities."""
    return teacher - student


def is_selected(delta: Column) -> Column:
    return F.abs(delta) >= SELECTED_FROM


def selected_count(tokens: Column) -> Column:
    return F.size(F.filter(tokens, lambda t: t["selected"]))
