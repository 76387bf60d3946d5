"""Which records a trainer takes, and which teacher each of them goes to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prompt_tokens(prompt: Column) -> Column:
    """The tokens of all messages of a prompt, counted as runs without white space; none in a null prompt or message."""
    count = lambda n, message: n + F.coalesce(F.regexp_count(message["content"], F.lit(r"(?U)\S+")), F.lit(0))
    return F.coalesce(F.aggregate(prompt, F.lit(0), count), F.lit(0))


def without_overlong(records: DataFrame, prompt: str, most: int, length: Callable[[Column], Column] = prompt_tokens) -> DataFrame:
    """Records whose prompt has a length of at most ``most``. A caller with a tokenizer passes its own length; one that it can't tell fails the job."""
    known = F.coalesce(length(F.col(prompt)), F.raise_error(F.lit("a prompt of unknown length")).cast("long"))
    return records.where(known <= most)


def routed(records: DataFrame, teachers: DataFrame, key: str = "data_source") -> DataFrame:
    """Records with the ``teacher`` of their source, from a table of ``key`` and ``teacher``; null where it has none.

    Of several teachers of one source the least by name takes its records. A null source has no teacher.
    """
    return records.join(teachers.groupBy(key).agg(F.min("teacher").alias("teacher")), key, "left")


def unrouted(records: DataFrame, teachers: DataFrame, key: str = "data_source") -> DataFrame:
    """Sources without a teacher, null among them, and how many records each has."""
    return records.groupBy(key).agg(F.count("*").alias("records")).join(teachers, key, "left_anti")
