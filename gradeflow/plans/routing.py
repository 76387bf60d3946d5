"""Queries on the choice of records and teachers, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeflow.operators import routing
from gradeflow.plans import Query, table

MOST_TOKENS = 60


def _prompts(spark: SparkSession, folder: str) -> DataFrame:
    """The user's turns of each conversation as one prompt."""
    turns = table(spark, folder, "conversations").where("role = 'user'")
    message = F.struct("turn", "role", F.col("text").alias("content"))
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(message)).alias("prompt"))


def overlong_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations whose prompt isn't too long."""
    tokens = routing.prompt_tokens(F.col("prompt"))
    return routing.without_overlong(_prompts(spark, folder), "prompt", MOST_TOKENS).select(
        "conv_id", tokens.cast("long").alias("tokens"), F.size("prompt").cast("long").alias("messages")
    )


def _teachers(spark: SparkSession, folder: str) -> DataFrame:
    """A teacher for each source whose least language isn't ``de``, and a second one that is never taken; the others have none."""
    docs = table(spark, folder, "documents")
    found = docs.groupBy("source").agg(F.min("lang").alias("least"), F.max("lang").alias("most"))
    named = found.where("least <> 'de'").select("source", F.concat_ws("-", "source", "most").alias("teacher"))
    return named.union(named.select("source", F.concat("teacher", F.lit("-second"))))


def teacher_routing(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's teacher by its source."""
    docs = table(spark, folder, "documents").select("doc_id", "source")
    return routing.routed(docs, _teachers(spark, folder), "source").select("doc_id", "source", "teacher")


def teacher_missing(spark: SparkSession, folder: str) -> DataFrame:
    """Sources without a teacher."""
    return routing.unrouted(table(spark, folder, "documents"), _teachers(spark, folder), "source")


TEACHERS_SQL = """SELECT source, source || '-' || max(lang) AS teacher FROM documents GROUP BY source HAVING min(lang) <> 'de'"""

QUERIES: dict[str, Query] = {"overlong_filter": overlong_filter, "teacher_routing": teacher_routing, "teacher_missing": teacher_missing}

ORACLES: dict[str, str] = {
    "overlong_filter": rf"""SELECT conv_id, CAST(sum(len(regexp_extract_all(text, '\S+'))) AS BIGINT) AS tokens, count(*) AS messages FROM conversations
        WHERE role = 'user' GROUP BY conv_id HAVING tokens <= {MOST_TOKENS}""",
    "teacher_routing": f"SELECT doc_id, source, teacher FROM documents LEFT JOIN ({TEACHERS_SQL}) USING (source)",
    "teacher_missing": f"""SELECT source, count(*) AS records FROM documents
        WHERE source NOT IN (SELECT source FROM ({TEACHERS_SQL})) GROUP BY source""",
}
