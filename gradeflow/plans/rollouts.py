"""Advantages, sampling filters, evaluation figures, masked and failing lines over events, responses and token tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeflow.functions import logs
from gradeflow.functions.reward import graded_score
from gradeflow.operators import rollouts, traces
from gradeflow.plans import Query, table
from gradeflow.plans.logs import FAILED_SQL, LINES_SQL, as_lines
from gradeflow.plans.scoring import GRADED_SQL, RESPONSES_SQL, responses


def _sampled(spark: SparkSession, folder: str) -> DataFrame:
    """Events as responses: the user is the prompt, whole units of the value are the reward."""
    return table(spark, folder, "events").select("event_id", "user_id", "event_type", F.floor("value").alias("reward"))


def group_advantages(spark: SparkSession, folder: str) -> DataFrame:
    made = rollouts.group_advantages(_sampled(spark, folder), "user_id")
    return made.select("event_id", "reward", *[F.round(c, 6).alias(c) for c in ("grpo", "centred", "leave_one_out")])


ADVANTAGES_SQL = """
SELECT event_id, CAST(reward AS BIGINT) AS reward,
  round(CASE WHEN n = 1 THEN reward ELSE (reward - total / n) / (std + 1e-6::DOUBLE) END, 6) AS grpo,
  round(CASE WHEN n = 1 THEN reward ELSE reward - total / n END, 6) AS centred,
  round(CASE WHEN n = 1 THEN reward ELSE reward - (total - reward) / (n - 1) END, 6) AS leave_one_out
FROM (SELECT event_id, reward, count(*) OVER u AS n, sum(reward) OVER u AS total, stddev_samp(reward) OVER u AS std
      FROM (SELECT event_id, user_id, floor(value) AS reward FROM events) WINDOW u AS (PARTITION BY user_id))
"""


def dynamic_sampling(spark: SparkSession, folder: str) -> DataFrame:
    """Events of users and days as groups with rewards of 0 and 1, of the last steps only, where rewards differ."""
    events = table(spark, folder, "events").select(
        "event_id",
        F.concat_ws("/", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("prompt"),
        (F.col("value") > 40).cast("int").alias("reward"),
        (F.col("event_id") - F.col("event_id") % 7).alias("sampled"),
    )
    return rollouts.with_spread(rollouts.fresh(events, "event_id", "sampled"), "prompt").drop("sampled")


DYNAMIC_SQL = """
SELECT event_id, prompt, reward FROM (
  SELECT *, min(reward) OVER (PARTITION BY prompt) < max(reward) OVER (PARTITION BY prompt) AS differ FROM (
    SELECT event_id, user_id || '/' || CAST(ts AS DATE) AS prompt, CAST(value > 40 AS INTEGER) AS reward
    FROM events WHERE event_id % 7 <= 3))
WHERE differ
"""


def pass_at_k(spark: SparkSession, folder: str) -> DataFrame:
    found = rollouts.pass_at_k(_sampled(spark, folder), "user_id", F.col("reward") >= 100, 3)
    return found.withColumn("pass_at_k", F.round("pass_at_k", 9))


PASS_SQL = """
SELECT user_id, n AS responses, c AS passes, CASE WHEN n >= 3 THEN round(1 - greatest(n - c, 0)::DOUBLE / n
  * greatest(n - c - 1, 0) / (n - 1) * greatest(n - c - 2, 0) / (n - 2), 9) END AS pass_at_k
FROM (SELECT user_id, count(*) AS n, count(*) FILTER (floor(value) >= 100) AS c FROM events GROUP BY user_id)
"""


def evaluation_figures(spark: SparkSession, folder: str) -> DataFrame:
    """Graded responses by language; those whose last sign is a full stop count as invalid."""
    scored = responses(spark, folder).withColumn(
        "score", graded_score(F.col("solution"), F.col("truth"), F.col("feedback"))["score"]
    )
    valid = ~F.rtrim("solution").endswith(".")
    figures = rollouts.evaluation_figures(scored, "lang", F.col("score"), valid, F.length("solution"))
    return figures.withColumns({c: F.round(c, 6) for c in figures.columns[2:]})


EVALUATION_SQL = f"""
SELECT lang, count(*) AS responses, round(avg(score), 6) AS mean_reward, round(stddev_samp(score), 6) AS std_reward,
  round(count(*) FILTER (ends_with(rtrim(solution), '.'))::DOUBLE / count(*), 6) AS invalid_rate,
  round(quantile_cont(length(solution), 0.5)::DOUBLE, 6) AS length_p50,
  round(quantile_cont(length(solution), 0.9)::DOUBLE, 6) AS length_p90,
  round(quantile_cont(length(solution), 0.99)::DOUBLE, 6) AS length_p99
FROM ({RESPONSES_SQL}) r JOIN ({GRADED_SQL}) g ON r.doc_id = g.doc_id GROUP BY lang
"""


def feedback_used(spark: SparkSession, folder: str) -> DataFrame:
    used = rollouts.used_fraction(responses(spark, folder), "lang", "feedback")
    return used.withColumn("feedback_used", F.round("feedback_used", 6))


USED_SQL = """
SELECT lang, count(*) AS records, round(count(*) FILTER (quality = 0 AND coalesce(source, '') <> '')::DOUBLE / count(*), 6)
  AS feedback_used FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang
"""


def token_divergence(spark: SparkSession, folder: str) -> DataFrame:
    made = traces.with_tokens(table(spark, folder, "embeddings"), "embedding")
    tokens = F.col("tokens")
    return made.select(
        "vec_id",
        F.round(rollouts.mean_divergence(tokens), 6).alias("divergence"),
        F.round(rollouts.clip_fraction(tokens, "teacher_logprob", "student_logprob"), 6).alias("clipped"),
    )


DIVERGENCE_SQL = """
SELECT vec_id, round(avg(greatest(least(greatest(student, -10) - greatest(teacher, -10), 10), -10)), 6) AS divergence,
  round(avg(CASE WHEN abs(exp(teacher - student) - 1) > 0.2::DOUBLE THEN 1 ELSE 0 END), 6) AS clipped
FROM (SELECT vec_id, round(-1.7::DOUBLE + delta, 3) AS student, round(-1.7::DOUBLE + 2 * delta, 3) AS teacher
      FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS delta FROM embeddings)) GROUP BY vec_id
"""

def redacted_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a secret of some kind put in, masked."""
    docs = table(spark, folder, "documents")
    number = F.col("doc_id").cast("string")
    planted = (
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("Authorization: Bearer abcdef."), number, F.lit("/x= sent sk-0123456789ab"), number))
        .when(F.col("doc_id") % 4 == 1, F.concat(F.lit("GET https://x.y/z?a=1&Signature="), number, F.lit("%2F&b=2 password: p"), number))
        .otherwise("")
    )
    shown = docs.select("doc_id", logs.redact(F.concat(planted, F.lit(" "), "text")).alias("r"))
    return shown.select("doc_id", "r.*")


def _redact_sql() -> str:
    inner = """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Authorization: Bearer abcdef.' || doc_id || '/x= sent sk-0123456789ab' || doc_id
        WHEN 1 THEN 'GET https://x.y/z?a=1&Signature=' || doc_id || '%2F&b=2 password: p' || doc_id ELSE '' END || ' ' || text AS line
      FROM documents"""
    for kind, pattern in logs.SECRETS.items():
        inner = f"""SELECT * REPLACE (regexp_replace(line, '{pattern}', '\\1{logs.MASK}', 'g') AS line),
            CAST(len(regexp_extract_all(line, '{pattern}')) AS INTEGER) AS {kind} FROM ({inner})"""
    return inner


FAILURE_TEXTS = ("CUDA out of memory", "NCCL watchdog Timeout", "request timed out", "RuntimeError: odd", "step done", "KeyError: x", "Permission denied", "disk: No space left")


def failure_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Log lines and documents with a text of failure in the middle of every eighth, counted by the kind that their text tells."""
    told = F.element_at(F.array(*[F.lit(t) for t in FAILURE_TEXTS]), (F.col("number") / 8 % len(FAILURE_TEXTS) + 1).cast("int"))
    lines = as_lines(table(spark, folder, "events")).select(F.col("line_no").alias("number"), "line")
    texts = table(spark, folder, "documents").select(F.col("doc_id").alias("number"), F.col("text").alias("line"))
    both = lines.union(texts).select(F.when(F.col("number") % 8 == 0, F.concat_ws(" ", "line", told, "line")).otherwise(F.col("line")).alias("line"))
    return both.groupBy(logs.failure_kind(F.col("line")).alias("kind")).agg(F.count("*").alias("lines"))


def _kinds_sql() -> str:
    any_of = lambda texts: " OR ".join(f"contains(low, '{t}')" for t in texts)
    kinds = " ".join(f"WHEN {any_of(texts)} THEN '{kind}'" for kind, texts in logs.FAILURE_KINDS.items())
    told = ", ".join(f"'{t}'" for t in FAILURE_TEXTS)
    return f"""
SELECT CASE {kinds} WHEN {FAILED_SQL} THEN 'other' END AS kind, count(*) AS lines FROM (
  SELECT line, lower(line) AS low FROM (
    SELECT CASE WHEN number % 8 = 0 THEN concat_ws(' ', line, [{told}][number // 8 % {len(FAILURE_TEXTS)} + 1], line) ELSE line END AS line FROM (
      SELECT line_no AS number, line FROM ({LINES_SQL}) UNION ALL SELECT doc_id, text FROM documents)))
GROUP BY 1"""

QUERIES: dict[str, Query] = {
    "group_advantages": group_advantages,
    "dynamic_sampling": dynamic_sampling,
    "pass_at_k": pass_at_k,
    "evaluation_figures": evaluation_figures,
    "feedback_used": feedback_used,
    "token_divergence": token_divergence,
    "redacted_lines": redacted_lines,
    "failure_kinds": failure_kinds,
}

ORACLES: dict[str, str] = {
    "group_advantages": ADVANTAGES_SQL,
    "dynamic_sampling": DYNAMIC_SQL,
    "pass_at_k": PASS_SQL,
    "evaluation_figures": EVALUATION_SQL,
    "feedback_used": USED_SQL,
    "token_divergence": DIVERGENCE_SQL,
    "redacted_lines": _redact_sql(),
    "failure_kinds": _kinds_sql(),
}
