"""Costs, budgets, running clips, base against checkpoint, and feedback from what passed, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeflow.operators import comparison, costs, rollouts
from gradeflow.plans import Query, table


def _spans(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as runs: the customer is the account, the priority the profile; they last up to 97 hours."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    started = F.timestamp_seconds(F.unix_timestamp(day) + key % 24 * 3600)
    return table(spark, folder, "orders").select(
        key.alias("run_id"), F.col("o_custkey").alias("account"), F.col("o_orderpriority").alias("profile"), (key % 8 + 1).alias("units"),
        started.alias("started"), F.timestamp_seconds(F.unix_timestamp(started) + (key % 97 + 1) * 3600).alias("ended"),
    )


def _rates(spark: SparkSession, folder: str) -> DataFrame:
    """A rate of each profile from the tenth of every month in which it was ordered, but none for the first one."""
    day = F.date_trunc("month", F.col("o_orderdate").cast("timestamp"))
    counted = table(spark, folder, "orders").groupBy(F.col("o_orderpriority").alias("profile"), day.alias("month")).agg((F.count("*") % 50 + 100).alias("rate"))
    return counted.select("profile", (F.col("month") + F.expr("interval 9 days 5 hours")).alias("valid_from"), "rate")


SPANS_SQL = """SELECT o_orderkey AS run_id, o_custkey AS account, o_orderpriority AS profile, o_orderkey % 8 + 1 AS units,
  CAST(o_orderdate AS TIMESTAMP) + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS started,
  CAST(o_orderdate AS TIMESTAMP) + to_hours(CAST(o_orderkey % 24 + o_orderkey % 97 + 1 AS INTEGER)) AS ended FROM orders"""
RATES_SQL = """SELECT *, coalesce(lead(valid_from) OVER (PARTITION BY profile ORDER BY valid_from), TIMESTAMP '9999-01-01') AS valid_until FROM (
  SELECT o_orderpriority AS profile, date_trunc('month', CAST(o_orderdate AS TIMESTAMP)) + INTERVAL '9 days 5 hours' AS valid_from, count(*) % 50 + 100 AS rate
  FROM orders GROUP BY 1, 2)"""
COST_SQL = f"""
SELECT run_id, account, started, whole::DOUBLE AS hours, coalesce(cost, 0)::DOUBLE AS cost, (whole - coalesce(paid, 0))::DOUBLE AS unpriced_hours FROM (
  SELECT s.run_id, s.account, s.started, date_diff('hour', s.started, s.ended) AS whole, sum(hours * units * rate) AS cost, sum(hours) AS paid
  FROM ({SPANS_SQL}) s LEFT JOIN (SELECT a.run_id, rate, date_diff('hour', greatest(started, valid_from), least(ended, valid_until)) AS hours
    FROM ({SPANS_SQL}) a JOIN ({RATES_SQL}) r ON a.profile = r.profile AND valid_from < ended AND valid_until > started) p ON s.run_id = p.run_id
  GROUP BY ALL)
"""


def run_cost(spark: SparkSession, folder: str) -> DataFrame:
    made = costs.priced(_spans(spark, folder), _rates(spark, folder))
    return made.select("run_id", *[F.round(c, 6).alias(c) for c in ("hours", "cost", "unpriced_hours")])


RUN_COST_SQL = f"SELECT run_id, round(hours, 6) AS hours, round(cost, 6) AS cost, round(unpriced_hours, 6) AS unpriced_hours FROM ({COST_SQL})"


def budget_breaches(spark: SparkSession, folder: str) -> DataFrame:
    """The run with which a customer spends more than three times the balance."""
    spans = _spans(spark, folder)
    cost = costs.priced(spans, _rates(spark, folder)).join(spans.select("run_id", "account", F.col("started").alias("at")), "run_id")
    budgets = table(spark, folder, "customer").select(F.col("c_custkey").alias("account"), F.floor(F.col("c_acctbal") * 3).alias("budget"))
    found = costs.first_breaches(cost, budgets)
    return found.select("account", "budget", F.col("at").cast("timestamp_ntz").alias("breached_at"), "run_id", F.round("spent", 4).alias("spent"))


BREACHES_SQL = f"""
SELECT account, budget, started AS breached_at, run_id, round(spent, 4) AS spent FROM (
  SELECT account, started, run_id, sum(cost) OVER (PARTITION BY account ORDER BY started, run_id) AS spent FROM ({COST_SQL})) c
JOIN (SELECT c_custkey AS account, CAST(floor(c_acctbal * 3) AS BIGINT) AS budget FROM customer) USING (account)
WHERE spent > budget QUALIFY row_number() OVER (PARTITION BY account ORDER BY started, run_id) = 1
"""


def clipped_advantages(spark: SparkSession, folder: str) -> DataFrame:
    """Events as responses of users at steps of a hundred events; the advantage is the distance of the whole value from 40."""
    rows = table(spark, folder, "events").select("event_id", "user_id", F.floor(F.col("event_id") / 100).alias("step"), (F.floor("value") - 40).alias("advantage"))
    made = rollouts.clipped_advantages(rows, "user_id", "step", "advantage", 1.5)
    return made.select("event_id", "advantage", F.round("limit", 6).alias("most"), F.round("clipped", 6).alias("clipped"))


CLIPPED_SQL = """
SELECT event_id, advantage, round(most, 6) AS most, round(greatest(least(advantage, most), -most), 6) AS clipped FROM (
  SELECT *, 1.5::DOUBLE * avg(abs(advantage)) OVER (PARTITION BY user_id ORDER BY step RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS most
  FROM (SELECT event_id, user_id, event_id // 100 AS step, CAST(floor(value) AS BIGINT) - 40 AS advantage FROM events))
"""


def checkpoint_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """Quality labels as the base's results, absence of toxicity as the checkpoint's, by language."""
    items = table(spark, folder, "labels").join(table(spark, folder, "documents").select("doc_id", "lang"), "doc_id")
    base = items.select("doc_id", "lang", F.col("quality").alias("score"))
    made = comparison.compared(base, items.select("doc_id", (1 - F.col("toxic")).alias("score")), "doc_id", "lang", "score", least_gain=0.01)
    return made.select("lang", "items", "gate", *[F.round(c, 6).alias(c) for c in made.columns if c not in ("lang", "items", "gate")])


_DRAWS = " + ".join(f"(share >= {s!r}::DOUBLE)::INTEGER" for s in comparison._poisson_shares())
COMPARISON_SQL = f"""
WITH p AS (SELECT doc_id, lang, quality::DOUBLE AS b, (1 - toxic)::DOUBLE AS o, (1 - toxic - quality)::DOUBLE AS gain
           FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL),
w AS (SELECT lang, n, gain, {_DRAWS} AS w FROM (
        SELECT lang, n, gain, CAST('0x' || substr(md5('bootstrap/' || doc_id || '/' || n), 1, 8) AS BIGINT) / 4294967296::DOUBLE AS share
        FROM p, range({comparison.REPLICATES}) r(n))),
m AS (SELECT lang, n, sum(w * gain) / nullif(sum(w), 0) AS mean FROM w GROUP BY lang, n),
e AS (SELECT lang, quantile_cont(mean, 0.025) AS boot_low, quantile_cont(mean, 0.975) AS boot_high FROM m GROUP BY lang),
x AS (SELECT lang, count(*) AS items, avg(b) AS base_mean, avg(o) AS other_mean, avg(gain) AS gain,
             avg(gain) - {comparison.NORMAL!r}::DOUBLE * stddev_samp(gain) / sqrt(count(*)) AS low,
             avg(gain) + {comparison.NORMAL!r}::DOUBLE * stddev_samp(gain) / sqrt(count(*)) AS high FROM p GROUP BY lang)
SELECT x.lang, items, CASE WHEN low > 0.01 THEN 'promote' WHEN high < 0 THEN 'reject' ELSE 'hold' END AS gate,
  {", ".join(f"round({c}, 6) AS {c}" for c in ("base_mean", "other_mean", "gain", "low", "high", "boot_low", "boot_high"))}
FROM x JOIN e ON x.lang IS NOT DISTINCT FROM e.lang
"""


def implicit_feedback(spark: SparkSession, folder: str) -> DataFrame:
    """Events of a user and day as responses to one prompt; those above 40 passed, the one worth most teaches the others."""
    responses = table(spark, folder, "events").select(
        "event_id", "user_id", F.to_date("ts").alias("day"), F.floor("value").alias("reward"), F.concat_ws(" ", "event_type", "props").alias("response")
    )
    made = rollouts.implicit_feedback(responses, ["user_id", "day"], "event_id", "response", "reward", F.col("reward") > 40)
    return made.select("event_id", "reward", "feedback")


IMPLICIT_SQL = """
WITH r AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day, CAST(floor(value) AS BIGINT) AS reward, concat_ws(' ', event_type, props) AS response FROM events),
b AS (SELECT user_id, day, arg_max(response, (reward, -event_id)) AS feedback FROM r WHERE reward > 40 GROUP BY user_id, day)
SELECT event_id, reward, feedback FROM r LEFT JOIN b USING (user_id, day) WHERE coalesce(reward, 0) <= 40
"""

QUERIES: dict[str, Query] = {
    "run_cost": run_cost,
    "budget_breaches": budget_breaches,
    "clipped_advantages": clipped_advantages,
    "checkpoint_comparison": checkpoint_comparison,
    "implicit_feedback": implicit_feedback,
}

ORACLES: dict[str, str] = {
    "run_cost": RUN_COST_SQL,
    "budget_breaches": BREACHES_SQL,
    "clipped_advantages": CLIPPED_SQL,
    "checkpoint_comparison": COMPARISON_SQL,
    "implicit_feedback": IMPLICIT_SQL,
}
