"""What runs cost: spans of time against rates that change, running totals per account, and the first breach of a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeflow.operators.ordering import with_running

HOUR_MS = 3_600_000
DAY_MS = 24 * HOUR_MS


def _ms(column: str):
    return F.unix_millis(F.col(column).cast("timestamp"))


def _buckets(first, last, bucket_ms: int):
    return F.explode(F.sequence(F.floor(first / bucket_ms), F.floor(last / bucket_ms))).alias("_bucket")


def priced(spans: DataFrame, rates: DataFrame, bucket_ms: int = DAY_MS) -> DataFrame:
    """``run_id, hours, cost, unpriced_hours`` of each run, from ``run_id, profile, units, started, ended`` and ``profile, valid_from, rate``.

    A rate, a whole number for each unit and hour, holds from its time until the next one of the profile. A run that goes over a change is priced in pieces;
    time before the first rate is ``unpriced_hours``. Both sides are cut into buckets of time and joined on profile and bucket, so a profile that all
    runs share is many keys, and a run meets only the rates of its own days. Whole numbers are added, so the order doesn't matter. A run without start
    or end, or that ends before it starts, has no hours.
    """
    begin, end = F.coalesce(_ms("started"), F.lit(0)), F.coalesce(_ms("ended"), F.lit(0))
    known = F.col("started").isNotNull() & F.col("ended").isNotNull()
    timed = spans.select("run_id", "profile", "units", begin.alias("_begin"), F.when(known & (end > begin), end).otherwise(begin).alias("_end"))
    horizon = timed.agg(F.max("_end")).first()[0] or 0
    following = F.lead("_from").over(Window.partitionBy("profile").orderBy("_from"))
    held = rates.where("valid_from is not null").groupBy("profile", _ms("valid_from").alias("_from")).agg(F.max("rate").alias("rate"))
    held = held.withColumn("_until", F.least(F.coalesce(following, F.lit(horizon)), F.lit(horizon))).where("_from < _until")
    pieces = timed.where("_begin < _end").select("*", _buckets(F.col("_begin"), F.col("_end") - 1, bucket_ms))
    prices = held.select("*", _buckets(F.col("_from"), F.col("_until") - 1, bucket_ms))
    start = F.greatest("_begin", "_from", F.col("_bucket") * bucket_ms)
    stop = F.least("_end", "_until", (F.col("_bucket") + 1) * bucket_ms)
    met = pieces.join(prices, ["profile", "_bucket"]).select("run_id", (stop - start).alias("_ms"), "units", "rate").where("_ms > 0")
    paid = met.groupBy("run_id").agg(F.sum("_ms").alias("_paid"), F.sum(F.col("_ms") * F.col("units") * F.col("rate")).alias("_cost"))
    whole = timed.groupBy("run_id").agg(F.sum(F.col("_end") - F.col("_begin")).alias("_whole"))
    zero = F.lit(0).cast("long")
    return whole.join(paid, "run_id", "left").select(
        "run_id",
        (F.col("_whole") / HOUR_MS).alias("hours"),
        (F.coalesce("_cost", zero) / HOUR_MS).alias("cost"),
        ((F.col("_whole") - F.coalesce("_paid", zero)) / HOUR_MS).alias("unpriced_hours"),
    )


def running_spend(costs: DataFrame, account: str = "account", at: str = "at", key: str = "run_id", cost: str = "cost") -> DataFrame:
    """``costs`` with ``spent``: what the account has spent up to and with this row, by time, then by key."""
    return with_running(costs, [at, key], [account], {"spent": cost})


def first_breaches(costs: DataFrame, budgets: DataFrame, account: str = "account", at: str = "at", key: str = "run_id", cost: str = "cost") -> DataFrame:
    """``account, budget, at, run_id, spent``: the row with which each account first spends more than its budget.

    The running totals are carried over partitions (:func:`gradeflow.operators.ordering.with_running`), so an account that has a third of all runs isn't sorted in one
    task. Accounts that stay within their budget, or have none, give no row.
    """
    over = running_spend(costs, account, at, key, cost).join(budgets.select(account, "budget"), account).where(F.col("spent") > F.col("budget"))
    first = F.min(F.struct(at, key, "spent", "budget")).alias("_first")
    return over.groupBy(account).agg(first).select(account, "_first.budget", f"_first.{at}", f"_first.{key}", "_first.spent")
