"""Run-log analytics. Lines are ``run_id, line_no, line``; ``line_no`` only has to order a run's lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeflow.functions import logs as lf
from gradeflow.functions.text import strip
from gradeflow.operators.ordering import top_per_group

KEPT_LINES = 1000
SHOWN_LINES = 8


def _where(value: Column | str, condition: Column) -> Column:
    return F.when(condition, F.col(value) if isinstance(value, str) else value)


def step_metrics(lines: DataFrame, wide_numbers: bool = False) -> DataFrame:
    """``run_id, step`` and the last value each metric was given at that step.

    Works on a batch and on a stream. A plain text search spares most lines the patterns. All
    aggregate buffers are numbers, so rows are combined by hash before the shuffle, and a hot run
    sends one small row per step and task.
    """
    likely = lines.where(F.col("line").contains(lf.STEP_WORD))
    parsed = likely.select("run_id", "line_no", "line", lf.step_of(F.col("line")).alias("step")).where(
        F.col("step").isNotNull()
    )
    values = parsed.select(
        "run_id",
        "line_no",
        "step",
        *[lf.metric_of(F.col("line"), name, wide_numbers).alias(name) for name in lf.METRIC_NAMES],
    )
    return values.groupBy("run_id", "step").agg(
        *[F.max_by(name, _where("line_no", F.col(name).isNotNull())).alias(name) for name in lf.METRIC_NAMES]
    )


def run_status(lines: DataFrame, expect_steps: int = 1, exact_step: bool = False) -> DataFrame:
    """One row per run: line count, configured steps, status, and the lines that prove it.

    One scan and one shuffle. Lines that prove nothing are blanked before they are grouped, and
    each task sends one row per run, however many lines the run has.
    """
    line = F.col("line")
    fresh = lf.is_fresh_step(line, expect_steps, exact_step) if expect_steps > 0 else F.lit(False)
    seen = lines.select(
        "run_id",
        "line_no",
        "line",
        lf.is_failure(line).alias("_failed"),
        lf.is_progress(line).alias("_moved"),
        fresh.alias("_fresh"),
        lf.configured_steps_of(line).alias("_steps"),
    ).withColumn("line", _where("line", F.col("_failed") | F.col("_moved") | F.col("_fresh")))
    failed_at, fresh_at, moved_at = (_where("line_no", F.col(flag)) for flag in ("_failed", "_fresh", "_moved"))
    found = seen.groupBy("run_id").agg(
        F.count("*").alias("lines"),
        F.max_by("_steps", _where("line_no", F.col("_steps").isNotNull())).alias("configured_steps"),
        F.max(failed_at).alias("_failed_at"),
        F.max(fresh_at).alias("_fresh_at"),
        F.max_by("line", failed_at).alias("_failure"),
        F.max_by("line", fresh_at).alias("_reached"),
        F.max_by("line", moved_at).alias("_progress"),
    )
    failed, reached = F.col("_failure").isNotNull(), F.col("_reached").isNotNull()
    status = (
        F.when(failed & (F.col("_fresh_at") > F.col("_failed_at")), "completed-with-warning")
        .when(failed, "failed")
        .when(reached, "completed")
        .when(F.col("_progress").isNotNull(), "progress-evidence-seen")
        .otherwise("incomplete")
    )
    return found.select(
        "run_id",
        status.alias("status"),
        "lines",
        "configured_steps",
        strip(F.col("_failure")).alias("failure_line"),
        strip(F.col("_reached")).alias("step_evidence"),
        _where(strip(F.col("_progress")), ~reached).alias("progress_evidence"),
    )


def app_ids(lines: DataFrame) -> DataFrame:
    """The app id on the last line that names one, per run."""
    likely = lines.where(F.col("line").contains(lf.APP_ID_START))
    named = likely.select("run_id", "line_no", lf.app_id_of(F.col("line")).alias("app_id"))
    return named.where(F.col("app_id").isNotNull()).groupBy("run_id").agg(F.max_by("app_id", "line_no").alias("app_id"))


def tail(lines: DataFrame, keep: int = KEPT_LINES) -> DataFrame:
    """The newest ``keep`` lines of every run."""
    return top_per_group(lines, ["run_id"], [F.col("line_no").desc()], keep)
