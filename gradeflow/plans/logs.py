"""Run-log analytics over log lines made from the events table, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeflow.operators import logs as ops
from gradeflow.plans import Query, table
from gradeflow.session import fresh_path
from gradeflow.sources.logs import read_log_lines
from gradeflow.streaming import runs as live

LINES_PER_RUN_RANGE = 1000


def _text(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("string")


def _fraction(value: Column) -> Column:
    """An integer below 1000 as ``0.ddd``."""
    return F.concat(F.lit("0."), F.lpad(_text(value), 3, "0"))


def as_lines(events: DataFrame) -> DataFrame:
    """Events as log lines. Event ids rise with time, so they order a run's lines as they are.

    A run is a user's events within a range of ids. Batch or stream.
    """
    event, kind = F.col("event_id"), F.col("event_type")
    step = _text(event % 10)
    loss = F.concat(
        F.when(event % 4 == 0, "").when(event % 4 == 1, " - distillation_loss = -").otherwise(" - distillation/loss:"),
        F.when(event % 4 == 0, "").otherwise(_fraction(event % 1000)),
    )
    metric = F.concat(
        F.lit("step:"), step, loss, F.lit(" - critic/rewards/mean:"), _fraction(event * 7 % 1000),
        F.lit(" - kl_loss: "), _fraction(event * 3 % 1000), F.lit(" - training/global_step:"), step,
    )
    killed, saved = (kind == "error") & (event % 5 == 0), (kind == "view") & (event % 7 == 0)
    line = (
        F.when(kind == "purchase", metric)
        .when(killed, F.concat(F.lit("  RuntimeError: worker "), _text(event), F.lit(" killed")))
        .when(kind == "error", F.concat(F.lit("retry reward=0.5 at timestep: "), step))
        .when(kind == "signup", F.concat(F.lit("Found checkpoint: /ckpt/run/global_step_"), step))
        .when(saved, F.concat(F.lit("Saving checkpoint to /ckpt/run/global_step_"), step, F.lit(" ")))
        .when(kind == "view", F.concat(F.lit("loading shard "), _text(event)))
        .when(event % 3 == 0, F.concat(F.lit("Total training steps: "), step))
        .otherwise(F.concat(F.lit("submitted ap-X"), _text(event), F.lit(" to the cluster")))
    )
    run = F.concat(F.lit("run-"), _text("user_id"), F.lit("-"), _text(F.floor(event / LINES_PER_RUN_RANGE)))
    ended = F.when(saved, F.lit(0)).when(killed, F.lit(1))
    return events.select(
        run.alias("run_id"), event.alias("line_no"), "ts", line.alias("line"), ended.alias("exit_code")
    )


LINES_SQL = """
SELECT 'run-' || user_id || '-' || (event_id // 1000) AS run_id, event_id AS line_no, ts,
  CASE WHEN event_type = 'purchase' THEN 'step:' || (event_id % 10)
      || CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN ' - distillation_loss = -' ELSE ' - distillation/loss:' END
      || CASE event_id % 4 WHEN 0 THEN '' ELSE '0.' || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') END
      || ' - critic/rewards/mean:0.' || lpad(CAST(event_id * 7 % 1000 AS VARCHAR), 3, '0')
      || ' - kl_loss: 0.' || lpad(CAST(event_id * 3 % 1000 AS VARCHAR), 3, '0')
      || ' - training/global_step:' || (event_id % 10)
    WHEN event_type = 'error' AND event_id % 5 = 0 THEN '  RuntimeError: worker ' || event_id || ' killed'
    WHEN event_type = 'error' THEN 'retry reward=0.5 at timestep: ' || (event_id % 10)
    WHEN event_type = 'signup' THEN 'Found checkpoint: /ckpt/run/global_step_' || (event_id % 10)
    WHEN event_type = 'view' AND event_id % 7 = 0
      THEN 'Saving checkpoint to /ckpt/run/global_step_' || (event_id % 10) || ' '
    WHEN event_type = 'view' THEN 'loading shard ' || event_id
    WHEN event_id % 3 = 0 THEN 'Total training steps: ' || (event_id % 10)
    ELSE 'submitted ap-X' || event_id || ' to the cluster' END AS line,
  CASE WHEN event_type = 'view' AND event_id % 7 = 0 THEN 0 WHEN event_type = 'error' AND event_id % 5 = 0 THEN 1 END
    AS exit_code
FROM events
"""


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return as_lines(table(spark, folder, "events"))


def log_step_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return ops.step_metrics(_lines(spark, folder)).orderBy("run_id", "step")


def _metric_sql(pattern: str) -> str:
    number = r"\s*[:=]\s*(-?[0-9]+(?:\.[0-9]+)?)"
    return f"TRY_CAST(nullif(regexp_extract(line, '(?:{pattern}){number}', 1), '') AS DOUBLE)"


STEP_METRICS_SQL = rf"""
SELECT run_id, step, arg_max(loss, line_no) FILTER (loss IS NOT NULL) AS distillation_loss,
       arg_max(gain, line_no) FILTER (gain IS NOT NULL) AS reward,
       arg_max(kl, line_no) FILTER (kl IS NOT NULL) AS teacher_kl
FROM (SELECT run_id, line_no,
        TRY_CAST(nullif(regexp_extract(line, '(?:training/global_step|global_step|step)\s*[:=]\s*([0-9]+)', 1), '')
          AS BIGINT) AS step,
        {_metric_sql("distillation/loss|distillation_loss")} AS loss,
        {_metric_sql("critic/rewards/mean|train/critic/rewards/mean|reward")} AS gain,
        {_metric_sql("teacher_kl|kl_loss|kl")} AS kl
      FROM ({LINES_SQL}))
WHERE step IS NOT NULL GROUP BY run_id, step
"""


def log_status(spark: SparkSession, folder: str) -> DataFrame:
    return ops.run_status(_lines(spark, folder), expect_steps=1)


def _any_sql(*needles: str) -> str:
    return "(" + " OR ".join(f"contains(line, '{n}')" for n in needles) + ")"


# The trainer texts that the status rests on, as in ``gradeflow/functions/logs.py``.
FAILED_SQL = _any_sql(
    "Traceback (most recent call last)", "subprocess.CalledProcessError", "RuntimeError:", "ValueError:",
    "IndexError:", "ImportError:", "ModuleNotFoundError:", "CUDA out of memory", "CUDA error",
)
MOVED_SQL = _any_sql(
    "training/global_step", "train/critic/rewards/mean", "critic/rewards/mean", "distillation/loss",
    "actor/pg_loss", "Saving checkpoint", "local_global_step_folder",
)
RESUMED_SQL = _any_sql("Found checkpoint", "Load from checkpoint", "Resuming from", "Setting global step")
REACHED_SQL = _any_sql(
    "training/global_step:1", "training/global_step: 1", "step:1 -", "step: 1 -", "global_step_1",
    "''global_step'': 1", '"global_step": 1',
)
STATUS_SQL = f"""
SELECT run_id, CASE WHEN failed_at IS NOT NULL AND fresh_at > failed_at THEN 'completed-with-warning'
    WHEN failed_at IS NOT NULL THEN 'failed' WHEN fresh_at IS NOT NULL THEN 'completed'
    WHEN progress_evidence IS NOT NULL THEN 'progress-evidence-seen' ELSE 'incomplete' END AS status,
  lines, configured_steps, failure_line, step_evidence,
  CASE WHEN step_evidence IS NULL THEN progress_evidence END AS progress_evidence
FROM (
  SELECT run_id, count(*) AS lines,
    arg_max(steps, line_no) FILTER (steps IS NOT NULL) AS configured_steps,
    max(line_no) FILTER (failed) AS failed_at, max(line_no) FILTER (fresh) AS fresh_at,
    trim(arg_max(line, line_no) FILTER (failed)) AS failure_line,
    trim(arg_max(line, line_no) FILTER (fresh)) AS step_evidence,
    trim(arg_max(line, line_no) FILTER (moved)) AS progress_evidence
  FROM (SELECT *, {FAILED_SQL} AS failed, {MOVED_SQL} AS moved, {REACHED_SQL} AND NOT {RESUMED_SQL} AS fresh,
          TRY_CAST(nullif(regexp_extract(line, 'Total training steps:\\s*([0-9]+)', 1), '') AS BIGINT) AS steps
        FROM ({LINES_SQL}))
  GROUP BY run_id)
"""


def log_app_id(spark: SparkSession, folder: str) -> DataFrame:
    return ops.app_ids(_lines(spark, folder))


APP_ID_SQL = rf"""
SELECT run_id, arg_max(app, line_no) AS app_id
FROM (SELECT run_id, line_no, nullif(regexp_extract(line, '\bap-[A-Za-z0-9]+\b'), '') AS app FROM ({LINES_SQL}))
WHERE app IS NOT NULL GROUP BY run_id
"""


def log_tail(spark: SparkSession, folder: str) -> DataFrame:
    return ops.tail(_lines(spark, folder), ops.SHOWN_LINES).select("run_id", "line_no", "line")


TAIL_SQL = f"""
SELECT run_id, line_no, line FROM ({LINES_SQL})
QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY line_no DESC) <= 8
"""


def log_files(spark: SparkSession, folder: str) -> DataFrame:
    """All lines written as text files in order and read back, each with whether its file came back in order."""
    path = fresh_path(spark, "log-files")
    numbered = F.concat(_text("line_no"), F.lit("|"), "line")
    lines = _lines(spark, folder).repartitionByRange("line_no").sortWithinPartitions("line_no")
    lines.select(numbered.alias("value")).write.text(path)
    back = read_log_lines(spark, path)
    event = F.split("line", r"\|", 2)[0].cast("bigint")
    ranges = back.groupBy("run_id").agg(
        (F.max(event) - F.min(event) + 1).alias("span"),
        F.count("*").alias("rows"),
        (F.max("line_no") + 1).alias("numbered"),
        F.min_by(event, "line_no").alias("first"),
        F.min(event).alias("least"),
    )
    whole = (F.col("rows") == F.col("numbered")) & (F.col("first") == F.col("least")) & (F.col("span") == F.col("rows"))
    return back.join(ranges.select("run_id", whole.alias("in_order")), "run_id").select("line", "in_order")


LOG_FILES_SQL = f"SELECT line_no || '|' || line AS line, true AS in_order FROM ({LINES_SQL})"


def _line_stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = table(spark, folder, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    return as_lines(stream)


def stream_step_metrics(spark: SparkSession, folder: str) -> DataFrame:
    out = fresh_path(spark, "stream-metrics")
    live.step_metrics(_line_stream(spark, folder), f"{out}/data", f"{out}/state").awaitTermination()
    return live.read_newest(spark, f"{out}/data", ["run_id", "step"])


def stream_run_state(spark: SparkSession, folder: str) -> DataFrame:
    out = fresh_path(spark, "stream-state")
    live.run_state(_line_stream(spark, folder), f"{out}/data", f"{out}/state").awaitTermination()
    return live.read_newest(spark, f"{out}/data", ["run_id"])


STATE_SQL = f"""
SELECT run_id, CASE WHEN ended IS NULL THEN 'running' WHEN ended = 0 THEN 'completed' ELSE 'failed' END AS status,
       app_id, updated_at, last_line
FROM (SELECT run_id, arg_max(exit_code, line_no) FILTER (exit_code IS NOT NULL) AS ended,
        arg_max(app, line_no) FILTER (app IS NOT NULL) AS app_id, max(ts) AS updated_at, max(line_no) AS last_line
      FROM (SELECT *, nullif(regexp_extract(line, '\\bap-[A-Za-z0-9]+\\b'), '') AS app FROM ({LINES_SQL}))
      GROUP BY run_id)
"""


def stream_log_tail(spark: SparkSession, folder: str) -> DataFrame:
    out = fresh_path(spark, "stream-tail")
    live.log_tail(_line_stream(spark, folder), f"{out}/data", f"{out}/state", ops.SHOWN_LINES).awaitTermination()
    return live.read_tail(spark, f"{out}/data", ops.SHOWN_LINES).select("run_id", "line_no", "line")


QUERIES: dict[str, Query] = {
    "log_step_metrics": log_step_metrics,
    "log_status": log_status,
    "log_app_id": log_app_id,
    "log_tail": log_tail,
    "log_files": log_files,
    "stream_step_metrics": stream_step_metrics,
    "stream_run_state": stream_run_state,
    "stream_log_tail": stream_log_tail,
}

ORACLES: dict[str, str] = {
    "log_step_metrics": STEP_METRICS_SQL,
    "log_status": STATUS_SQL,
    "log_app_id": APP_ID_SQL,
    "log_tail": TAIL_SQL,
    "log_files": LOG_FILES_SQL,
    "stream_step_metrics": STEP_METRICS_SQL,
    "stream_run_state": STATE_SQL,
    "stream_log_tail": TAIL_SQL,
}
