"""Live run analytics over appended log lines and ingest payloads."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gradeflow.functions import logs as lf
from gradeflow.operators import ingest
from gradeflow.operators import logs as log_ops
from gradeflow.operators.registry import newest_rows

BATCH = "batch_id"


def write_version(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that keeps each micro-batch in its own folder, so a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")

    return write


def read_newest(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The newest version of every key that the stream has written."""
    return newest_rows(spark.read.parquet(path), keys, BATCH).drop(BATCH)


def _start(
    df: DataFrame, mode: str, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str | None
) -> StreamingQuery:
    """Start the stream: every so often (``"10 seconds"``), or once over what is there and then stop."""
    writer = df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint)
    timed = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return timed.start()


def step_metrics(lines: DataFrame, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Metrics per run and step while runs go on. The state is one row of numbers per run and step.

    A line seen twice changes nothing, so no duplicate filter (and no state for one) is needed.
    """
    return _start(log_ops.step_metrics(lines), "update", write_version(out), checkpoint, every)


def run_state(lines: DataFrame, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """State and app id per run from ``run_id, line_no, ts, line, exit_code``.

    A run is running until a record carries its exit code: 0 is completed, anything else failed.
    """
    return _start(state_of(lines), "update", write_version(out), checkpoint, every)


def state_of(lines: DataFrame) -> DataFrame:
    """The aggregation behind :func:`run_state`, usable on a batch too."""
    app = lf.app_id_of(F.col("line"))
    named = lines.withColumn("_app", app)
    states = named.groupBy("run_id").agg(
        F.max_by("exit_code", F.when(F.col("exit_code").isNotNull(), F.col("line_no"))).alias("_exit"),
        F.max_by("_app", F.when(F.col("_app").isNotNull(), F.col("line_no"))).alias("app_id"),
        F.max("ts").alias("updated_at"),
        F.max("line_no").alias("last_line"),
    )
    status = F.when(F.col("_exit").isNull(), "running").when(F.col("_exit") == 0, "completed").otherwise("failed")
    return states.select("run_id", status.alias("status"), "app_id", "updated_at", "last_line")


def log_tail(
    lines: DataFrame, out: str, checkpoint: str, keep: int = log_ops.KEPT_LINES, every: str | None = None
) -> StreamingQuery:
    """The newest lines per run: every micro-batch adds its own newest ones, and reading cuts again."""
    write = write_version(out)

    def sink(batch: DataFrame, batch_id: int) -> None:
        write(log_ops.tail(batch, keep), batch_id)

    return _start(lines, "append", sink, checkpoint, every)


def read_tail(spark: SparkSession, path: str, keep: int = log_ops.KEPT_LINES) -> DataFrame:
    lines = spark.read.parquet(path).drop(BATCH).dropDuplicates(["run_id", "line_no"])
    return log_ops.tail(lines, keep)


def ingest_payloads(
    payloads: DataFrame, out: str, quarantine: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Arriving payloads as versions; refused ones go to ``quarantine`` with the reason."""
    keep, refuse = write_version(out), write_version(quarantine)

    def sink(batch: DataFrame, batch_id: int) -> None:
        parsed = ingest.parse_payloads(batch).persist()
        keep(ingest.accepted(parsed).drop("payload"), batch_id)
        refuse(ingest.quarantined(parsed), batch_id)
        parsed.unpersist()

    return _start(payloads, "append", sink, checkpoint, every)


def upsert_runs(changes: DataFrame, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Run changes as versions keyed by micro-batch; replaying a batch adds nothing."""
    return _start(changes, "append", write_version(out), checkpoint, every)
