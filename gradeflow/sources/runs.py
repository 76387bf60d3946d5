"""Run stores and ingest payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeflow.operators.ingest import METRIC_FIELDS, TRACE_FIELDS, is_object, read_object, read_texts

TEXTS = ("id", "name", "status", "created_at", "updated_at")
CONFIG_FIELDS = {
    **dict.fromkeys(("algorithm", "model", "teacher_model", "dataset", "hint_placement", "hint", "topology"), "string"),
    **dict.fromkeys(("steps", "train_rows", "val_rows"), "bigint"),
    "smoke_gpu": "boolean",
}
JOB_FIELDS = {"pid": "bigint", "backend": "string", "app_id": "string", "command": "array<string>", "image": "string"}


def read_run_store(spark: SparkSession, path: str) -> DataFrame:
    """One row per run of the JSON documents ``{"runs": [...]}`` at ``path``."""
    return parse_run_stores(spark.read.text(path, wholetext=True))


def parse_run_stores(documents: DataFrame, text: str = "value") -> DataFrame:
    """One row per run of each document; a broken document fails the job.

    ``whole`` is the run as it stands in the document; so are ``whole`` of its config, job, metrics and traces. Other
    columns are what is read out of them.
    """
    store = F.from_json(text, "struct<runs:array<variant>>", {"mode": "FAILFAST"})
    run = F.col("whole")

    def elements(name: str) -> Column:
        return F.try_variant_get(run, f"$.{name}", "array<variant>")

    def part(name: str, fields: dict[str, str]) -> Column:
        value = F.try_variant_get(run, f"$.{name}", "variant")
        return F.when(is_object(value), read_object(value, fields)).alias(name)

    return documents.select(F.explode(store["runs"]).alias("whole")).select(
        *[F.try_variant_get(run, f"$.{name}", "string").alias(name) for name in TEXTS],
        part("config", CONFIG_FIELDS),
        F.try_variant_get(run, "$.command", "array<string>").alias("command"),
        F.transform(elements("metrics"), lambda v: read_object(v, METRIC_FIELDS)).alias("metrics"),
        F.transform(elements("traces"), lambda v: read_object(v, TRACE_FIELDS)).alias("traces"),
        read_texts(elements("logs")).alias("logs"),
        part("job", JOB_FIELDS),
        "whole",
    )


def run_metrics(runs: DataFrame) -> DataFrame:
    return runs.select(F.col("id").alias("run_id"), F.explode("metrics").alias("_m")).select("run_id", "_m.*")


def run_traces(runs: DataFrame) -> DataFrame:
    return runs.select(F.col("id").alias("run_id"), F.explode("traces").alias("_t")).select("run_id", "_t.*")


def run_logs(runs: DataFrame) -> DataFrame:
    return runs.select(F.col("id").alias("run_id"), F.posexplode("logs").alias("line_no", "line"))


def stream_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Arriving payload records ``run_id, seq, payload`` (JSON lines) as a stream."""
    return spark.readStream.schema("run_id string, seq bigint, payload string").json(path)
