"""Rubric task folders and the judge's scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeflow.functions import rubric as rf
from gradeflow.functions.text import text_or
from gradeflow.sources.paths import below, file_path

TASK_FILE = "task.json"
SCORES_FILE = "scores.json"


def _whole_files(spark: SparkSession, root: str, name: str) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name)
    return reader.text(root, wholetext=True).select(file_path().alias("file"), "value")


def read_tasks(spark: SparkSession, root: str, name: str = TASK_FILE) -> DataFrame:
    """Every ``<root>/tasks/**/task.json`` as a task row; its id is the folder below ``tasks``. ``name`` may be a pattern of file names."""
    files = _whole_files(spark, f"{root.rstrip('/')}/tasks", name)
    task_id = F.regexp_extract("file", below(root, r"/tasks/(.+)/[^/]+$"), 1)
    return parse_tasks(files.select(task_id.alias("task_id"), "value"))


def parse_tasks(texts: DataFrame, text: str = "value") -> DataFrame:
    """Task rows from ``task_id`` and the JSON text of each task; a broken text fails the job."""
    parsed = F.from_json(text, rf.TASK_TYPE, {"mode": "FAILFAST"})
    return shape_tasks(texts.select("task_id", parsed.alias("t")).select("task_id", "t.*"))


def shape_tasks(raw: DataFrame) -> DataFrame:
    """Task rows from parsed task files: area, texts without nulls, deliverables and criteria."""
    criteria = F.coalesce("criteria", F.array().cast(rf.CRITERIA_TYPE))
    return raw.select(
        "task_id",
        F.split("task_id", "/")[0].alias("practice_area"),
        *[text_or(F.col(name)).alias(name) for name in ("title", "work_type", "instructions")],
        rf.deliverables_of(criteria, F.col("deliverables")).alias("deliverables"),
        criteria.alias("criteria"),
    )


def read_scores(spark: SparkSession, root: str, name: str = SCORES_FILE) -> DataFrame:
    """``task_id, scores`` from ``<root>/scores/<task>/scores.json``, or files of another name."""
    files = _whole_files(spark, f"{root.rstrip('/')}/scores", name)
    task_id = F.regexp_extract("file", below(root, r"/scores/(.+)/[^/]+$"), 1)
    return parse_scores(files.select(task_id.alias("task_id"), "value"))


def parse_scores(texts: DataFrame, text: str = "value") -> DataFrame:
    """``task_id, scores`` from ``task_id`` and a judge's JSON text; a broken text fails the job."""
    read = F.from_json(text, rf.JUDGED_TYPE, {"mode": "FAILFAST"})
    return texts.select("task_id", F.when(read.isNotNull(), read.withField("whole", F.col(text))).alias("scores"))


def list_documents(spark: SparkSession, root: str, folder: str = "documents") -> DataFrame:
    """``task_id, entry`` of every file and folder below ``<root>/tasks/<task>/documents``, from the paths of the files alone.

    A folder is an entry once, however many files are below it; one without any file can't be seen. Contents aren't read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{root.rstrip('/')}/tasks").select("path")
    inside = below(root, rf"/tasks/(.+?)/\Q{folder}\E/(.+)$")
    named = files.select(F.regexp_extract("path", inside, 1).alias("task_id"), F.split(F.regexp_extract("path", inside, 2), "/").alias("parts")).where("task_id <> ''")
    prefixes = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda n: F.array_join(F.slice("parts", 1, n), "/"))
    return named.select("task_id", F.explode(prefixes).alias("entry")).distinct()


def write_manifest(manifest: DataFrame, path: str) -> None:
    """The one-row manifest as a JSON text."""
    manifest.select(F.col("manifest").alias("value")).write.mode("overwrite").text(path)
