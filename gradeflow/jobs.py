"""The three dataset builds end to end: read, split or cap, make records, write."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeflow.functions import rubric as rf
from gradeflow.functions.conversation import exported_conversation_fields
from gradeflow.operators import records, rubric, splits
from gradeflow.operators.ordering import first_rows, with_row_index
from gradeflow.sources import datasets, documents, tasks

# All rows; a caller may ask for fewer.
ROWS = {"train": 0, "test": 0}


def _parts(train: DataFrame, test: DataFrame | None, order: Sequence[str], rows: dict[str, int]) -> DataFrame:
    """Both splits, capped and numbered; without a test source the train source serves for both."""
    sources = {"train": train, "test": train if test is None else test}
    capped = [first_rows(df, rows[name], order).withColumn("split", F.lit(name)) for name, df in sources.items()]
    return with_row_index(capped[0].unionByName(capped[1]), order, by=["split"])


def _written(spark: SparkSession, made: DataFrame, out: str) -> DataFrame:
    datasets.write_records(made, out)
    return records.split_counts(datasets.read_records(spark, out))


def build_question_set(
    train: DataFrame, test: DataFrame | None, out: str, *, order: Sequence[str], rows: dict[str, int] = ROWS, **options
) -> DataFrame:
    """Question rows as records under ``out``; gives the row count of each split.

    ``options`` are those of :func:`gradeflow.operators.records.question_records`.
    """
    parts = _parts(train, test, order, rows)
    made = records.question_records(parts, index="index", split="split", **options)
    return _written(train.sparkSession, made, out)


def build_conversation_set(
    train: DataFrame,
    test: DataFrame | None,
    out: str,
    *,
    order: Sequence[str],
    conversations: str = "conversations",
    rows: dict[str, int] = ROWS,
    **options,
) -> DataFrame:
    """Exported conversations (a ``variant`` column) as records under ``out``; gives the counts per split."""
    parts = _parts(train, test, order, rows).withColumn("_f", exported_conversation_fields(F.col(conversations)))
    made = records.conversation_records(parts.select("*", "_f.*"), index="index", split="split", **options)
    return _written(train.sparkSession, made, out)


def build_distillation_set(
    train: DataFrame, test: DataFrame | None, out: str, *, order: Sequence[str], rows: dict[str, int] = ROWS, **options
) -> DataFrame:
    """Question rows as distillation records under ``out``, source columns kept; gives the counts per split."""
    parts = _parts(train, test, order, rows).withColumnsRenamed({"split": "_split", "index": "_index"})
    made = records.distillation_records(parts, index="_index", split="_split", **options)
    return _written(train.sparkSession, made.drop("_split", "_index"), out)


def build_rubric_set(
    spark: SparkSession,
    root: str,
    out: str,
    *,
    created_at: Column,
    model: str,
    train_tasks: int = 8,
    preview_tasks: int = 2,
    seed: int = 17,
    document_chars: int = rf.DOCUMENT_CHARS,
    prompt_chars: int = rf.PROMPT_CHARS,
    attempts: DataFrame | None = None,
    generate: rubric.Generate | None = None,
    scores: DataFrame | None = None,
    template: str = rf.RUBRIC_REPROMPT,
) -> DataFrame:
    """Rubric task folders under ``root`` to records, runs, held-out ids and a manifest under ``out``.

    Attempts come as a table or from ``generate``; a task without one gets a fallback draft. Gives
    the run rows. Only the picked tasks' documents are extracted.
    """
    found = tasks.read_tasks(spark, root)
    split = splits.stratified_split(
        found, "task_id", "practice_area", train=train_tasks, preview=preview_tasks, seed=seed
    )
    split.write.mode("overwrite").parquet(f"{out}/split")
    split = spark.read.parquet(f"{out}/split")
    picked = splits.generation_set(split)

    chosen = found.join(picked.select("task_id", "split"), "task_id")
    files = documents.read_document_files(spark, root, document_chars, tasks=picked)
    prompted = rubric.with_prompt(chosen, files, prompt_chars=prompt_chars)
    if generate is not None:
        # Written once: generating again after a lost executor could give other texts.
        rubric.made_attempts(prompted, generate).write.mode("overwrite").parquet(f"{out}/attempts")
        attempts = spark.read.parquet(f"{out}/attempts")
    ready = rubric.with_scores(rubric.with_attempts(prompted, attempts), scores)
    labelled = ready.withColumn("split", F.when(F.col("split") == "train", "train").otherwise("test"))
    datasets.write_records(rubric.rubric_records(labelled, template=template), f"{out}/records")

    runs = rubric.run_rows(picked, scores, created_at)
    runs.write.mode("overwrite").parquet(f"{out}/runs")
    rubric.heldout_ids(split, "task_id").write.mode("overwrite").parquet(f"{out}/heldout")
    paths = {f"{name}_parquet": f"{out}/records/split={name}" for name in ("train", "test")}
    made = rubric.manifest(
        split, spark.read.parquet(f"{out}/runs"), id_col="task_id",
        created_at=F.date_format(created_at, "yyyy-MM-dd'T'HH:mm:ssXXX"), model=model, paths=paths,
    )
    tasks.write_manifest(made, f"{out}/manifest")
    return spark.read.parquet(f"{out}/runs")
