"""Rubric-graded tasks to training records: documents, attempts, scores, prompts, splits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeflow.functions import rubric as rf
from gradeflow.functions.reward import RUBRIC_SOURCE, reward_terms
from gradeflow.functions.text import fill_template, strip, trim_text, utc_stamp
from gradeflow.operators.frames import side_by_side
from gradeflow.operators.ordering import path_order, top_per_group
from gradeflow.operators.records import chat_columns

# Labels in rubric records and run names.
ABILITY = "legal_agent"
TRUTH = "harvey_lab_rubric"
RUN_PREFIX = "harvey_sdpo"
RUN_MODEL = "qwen36_35b_a3b"
NOTES = (
    "Training rows include rubric-derived feedback from generated attempts.",
    "Held-out eval tasks are recorded in the manifest and are not used as feedback-conditioned train rows.",
)
# The fewest characters of a document block that survive trimming: "### " and a path of one.
SHORTEST_BLOCK = 5

Generate = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def document_blocks(documents: DataFrame, prompt_chars: int = rf.PROMPT_CHARS) -> DataFrame:
    """``task_id, blocks`` from ``task_id, path, text`` with the blocks in path order.

    A prompt ends after ``prompt_chars`` characters and every block adds some, so blocks past the
    kept number cannot reach it. That keeps the array of even a huge task small and exact.
    """
    enough = prompt_chars // SHORTEST_BLOCK + 1
    order = path_order(F.col("path"))
    kept = top_per_group(documents, ["task_id"], [order], enough)
    block = F.struct(order.alias("at"), rf.document_block(F.col("path"), F.col("text")).alias("block"))
    return kept.groupBy("task_id").agg(
        F.transform(F.array_sort(F.collect_list(block)), lambda b: b["block"]).alias("blocks")
    )


def trimmed_documents(documents: DataFrame, limit: int = rf.DOCUMENT_CHARS) -> DataFrame:
    return documents.withColumn("text", trim_text(F.col("text"), limit))


def with_prompt(
    tasks: DataFrame, documents: DataFrame, *, include_rubric: bool = False, prompt_chars: int = rf.PROMPT_CHARS
) -> DataFrame:
    """Tasks with their ``prompt``. ``documents`` are ``task_id, path, text``, already trimmed."""
    joined = tasks.join(document_blocks(documents, prompt_chars), "task_id", "left")
    prompt = rf.build_prompt(
        task_id=F.col("task_id"),
        title=F.col("title"),
        work_type=F.col("work_type"),
        instructions=F.col("instructions"),
        deliverables=F.col("deliverables"),
        blocks=F.col("blocks"),
        criteria=F.col("criteria") if include_rubric else None,
        limit=prompt_chars,
    )
    return joined.withColumn("prompt", prompt).drop("blocks")


def with_attempts(tasks: DataFrame, attempts: DataFrame | None) -> DataFrame:
    """Tasks with their ``attempt``; a task without one gets the fallback draft."""
    fallback = rf.fallback_attempt(F.col("title"), F.col("criteria"))
    if attempts is None:
        return tasks.withColumn("attempt", fallback)
    joined = tasks.join(attempts.select("task_id", F.col("attempt").alias("_made")), "task_id", "left")
    return joined.withColumn("attempt", F.coalesce("_made", fallback)).drop("_made")


def made_attempts(tasks: DataFrame, generate: Generate) -> DataFrame:
    """``task_id, attempt`` from the user's generator, which gets ``task_id, prompt`` in Arrow batches."""
    made = tasks.select("task_id", "prompt").mapInPandas(generate, "task_id string, attempt string")
    return made.withColumn("attempt", strip(F.col("attempt")))


def with_scores(tasks: DataFrame, scores: DataFrame | None) -> DataFrame:
    """Tasks with their ``scores`` struct, null where unscored, and the ``feedback`` made from it."""
    if scores is None:
        joined = tasks.withColumn("scores", F.lit(None).cast(rf.SCORES_TYPE))
    else:
        read = F.col("scores")
        if "whole" not in scores.schema["scores"].dataType.names:
            read = F.when(read.isNotNull(), read.withField("whole", F.lit(None).cast("string")))
        joined = tasks.join(scores.select("task_id", read.alias("scores")), "task_id", "left")
    return joined.withColumn("feedback", rf.feedback_text(F.col("criteria"), F.col("scores")))


def rubric_records(tasks: DataFrame, *, template: str = rf.RUBRIC_REPROMPT) -> DataFrame:
    """Records from tasks carrying ``split, prompt, attempt, feedback, scores``.

    Only training rows show the attempt and feedback; test rows keep the bare prompt and hold neither.
    """
    in_train = F.col("split") == "train"
    filled = fill_template(
        template, prompt=F.col("prompt"), solution=F.col("attempt"), feedback=F.col("feedback")
    )
    extra: dict[str, Column] = {
        "split": F.col("split"),
        "task_id": F.col("task_id"),
        "practice_area": F.col("practice_area"),
        "work_type": F.col("work_type"),
        "original_prompt": F.col("prompt"),
        "answer": F.lit(TRUTH),
        "feedback_raw": F.when(in_train, F.col("feedback")).otherwise(""),
        "previous_attempt": F.when(in_train, F.col("attempt")).otherwise(""),
        "harvey_scores_json": rf.scores_json(F.col("scores")),
        "reward_terms": reward_terms(F.col("criteria")),
        "sdpo_bridge": F.lit(True),
    }
    return tasks.select(
        *chat_columns(
            data_source=F.lit(RUBRIC_SOURCE),
            content=F.when(in_train, filled).otherwise(F.col("prompt")),
            ability=F.lit(ABILITY),
            truth=F.lit(TRUTH),
            extra=extra,
        )
    )


def run_id(task_id: Column, at: Column) -> Column:
    return F.concat_ws("/", F.lit(RUN_PREFIX), task_id, F.lit(RUN_MODEL), utc_stamp(at))


def run_rows(generation: DataFrame, scores: DataFrame | None, at: Column) -> DataFrame:
    """``task_id, split, run_id, score, all_pass`` of the generated tasks."""
    rows = generation.select("task_id", "split", run_id(F.col("task_id"), at).alias("run_id"))
    if scores is None:
        return rows.withColumns({"score": F.lit(None).cast("double"), "all_pass": F.lit(None).cast("boolean")})
    judged = scores.select(
        "task_id", F.col("scores.score").alias("score"), F.col("scores.all_pass").alias("all_pass")
    )
    return rows.join(judged, "task_id", "left")


def document_counts(listing: DataFrame) -> DataFrame:
    """``documents_read`` and ``total_vdr_files`` per task, counting files (not folders)."""
    return listing.groupBy("task_id").agg(
        F.count("*").alias("documents_read"), F.count("*").alias("total_vdr_files")
    )


def entry_counts(entries: DataFrame) -> DataFrame:
    """``documents_read`` and ``total_vdr_files`` per task from ``task_id, entry`` of every entry below its documents, folders among them."""
    counted = F.count_distinct("entry")
    return entries.groupBy("task_id").agg(counted.alias("documents_read"), counted.alias("total_vdr_files"))


def manifest(
    split: DataFrame, runs: DataFrame, *, id_col: str, created_at: Column, model: str, paths: dict[str, str]
) -> DataFrame:
    """The one-row JSON manifest of a generation set.

    Train, preview and run lists are as long as the set that was asked for. Held-out ids are the
    rest of the table, so they are counted here and stay a table (:func:`heldout_ids`).
    """
    position = F.struct(F.col("position"), F.col(id_col).cast("string").alias("id"))

    def ids(condition: Column) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(condition, position))), lambda p: p["id"])

    listed = split.where((F.col("split") == "train") | F.col("in_preview")).agg(
        ids(F.col("split") == "train").alias("train_tasks"), ids(F.col("in_preview")).alias("eval_preview_tasks")
    )
    held = split.agg(F.count_if(F.col("split") == "heldout").alias("heldout_eval_count"))
    run = F.struct("task_id", "split", "run_id", "score", "all_pass")
    made = runs.agg(F.array_sort(F.collect_list(run)).alias("runs"))
    body = F.struct(
        created_at.alias("created_at"),
        F.lit(model).alias("model"),
        "train_tasks",
        "heldout_eval_count",
        "eval_preview_tasks",
        "runs",
        F.struct(*[F.lit(v).alias(k) for k, v in paths.items()]).alias("paths"),
        F.array(*[F.lit(note) for note in NOTES]).alias("notes"),
    )
    return side_by_side(listed, held, made).select(F.to_json(body).alias("manifest"))


def heldout_ids(split: DataFrame, id_col: str) -> DataFrame:
    return split.where(F.col("split") == "heldout").select(id_col, "position")
