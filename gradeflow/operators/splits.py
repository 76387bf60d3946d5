"""Seeded, stratified train / held-out / preview splits and the check that they do not leak."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeflow.operators.ordering import row_index

# Length of the hash prefix: every stratum is ranked in up to 16**3 separate pieces.
PREFIX = 3


def stratum_ranks(df: DataFrame, id_col: str, stratum: str, seed: int = 17) -> DataFrame:
    """``id, stratum, rank`` with ranks from 1 in the order of ``md5(seed/id)`` inside the stratum.

    The hash is uniform, so its leading digits cut a stratum into even, already ordered pieces.
    Each piece is ranked on its own and shifted by the sizes of the pieces before it.
    """
    # As a struct the stratum is never null, so grouping, ranking and joining share one partitioning.
    hashed = df.select(
        F.col(id_col),
        F.struct(stratum).alias("_stratum"),
        F.md5(F.concat(F.lit(f"{seed}/"), F.col(id_col).cast("string"))).alias("_hash"),
    ).withColumn("_piece", F.substring("_hash", 1, PREFIX))
    sizes = hashed.groupBy("_stratum", "_piece").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy("_stratum").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_stratum", "_piece", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_stratum", "_piece").orderBy("_hash", id_col)
    return (
        hashed.withColumn("_rank", F.row_number().over(inside))
        .join(shifts, ["_stratum", "_piece"])
        .select(id_col, f"_stratum.{stratum}", (F.col("_before") + F.col("_rank")).alias("rank"))
    )


def round_robin(df: DataFrame, id_col: str, stratum: str, seed: int = 17) -> DataFrame:
    """``id, stratum, rank, position``: one of each stratum in turn until all strata are drained.

    The position is the row index of the (rank, stratum) order, for any number of strata.
    """
    ranked = stratum_ranks(df, id_col, stratum, seed)
    indexed = row_index(ranked, ["rank", stratum], name="_index", carry=[id_col])
    return indexed.select(id_col, stratum, "rank", (F.col("_index") + 1).alias("position"))


def stratified_split(
    df: DataFrame, id_col: str, stratum: str, *, train: int, preview: int, seed: int = 17
) -> DataFrame:
    """``id, stratum, position, split, in_preview`` for every row.

    ``split`` is ``train`` or ``heldout``; the preview is the first held-out rows. Where none are
    asked for, the first held-out row still serves as preview.
    """
    if train <= 0:
        raise ValueError("the train size must be positive")
    last_preview = train + max(preview, 1)
    position = F.col("position")
    return round_robin(df, id_col, stratum, seed).select(
        id_col,
        stratum,
        "position",
        F.when(position <= train, "train").otherwise("heldout").alias("split"),
        ((position > train) & (position <= last_preview)).alias("in_preview"),
    )


def generation_set(split: DataFrame) -> DataFrame:
    """Train and preview rows together, labelled ``train`` and ``eval_preview``, in one pass."""
    wanted = split.where((F.col("split") == "train") | F.col("in_preview"))
    return wanted.withColumn("split", F.when(F.col("in_preview"), "eval_preview").otherwise("train"))


def without(ordered: DataFrame, taken: DataFrame, id_col: str) -> DataFrame:
    """The rows whose id is not among the taken ones."""
    return ordered.join(taken.select(id_col), id_col, "left_anti")


def leak_report(train: DataFrame, test: DataFrame, id_col: str, feedback: str) -> DataFrame:
    """One row: test rows whose id is also in train, and test rows that still carry feedback. Both must be 0.

    Both parts are counted per id in one shuffle, so repeated ids do no harm.
    """
    shown = (F.coalesce(F.col(feedback), F.lit("")) != "").cast("bigint")
    sides = train.select(id_col, F.lit(1).alias("_train"), F.lit(0).alias("_test"), F.lit(0).alias("_shown")).unionByName(
        test.select(id_col, F.lit(0).alias("_train"), F.lit(1).alias("_test"), shown.alias("_shown"))
    )
    per_id = sides.groupBy(id_col).agg(
        F.max("_train").alias("_train"), F.sum("_test").alias("_test"), F.sum("_shown").alias("_shown")
    )
    return per_id.agg(
        F.coalesce(F.sum(F.when(F.col("_train") == 1, F.col("_test"))), F.lit(0)).alias("shared_ids"),
        F.coalesce(F.sum("_shown"), F.lit(0)).alias("test_rows_with_feedback"),
    )
