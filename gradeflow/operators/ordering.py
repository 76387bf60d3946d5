"""Order-dependent building blocks that never gather a large group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeflow.operators.frames import join_on
from gradeflow.session import ensure_checkpoints

SALTS = 1024
# A limit this small is taken by TakeOrderedAndProject; a larger one by the row index.
TOP_ROWS = 10_000
_ROW_BITS = 33  # monotonically_increasing_id keeps the row number within a partition in 33 bits


def row_index(
    df: DataFrame, order: Sequence[str], by: Sequence[str] = (), name: str = "index", carry: Sequence[str] = ()
) -> DataFrame:
    """``by``, ``order``, ``carry`` and the dense 0-based position of every row in its ``by`` group.

    Rows with equal ``by`` and ``order`` get positions in any order. Rows are range-partitioned, so a
    group of any size is spread over all tasks: positions inside a partition are counted locally
    and shifted by the totals of the partitions before it. The sorted keys are checkpointed because
    both the counting and the shifting must see the same partition bounds.
    """
    ensure_checkpoints(df.sparkSession)
    keys = [*by, *order]
    local = (
        df.select(*keys, *carry)
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_row", F.monotonically_increasing_id())
        .checkpoint()
        .withColumn("_part", F.shiftright("_row", _ROW_BITS))
    )
    totals = local.groupBy(*by, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(*by, "_part", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    return join_on(local, shifts, [*by, "_part"]).select(
        *keys, *carry, (F.col("_before") + F.col("_row") - F.col("_first")).alias(name)
    )


def with_row_index(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), name: str = "index") -> DataFrame:
    """``df`` with its row position added. Each row is numbered once, so ties get different positions in any order."""
    carried = [c for c in df.columns if c not in (*by, *order)]
    return row_index(df, order, by, name, carry=carried).select(*df.columns, name)


def first_rows(df: DataFrame, rows: int, order: Sequence[str]) -> DataFrame:
    """The first ``rows`` rows in a unique order, or all of them where ``rows`` is not positive."""
    if rows <= 0:
        return df
    if rows <= TOP_ROWS:
        return df.orderBy(*order).limit(rows)
    return with_row_index(df, order, name="_index").where(F.col("_index") < rows).drop("_index")


def with_running(df: DataFrame, order: Sequence[str], by: Sequence[str], sums: dict[str, str]) -> DataFrame:
    """``df`` with running sums: for each new name the sum of a column over the rows of the group up to this one.

    ``order`` has no ties within a group. Rows are range-partitioned, so a group of any size is many partitions: each adds up
    its own rows, and the totals of the group's partitions before are carried in. Null counts as 0.
    """
    ensure_checkpoints(df.sparkSession)
    keys = [*by, *order]
    local = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_row", F.monotonically_increasing_id()).checkpoint()
    local = local.withColumn("_part", F.shiftright("_row", _ROW_BITS))
    totals = local.groupBy(*by, "_part").agg(*[F.sum(c).alias(f"_total_{name}") for name, c in sums.items()])
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*by, "_part", *[F.coalesce(F.sum(f"_total_{name}").over(before), F.lit(0)).alias(f"_before_{name}") for name in sums])
    inside = Window.partitionBy(*by, "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = [(F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_before_{name}")).alias(name) for name, c in sums.items()]
    return join_on(local, carried, [*by, "_part"]).select(*df.columns, *running)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, salts: int = SALTS) -> DataFrame:
    """The first ``k`` rows of each group, in an order without ties.

    Groups are first cut down in up to ``salts`` parts. A part takes whole input partitions, so each
    of them sends at most ``k`` rows of a group, and a hot group is cut down by many tasks.
    """
    salted = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    part = Window.partitionBy(*keys, "_salt").orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(*order)
    return (
        salted.withColumn("_rank", F.row_number().over(part))
        .where(F.col("_rank") <= k)
        .drop("_salt")
        .withColumn("_rank", F.row_number().over(whole))
        .where(F.col("_rank") <= k)
        .drop("_rank")
    )


def with_previous(
    df: DataFrame, key: str, order: Sequence[str], value: str, chunk: Column, name: str
) -> DataFrame:
    """``df`` with the previous ``value`` of the same key in ``order``.

    ``chunk`` must not decrease along ``order``. Each (key, chunk) is sorted on its own, and only
    the last value of each chunk is carried over to the next one, so a hot key is many small sorts.
    """
    # As a struct the key is never null, so both windows and the join share one partitioning.
    chunked = df.withColumn("_key", F.struct(key)).withColumn("_chunk", chunk)
    inside = Window.partitionBy("_key", "_chunk").orderBy(*order)
    carried = (
        chunked.groupBy("_key", "_chunk")
        .agg(F.max_by(value, F.struct(*order)).alias("_last"))
        .withColumn("_carried", F.lag("_last").over(Window.partitionBy("_key").orderBy("_chunk")))
        .drop("_last")
    )
    in_chunk = F.col("_in_chunk")
    return (
        chunked.withColumn("_in_chunk", F.lag(F.struct(value)).over(inside))
        .join(carried, ["_key", "_chunk"])
        .withColumn(name, F.when(in_chunk.isNotNull(), in_chunk[value]).otherwise(F.col("_carried")))
        .drop("_key", "_chunk", "_in_chunk", "_carried")
    )


def path_order(path: Column) -> Column:
    """Sort key that compares paths part by part, so that ``a/b`` comes before ``a-b/c``."""
    return F.split(path, "/")

