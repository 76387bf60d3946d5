"""Versions of a keyed table that streams write: immutable folders, folded now and then, never changed in place.

Below the table's folder ``deltas/<query>/<batch>`` has what one micro-batch of one streaming query wrote, ``bases/<stamp>`` what
has been folded, and ``manifests/<stamp>`` up to which batch of each query a base holds everything. A query is its
number and its Spark id, so a fresh checkpoint over the same table goes on behind the versions of the one before. A folder counts
once Spark has marked its write as ended: a reader takes the newest such base, the deltas beyond its manifest, and so
sees the state before a batch or a fold, or the one after it. A repeated batch that was written before is left out, one that was cut off is written again.
One stream at a time writes to a table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeflow.operators.frames import join_on
from gradeflow.operators.registry import newest_rows
from gradeflow.sources.paths import child_names, is_written

VERSION = "_version"
MANIFEST = "query string, batch long"


def _folded(spark: SparkSession, path: str) -> tuple[str | None, dict[str, int]]:
    """The newest whole base and the last batch of each query that it holds."""
    for stamp in reversed(child_names(spark, f"{path}/bases")):
        if is_written(spark, f"{path}/bases/{stamp}"):
            # One row per query that ever wrote.
            rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifests/{stamp}").collect()
            return stamp, {r["query"]: r["batch"] for r in rows}
    return None, {}


def _pending(spark: SparkSession, path: str, held: dict[str, int]) -> list[tuple[str, int]]:
    """Whole deltas that no base holds yet."""
    found = []
    for query in child_names(spark, f"{path}/deltas"):
        fresh = [int(b) for b in child_names(spark, f"{path}/deltas/{query}") if int(b) > held.get(query, -1)]
        found += [(query, b) for b in fresh if is_written(spark, _delta(path, query, b))]
    return found


def _delta(path: str, query: str, batch: int) -> str:
    return f"{path}/deltas/{query}/{batch:012d}"


def _newest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows of each key's newest version."""
    latest = rows.groupBy(*keys).agg(F.max(VERSION).alias(VERSION))
    return join_on(rows, latest, [*keys, VERSION])


def _rows(spark: SparkSession, path: str, stamp: str | None, deltas: list[tuple[str, int]]) -> DataFrame | None:
    places = [_delta(path, q, b) for q, b in deltas] + ([f"{path}/bases/{stamp}"] if stamp else [])
    return spark.read.option("mergeSchema", True).parquet(*places) if places else None


def read(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The rows of the newest version of every key. The plan names the folders it was made for, which never change."""
    stamp, held = _folded(spark, path)
    rows = _rows(spark, path, stamp, _pending(spark, path, held))
    if rows is None:
        raise ValueError(f"no version has been written to {path}")
    return _newest(rows, keys).drop(VERSION)


def fold(spark: SparkSession, path: str, keys: Sequence[str]) -> bool:
    """Write a new base of all whole versions; whether there was anything to fold.

    The manifest is written before the base, so a fold that is cut off leaves nothing that a reader sees.
    """
    stamp, held = _folded(spark, path)
    deltas = _pending(spark, path, held)
    if not deltas:
        return False
    number = 1 + max([int(name.split("-")[0]) for name in child_names(spark, f"{path}/bases")], default=0)
    fresh = f"{number:012d}-{uuid.uuid4().hex}"
    for query, batch in deltas:
        held[query] = max(batch, held.get(query, -1))
    spark.createDataFrame(sorted(held.items()), MANIFEST).coalesce(1).write.parquet(f"{path}/manifests/{fresh}")
    _newest(_rows(spark, path, stamp, deltas), keys).write.parquet(f"{path}/bases/{fresh}")
    return True


def _name_of_query(spark: SparkSession, path: str, checkpoint: str) -> str:
    """The folder of the query with this checkpoint: its number in order of first writes, and Spark's id of it."""
    own = json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]
    known = child_names(spark, f"{path}/deltas")
    number = 1 + max([int(name.split("-")[0]) for name in known], default=0)
    return next((name for name in known if name.endswith(own)), f"{number:06d}-{own}")


def sink(path: str, checkpoint: str, keys: Sequence[str], order: str | None = None, fold_every: int = 16) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink. With ``order`` only each key's newest row of the batch is kept, else all rows.

    Every so many batches all versions are folded, so reading takes one base and fewer deltas than that.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        query = _name_of_query(spark, path, checkpoint)
        place = _delta(path, query, batch_id)
        if not is_written(spark, place):
            rows = newest_rows(batch, keys, order) if order else batch
            rows.withColumn(VERSION, F.lit(f"{query.split('-')[0]}/{batch_id:012d}")).write.mode("overwrite").parquet(place)
        if (batch_id + 1) % fold_every == 0:
            fold(spark, path, keys)

    return write
