"""What several operators share: stored tables, shipped code, folds, Arrow batches as byte arrays."""

from __future__ import annotations

import ctypes
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeflow.session import fresh_path

PACKAGE = Path(__file__).resolve().parent.parent
CHUNK_BYTES = 1 << 19
# Rows that Spark hands a Python worker at once, where the session allows more: whole texts are long rows.
BATCH_ROWS = 2000
# Rows in a file of a narrow intermediate table.
FILE_ROWS = 50_000
_ROWS_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


@lru_cache(maxsize=4)
def _package_zip() -> str:
    made = Path(tempfile.mkdtemp(prefix="package-")) / f"{PACKAGE.name}.zip"
    with zipfile.ZipFile(made, "w") as out:
        for path in sorted(PACKAGE.rglob("*.py")):
            out.write(path, path.relative_to(PACKAGE.parent))
    return str(made)


def ship(spark: SparkSession) -> None:
    """Give every executor this package, once per Spark context, so that worker caches outlive a task.

    Also lowers the session's rows per Arrow batch to ``BATCH_ROWS``, which bounds the memory next to the heap.
    """
    if not 0 < int(spark.conf.get(_ROWS_SETTING)) <= BATCH_ROWS:
        spark.conf.set(_ROWS_SETTING, str(BATCH_ROWS))
    context = spark.sparkContext
    if getattr(context, "_gradeflow_shipped", False):
        return
    context.addPyFile(_package_zip())
    context._gradeflow_shipped = True


def in_files(df: DataFrame, rows: int, each: int = FILE_ROWS) -> DataFrame:
    """``df``, of about ``rows`` rows, in one partition for ``each`` rows, though in as many as there are cores, and never in more than it has."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))


def stored(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here, and a lost executor loses nothing.

    ``rows``: about how many it has at most, if known. A table with few rows is then written by few tasks in few files, whatever the number of
    shuffle partitions.
    """
    path = fresh_path(df.sparkSession, label)
    df = df if rows is None else in_files(df, rows)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """``df``, a narrow table, marked for a broadcast join if it has at most ``rows`` rows; else it is shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def fold(key: Column, folds: int) -> Column:
    """CRC-32 of the key as text, modulo ``folds``; null for a null key."""
    return F.pmod(F.crc32(key.cast("string")), F.lit(folds))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row starts; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, starts, data = column.buffers()
    offsets = np.frombuffer(starts, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), offsets


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of about ``size`` bytes: first row, end row, their bytes, row starts from 0 on."""
    if not len(column):
        return
    data, offsets = utf8(column)
    first = 0
    while first < len(column):
        end = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        end = min(len(column), max(end, first + 1))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def give_back() -> None:
    """Return freed memory to the system: workers outlive their tasks, the driver its stages, and what they hold adds up."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_texts(df: DataFrame, work: Callable, schema: str, text: str = "text") -> DataFrame:
    """``work(rows, bytes, offsets)`` gives the output columns for a run of input rows; all run in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index(text)
            for first, end, data, offsets in chunks(batch.column(place)):
                yield work(batch.slice(first, end - first), data, offsets)
        give_back()

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)
