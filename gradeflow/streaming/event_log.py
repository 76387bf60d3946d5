"""An append-only log of job events: written once however often they arrive, read on from a cursor."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gradeflow.operators.ordering import first_rows
from gradeflow.streaming import runs

# Sequence ids that one folder of the log holds: a cursor skips whole folders.
SPAN = 4096


def append_events(events: DataFrame, out: str, checkpoint: str, keys: Sequence[str], sequence: str = "seq", ts: str = "ts", delay: str = "1 hour") -> StreamingQuery:
    """Write each event once. A repeat is left out if its time is at most ``delay`` from the first one's, or behind the watermark.

    The state is one key per event of the last ``delay``. Each micro-batch is its own folder, cut by ranges of the sequence; a
    repeated batch replaces itself.
    """
    watched = events.withColumn("_watched", F.col(ts).cast("timestamp")).withWatermark("_watched", delay)
    once = watched.dropDuplicatesWithinWatermark(list(keys)).drop("_watched")

    def write(batch: DataFrame, batch_id: int) -> None:
        ranged = batch.withColumn("span", F.floor(F.col(sequence) / SPAN)).repartitionByRange("span", sequence).sortWithinPartitions("span", sequence)
        ranged.write.mode("overwrite").partitionBy("span").parquet(f"{out}/{runs.BATCH}={batch_id}")

    return once.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_after(spark: SparkSession, out: str, cursor: int, rows: int = 0, sequence: str = "seq") -> DataFrame:
    """The events behind the cursor, or the first ``rows`` of them. Folders of ranges up to the cursor aren't listed for reading,
    files by their least and greatest sequence are skipped inside the others.
    """
    events = spark.read.parquet(out)
    behind = events.where((F.col("span") >= cursor // SPAN) & (F.col(sequence) > cursor)).drop(runs.BATCH, "span")
    return first_rows(behind, rows, [sequence])
