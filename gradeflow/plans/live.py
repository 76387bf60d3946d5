"""Streams that end, expire and compact, over the events table cut into batches that arrive one after another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gradeflow.operators import logs as log_ops
from gradeflow.plans import Query, table
from gradeflow.plans.logs import LINES_SQL, STATE_SQL, STEP_METRICS_SQL, as_lines
from gradeflow.plans.registry import STATUS_SQL, _status
from gradeflow.session import fresh_path
from gradeflow.streaming import closing, event_log, versions

PARTS = 3
SILENCE_MS = 6 * 3600 * 1000
LATE_EVERY = 10


def arriving(spark: SparkSession, parts: list[DataFrame], source: str, start: Callable[[DataFrame], StreamingQuery]) -> None:
    """Each part is appended to ``source`` and taken in by the stream, which goes on from its checkpoint, before the next one arrives."""
    for part in parts:
        part.write.mode("append").parquet(source)
        start(spark.readStream.schema(part.schema).parquet(source)).awaitTermination()


def _cut(events: DataFrame) -> list[DataFrame]:
    """The events in parts by id, which rises with time, with ``part``."""
    last = F.lit(events.agg(F.max("event_id")).first()[0] or 0)
    numbered = events.withColumn("part", F.least(F.floor(F.col("event_id") * PARTS / (last + 1)), F.lit(PARTS - 1)))
    return [numbered.where(F.col("part") == k) for k in range(PARTS)]


PART_SQL = f"least(floor(event_id * {PARTS} / ((SELECT max(event_id) FROM events) + 1)), {PARTS - 1})"


def run_orphans(spark: SparkSession, folder: str) -> DataFrame:
    """Users as runs that end with a purchase; hours without an event make an orphan."""
    parts = [p.select(F.col("user_id").cast("string").alias("run_id"), "ts", (F.col("event_type") == "purchase").alias("ended")) for p in _cut(table(spark, folder, "events"))]
    out = fresh_path(spark, "orphans")

    def start(stream: DataFrame) -> StreamingQuery:
        return closing.orphans(stream, SILENCE_MS, "1 hour").writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()

    arriving(spark, parts, f"{out}/in", start)
    return spark.read.parquet(f"{out}/data").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("at", "last_seen")})


ORPHANS_SQL = f"""
WITH w AS (SELECT max(epoch_us(ts) // 1000) - 3600000 AS passed FROM events),
e AS (SELECT CAST(user_id AS VARCHAR) AS run_id, epoch_us(ts) // 1000 AS ms, event_type = 'purchase' AS ended FROM events, w WHERE epoch_us(ts) // 1000 <= passed),
g AS (SELECT run_id, ms, ended, lead(ms) OVER (PARTITION BY run_id ORDER BY ms, ended) AS next_ms FROM e),
o AS (SELECT * FROM g, w WHERE NOT ended AND coalesce(next_ms, passed + 1) - ms > {SILENCE_MS})
SELECT run_id, 'orphaned' AS event, make_timestamp(1000 * (ms + {SILENCE_MS})) AS "at", make_timestamp(1000 * ms) AS last_seen FROM o
UNION ALL SELECT run_id, 'revived', make_timestamp(1000 * next_ms), make_timestamp(1000 * next_ms) FROM o WHERE next_ms IS NOT NULL
"""


def _run_lines(spark: SparkSession, folder: str) -> list[DataFrame]:
    """Log lines in parts. A run is a user's events of one part, and its last line ends it."""
    parts = []
    for k, part in enumerate(_cut(table(spark, folder, "events"))):
        ends = part.groupBy("user_id").agg(F.max("event_id").alias("last")).select(F.col("last").alias("line_no"), (F.col("last") % 2).cast("int").alias("exit_code"))
        number = F.concat(F.substring_index("run_id", "-", 2), F.lit(f"-{k}"))
        lines = as_lines(part).select(number.alias("run_id"), "line_no", "ts", "line")
        parts.append(lines.join(ends, "line_no", "left"))
    return parts


_RUN_LINES_SQL = f"""SELECT 'run-' || user_id || '-' || CAST({PART_SQL} AS BIGINT) AS run_id, l.line_no, l.ts, l.line,
  CASE WHEN l.line_no = max(l.line_no) OVER (PARTITION BY user_id, {PART_SQL}) THEN CAST(l.line_no % 2 AS INTEGER) END AS exit_code
FROM ({LINES_SQL}) l JOIN events ON event_id = line_no"""


def stream_ended_runs(spark: SparkSession, folder: str) -> DataFrame:
    """States of runs that all end, and, after them, every tenth line of the first part again: too late, as its runs are gone."""
    parts, out = _run_lines(spark, folder), fresh_path(spark, "ended-runs")
    arriving(
        spark, [*parts, parts[0].where(F.col("line_no") % LATE_EVERY == 0)], f"{out}/in",
        lambda stream: closing.run_state(stream, f"{out}/data", f"{out}/late", f"{out}/state", fold_every=2),
    )
    states = versions.read(spark, f"{out}/data", ["run_id"])
    late = versions.read(spark, f"{out}/late", ["run_id", "line_no"])
    return states.select("run_id", "status", "app_id", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"), "last_line").union(
        late.select("run_id", F.lit("late"), F.lit(None).cast("string"), F.lit(None).cast("timestamp_ntz"), "line_no")
    )


ENDED_RUNS_SQL = f"""{STATE_SQL.replace(LINES_SQL, _RUN_LINES_SQL)}
UNION ALL SELECT run_id, 'late', NULL, NULL, line_no FROM ({_RUN_LINES_SQL}) WHERE run_id LIKE '%-0' AND line_no % {LATE_EVERY} = 0
"""


def stream_ended_metrics(spark: SparkSession, folder: str) -> DataFrame:
    parts, out = _run_lines(spark, folder), fresh_path(spark, "ended-metrics")
    arriving(spark, parts, f"{out}/in", lambda stream: closing.step_metrics(stream, f"{out}/data", f"{out}/late", f"{out}/state", fold_every=2))
    return versions.read(spark, f"{out}/data", ["run_id", "step"])


def stream_kept_tail(spark: SparkSession, folder: str) -> DataFrame:
    """The last lines of users as runs that go on over all parts, from state alone."""
    out = fresh_path(spark, "kept-tail")
    parts = [as_lines(p).withColumn("run_id", F.substring_index("run_id", "-", 2)).withColumn("exit_code", F.lit(None).cast("int")) for p in _cut(table(spark, folder, "events"))]
    arriving(spark, parts, f"{out}/in", lambda stream: closing.log_tail(stream, f"{out}/data", f"{out}/late", f"{out}/state", log_ops.SHOWN_LINES, idle_ms=1 << 40, fold_every=2))
    return versions.read(spark, f"{out}/data", ["run_id"]).select("run_id", "line_no", "line")


KEPT_TAIL_SQL = f"""
SELECT 'run-' || user_id AS run_id, line_no, line FROM ({LINES_SQL}) l JOIN events ON event_id = line_no
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY line_no DESC) <= 8
"""


def stream_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Run changes as versions, written under two checkpoints one after the other, folded on the way."""
    out = fresh_path(spark, "versions")
    parts = [p.select("user_id", "event_id", "ts", _status().alias("status")) for p in _cut(table(spark, folder, "events"))]

    def start(state: str) -> Callable[[DataFrame], StreamingQuery]:
        def write(stream: DataFrame) -> StreamingQuery:
            sink = versions.sink(f"{out}/data", f"{out}/{state}", ["user_id"], order="event_id", fold_every=2)
            return stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{out}/{state}").trigger(availableNow=True).start()

        return write

    arriving(spark, parts[:2], f"{out}/first", start("state-1"))
    arriving(spark, parts[2:], f"{out}/second", start("state-2"))
    return versions.read(spark, f"{out}/data", ["user_id"])


VERSIONS_SQL = f"""
SELECT user_id, max(event_id) AS event_id, arg_max(ts, event_id) AS ts, arg_max({STATUS_SQL}, event_id) AS status
FROM events GROUP BY user_id
"""


def event_cursor(spark: SparkSession, folder: str) -> DataFrame:
    """Events that arrive twice in each part, and again with the next one, read on from the middle of the log."""
    out = fresh_path(spark, "event-log")
    parts = [p.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), "ts", _status().alias("status")) for p in _cut(table(spark, folder, "events"))]
    twice = [p.union(p.where("seq % 3 = 0")) for p in parts]
    replayed = [twice[0], *[twice[k].union(parts[k - 1].where("seq % 5 = 0")) for k in range(1, PARTS)]]
    arriving(spark, replayed, f"{out}/in", lambda stream: event_log.append_events(stream, f"{out}/data", f"{out}/state", ["run_id", "seq"]))
    cursor = table(spark, folder, "events").agg(F.floor(F.max("event_id") / 3)).first()[0] or 0
    return event_log.read_after(spark, f"{out}/data", cursor)


CURSOR_SQL = f"""
SELECT user_id AS run_id, event_id AS seq, ts, {STATUS_SQL} AS status FROM events
WHERE event_id > (SELECT max(event_id) // 3 FROM events)
"""

QUERIES: dict[str, Query] = {
    "run_orphans": run_orphans,
    "stream_ended_runs": stream_ended_runs,
    "stream_ended_metrics": stream_ended_metrics,
    "stream_kept_tail": stream_kept_tail,
    "stream_versions": stream_versions,
    "event_cursor": event_cursor,
}

ORACLES: dict[str, str] = {
    "run_orphans": ORPHANS_SQL,
    "stream_ended_runs": ENDED_RUNS_SQL,
    "stream_ended_metrics": STEP_METRICS_SQL.replace(LINES_SQL, _RUN_LINES_SQL),
    "stream_kept_tail": KEPT_TAIL_SQL,
    "stream_versions": VERSIONS_SQL,
    "event_cursor": CURSOR_SQL,
}
