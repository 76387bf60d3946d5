"""Streams that end, expire and compact: timers, eviction, late records, bounded tails, versions and the event log."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gradeflow.plans.live import arriving
from gradeflow.streaming import closing, event_log, versions

START = datetime(2024, 1, 1)
HOUR_MS = 3600 * 1000
LINE = "run_id string, line_no long, ts timestamp, line string, exit_code int"


def at(minutes: float) -> datetime:
    return START + timedelta(minutes=minutes)


def frames(spark, batches, schema):
    return [spark.createDataFrame(rows, schema).coalesce(1) for rows in batches]


@pytest.fixture
def two_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_silent_run_is_orphaned_once_and_revived(spark, tmp_path, two_partitions):
    """Three batches; the second brings records out of order, the third one after the silence."""
    batches = [
        [("a", at(0), False), ("b", at(1), False), ("c", at(2), True), (None, at(2), False), ("a", None, False)],
        [("d", at(200), False), ("a", at(30), None), ("d", at(190), False)],
        [("a", at(300), False), ("d", at(310), True), ("clock", at(2000), False)],
    ]
    seen = []

    def start(stream):
        def note(batch, _):
            seen.extend((r["run_id"], r["event"], r["at"], r["last_seen"]) for r in batch.collect())

        found = closing.orphans(stream, HOUR_MS, "0 seconds")
        return found.writeStream.foreachBatch(note).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()

    arriving(spark, frames(spark, batches, "run_id string, ts timestamp, ended boolean"), str(tmp_path / "in"), start)
    local = lambda m: spark.createDataFrame([(at(m),)], "t timestamp").first()["t"]
    assert sorted(seen) == sorted([
        ("a", "orphaned", local(90), local(30)), ("a", "revived", local(300), local(300)), ("a", "orphaned", local(360), local(300)),
        ("b", "orphaned", local(61), local(1)), ("d", "orphaned", local(260), local(200)),
        ("d", "revived", local(310), local(310)),
    ])


def test_state_falls_to_nothing_when_runs_end_and_late_lines_are_put_by(spark, tmp_path, two_partitions):
    out, late, state, source = (str(tmp_path / n) for n in ("out", "late", "state", "in"))
    batches = [
        [("r", 1, at(1), "ap-A1 up", None), ("r", 2, at(2), "", 0), ("s", 1, at(3), "x", None)],
        [("s", 2, at(60), "see ap-B2", 3)],
        [("r", 3, at(4), "too late", None), ("s", 3, at(61), "after its end", None), ("clock", 1, at(9000), "", 0)],
    ]
    queries = []

    def start(stream):
        queries.append(closing.run_state(stream, out, late, state, delay="0 seconds", idle_ms=HOUR_MS))
        return queries[-1]

    arriving(spark, frames(spark, batches, LINE), source, start)
    rows = {r["run_id"]: (r["status"], r["app_id"], r["last_line"]) for r in versions.read(spark, out, ["run_id"]).collect()}
    assert rows["r"] == ("completed", "ap-A1", 2) and rows["clock"][0] == "completed"
    assert [(r["run_id"], r["line_no"]) for r in versions.read(spark, late, ["run_id", "line_no"]).collect()] == [("r", 3)]
    # What comes after the end, in time, is a run of its own that falls silent.
    assert rows["s"] == ("running", None, 3)
    assert queries[-1].recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == 0


def test_metrics_of_a_run_end_with_it(spark, tmp_path, two_partitions):
    out, late, state, source = (str(tmp_path / n) for n in ("out", "late", "state", "in"))
    batches = [
        [("r", 1, at(1), "step:1 reward:0.5", None), ("r", 2, at(1), "noise", None), ("r", 3, at(2), "step:1 kl:0.25 reward:0.75", None)],
        [("r", 2, at(2), "step:1 reward:0.1 kl:7", None), ("r", 9, at(3), "step:2 reward:1", 0)],
        [("clock", 1, at(9000), "", 0)],
    ]
    queries = []

    def start(stream):
        queries.append(closing.step_metrics(stream, out, late, state, delay="0 seconds"))
        return queries[-1]

    arriving(spark, frames(spark, batches, LINE), source, start)
    rows = {r["step"]: (r["distillation_loss"], r["reward"], r["teacher_kl"]) for r in versions.read(spark, out, ["run_id", "step"]).collect()}
    assert rows == {1: (None, 0.75, 0.25), 2: (None, 1.0, None)}
    assert queries[-1].recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == 0


def test_a_hot_run_keeps_only_its_tail(spark, tmp_path, two_partitions):
    out, late, state, source = (str(tmp_path / n) for n in ("out", "late", "state", "in"))
    parts = [
        spark.range(k * 40_000, (k + 1) * 40_000).select(
            F.lit("hot").alias("run_id"), F.col("id").alias("line_no"), (F.lit(START) + F.make_interval(secs=F.col("id"))).cast("timestamp").alias("ts"),
            F.concat(F.lit("l"), "id").alias("line"), F.lit(None).cast("int").alias("exit_code"),
        )
        for k in range(3)
    ]
    queries = []

    def start(stream):
        queries.append(closing.log_tail(stream, out, late, state, keep=5, idle_ms=1 << 40, fold_every=2))
        return queries[-1]

    arriving(spark, parts, source, start)
    kept = versions.read(spark, out, ["run_id"]).orderBy("line_no").collect()
    assert [(r["line_no"], r["line"]) for r in kept] == [(n, f"l{n}") for n in range(119_995, 120_000)]
    # Five lines, one value with the last time, one timer and its index.
    assert queries[-1].recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 10


def version(spark, value):
    return spark.createDataFrame([("k", value)], "key string, value int")


def test_versions_of_two_checkpoints_and_cut_off_writes(spark, tmp_path, monkeypatch):
    out, keys = str(tmp_path / "t"), ["key"]
    for name, own in (("one", "aaaa"), ("two", "0000")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "metadata").write_text(f'{{"id": "{own}"}}')
    first, second = (versions.sink(out, str(tmp_path / n), keys, fold_every=1000) for n in ("one", "two"))
    value = lambda: versions.read(spark, out, keys).first()["value"]
    first(version(spark, 1), 0)
    first(version(spark, 2), 1)
    first(version(spark, 9), 1)  # a repeated batch was written before
    assert value() == 2
    second(version(spark, 3), 0)  # a fresh checkpoint counts from 0 again
    assert value() == 3
    before = versions.read(spark, out, keys)
    # A fold that dies after its manifest leaves readers what they had, and the next one ends.
    with monkeypatch.context() as patch:
        patch.setattr(versions, "_newest", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            versions.fold(spark, out, keys)
    assert value() == 3
    assert versions.fold(spark, out, keys) and not versions.fold(spark, out, keys)
    assert value() == 3 and before.first()["value"] == 3
    second(version(spark, 4), 1)
    first(version(spark, 0), 1)  # folded long ago
    assert value() == 4
    # A write that was cut off has no mark and isn't read; it is written again.
    (tmp_path / "t" / "deltas" / "000002-0000" / f"{2:012d}").mkdir()
    assert value() == 4
    second(version(spark, 5), 2)
    assert value() == 5


def test_newest_version_of_a_key_is_all_its_rows(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "metadata").write_text('{"id": "x"}')
    keep = versions.sink(str(tmp_path / "t"), str(tmp_path / "c"), ["key"], fold_every=2)
    rows = lambda *pairs: spark.createDataFrame(pairs, "key string, n int")
    keep(rows(("a", 1), ("a", 2), (None, 7)), 0)
    keep(rows(("a", 3), ("b", 4)), 1)
    keep(rows(("b", 5), ("b", 6)), 2)
    made = versions.read(spark, str(tmp_path / "t"), ["key"]).collect()
    assert sorted((r["key"] or "", r["n"]) for r in made) == [("", 7), ("a", 3), ("b", 5), ("b", 6)]
    with pytest.raises(ValueError, match="no version"):
        versions.read(spark, str(tmp_path / "none"), ["key"])


def test_a_cursor_skips_folders(spark, tmp_path, two_partitions):
    out, state, source = (str(tmp_path / n) for n in ("out", "state", "in"))
    events = lambda low, high: spark.range(low, high).select(F.lit("r").alias("run_id"), F.col("id").alias("seq"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("ts"))
    parts = [events(0, 9000), events(8000, 12_000).union(events(8000, 9000)), events(11_000, 20_000)]
    arriving(spark, parts, source, lambda stream: event_log.append_events(stream, out, state, ["run_id", "seq"]))
    behind = event_log.read_after(spark, out, 15_000)
    assert sorted(r["seq"] for r in behind.collect()) == list(range(15_001, 20_000))
    assert [r["seq"] for r in event_log.read_after(spark, out, 11_999, rows=3).collect()] == [12_000, 12_001, 12_002]
    assert {f.split("span=")[1].split("/")[0] for f in behind.inputFiles()} >= {"3", "4"}
    assert "PartitionFilters: [isnotnull(span" in behind._jdf.queryExecution().toString()
