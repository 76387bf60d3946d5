"""What must not grow with the tables: broadcasts, shuffles and state."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Row

from gradeflow.plans import files, registry
from gradeflow.streaming import closing


def events(spark, folder, rows):
    """An events table of ``event_id, ts, user_id, event_type`` and a value."""
    kinds = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    spark.createDataFrame([(*row, 1.5, "{}") for row in rows], kinds).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_run_metrics_are_not_broadcast(spark, tmp_path):
    """The estimated sizes shrink where variants are dropped, whatever the number of runs."""
    at = datetime(2024, 1, 1)
    made = registry.run_store_metrics(spark, events(spark, tmp_path, [(7, at, 1, "view"), (8, at, 1, "click"), (None, at, 1, "view")]))
    assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
    rows = {(r["run_id"], r["step"]): (r["reward"], r["status"], r["configured"]) for r in made.collect()}
    assert rows == {
        ("run-7", 7): (0.5, "queued", 7), ("run-7", 10): (None, "queued", 7),
        ("run-8", 8): (0.5, "running", 8), ("run-8", 10): (None, "running", 8),
    }


class State:
    """A value, list or map of one run that counts how often it is called, and the elements it is given."""

    def __init__(self, calls):
        self.held, self.calls = None, calls

    def get(self, *_):
        self.calls.append(1)
        return self.held

    def update(self, value):
        self.calls.append(1)
        self.held = value

    def exists(self):
        return self.get() is not None

    def clear(self):
        self.update(None)

    def appendList(self, values):
        self.calls.extend(values)
        self.held = [*(self.held or []), *values]

    def put(self, values):
        self.calls.extend(values)
        self.held = values

    def getValue(self, key):
        self.calls.append(1)
        return (self.held or {}).get(key)

    def containsKey(self, key):
        return self.getValue(key) is not None

    def updateValue(self, key, value):
        self.calls.append(1)
        self.held = (self.held or {}) | {key: value}


class Handle:
    def __init__(self):
        self.calls, self.timers = [], set()

    def getValueState(self, *_):
        return State(self.calls)

    getListState = getMapState = getValueState

    def registerTimer(self, at):
        self.calls.append(1)
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls.append(1)
        self.timers.discard(at)


class Times:
    def getCurrentWatermarkInMs(self):
        return 0


def taken_in(processor, names, batches):
    """What a processor gives for the batches of one run, and how many state calls and elements each took."""
    handle, made, calls = Handle(), [], []
    processor.init(handle)
    for batch in batches:
        handle.calls.clear()
        made.append([tuple(r)[2:] for r in processor.handleInputRows(("r",), (Row(*names)(*row) for row in batch), Times())])
        calls.append(len(handle.calls))
    return made, calls, handle


def test_steps_take_a_call_for_each_chunk(spark):
    names = ["run_id", "at", "line_no", "exit_code", "step", *closing.lf.METRIC_NAMES]
    first = [("r", 5, n, None, n // 2, None, n / 2 if n % 2 == 0 else None, None) for n in range(2000)]
    second = [("r", 6, 2000, 0, 7, None, None, 2.5), ("r", 6, 3, None, 7, 9.0, 9.0, None)]
    (one, two), calls, handle = taken_in(closing.StepMetrics(1000), names, [first, second])
    assert sorted(one) == [(None, k, None, float(k), None) for k in range(1000)]
    assert two == [(None, 7, 9.0, 7.0, 2.5)] and handle.timers == {6}
    assert calls[0] <= 1000 / closing.STEPS + 5 and calls[1] <= 6


def test_the_state_of_a_run_is_one_value(spark):
    names = ["run_id", "at", "line_no", "exit_code", "app_id", "micros"]
    first = [("r", 5, n, None, "ap-1" if n == 4 else None, n) for n in range(1000)]
    made, calls, handle = taken_in(closing.RunStates(1000), names, [first, [("r", 7, 1001, 1, None, 3)]])
    assert made == [[(None, None, "ap-1", 999, 999)], [(None, 1, "ap-1", 999, 1001)]]
    assert handle.timers == {7} and calls[0] <= 3 and calls[1] <= 4


def test_a_tail_is_one_value(spark):
    names = ["run_id", "at", "line_no", "exit_code", "line"]
    first = [("r", 5, n, None, f"l{n}") for n in range(1000)]
    made, calls, handle = taken_in(closing.Tails(1000, 3), names, [first, [("r", 7, 998, None, "again"), ("r", 7, 1, None, "old")]])
    assert made == [[(n, f"l{n}") for n in (997, 998, 999)], [(997, "l997"), (998, "again"), (999, "l999")]]
    assert handle.timers == {1007} and calls[0] <= 3 and calls[1] <= 4


def test_waiting_heartbeats_are_few_elements(spark):
    made, calls, handle = taken_in(closing.Heartbeats(1000), ["run_id", "at", "ended"], [[("r", n, False) for n in range(10_000)]])
    assert made == [[]] and handle.timers == {0} and calls[0] <= 4


def values_of(rows):
    """Packed rows, one tuple per record."""
    return [(row[0], *values) for row in rows for values in zip(*row[1:], strict=True)]


def test_records_of_a_run_reach_python_in_few_rows(spark):
    """Nulls stay in their places; a hot run takes several rows, and its records keep their order."""
    rows = [("hot", n, None if n % 3 else f"l{n}", n) for n in range(1000)] + [("a", 1, None, None), ("", 2, "x", 3)]
    packed = closing._packed(spark.createDataFrame(rows, "run_id string, at long, line string, line_no int").coalesce(1)).collect()
    assert len(packed) == 2 + -(-1000 // closing.PACK) and all(len(r["at"]) <= closing.PACK for r in packed)
    assert sorted(values_of(packed), key=lambda r: (r[0], r[1])) == sorted(rows, key=lambda r: (r[0], r[1]))
    assert closing._packed(spark.createDataFrame([], "run_id string, at long")).collect() == []


def test_what_is_late_leaves_in_few_rows(spark):
    class Later(Times):
        def getCurrentWatermarkInMs(self):
            return 10_000

    processor = closing.Packed(closing.RunStates(1000))
    processor.init(Handle())
    lists = [[n, n + 1] for n in range(0, 9000, 2)]
    rows = (Row("run_id", "at", "line_no", "exit_code", "app_id", "micros")("r", at, at, [None] * 2, [None] * 2, at) for at in lists)
    made = list(processor.handleInputRows(("r",), rows, Later()))
    assert len(made) <= 3
    assert [r[:3] for r in values_of(made)] == [("r", True, n) for n in range(9000)]


def test_a_late_end_of_an_orphan_is_an_end(spark):
    """The end has a time before the last record; what comes next begins anew."""
    class Later(Times):
        def getCurrentWatermarkInMs(self):
            return 50_000

    handle, processor = Handle(), closing.Heartbeats(1000)
    processor.init(handle)
    for batch in ([("r", 9000, False)], [("r", 5000, True), ("r", 6000, False)]):
        list(processor.handleInputRows(("r",), (Row("run_id", "at", "ended")(*row) for row in batch), Later()))
        found = [tuple(r)[1:] for r in processor.handleExpiredTimer(("r",), Later(), None)]
    assert found == [("orphaned", 7000, 6000)]


def test_json_bodies_take_one_shuffle(spark, tmp_path):
    """Both shapes of a file come out of one row, which the writer needs no second shuffle for."""
    rows = [(n, f"text {n}", "en") for n in (1, 2, 150)] + [(None, None, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    made = files._bodies(spark, str(tmp_path))
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    bodies = {(r["shape"], r["file"]): r["value"] for r in made.collect()}
    assert len(bodies) == 6 and bodies["lists", 1] == '[{"doc_id":150,"text":"text 150","lang":"en"}]'
    assert bodies["objects", 1].endswith(', "rows": ' + bodies["lists", 1] + ', "more": [1]}')
