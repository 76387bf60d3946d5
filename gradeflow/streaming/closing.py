"""Streams over runs whose state ends: heartbeats, run state, step metrics and log tails, one state per run.

All of them watch event time. A run's state goes when the watermark has passed its end, or its last record by ``idle``. The
event-time column itself doesn't reach the state operator, so records behind the watermark aren't dropped unseen: they are
taken in while their run has state, and go to a side table where it has none.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import ArrayType, StructField, StructType

from gradeflow.functions import logs as lf
from gradeflow.operators import logs as log_ops
from gradeflow.streaming import versions

DELAY = "10 minutes"
IDLE_MS = 7 * 24 * 3600 * 1000
# Neighbouring steps that are read and written at once.
STEPS = 64
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_in_rocks(spark: SparkSession) -> None:
    """State with lists, maps and timers needs this store; a checkpoint remembers the store it began with."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


# Records in a packed row, and what a task packs at once; they only bound memory.
PACK = 256
PACKED_ROWS, PACKED_BYTES = 1 << 20, 1 << 26
CHUNK = 4096


def _lists(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches by ``run_id``, the first column: of the others, arrays of at most ``PACK`` values."""
    table = pa.Table.from_batches(batches).combine_chunks()
    runs = table.column(0).combine_chunks().dictionary_encode()
    codes = runs.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    firsts = np.flatnonzero(np.diff(codes, prepend=-1))
    place = np.arange(len(codes)) - np.repeat(firsts, np.diff(firsts, append=len(codes)))
    starts = np.flatnonzero(place % PACK == 0)
    ends = pa.array(np.append(starts, len(codes)), pa.int32())
    values = [pa.ListArray.from_arrays(ends, c.combine_chunks()) for c in table.select(range(1, table.num_columns)).take(pa.array(order)).columns]
    packed = pa.RecordBatch.from_arrays([runs.dictionary.take(pa.array(codes[starts])), *values], table.column_names)
    edges = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(codes), 1 << 15)), len(starts))).tolist()
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        yield packed.slice(low, high - low)


def _arrays(schema: StructType) -> StructType:
    """The schema with an array in place of each column but the first."""
    return StructType([schema[0], *(StructField(f.name, ArrayType(f.dataType)) for f in schema[1:])])


def _packed(records: DataFrame) -> DataFrame:
    """The records of a run in few rows, each column behind ``run_id`` as an array, after a shuffle by run."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, size = [], 0, 0
        for batch in batches:
            held, rows, size = [*held, batch], rows + batch.num_rows, size + batch.nbytes
            if rows >= PACKED_ROWS or size >= PACKED_BYTES:
                yield from _lists(held)
                held, rows, size = [], 0, 0
        if rows:
            yield from _lists(held)

    return records.repartition("run_id").mapInArrow(pack, _arrays(records.schema))


class Packed(StatefulProcessor):
    """Another processor over packed records. What it makes of a run leaves packed too."""

    def __init__(self, inner: StatefulProcessor) -> None:
        self.inner = inner

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.inner.init(handle)

    def _together(self, made: Iterator[Row]) -> Iterator[Row]:
        while part := list(islice(made, CHUNK)):
            run, *values = zip(*part, strict=True)
            yield Row(*part[0].__fields__)(run[0], *map(list, values))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        records = ((run, *values) for run, *lists in rows for values in zip(*lists, strict=True))
        return self._together(iter(self.inner.handleInputRows(key, records, timerValues)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return self._together(iter(self.inner.handleExpiredTimer(key, timerValues, expiredTimerInfo)))

    def close(self) -> None:
        self.inner.close()


def _by_run(records: DataFrame, delay: str, processor: StatefulProcessor, schema: str, *columns: str) -> DataFrame:
    """``processor`` over the records of each ``run_id``; they have ``at``, the milliseconds of ``ts``, in place of it.

    Processors take plain records one by one. What costs time is each row that goes into Python or out of it, so a run's records
    travel packed; and each call to a state and each element of it, so what a run holds is
    one value where it is bounded, else chunks of arrays, read and written once for each run and batch.
    """
    keep_state_in_rocks(records.sparkSession)
    timed = records.where("run_id is not null and ts is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", delay).select("run_id", F.unix_millis("ts").alias("at"), *columns)
    made = StructType.fromDDL(schema)
    found = _packed(timed).groupBy("run_id").transformWithState(Packed(processor), _arrays(made), "append", "eventtime")
    return found.select("run_id", F.inline(F.arrays_zip(*made.names[1:])))


_EVENT = Row("run_id", "event", "at", "last_seen")


def _chunks(records: list[tuple]) -> list[tuple[list, ...]]:
    """Records as the arrays of their members, so many to an element of a list state."""
    parts = [records[k : k + CHUNK] for k in range(0, len(records), CHUNK)]
    return [tuple(list(values) for values in zip(*part, strict=True)) for part in parts]


class Heartbeats(StatefulProcessor):
    """Orphans and revivals of a run. Records wait until the watermark has passed them, so the order of arrival doesn't matter."""

    def __init__(self, silence_ms: int) -> None:
        self.silence = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "last long, orphaned boolean")
        self.waiting = handle.getListState("waiting", "at array<long>, ended array<boolean>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        fresh = [(at, ended) for _, at, ended in rows]
        self.waiting.appendList(_chunks(fresh))
        self.handle.registerTimer(min(at for at, _ in fresh))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        records = sorted(r for chunk in self.waiting.get() for r in zip(*chunk, strict=True))
        known = self.known.get()
        last, orphaned = known or (None, False)
        found: list[tuple[str, int, int]] = []

        def silent_until(moment: int) -> None:
            nonlocal orphaned
            if last is not None and not orphaned and moment - last > self.silence:
                orphaned = True
                found.append(("orphaned", last + self.silence, last))

        for at, ended in records:
            if at > passed:
                break
            silent_until(at)
            if orphaned and at > last:
                orphaned = False
                found.append(("revived", at, at))
            # An end behind the last record known ends a silent run too.
            last, orphaned = (None, False) if ended else (at if last is None else max(last, at), orphaned)
        silent_until(passed + 1)
        left = [r for r in records if r[0] > passed]
        if left:
            self.waiting.put(_chunks(left))
            self.handle.registerTimer(left[0][0])
        elif records:
            self.waiting.clear()
        if last is None:
            if known:
                self.known.clear()
        elif known != (last, orphaned):
            self.known.update((last, orphaned))
        if last is not None and not orphaned:
            self.handle.registerTimer(last + self.silence)
        for event in found:
            yield _EVENT(key[0], *event)

    def close(self) -> None:
        pass


def orphans(records: DataFrame, silence_ms: int, delay: str = DELAY) -> DataFrame:
    """``run_id, event, at, last_seen`` from a stream of ``run_id, ts, ended``: runs without a record for so long, and their return.

    A run is ``orphaned`` once, ``silence_ms`` after its last record, and ``revived`` by the next one. A run that has ended is
    watched no more until it has a record again. Times are compared in milliseconds; nothing is said before the watermark has passed it.
    """
    timed = _by_run(records.withColumn("ended", F.coalesce("ended", F.lit(False))), delay, Heartbeats(silence_ms), "run_id string, event string, at long, last_seen long", "ended")
    return timed.select("run_id", "event", F.timestamp_millis("at").alias("at"), F.timestamp_millis("last_seen").alias("last_seen"))


class Closing(StatefulProcessor):
    """What the processors below share: when a run's state goes, and which records are late.

    ``columns`` are those of the output behind ``run_id, late, line_no``, and ``held`` what a run holds beside its times, bounded.
    Records are ``run_id, at, line_no, exit_code`` and what :meth:`take` expects behind them.
    """

    columns: tuple[str, ...] = ()
    held = ""

    def __init__(self, idle_ms: int) -> None:
        self.idle = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.shape = Row("run_id", "late", "line_no", *self.columns)
        self.run = handle.getValueState("run", f"last long, until long, over boolean{self.held}")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        passed, nothing = timerValues.getCurrentWatermarkInMs(), (None,) * len(self.columns)
        before = self.run.get()
        last, until, over, *own = before or (None, None, False)
        self.begin(*own)
        newest = last
        taken = False
        for _, at, line_no, exit_code, *values in rows:
            if before is None and at < passed:
                yield self.shape(key[0], True, line_no, *nothing)
                continue
            taken = True
            newest = at if newest is None or at > newest else newest
            over = over or exit_code is not None
            self.take(line_no, exit_code, *values)
        if not taken:
            return
        for line_no, *values in self.made():
            yield self.shape(key[0], False, line_no, *values)
        # The end of a run, once known, is its last record; before, the run may be silent for so long.
        now = newest if over else newest + self.idle
        if now != until:
            if until is not None:
                self.handle.deleteTimer(until)
            self.handle.registerTimer(now)
        after = (newest, now, over, *self.holds())
        if after != before:
            self.run.update(after)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.run.clear()
        return iter(())

    def close(self) -> None:
        pass

    def begin(self, *own) -> None:
        """Take up what a run holds; nothing for a new one."""

    def take(self, line_no: int, exit_code: int | None, *values) -> None:
        """Take a record in."""

    def made(self) -> Iterator[tuple]:
        """``line_no`` and ``columns`` of what is new."""

    def holds(self) -> tuple:
        """What the run holds now."""
        return ()


def _later(line: int | None, value, before: tuple) -> tuple:
    """The line and value of a record that has a value and is behind the one known before, or that one."""
    there = line is not None and value is not None and value == value
    return (line, value) if there and (before[0] is None or line > before[0]) else before


def _greatest(one: int | None, two: int | None) -> int:
    return max(one or 0, two or 0)


class RunStates(Closing):
    columns = ("exit_code", "app_id", "updated_at", "last_line")
    held = ", exit_line long, exit_code int, app_line long, app_id string, updated_at long, last_line long"

    def begin(self, *own) -> None:
        exit_line, code, app_line, app, self.updated, self.last = own or (None,) * 6
        self.exit, self.app = (exit_line, code), (app_line, app)

    def take(self, line_no: int, exit_code: int | None, app_id: str | None, micros: int) -> None:
        self.exit, self.app = _later(line_no, exit_code, self.exit), _later(line_no, app_id, self.app)
        self.updated, self.last = _greatest(micros, self.updated), _greatest(line_no, self.last)

    def made(self) -> Iterator[tuple]:
        yield None, self.exit[1], self.app[1], self.updated, self.last

    def holds(self) -> tuple:
        return (*self.exit, *self.app, self.updated, self.last)


class StepMetrics(Closing):
    """Steps are held in chunks of neighbours, so a long run reads and writes those that a batch touches."""

    columns = ("step", *lf.METRIC_NAMES)
    held = ", steps boolean"

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        numbers = ", ".join(f"line_{name}: long, {name}: double" for name in lf.METRIC_NAMES)
        self.chunks = handle.getMapState("chunks", "chunk long", f"steps array<struct<step: long, {numbers}>>")

    def begin(self, *own) -> None:
        self.known = bool(own and own[0])
        self.fresh: dict[int, dict[int, list[tuple]]] = {}
        self.touched: set[int] = set()

    def take(self, line_no: int, exit_code: int | None, step: int | None, *values: float | None) -> None:
        if step is None:
            return
        place = step // STEPS
        chunk = self.fresh.get(place)
        if chunk is None:
            found = self.chunks.getValue((place,)) if self.known else None
            chunk = self.fresh[place] = {row[0]: list(zip(row[1::2], row[2::2], strict=True)) for row in (found[0] if found else ())}
        self.touched.add(step)
        pairs = chunk.setdefault(step, [(None, None)] * len(values))
        for k, value in enumerate(values):
            pairs[k] = _later(line_no, value, pairs[k])

    def made(self) -> Iterator[tuple]:
        for place, chunk in self.fresh.items():
            self.chunks.updateValue((place,), ([(step, *(x for pair in pairs for x in pair)) for step, pairs in chunk.items()],))
            for step in self.touched.intersection(chunk):
                yield None, step, *[value for _, value in chunk[step]]

    def holds(self) -> tuple:
        return (self.known or bool(self.fresh),)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.chunks.clear()
        return super().handleExpiredTimer(key, timerValues, expiredTimerInfo)


class Tails(Closing):
    columns = ("line",)
    held = ", lines array<struct<line_no: long, line: string>>"

    def __init__(self, idle_ms: int, keep: int) -> None:
        super().__init__(idle_ms)
        self.keep = keep

    def begin(self, *own) -> None:
        self.kept = [tuple(row) for row in own[0]] if own else []
        # The newest records of the batch; of equal line numbers the first ones.
        self.heap: list[tuple] = []
        self.count = 0

    def take(self, line_no: int, exit_code: int | None, line: str | None) -> None:
        self.count += 1
        if line_no is None:
            return
        push = heapq.heappush if len(self.heap) < self.keep else heapq.heappushpop
        push(self.heap, (line_no, -self.count, line))

    def made(self) -> Iterator[tuple]:
        fresh = {line_no: line for line_no, _, line in sorted(self.heap, reverse=True)}
        self.kept = sorted((dict(self.kept) | fresh).items())[-self.keep :]
        yield from self.kept

    def holds(self) -> tuple:
        return (self.kept,)


_LATE = "run_id string, late boolean, line_no long"


def _written(made: DataFrame, out: str, late: str, checkpoint: str, keys: list[str], shown: Callable[[DataFrame], DataFrame], fold_every: int) -> StreamingQuery:
    """Both sides of a stream: versions of what is new, and late records, one folder per batch each. The batch is worked out once."""
    keep, put_by = versions.sink(out, checkpoint, keys, fold_every=fold_every), versions.sink(late, checkpoint, ["run_id", "line_no"], fold_every=fold_every)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        keep(shown(batch.where("not late")), batch_id)
        put_by(batch.where("late").select("run_id", "line_no"), batch_id)
        batch.unpersist()

    return made.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_state(lines: DataFrame, out: str, late: str, checkpoint: str, delay: str = DELAY, idle_ms: int = IDLE_MS, fold_every: int = 16) -> StreamingQuery:
    """State and app id per run from ``run_id, line_no, ts, line, exit_code``, as versions under ``out`` by ``run_id``."""
    named = lines.withColumns({"app_id": lf.app_id_of(F.col("line")), "exit_code": F.col("exit_code").cast("int"), "micros": F.unix_micros(F.col("ts").cast("timestamp"))})
    made = _by_run(named, delay, RunStates(idle_ms), f"{_LATE}, exit_code int, app_id string, updated_at long, last_line long", "line_no", "exit_code", "app_id", "micros")
    status = F.when(F.col("exit_code").isNull(), "running").when(F.col("exit_code") == 0, "completed").otherwise("failed")
    shown = lambda b: b.select("run_id", status.alias("status"), "app_id", F.timestamp_micros("updated_at").alias("updated_at"), "last_line")
    return _written(made, out, late, checkpoint, ["run_id"], shown, fold_every)


def step_metrics(lines: DataFrame, out: str, late: str, checkpoint: str, delay: str = DELAY, idle_ms: int = IDLE_MS, fold_every: int = 16) -> StreamingQuery:
    """Metrics per run and step, as versions under ``out``. Lines without a step reach the state only where they end a run."""
    step = lf.step_of(F.col("line"))
    parsed = lines.withColumn("step", F.when(F.col("line").contains(lf.STEP_WORD), step)).where("step is not null or exit_code is not null")
    valued = parsed.withColumns({name: F.when(F.col("step").isNotNull(), lf.metric_of(F.col("line"), name)) for name in lf.METRIC_NAMES})
    schema = f"{_LATE}, step long, " + ", ".join(f"{name} double" for name in lf.METRIC_NAMES)
    made = _by_run(valued, delay, StepMetrics(idle_ms), schema, "line_no", "exit_code", "step", *lf.METRIC_NAMES)
    return _written(made, out, late, checkpoint, ["run_id", "step"], lambda b: b.select("run_id", "step", *lf.METRIC_NAMES), fold_every)


def log_tail(lines: DataFrame, out: str, late: str, checkpoint: str, keep: int = log_ops.KEPT_LINES, delay: str = DELAY, idle_ms: int = IDLE_MS, fold_every: int = 16) -> StreamingQuery:
    """The newest ``keep`` lines of each run in its state; each version of a run is its whole tail, so reading folds no history."""
    made = _by_run(lines, delay, Tails(idle_ms, keep), f"{_LATE}, line string", "line_no", "exit_code", "line")
    return _written(made, out, late, checkpoint, ["run_id"], lambda b: b.select("run_id", "line_no", "line"), fold_every)
