from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gradeflow.operators import ingest, registry, traces
from gradeflow.sources.logs import LINE_RECORD, stream_log_lines
from gradeflow.sources.runs import stream_payloads
from gradeflow.streaming import runs as live


def config(spark, **changes):
    base = {"algorithm": "sdpo", "model": "Qwen/Qwen3.5-0.8B", "dataset": "traces", "steps": 4, "train_rows": 64, "val_rows": 16}
    row = {**base, **changes}
    kinds = "algorithm string, model string, dataset string, steps int, train_rows int, val_rows int"
    return spark.createDataFrame([tuple(row.values())], kinds)


@pytest.mark.parametrize("changes, broken", [
    ({}, []),
    ({"model": None}, ["model and dataset"]),
    ({"model": " "}, ["model and dataset"]),
    ({"dataset": ""}, ["model and dataset"]),
    ({"model": "acme/x"}, ["model catalogue"]),
    ({"algorithm": "ppo", "steps": 0}, ["algorithm", "steps"]),
    ({"steps": 101, "train_rows": 2049, "val_rows": 513}, ["steps", "train_rows", "val_rows"]),
    ({"algorithm": None, "steps": None, "train_rows": None, "val_rows": None}, []),
])
def test_config_rules(spark, changes, broken):
    filled = registry.with_defaults(config(spark, **changes))
    assert registry.violations(filled).first()["violations"] == broken
    catalogue = registry.lookup_catalogue(spark)
    assert registry.violations(filled, catalogue).first()["violations"] == broken


def test_config_defaults(spark):
    row = registry.with_defaults(config(spark, steps=None, train_rows=None)).first()
    assert (row["steps"], row["train_rows"], row["topology"], row["smoke_gpu"]) == (10, 64, "single-gpu", False)
    assert row["teacher_model"] == row["model"] and row["hint_placement"] == "before-mistake"


def test_newest_keeps_fields_a_change_leaves_out(spark):
    changes = spark.createDataFrame(
        [("r", 1, "draft", "n"), ("r", 2, "queued", None), ("s", 5, None, "m")], "id string, seq int, status string, name string"
    )
    got = {r["id"]: (r["seq"], r["status"], r["name"]) for r in registry.newest(changes, "id", "seq", ["status", "name"]).collect()}
    assert got == {"r": (2, "queued", "n"), "s": (5, None, "m")}
    assert registry.run_lookup(changes, "s").count() == 1
    listed = registry.run_list(changes.withColumn("created_at", F.col("seq"))).collect()
    assert [r["id"] for r in listed] == ["s", "r", "r"]


PAYLOADS = [
    (1, '{"metrics": [{"step": 1, "reward": 0.5}], "logs": ["a"], "status": "running"}', None),
    (2, '{"logs": []}', None),
    (3, '{"metrics": {"step": 1}}', "metrics, traces, and logs must be arrays"),
    (4, '{"logs": "[1]"}', "metrics, traces, and logs must be arrays"),
    (5, '{"traces": null}', "metrics, traces, and logs must be arrays"),
    (6, "[]", "JSON body must be an object"),
    (7, "{", "JSON body must be an object"),
    (8, None, "JSON body must be an object"),
    (9, "{}", None),
]


def test_ingest_replaces_only_what_it_carries(spark):
    rows = spark.createDataFrame([("r", seq, body) for seq, body, _ in PAYLOADS], "run_id string, seq int, payload string")
    parsed = ingest.parse_payloads(rows)
    assert {r["seq"]: r["error"] for r in parsed.collect()} == {seq: error for seq, _, error in PAYLOADS}
    now = ingest.typed(ingest.current(ingest.accepted(parsed))).first()
    assert (now["seq"], now["status"], now["logs"], now["metrics"][0]["reward"], now["traces"]) == (9, "running", [], 0.5, None)


def test_ingest_keeps_what_it_does_not_know_and_sets_aside_what_does_not_fit(spark):
    first = '{"metrics": [{"step": 1}], "logs": ["a", 2, {"q": [1]}]}'
    second = '{"metrics": [1, {"step": "x"}, {"step": null, "reward": "0.5", "entropy": 2}], "traces": [[], {"id": "t", "k": 1}]}'
    rows = spark.createDataFrame([("r", 1, first), ("r", 2, second)], "run_id string, seq int, payload string")
    now = ingest.current(ingest.accepted(ingest.parse_payloads(rows)))
    shown = ingest.typed(now).select(
        "logs", F.to_json("metrics.whole").alias("metrics"), F.col("metrics.reward").alias("rewards"), F.to_json("traces.whole").alias("traces")
    ).first()
    assert tuple(shown) == (["a", "2", '{"q":[1]}'], '[{"entropy":2,"reward":"0.5","step":null}]', [0.5], '[{"id":"t","k":1}]')
    left = {tuple(r) for r in ingest.misfits(now, "run_id").collect()}
    assert left == {("r", "metrics", "1"), ("r", "metrics", '{"step":"x"}'), ("r", "traces", "[]")}


def test_transitions(spark):
    steps = ["draft", "queued", "running", "failed", "queued", "completed"]
    rows = spark.createDataFrame([("r", i, s) for i, s in enumerate(steps)], "id string, seq int, status string")
    for width in (1, 2, 100):
        got = registry.transitions(rows, "id", ["seq"], "status", F.floor(F.col("seq") / width)).orderBy("seq").collect()
        assert [r["allowed"] for r in got] == [True, True, True, True, True, False]
        assert [r["previous_status"] for r in got] == [None, *steps[:-1]]
    assert rows.where(registry.launchable(F.col("status"))).count() == 2


def test_tokens_and_teacher_prompt(spark):
    made = spark.createDataFrame([("t", "p", "h", [0.24, -0.31, 0.25], ["a", "b", "c"])],
                                 "id string, prompt string, hint string, d array<double>, w array<string>")
    full = traces.with_teacher_prompt(traces.with_tokens(made, "d", "w"))
    row = full.first()
    assert row["judge_selected"] == 2 and row["teacher_prompt"] == "p\n\nPrivileged feedback: h"
    tokens = traces.token_table(full, "id").orderBy("position").collect()
    assert [(t["text"], t["student_logprob"], t["teacher_logprob"], t["selected"]) for t in tokens] == [
        ("a", -1.46, -1.22, False), ("b", -2.01, -2.32, True), ("c", -1.45, -1.2, True)
    ]




def lines_at(spark, path, rows):
    spark.createDataFrame([(r, n, None, line + " \t", code) for r, n, line, code in rows], LINE_RECORD).coalesce(1).write.mode("append").json(path)


def test_stream_state_grows_with_new_files_and_a_rerun_adds_nothing(spark, tmp_path):
    source, out, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    lines_at(spark, source, [("r", 0, "submitted ap-A1", None), ("s", 0, "hi", None)])

    def run():
        live.run_state(stream_log_lines(spark, source), out, state).awaitTermination()
        newest = live.read_newest(spark, out, ["run_id"]).collect()
        return {r["run_id"]: (r["status"], r["app_id"]) for r in newest}

    assert run() == {"r": ("running", "ap-A1"), "s": ("running", None)}
    versions = spark.read.parquet(out).count()
    assert run() == {"r": ("running", "ap-A1"), "s": ("running", None)}
    assert spark.read.parquet(out).count() == versions
    lines_at(spark, source, [("r", 1, "again ap-B2", None), ("r", 2, "", 0), ("s", 3, "", 7)])
    assert run() == {"r": ("completed", "ap-B2"), "s": ("failed", None)}


def test_streamed_tail_over_several_batches(spark, tmp_path):
    source, out, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    for batch in range(3):
        lines_at(spark, source, [("r", batch * 10 + i, f"l{batch}{i}", None) for i in range(10)])
        live.log_tail(stream_log_lines(spark, source), out, state, keep=4).awaitTermination()
    kept = live.read_tail(spark, out, keep=4).orderBy("line_no").collect()
    assert [(r["line_no"], r["line"]) for r in kept] == [(20 + i, f"l2{i}") for i in range(6, 10)]


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    write = live.write_version(str(tmp_path))
    rows = spark.createDataFrame([("r", "draft")], "run_id string, status string")
    write(rows, 0)
    write(rows, 0)
    write(rows.withColumn("status", F.lit("queued")), 1)
    assert spark.read.parquet(str(tmp_path)).count() == 2
    assert live.read_newest(spark, str(tmp_path), ["run_id"]).first()["status"] == "queued"


def test_streamed_ingest_quarantines_what_it_refuses(spark, tmp_path):
    source, out, refused, state = (str(tmp_path / name) for name in ("in", "out", "refused", "state"))
    rows = [("r", seq, body) for seq, body, _ in PAYLOADS]
    spark.createDataFrame(rows, "run_id string, seq bigint, payload string").write.json(source)
    live.ingest_payloads(stream_payloads(spark, source), out, refused, state).awaitTermination()
    assert {r["seq"]: r["error"] for r in spark.read.parquet(refused).collect()} == {s: e for s, _, e in PAYLOADS if e}
    assert ingest.current(spark.read.parquet(out)).first()["logs"] == []


def test_a_stream_on_an_interval_goes_on_until_stopped(spark, tmp_path):
    source, out, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    lines_at(spark, source, [("r", 0, "step:1 reward:0.5", None)])
    query = live.step_metrics(stream_log_lines(spark, source), out, state, every="1 second")
    try:
        query.processAllAvailable()
        lines_at(spark, source, [("r", 1, "step:1 reward:0.75", None)])
        query.processAllAvailable()
        assert query.isActive
    finally:
        query.stop()
    assert [r["reward"] for r in live.read_newest(spark, out, ["run_id", "step"]).collect()] == [0.75]


def test_drafts_and_launches(spark):
    at = F.lit("2024-01-02 03:04:05").cast("timestamp")
    configs = config(spark, model=" Qwen/Qwen3.5-4B ").unionByName(config(spark, steps=0)).withColumn("key", F.lit("k"))
    made = registry.draft_runs(configs, "key", at)
    row = made.first()
    assert made.count() == 1 and row["name"] == "sdpo_traces" and row["status"] == "draft"
    assert row["config"]["model"] == row["config"]["teacher_model"] == "Qwen/Qwen3.5-4B"
    states = spark.createDataFrame([("a", "draft"), ("b", "running"), ("c", "failed")], "id string, status string")
    asked = registry.launch(states.withColumn("updated_at", at - F.expr("interval 1 day")), at).collect()
    assert {r["id"]: (r["status"], r["error"]) for r in asked} == {
        "a": ("queued", None), "b": ("running", "cannot launch a running run"), "c": ("queued", None)
    }


def test_a_null_field_breaks_its_rule(spark):
    kinds = "algorithm string, model string, dataset string, steps int, train_rows int, val_rows int"
    bad = spark.createDataFrame([(None, None, None, None, None, None)], kinds)
    assert set(registry.violations(bad).first()["violations"]) >= {"algorithm", "model and dataset", "steps", "train_rows", "val_rows"}
