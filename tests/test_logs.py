"""Run-log status and metrics on small logs, and reading log files in pieces."""

from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from gradeflow.functions import logs as lf
from gradeflow.operators import logs as ops
from gradeflow.operators.registry import run_summary
from gradeflow.sources.logs import read_log_lines

STEP = 7
NOISE = ("worker 3 is ready", "shards read: 12 of 40", "eta 00:10")
FAILURES = ("ValueError: bad shape", "CUDA error: illegal address", "Traceback (most recent call last):")
FRESH = (f"step:{STEP} - lr:0.1", f"wrote global_step_{STEP} to disk", f'{{"global_step": {STEP}}}')
RESUMED = (f"Resuming from /w/global_step_{STEP}", f"Setting global step to {STEP}, was global_step_{STEP}")
PROGRESS = ("actor/pg_loss=0.5", "Saving checkpoint (async)")


def made_logs():
    """Logs by what they hold, each kind of line in one of its spellings, with the status that the rules give."""
    flags = itertools.product((None, "before", "after"), (False, True), (False, True), (False, True), (0, STEP))
    for k, (failed, fresh, resumed, progress, wanted) in enumerate(flags):
        pick = lambda texts, k=k: texts[k % len(texts)]
        lines = [pick(NOISE), *[pick(FAILURES)] * (failed == "before"), *[pick(RESUMED)] * resumed, *[pick(PROGRESS)] * progress]
        lines += [*[f"  {pick(FRESH)} "] * fresh, *[pick(FAILURES)] * (failed == "after"), pick(NOISE)]
        reached = fresh and wanted > 0
        if failed:
            status = "completed-with-warning" if reached and failed == "before" else "failed"
        else:
            status = "completed" if reached else "progress-evidence-seen" if progress else "incomplete"
        evidence = (pick(FAILURES) if failed else None, pick(FRESH) if reached else None, pick(PROGRESS) if progress and not reached else None)
        yield f"log-{k}", wanted, lines, (status, len(lines), *evidence)


def log(spark, lines, run="r"):
    return spark.createDataFrame([(run, i, line) for i, line in enumerate(lines)], "run_id string, line_no bigint, line string")


@pytest.mark.parametrize("wanted", [0, STEP])
def test_status_of_every_kind_of_log(spark, wanted):
    own = [(name, lines, expected) for name, asked, lines, expected in made_logs() if asked == wanted]
    rows = spark.createDataFrame([(name, i, line) for name, lines, _ in own for i, line in enumerate(lines)], "run_id string, line_no bigint, line string")
    made = {r["run_id"]: (r["status"], r["lines"], r["failure_line"], r["step_evidence"], r["progress_evidence"]) for r in ops.run_status(rows, expect_steps=wanted).collect()}
    assert made == {name: expected for name, _, expected in own}


def test_exact_step_and_configured_steps(spark):
    lines = log(spark, ["Total training steps: 4", "global_step_10", "Total training steps: 5 Total training steps:\t6"])
    assert ops.run_status(lines, 1).first()["status"] == "completed"
    row = ops.run_status(lines, 1, exact_step=True).first()
    assert (row["status"], row["configured_steps"]) == ("incomplete", 6)


METRIC_LINE = "step:1 - distillation/loss:0.114 - critic/rewards/mean:0.78 - teacher_kl:0.081 - training/global_step:1"


def metrics(spark, lines, **options):
    return [tuple(r) for r in ops.step_metrics(log(spark, lines), **options).orderBy("step").collect()]


def test_metrics_of_one_line(spark):
    assert metrics(spark, [METRIC_LINE]) == [("r", 1, 0.114, 0.78, 0.081)]


def test_the_last_value_of_each_metric_wins(spark):
    lines = ["step=2 reward: 0.5", "noise", "global_step: 2 kl=0.25", "step:2 reward: -0.75", "step 9", "timestep: 4"]
    assert metrics(spark, lines) == [("r", 2, None, -0.75, 0.25), ("r", 4, None, None, None)]


def test_numbers_the_plain_pattern_cuts_short(spark):
    lines = ["step:1 distillation/loss:1e-05 reward:nan kl:-inf"]
    assert metrics(spark, lines) == [("r", 1, 1.0, None, None)]
    wide = metrics(spark, lines, wide_numbers=True)[0]
    assert wide[2] == 1e-05 and wide[3] != wide[3] and wide[4] == float("-inf")


def test_summary_reads_the_last_step_even_where_it_is_incomplete(spark):
    made = ops.step_metrics(log(spark, [METRIC_LINE, "step:2 distillation/loss:0.5"]))
    row = run_summary(made).first()
    assert (row["last_loss"], row["last_reward"], row["min_loss"], row["max_loss"]) == (0.5, None, 0.114, 0.5)
    assert row["reward_change"] == pytest.approx(-0.78)


def test_app_id_and_tail(spark):
    lines = ["app ap-Ab1 up", "wrap-x", "see ap-Zz9.", "ap-", *[f"n{i}" for i in range(1200)]]
    assert ops.app_ids(log(spark, lines)).first()["app_id"] == "ap-Zz9"
    assert [r["line"] for r in ops.tail(log(spark, lines), 8).orderBy("line_no").collect()] == lines[-8:]
    assert ops.tail(log(spark, lines)).count() == 1000


def test_a_log_read_in_many_splits_keeps_its_order(spark, tmp_path):
    wanted = [f"line {i} " + "x" * (i % 50) for i in range(4000)]
    (tmp_path / "long.log").write_text("\n".join(wanted))
    (tmp_path / "odd.v2.log").write_bytes(b"one\r\ntwo\rthree\x0bfour\xe2\x80\xa8five \xff\nlast\n")
    for name in ("a", "b"):
        (tmp_path / "deep" / name).mkdir(parents=True)
        (tmp_path / "deep" / name / "run.log").write_text(f"from {name}\n")
    same = read_log_lines(spark, f"{tmp_path}/deep/*")
    assert sorted((r["run_id"].rsplit("/", 2)[-2:], r["line"]) for r in same.collect()) == [
        (["a", "run"], "from a"), (["b", "run"], "from b")
    ]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        lines = read_log_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 4
        rows = lines.orderBy("run_id", "line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["line"] for r in rows if r["run_id"] == "long"] == wanted
    assert [r["line_no"] for r in rows if r["run_id"] == "long"] == list(range(4000))
    odd = [r["line"] for r in rows if r["run_id"] == "odd.v2"]
    assert odd == ["one", "two", "three", "four", "five \ufffd", "last"]


def test_every_step_name_holds_the_searched_word():
    assert all(lf.STEP_WORD in name for name in lf.STEP_NAMES.split("|"))


def test_lines_without_a_step_are_skipped(spark):
    assert ops.step_metrics(log(spark, ["reward: 1", "steps", "step:"])).count() == 0
    assert ops.app_ids(log(spark, ["nothing", "ap-"])).select(F.count("*")).first()[0] == 0


def test_secrets_are_masked_and_counted(spark):
    lines = ["a Bearer abcdefgh1 b", "k=sk-abcdefghijkl end", "u?x=1&sig=Zz%2F&y=2", "PASSWORD: p1, secret=s2", "bearer abc", "", None]
    rows = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "i int, line string")
    got = [tuple(r["r"]) for r in rows.select(lf.redact(F.col("line")).alias("r"), "i").orderBy("i").collect()]
    assert got == [
        ("a Bearer [redacted] b", 1, 0, 0, 0), ("k=[redacted] end", 0, 1, 0, 0), ("u?x=1&sig=[redacted]&y=2", 0, 0, 1, 0),
        ("PASSWORD: [redacted], secret=[redacted]", 0, 0, 0, 2), ("bearer abc", 0, 0, 0, 0), ("", 0, 0, 0, 0), (None,) * 5,
    ]


def test_failure_kinds(spark):
    lines = ["CUDA out of memory", "NCCL timeout", "Timed out", "RuntimeError: x", "fine", "", None]
    rows = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "i int, line string")
    got = [r["k"] for r in rows.select("i", lf.failure_kind(F.col("line")).alias("k")).orderBy("i").collect()]
    assert got == ["memory", "device", "time", "other", None, None, None]
