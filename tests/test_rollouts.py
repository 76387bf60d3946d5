"""Response groups against values worked out by hand: lone rows, nulls, ties, empty tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gradeflow.operators import rollouts


@pytest.fixture(scope="module")
def rows(spark):
    made = [(1, "a", 1.0), (2, "a", 3.0), (3, "a", None), (4, "b", 5.0), (5, None, 2.0), (6, None, 2.0)]
    return spark.createDataFrame(made, "id int, g string, reward double")


def test_advantages(rows):
    got = {r["id"]: (r["grpo"], r["centred"], r["leave_one_out"]) for r in rollouts.group_advantages(rows, "g").collect()}
    assert got[1] == (pytest.approx(-1 / (2**0.5 + 1e-6)), -1.0, -2.0)
    assert got[2] == (pytest.approx(1 / (2**0.5 + 1e-6)), 1.0, 2.0)
    assert got[3] == (None, None, None) and got[4] == (5.0, 5.0, 5.0)
    assert got[5] == got[6] == (0.0, 0.0, 0.0)


def test_groups_without_spread_go(rows):
    assert {r["id"] for r in rollouts.with_spread(rows, "g").collect()} == {1, 2, 3}
    assert rollouts.with_spread(rows.where("false"), "g").count() == 0


def test_pass_at_k(rows):
    got = {r["g"]: tuple(r)[1:] for r in rollouts.pass_at_k(rows, "g", F.col("reward") >= 3, 2).collect()}
    assert got["a"] == (3, 1, pytest.approx(2 / 3)) and got["b"] == (1, 1, None) and got[None] == (2, 0, 0.0)


def test_figures(spark):
    made = spark.createDataFrame([("x", 0.0, "ab"), ("x", 1.0, "abcd"), ("x", None, None), ("y", 0.5, "")], "by string, score double, text string")
    valid, length = F.length("text") > 2, F.length("text")
    got = {r["by"]: tuple(r)[1:] for r in rollouts.evaluation_figures(made, "by", F.col("score"), valid, length).collect()}
    assert got["x"][:5] == (3, 0.5, pytest.approx(0.5**0.5), pytest.approx(2 / 3), 3.0)
    assert got["y"] == (1, 0.5, None, 1.0, 0.0, 0.0, 0.0)


def test_tokens(spark):
    pairs = [([(-1.0, -2.0), (-30.0, -1.0)],), ([],), (None,)]
    made = spark.createDataFrame(pairs, "tokens array<struct<student_logprob:double,teacher_logprob:double>>")
    got = made.select(
        rollouts.mean_divergence(F.col("tokens")), rollouts.clip_fraction(F.col("tokens"), "student_logprob", "teacher_logprob")
    ).collect()
    assert [tuple(r) for r in got] == [(-4.0, 1.0), (None, None), (None, None)]
