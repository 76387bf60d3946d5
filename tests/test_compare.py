"""Costs, running sums, comparison, clips, feedback, hints, listings and cleared fields on small frames."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gradeflow.functions import conversation as conv
from gradeflow.operators import comparison, costs, registry, rollouts, routing, rubric
from gradeflow.operators.conversations import with_hints
from gradeflow.operators.ordering import with_running
from gradeflow.sources import tasks

START = datetime(2024, 3, 1)


def hour(n: float) -> datetime:
    return START + timedelta(hours=n)


def test_runs_are_priced_in_pieces(spark):
    rates = spark.createDataFrame([("p", hour(10), 100), ("p", hour(20), 300), ("q", hour(0), 7), ("p", None, 9)], "profile string, valid_from timestamp, rate long")
    spans = [
        ("before", "p", 1, hour(2), hour(5)), ("over", "p", 2, hour(8), hour(22)), ("long", "q", 1, hour(1), hour(101)), ("within", "p", 1, hour(12), hour(12.5)),
        ("back", "p", 1, hour(12), hour(11)), ("open", "p", 1, hour(12), None), ("other", "r", 1, hour(0), hour(1)),
    ]
    made = costs.priced(spark.createDataFrame(spans, "run_id string, profile string, units long, started timestamp, ended timestamp"), rates)
    assert {r["run_id"]: (r["hours"], r["cost"], r["unpriced_hours"]) for r in made.collect()} == {
        "before": (3, 0, 3), "over": (14, 2 * (10 * 100 + 2 * 300), 2), "long": (100, 700, 0), "within": (0.5, 50, 0), "back": (0, 0, 0), "open": (0, 0, 0), "other": (1, 0, 1)
    }


def test_running_sums_and_first_breach_of_a_hot_account(spark):
    pick = random.Random(4)
    rows = [("hot" if k % 3 else f"a{k % 5}", START + timedelta(minutes=pick.randrange(400)), k, pick.randrange(9)) for k in range(3000)]
    table = spark.createDataFrame(rows, "account string, at timestamp, run_id long, cost long").repartition(7)
    expected, first, budget = {}, {}, 500
    for account in {r[0] for r in rows}:
        spent = 0
        for _, at, key, cost in sorted(r for r in rows if r[0] == account):
            spent += cost
            expected[key] = spent
            if spent > budget:
                first.setdefault(account, (key, spent))
    running = with_running(table, ["at", "run_id"], ["account"], {"spent": "cost"})
    assert {r["run_id"]: r["spent"] for r in running.collect()} == expected
    budgets = spark.createDataFrame([("hot", budget), ("a0", budget), ("a3", 10**6), ("none", 0)], "account string, budget long")
    found = {r["account"]: (r["run_id"], r["spent"]) for r in costs.first_breaches(table, budgets).collect()}
    assert found == {a: first[a] for a in ("hot", "a0") if a in first}


def test_a_checkpoint_is_compared_with_its_base(spark):
    pick = random.Random(1)
    rows = [(k, suite, pick.random(), gain) for suite, gain in (("up", 0.3), ("down", -0.3), ("same", 0.0)) for k in range(suite.__len__() * 1000, suite.__len__() * 1000 + 400)]
    rows = [(1000 * n + k, suite, base, base + gain + pick.uniform(-0.5, 0.5)) for n, (k, suite, base, gain) in enumerate(rows)]
    base = spark.createDataFrame([(k, s, b) for k, s, b, _ in rows] + [(-1, "up", 0.5), (-2, "lone", 0.5)], "id long, suite string, score double")
    other = spark.createDataFrame([(k, o) for k, _, _, o in rows] + [(-2, 0.75), (-3, 1.0)], "id long, score double")
    made = {r["suite"]: r.asDict() for r in comparison.compared(base, other, "id", "suite", "score").collect()}
    again = {r["suite"]: r.asDict() for r in comparison.compared(base.repartition(5), other, "id", "suite", "score").collect()}
    assert {s: r["gate"] for s, r in made.items()} == {"up": "promote", "down": "reject", "same": "hold", "lone": "hold"}
    assert made["up"]["items"] == 400 and made["lone"]["items"] == 1 and made["lone"]["low"] is None
    for suite, row in made.items():
        assert row["boot_low"] == pytest.approx(again[suite]["boot_low"]) and row["boot_high"] == pytest.approx(again[suite]["boot_high"])
        assert row["boot_low"] <= row["gain"] <= row["boot_high"]
    width = lambda r, a, b: r[b] - r[a]
    assert width(made["up"], "boot_low", "boot_high") == pytest.approx(width(made["up"], "low", "high"), rel=0.3)


def test_poisson_weights_have_mean_and_variance_one(spark):
    weights = spark.range(20_000).select(comparison.poisson_weight(F.col("id"), F.lit(3), "s").alias("w"))
    mean, variance = weights.agg(F.avg("w"), F.var_samp("w")).first()
    assert abs(mean - 1) < 0.03 and abs(variance - 1) < 0.06


def test_advantages_are_clipped_at_the_running_mean(spark):
    rows = [("r", 1, 2.0), ("r", 1, -4.0), ("r", 2, 30.0), ("r", 3, None), ("r", 3, -100.0), ("s", 5, None)]
    made = rollouts.clipped_advantages(spark.createDataFrame(rows, "run string, step int, adv double"), "run", "step", "adv", 1.5)
    assert sorted((r["run"], r["step"], r["adv"] or 0, r["limit"], r["clipped"]) for r in made.collect()) == [
        ("r", 1, -4.0, 4.5, -4.0), ("r", 1, 2.0, 4.5, 2.0), ("r", 2, 30.0, 18.0, 18.0), ("r", 3, -100.0, 51.0, -51.0), ("r", 3, 0, 51.0, None), ("s", 5, 0, None, None)
    ]


def test_what_passed_teaches_what_failed(spark):
    rows = [(1, "p", "good", 5, True), (2, "p", "also good", 5, True), (3, "p", "bad", 1, False), (4, "q", "bad", 0, False), (5, None, "fine", 2, True), (6, None, "bad", 1, None)]
    made = rollouts.implicit_feedback(spark.createDataFrame(rows, "id long, prompt string, text string, reward int, ok boolean"), ["prompt"], "id", "text", "reward", F.col("ok"))
    assert {r["id"]: r["feedback"] for r in made.collect()} == {3: "good", 4: None, 6: "fine"}


TURNS = [("user", "q"), ("assistant", "ok"), ("assistant", "wrong one"), ("user", "again"), ("assistant", "wrong two")]


@pytest.mark.parametrize(("placement", "at", "role"), [("before-mistake", 2, "user"), ("after-trace", 5, "user"), ("system", 0, "system")])
def test_hints_in_arrays_and_in_tall_tables(spark, placement, at, role):
    wrong = lambda role, text: (role == "assistant") & text.startswith("wrong")
    tall = [("c", k + 3, *t) for k, t in enumerate(TURNS)] + [("right", k, *t) for k, t in enumerate(TURNS[:2])] + [("quiet", 0, "user", "q")]
    turns = spark.createDataFrame(tall, "conv_id string, turn int, role string, text string")
    hints = spark.createDataFrame([("c", "mind"), ("right", "mind"), ("quiet", None), ("gone", "mind")], "conv_id string, hint string")
    found = with_hints(turns, hints, placement, wrong(F.col("role"), F.col("text"))).orderBy("conv_id", "turn").collect()
    expected = [*TURNS[:at], (role, "mind"), *TURNS[at:]]
    assert [(r["role"], r["text"]) for r in found if r["conv_id"] == "c"] == expected
    assert [r["turn"] for r in found if r["conv_id"] == "c"] == list(range(3, 9))
    assert len([r for r in found if r["conv_id"] == "right"]) == (2 if placement == "before-mistake" else 3)
    assert len([r for r in found if r["conv_id"] == "quiet"]) == 1
    arrays = spark.createDataFrame([(TURNS, "mind"), (TURNS, None), ([], "mind")], "turns array<struct<role string, text string>>, hint string")
    mistake = conv.first_turn(F.col("turns"), lambda t: wrong(t["role"], t["text"]))
    made = [[tuple(t) for t in r["t"]] for r in arrays.select(conv.with_hint(F.col("turns"), F.col("hint"), placement, mistake).alias("t")).collect()]
    assert made[0] == expected and made[1] == TURNS and made[2] == ([] if placement == "before-mistake" else [(role, "mind")])
    with pytest.raises(ValueError, match="placement"):
        conv.with_hint(F.col("turns"), F.col("hint"), "anywhere", mistake)


def test_a_listing_counts_folders_once(spark, tmp_path):
    for name in ("a/one/documents/x.txt", "a/one/documents/deep/y.txt", "a/one/documents/deep/z/w.bin", "a/one/task.json", "b/documents/v", "b/other/documents.txt"):
        (tmp_path / "tasks" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tasks" / name).write_text("t")
    made = rubric.entry_counts(tasks.list_documents(spark, str(tmp_path))).collect()
    assert {r["task_id"]: (r["documents_read"], r["total_vdr_files"]) for r in made} == {"a/one": (5, 5), "b": (1, 1)}


def test_a_cleared_field_stays_null_until_it_is_set(spark):
    rows = [("k", 1, "x", "n", None), ("k", 2, None, None, None), ("k", 3, None, None, ["a"]), ("j", 1, "x", None, None), ("j", 2, None, "m", ["a"]), ("j", 3, "y", None, None)]
    made = registry.newest(spark.createDataFrame(rows, "key string, seq int, a string, b string, cleared array<string>"), "key", "seq", ["a", "b"], F.col("cleared"))
    assert {r["key"]: (r["seq"], r["a"], r["b"]) for r in made.collect()} == {"k": (3, None, "n"), "j": (3, "y", "m")}


def test_prompts_are_cut_by_tokens_and_teachers_are_picked_by_name(spark):
    message = "array<struct<role string, content string>>"
    rows = [(1, [("user", "one two"), ("user", None)]), (2, [("user", "a b c\n d")]), (3, None), (4, [])]
    prompts = spark.createDataFrame(rows, f"id int, prompt {message}")
    assert sorted(r["id"] for r in routing.without_overlong(prompts, "prompt", 3).collect()) == [1, 3, 4]
    with pytest.raises(Exception, match="unknown length"):
        routing.without_overlong(prompts, "prompt", 3, lambda p: F.when(F.size(p) > 1, F.size(p))).count()
    teachers = spark.createDataFrame([("s", "t2"), ("s", "t1"), (None, "t0")], "data_source string, teacher string")
    made = routing.routed(spark.createDataFrame([(1, "s"), (2, "u"), (3, None)], "id int, data_source string"), teachers)
    assert {r["id"]: r["teacher"] for r in made.collect()} == {1: "t1", 2: None, 3: None}


def test_deviation_of_large_rewards_cancels_nothing(spark):
    scored = spark.createDataFrame([("g", 1e9 + k, k) for k in range(5)] + [("one", 3.0, 2)], "by string, reward double, n int")
    made = {r["by"]: r for r in rollouts.evaluation_figures(scored, "by", F.col("reward"), F.col("n") > 0, F.col("n")).collect()}
    assert made["g"]["std_reward"] == pytest.approx(2.5**0.5) and made["one"]["std_reward"] is None and made["g"]["invalid_rate"] == 0.2
