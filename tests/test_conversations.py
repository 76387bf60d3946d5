from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from gradeflow.functions.conversation import exported_conversation_fields
from gradeflow.operators import records
from gradeflow.operators.conversations import conversation_fields, turn_arrays

EXPORTS = [
    ([], ("", "", "")),
    ("plain", ("plain", "plain", "")),
    ("[1, 2]", ("[1, 2]", "[1, 2]", "")),
    (None, ("", "", "")),
    (
        [{"from": "Human", "value": "q"}, {"from": "GPT", "value": "a1"}, {"role": "agent", "content": "a2"}],
        ("q", "a2", "human: q\ngpt: a1\nagent: a2"),
    ),
    ([{"from": "system", "value": "s"}, {"from": "tool", "value": "t"}], ("s", "", "system: s\ntool: t")),
    ([{"from": "user", "value": None, "content": "unused"}], ("", "", "user: ")),
    ([{"from": "", "speaker": "Bob", "message": "m"}, "bare"], ("m", "", "bob: m\nturn: bare")),
    ([{"speaker": "USER", "content": "c", "message": "m"}], ("c", "", "user: c")),
    ([{"from": "user", "value": 5}, {"role": "assistant", "message": "x\ny"}], ("5", "x\ny", "user: 5\nassistant: x\ny")),
]


def test_every_shape_of_exported_turn(spark):
    rows = [(i, json.dumps({"c": c})) for i, (c, _) in enumerate(EXPORTS)]
    parsed = spark.createDataFrame(rows, "i int, j string").select(
        "i", F.from_json("j", "c variant")["c"].alias("c")
    )
    got = parsed.select("i", exported_conversation_fields(F.col("c")).alias("f")).orderBy("i").collect()
    assert [tuple(r["f"]) for r in got] == [wanted for _, wanted in EXPORTS]


@pytest.fixture(scope="module")
def turns(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(25)]
    rows += [(2, 0, "system", "s"), (2, 1, None, "n"), (3, 0, "User", None), (3, 1, "agent", "done")]
    return spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")


def test_a_long_conversation_is_split_but_whole(turns):
    whole = {r["conv_id"]: r for r in conversation_fields(turns).collect()}
    parts = conversation_fields(turns, segment_turns=4).orderBy("conv_id", "segment").collect()
    assert len([p for p in parts if p["conv_id"] == 1]) == 7
    for key, row in whole.items():
        mine = [p for p in parts if p["conv_id"] == key]
        assert "\n".join(p["trajectory"] for p in mine) == row["trajectory"]
        assert {(p["prompt"], p["answer"]) for p in mine} == {(row["prompt"], row["answer"])}
    assert whole[2]["prompt"] == "s" and whole[2]["answer"] == "" and whole[3]["prompt"] == ""


def test_one_row_per_conversation_at_any_turn_number(spark):
    far = spark.createDataFrame([(1, 70_000, "user", "q"), (1, 140_000, "agent", "a"), (2, 5, "user", "x")], "conv_id int, turn int, role string, text string")
    got = {r["conv_id"]: tuple(r)[1:] for r in conversation_fields(far).collect()}
    assert got == {1: ("q", "a", "user: q\nagent: a"), 2: ("x", "", "user: x")}


def test_no_array_is_longer_than_a_segment(turns):
    sizes = turn_arrays(turns, segment_turns=4).select(F.size("turns").alias("n")).collect()
    assert max(r["n"] for r in sizes) == 4 and sum(r["n"] for r in sizes) == turns.count()


def flat(df):
    return df.select(F.col("prompt")[0]["content"].alias("content"), "extra_info.*").collect()


def test_feedback_and_attempt_order_of_precedence(spark):
    fields = spark.createDataFrame(
        [(0, "p", "a", "user: p", "column", ""), (1, "p", "a", "user: p", None, "tried"), (2, " p ", "a", "user: p", "", None)],
        "i int, prompt string, answer string, trajectory string, fb string, at string",
    )
    made = records.conversation_records(
        fields, index="i", split=F.lit("train"), data_source="d", feedback="fb", attempt="at", template="{prompt}|{solution}|{feedback}"
    )
    hint = "Successful reference trajectory:\nuser: p"
    assert [r["content"] for r in flat(made)] == ["p|user: p|column", f"p|tried|{hint}", f"p|user: p|{hint}"]
    static = records.conversation_records(fields, index="i", split=F.lit("train"), data_source="d", feedback="fb", static_feedback="S")
    assert [r["feedback_raw"] for r in flat(static)] == ["column", "S", "S"]


def test_a_plain_question_keeps_its_prompt_bare(spark):
    rows = spark.createDataFrame([(0, " q ", None)], "i int, question string, answer string")
    made = records.question_records(rows, index="i", split=F.lit("test"), data_source="d", suffix="")
    assert flat(made)[0]["content"] == "q" and flat(made)[0]["answer"] == ""
    assert [f.name for f in made.schema] == ["data_source", "prompt", "ability", "reward_model", "extra_info"]


def test_distillation_record_is_not_stripped_and_keeps_its_columns(spark):
    rows = spark.createDataFrame([(0, " q ", None)], "i int, question string, answer string")
    made = records.distillation_records(rows, index="i", split=F.lit("test"), data_source="d", suffix="go")
    row = made.first()
    assert row["prompt"][0]["content"] == " q  go" and row["question"] == " q "
    assert row["reward_model"]["ground_truth"] == "None"


def test_record_columns_replace_source_columns_of_the_same_name(spark):
    rows = spark.createDataFrame([(0, "q", "a", "old")], "i int, question string, answer string, prompt string")
    for made in (
        records.distillation_records(rows, index="i", split=F.lit("test"), data_source="d"),
        records.question_records(rows, index="i", split=F.lit("test"), data_source="d", suffix="", keep_source=True),
    ):
        assert made.columns.count("prompt") == 1 and made.first()["prompt"][0]["content"] == "q"
