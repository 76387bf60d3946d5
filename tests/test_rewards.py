from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gradeflow.functions import reward
from gradeflow.operators import records
from gradeflow.operators.scoring import graded_reward, score, score_responses


def graded(spark, rows, schema, column):
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], f"i int, {schema}")
    return [r["r"] for r in df.select("i", column.alias("r")).orderBy("i").collect()]


def test_empty_answers_match_exactly_but_are_never_graded(spark):
    columns = (F.col("s"), F.col("t"), F.col("f"))
    rows = [("", "", None)]
    schema = "s string, t string, f string"
    assert graded(spark, rows, schema, reward.exact_score(*columns))[0]["score"] == 1.0
    assert graded(spark, rows, schema, reward.graded_score(*columns))[0]["score"] == 0.0


def test_graded_score_gives_half_for_a_held_truth(spark):
    got = graded(
        spark, [("about 12 apples, 7 left", "12", "hint")], "s string, t string, f string",
        reward.graded_score(F.col("s"), F.col("t"), F.col("f")),
    )[0]
    assert (got["score"], got["extracted_answer"], got["exact"], got["contains_ground_truth"]) == (0.5, "7", False, True)
    assert got["sdpo_feedback_available"] is True


def test_second_strip_is_only_in_the_exact_score(spark):
    columns = (F.col("s"), F.col("t"), F.col("f"))
    rows = [("#### five ,", "five", "")]
    schema = "s string, t string, f string"
    assert graded(spark, rows, schema, reward.exact_score(*columns))[0]["score"] == 1.0
    assert graded(spark, rows, schema, reward.graded_score(*columns))[0]["score"] == 0.5


def test_worked_truth_matches_only_when_extracted(spark):
    rows = [("it is 72", "36 * 2 = 72\n#### 72", "")]
    schema = "s string, t string, f string"
    raw = reward.exact_score(F.col("s"), F.col("t"), F.col("f"))
    read = reward.exact_score(F.col("s"), F.col("t"), F.col("f"), extract_truth=True)
    assert graded(spark, rows, schema, raw)[0]["score"] == 0.0
    assert graded(spark, rows, schema, read)[0]["score"] == 1.0


# Response, terms, and by hand: score, terms that count, hits.
RUBRIC_CASES = [
    ("net debt " + "w " * 78, ["Net  Debt", "other"], 0.7, 2, 1),
    ("I can't say these ten words here now ok", [], 0.0, 0, 0),
    ("w " * 79 + "\u00a0", ["w", "w", " , ", ""], 1.0, 2, 2),
    ("w " * 80 + "I cannot provide legal advice", ["zzz"], 0.0, 1, 0),
    ("w " * 80, ["zzz"], 0.2, 1, 0),
    ("net debt, i can't", ["net debt"], 0.7, 1, 1),
    ("", ["a"], 0.0, 1, 0),
    ("A, b", ["a b", "A,"], 1.0, 2, 2),
]


def test_rubric_score(spark):
    got = graded(
        spark, [case[:2] for case in RUBRIC_CASES], "s string, t array<string>", reward.rubric_score(F.col("s"), F.col("t"), F.lit(None))
    )
    for row, case in zip(got, RUBRIC_CASES, strict=True):
        points, terms, hits = case[2:]
        assert row["score"] == pytest.approx(points)
        assert (row["harvey_reward_terms"], row["harvey_reward_hits"]) == (terms, hits)
        assert row["sdpo_feedback_available"] is False
    assert got[0]["score"] == pytest.approx(0.7)


# Criteria, and their terms by hand.
TERM_CASES = [
    ([("1", 'Pass the "Net Debt" test at 3.5x', "", [])], ["Net Debt", "3.5x"]),
    ([("1", "x", "50% and 12x 3.25%", []), ("2", None, "the IRS Code-B and R&D/IP", [])], ["12x", "3.25", "IRS Code-B", "R&D/IP"]),
    ([("1", ". ".join(f"Term{i}a" for i in range(70)), "x", [])], [f"Term{i}a" for i in range(48)]),
    ([("1", "x", "'ab' `abc` it", [])], ["abc"]),
    ([], []),
]


def test_reward_terms(spark):
    kind = "c array<struct<id:string,title:string,match_criteria:string,deliverables:array<string>>>"
    got = graded(spark, [(c,) for c, _ in TERM_CASES], kind, reward.reward_terms(F.col("c")))
    assert got == [terms for _, terms in TERM_CASES]


def test_python_reward_out_of_a_file(spark, tmp_path):
    source = "import math\n\ndef half(data_source, solution_str, ground_truth, extra_info=None, **_):\n"
    source += "    return {'score': math.floor(len(solution_str) / 2) + 0.5 + len(extra_info['terms'] or []), 'source': data_source + extra_info['k']}\n"
    path = tmp_path / "mine.py"
    path.write_text(source)
    fn = reward.reward_from_file(str(path), "half", "score double, source string")
    info = "struct<k:string,terms:array<string>>"
    rows = spark.createDataFrame(
        [("d", "abcd", "t", ("x", ["a", "b"]))],
        f"data_source string, solution_str string, ground_truth string, extra_info {info}",
    )
    assert score(rows, fn).select("score", "source").first() == (4.5, "dx")


def test_responses_scored_against_question_records(spark):
    rows = spark.createDataFrame([(0, "q", "7"), (1, "q", "8")], "id int, question string, answer string")
    made = records.question_records(
        rows, index="id", split=F.lit("train"), data_source="d", static_feedback="hint", keep_source=True
    ).select("id", "data_source", "reward_model", "extra_info")
    answers = spark.createDataFrame([(0, "so 7"), (0, "8"), (1, "8 or 9")], "id int, solution_str string")
    got = score_responses(answers, made, "id").collect()
    assert sorted((r["id"], r["extracted_answer"], r["score"]) for r in got) == [(0, "7", 1.0), (0, "8", 0.0), (1, "9", 0.0)]
    assert all(r["sdpo_feedback_available"] for r in got)
    half = score_responses(answers, made, "id", graded_reward(made.schema["extra_info"].dataType))
    assert sorted((r["id"], r["score"]) for r in half.collect()) == [(0, 0.0), (0, 1.0), (1, 0.5)]


def test_a_lone_text_is_one_term(spark):
    rows = spark.createDataFrame(
        [(reward.RUBRIC_SOURCE, "net debt", "", ("net debt",)), (reward.RUBRIC_SOURCE, "net", "", (None,))],
        "data_source string, solution_str string, ground_truth string, extra_info struct<reward_terms:string>",
    )
    got = [(r["score"], r["harvey_reward_terms"]) for r in score(rows).collect()]
    assert got == [(1.0, 1), (0.0, 0)]
