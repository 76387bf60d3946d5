"""Text functions against values worked out by hand, and by their properties on random texts."""

from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gradeflow.functions import text

# Input, comparison form, form without the second strip, answer, answer without the letter step. Worked out by hand.
EXPECTED = [
    ("", "", "", "", ""),
    (" ,x, ", "x", "x", ",x,", ",x,"),
    ("5 ,", "5", "5 ", "5", "5"),
    ("a\u00a0\u2003b", "a b", "a b", "B", "a\u00a0\u2003b"),
    ("A,B ,\n\n\n\n C", "ab c", "ab c", "C", "A,B ,\n\n\n\n C"),
    ("tab\there", "tab here", "tab here", "tab\there", "tab\there"),
    ("1,200 then -3.5", "1200 then -3.5", "1200 then -3.5", "-3.5", "-3.5"),
    ("a #### 72\nb #### 7,3", "a #### 72 b #### 73", "a #### 72 b #### 73", "7,3", "7,3"),
    ("<ANSWER>\n x </answer>", "<answer> x </answer>", "<answer> x </answer>", "x", "x"),
    ("\\boxed{9} and 2", "\\boxed{9} and 2", "\\boxed{9} and 2", "9", "9"),
    ("so it is b", "so it is b", "so it is b", "B", "so it is b"),
    ("x_a", "x_a", "x_a", "x_a", "x_a"),
    ("<answer>one</answer><answer> two", "<answer>one</answer><answer> two", "<answer>one</answer><answer> two", "one", "one"),
    ("####", "####", "####", "####", "####"),
]


def evaluated(spark, values, column):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r["y"] for r in rows.select("i", column.alias("y")).orderBy("i").collect()]


def test_spaces_are_pythons():
    whites = [c for c in map(chr, range(0x3100)) if c.isspace()]
    assert sorted(text.SPACES) == whites


def test_space_pattern_matches_pythons(spark):
    points = [chr(i) for i in range(1, 0x3100) if not 0xD800 <= i < 0xE000]
    found = evaluated(spark, points, F.col("x").rlike(rf"\A{text.WS}\z"))
    assert [c for c, hit in zip(points, found) if hit] == [c for c in points if c.isspace()]


@pytest.mark.parametrize(("restrip", "place"), [(True, 1), (False, 2)])
def test_normalize(spark, restrip, place):
    values = [row[0] for row in EXPECTED]
    assert evaluated(spark, values, text.normalize(F.col("x"), restrip)) == [row[place] for row in EXPECTED]


@pytest.mark.parametrize(("letters", "place"), [(True, 3), (False, 4)])
def test_extract_answer(spark, letters, place):
    values = [row[0] for row in EXPECTED]
    assert evaluated(spark, values, text.extract_answer(F.col("x"), letters)) == [row[place] for row in EXPECTED]


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab #<>/{}\\boxed1,.-\nABswer\u00a0é", max_size=60), min_size=150, max_size=150))
def test_properties_on_random_texts(spark, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    x, normal = F.col("x"), text.normalize(F.col("x"))
    got = rows.select(
        "i", text.extract_answer(x).alias("a"), text.trim_text(x, 20).alias("t"), normal.alias("n"),
        text.normalize(normal).alias("again"), text.count_words(x).alias("w"), text.has_words(x, 4).alias("h"),
    )
    for row in got.collect():
        value = values[row["i"]]
        assert row["a"] == row["a"].strip() and row["a"] in (value + value.upper() + value.replace(",", ""))
        assert row["n"] == row["again"] and "," not in row["n"] and row["n"] == row["n"].strip().lower()
        cut = row["t"].removesuffix("\n[truncated]")
        assert len(cut) <= 20 and "\n\n\n" not in cut
        assert (row["w"], row["h"]) == (len(value.split()), len(value.split()) >= 4)


def test_trim_cuts_at_a_line_end(spark):
    body = "x" * 1100 + "\n" + "y" * 199
    assert evaluated(spark, [body, "z" * 1300], text.trim_text(F.col("x"), 1200)) == [
        "x" * 1100 + "\n[truncated]", "z" * 1200 + "\n[truncated]"
    ]


def test_template_leaves_filled_in_braces_alone(spark):
    got = evaluated(
        spark, ["ask {solution}"],
        text.fill_template("{{p}} {prompt} / {solution}", prompt=F.col("x"), solution=F.lit("{prompt}")),
    )
    assert got == ["{p} ask {solution} / {prompt}"]
    with pytest.raises(ValueError):
        text.fill_template("{other}", prompt=F.lit(""))


def test_safe_name(spark):
    assert evaluated(spark, ["a/b c.d-é_٣²"], text.safe_name(F.col("x"))) == ["a_b_c_d-é_٣²"]


def test_absent_and_null_columns_read_as_text(spark):
    assert evaluated(spark, [None, "v"], text.text_or("x", "d")) == ["", "v"]
    assert evaluated(spark, ["v"], text.text_or(None, "d")) == ["d"]
