"""Reward expressions: exact, graded and rubric-coverage scores, as struct columns."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeflow.functions.text import (
    BOUNDARY,
    STARTS_WORD,
    WS,
    all_matches,
    contains_any,
    extract_answer,
    has_words,
    normalize,
    strip,
    text_or,
)

# The rubric-graded source, its refusal phrases, weights and word list.
RUBRIC_SOURCE = "harvey/lab"
REFUSALS = ("cannot provide legal advice", "i can't")
LONG_ANSWER_WORDS = 80
LONG_ANSWER_BONUS = 0.2
REFUSAL_PENALTY = 0.3
DULL_TERMS = ("pass", "fail", "agent", "issue")
TERM_LIMIT = 48
QUOTED_SPAN = r"[\"'`]([^\"'`]{3,80})[\"'`]"
NUMBER_TERM = rf"\p{{Nd}}{STARTS_WORD}\p{{Nd}}*(?:\.\p{{Nd}}+)?%?x?{BOUNDARY}"
CAPITAL_WORD = r"[A-Z][A-Za-z0-9&/-]*"
CAPITAL_RUN = rf"[A-Z]{STARTS_WORD}[A-Za-z0-9&/-]*(?:{WS}+{CAPITAL_WORD}){{0,5}}{BOUNDARY}"


def has_feedback(feedback: Column) -> Column:
    return text_or(feedback) != ""


def exact_score(solution: Column, truth: Column, feedback: Column, extract_truth: bool = False) -> Column:
    """1.0 where the extracted answer equals the truth. Two empty texts are equal.

    ``extract_truth`` reads the answer out of a worked truth before comparing.
    """
    extracted = extract_answer(solution)
    wanted = extract_answer(truth) if extract_truth else truth
    return F.struct(
        F.when(normalize(extracted) == normalize(wanted), 1.0).otherwise(0.0).alias("score"),
        extracted.alias("extracted_answer"),
        text_or(feedback).alias("feedback_raw"),
        has_feedback(feedback).alias("sdpo_feedback_available"),
    )


def graded_score(solution: Column, truth: Column, feedback: Column) -> Column:
    """1.0 for an exact answer, 0.5 where the response holds the truth; an empty truth never counts."""
    extracted = extract_answer(solution, letters=False)
    wanted = normalize(truth, restrip=False)
    # The costly side comes first in each test, so that Spark computes the extraction once for all uses.
    exact = (normalize(extracted, restrip=False) == wanted) & (wanted != "")
    held = F.contains(normalize(solution, restrip=False), wanted) & (wanted != "")
    return F.struct(
        F.greatest(exact.cast("double"), held.cast("double") / 2).alias("score"),
        extracted.alias("extracted_answer"),
        exact.alias("exact"),
        held.alias("contains_ground_truth"),
        text_or(feedback).alias("feedback_raw"),
        has_feedback(feedback).alias("sdpo_feedback_available"),
    )


def rubric_score(solution: Column, terms: Column, feedback: Column) -> Column:
    """Share of the rubric's terms the response holds, with a length bonus and a refusal penalty."""
    text = normalize(solution)
    wanted = F.filter(
        F.transform(F.coalesce(terms, F.array().cast("array<string>")), lambda t: normalize(t)), lambda t: t != ""
    )
    hits = F.size(F.filter(wanted, lambda t: F.contains(text, t)))
    count = F.size(wanted)
    bonus = F.when(has_words(text_or(solution), LONG_ANSWER_WORDS), LONG_ANSWER_BONUS).otherwise(0.0)
    penalty = F.when(contains_any(text, REFUSALS), REFUSAL_PENALTY).otherwise(0.0)
    score = hits / F.greatest(count, F.lit(1)) + bonus - penalty
    return F.struct(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score"),
        count.alias("harvey_reward_terms"),
        hits.alias("harvey_reward_hits"),
        has_feedback(feedback).alias("sdpo_feedback_available"),
    )


def routed_score(source: Column, solution: Column, truth: Column, terms: Column, feedback: Column) -> Column:
    """The rubric score for the rubric source and the exact score for every other."""
    rubric = rubric_score(solution, terms, feedback)
    exact = exact_score(solution, truth, feedback)
    graded = text_or(source) == RUBRIC_SOURCE
    return F.struct(
        F.when(graded, rubric["score"]).otherwise(exact["score"]).alias("score"),
        F.when(~graded, exact["extracted_answer"]).alias("extracted_answer"),
        F.when(~graded, exact["feedback_raw"]).alias("feedback_raw"),
        F.when(graded, rubric["harvey_reward_terms"]).alias("harvey_reward_terms"),
        F.when(graded, rubric["harvey_reward_hits"]).alias("harvey_reward_hits"),
        has_feedback(feedback).alias("sdpo_feedback_available"),
    )


def reward_terms(criteria: Column, limit: int = TERM_LIMIT) -> Column:
    """Distinct quoted spans, numbers and capitalised runs of all criteria, in that order of discovery."""
    raw = F.array_join(
        F.transform(criteria, lambda c: F.concat(text_or(c["title"]), F.lit(" "), text_or(c["match_criteria"]))), " "
    )
    found = F.concat(
        all_matches(raw, QUOTED_SPAN),
        all_matches(raw, NUMBER_TERM, 0),
        all_matches(raw, CAPITAL_RUN, 0),
    )
    tidy = F.transform(found, lambda t: strip(F.regexp_replace(t, f"{WS}+", " ")))
    kept = F.filter(tidy, lambda t: (F.length(t) >= 3) & ~F.lower(t).isin(*DULL_TERMS))
    return F.slice(F.array_distinct(kept), 1, limit)


RewardFn = Callable[[Column, Column, Column, Column], Column]


def python_reward(fn: Callable[..., dict], schema: T.StructType | str) -> RewardFn:
    """A user's ``fn(data_source, solution_str, ground_truth, extra_info) -> dict`` as a Column function.

    Arrow hands batches to Python; use a Column reward where the maths allows it.
    """

    @F.pandas_udf(schema)
    def scored(source: pd.Series, solution: pd.Series, truth: pd.Series, info: pd.DataFrame) -> pd.DataFrame:
        extras = [{k: v.tolist() if hasattr(v, "tolist") else v for k, v in row.items()} for row in info.to_dict("records")]
        rows = zip(source, solution, truth, extras, strict=True)
        return pd.DataFrame([fn(s, text, wanted, extra) for s, text, wanted, extra in rows])

    return scored


def reward_from_file(path: str, name: str, schema: T.StructType | str) -> RewardFn:
    """The function ``name`` out of the Python file ``path``; Spark ships it to the executors by value."""
    spec = importlib.util.spec_from_file_location("user_reward", path)
    if spec is None or spec.loader is None:
        raise ValueError(f"no Python file at {path}")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return python_reward(getattr(module, name), schema)
