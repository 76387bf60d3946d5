"""Expressions over rubric-graded tasks: deliverables, prompts, feedback, attempts, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradeflow.functions.text import text_or, trim_text

CRITERIA_TYPE = "array<struct<id:string,title:string,match_criteria:string,deliverables:array<string>>>"
RESULTS_TYPE = "array<struct<id:string,title:string,verdict:string,reasoning:string>>"
JUDGED_TYPE = f"struct<summary:string,score:double,all_pass:boolean,criteria_results:{RESULTS_TYPE}>"
# What is read out of a judge's JSON text, and the text itself.
SCORES_TYPE = JUDGED_TYPE.removesuffix(">") + ",whole:string>"
TASK_TYPE = (
    f"struct<title:string,work_type:string,instructions:string,deliverables:map<string,string>,criteria:{CRITERIA_TYPE}>"
)

# The wording of rubric prompts, feedback and fallback attempts, and their limits.
PROMPT_OPENING = "You are completing a Harvey LAB legal-agent benchmark task."
TASK_LABEL = "Task ID: "
TITLE_LABEL = "Title: "
WORK_LABEL = "Work type: "
INSTRUCTIONS_LABEL = "Instructions: "
BLOCK_LABEL = "\n### "
REASONING_LABEL = "\n  Judge reasoning: "
STANDARD_LABEL = "\n  Required standard: "
ATTEMPT_TITLE = "# Draft work product for "
OPEN_POINT = "- TODO "
FAILED = "FAIL"
PROMPT_CLOSING = "Draft the requested legal work product. Use clear headings and cite source documents when possible."
RUBRIC_HEADING = "Rubric criteria for training feedback construction:"
DELIVERABLES_HEADING = "Expected deliverables:"
DOCUMENTS_HEADING = "Source document excerpts:"
DEFAULT_DELIVERABLE = "output.md"
DEFAULT_SUMMARY = "Harvey LAB rubric feedback"
ATTEMPT_NOTE = "This is an intentionally sparse baseline attempt generated for the SDPO smoke path."
ATTEMPT_HEADING = "Open rubric-sensitive issues to address:"
RUBRIC_REPROMPT = (
    "{prompt}\n\nPrevious attempt:\n{solution}\n\nHarvey LAB rubric feedback:\n{feedback}\n\n"
    "Use the feedback to produce a corrected legal work product. Preserve the requested deliverable structure."
)
SHOWN_CRITERIA = 12
FEEDBACK_CHARS = 3200
PROMPT_CHARS = 9000
DOCUMENT_CHARS = 1200


def _lines(items: Column, line, sep: str = "\n") -> Column:
    return F.array_join(F.transform(items, line), sep)


def deliverables_of(criteria: Column, named: Column) -> Column:
    """Sorted distinct deliverables of the criteria, else those the task names, else the default one."""
    listed = F.flatten(
        F.transform(criteria, lambda c: F.coalesce(c["deliverables"], F.array().cast("array<string>")))
    )
    distinct = F.coalesce(F.array_sort(F.array_distinct(listed)), F.array().cast("array<string>"))
    values = F.coalesce(F.array_sort(F.map_values(named)), F.array().cast("array<string>"))
    return (
        F.when(F.size(distinct) > 0, distinct)
        .when(F.size(values) > 0, values)
        .otherwise(F.array(F.lit(DEFAULT_DELIVERABLE)))
    )


def document_block(path: Column, text: Column) -> Column:
    return F.concat(F.lit(BLOCK_LABEL), path, F.lit("\n"), text)


def build_prompt(
    *,
    task_id: Column,
    title: Column,
    work_type: Column,
    instructions: Column,
    deliverables: Column,
    blocks: Column,
    criteria: Column | None = None,
    limit: int = PROMPT_CHARS,
) -> Column:
    """The task prompt; ``blocks`` are document blocks in path order, ``criteria`` adds the rubric."""
    sections = [
        F.array(
            F.lit(PROMPT_OPENING),
            F.concat(F.lit(TASK_LABEL), task_id),
            F.concat(F.lit(TITLE_LABEL), text_or(title)),
            F.concat(F.lit(WORK_LABEL), text_or(work_type)),
            F.concat(F.lit(INSTRUCTIONS_LABEL), text_or(instructions)),
            F.lit(DELIVERABLES_HEADING),
            _lines(deliverables, lambda d: F.concat(F.lit("- "), d)),
            F.lit(DOCUMENTS_HEADING),
        ),
        F.coalesce(blocks, F.array().cast("array<string>")),
    ]
    if criteria is not None:
        rubric = _lines(
            criteria,
            lambda c: F.concat(
                F.lit("- "), text_or(c["id"]), F.lit(": "), text_or(c["title"]),
                F.lit("\n  "), text_or(c["match_criteria"]),
            ),
        )
        sections.append(F.array(F.lit(RUBRIC_HEADING), rubric))
    sections.append(F.array(F.lit(PROMPT_CLOSING)))
    return trim_text(F.array_join(F.concat(*sections), "\n\n"), limit)


def fallback_attempt(title: Column, criteria: Column) -> Column:
    """A sparse draft listing the first criteria as open points."""
    missed = _lines(
        F.slice(criteria, 1, SHOWN_CRITERIA),
        lambda c: F.concat(F.lit(OPEN_POINT), text_or(c["id"]), F.lit(": "), text_or(c["title"])),
    )
    return F.concat(
        F.lit(ATTEMPT_TITLE), text_or(title), F.lit(f"\n\n{ATTEMPT_NOTE}\n\n{ATTEMPT_HEADING}\n"),
        missed, F.lit("\n"),
    )


def _members(scores: Column) -> Column:
    """The members of the judge's JSON object; null where there is no such text."""
    return F.try_variant_get(F.try_parse_json(scores["whole"]), "$", "map<string,variant>")


def is_scored(scores: Column) -> Column:
    """Whether there are scores; an empty JSON object counts as none."""
    fields = ("summary", "score", "all_pass", "criteria_results")
    read = F.coalesce(*[scores[f].cast("string") for f in fields]).isNotNull()
    return scores.isNotNull() & (read | F.coalesce(F.size(F.map_keys(_members(scores))) > 0, F.lit(False)))


def feedback_text(criteria: Column, scores: Column, limit: int = FEEDBACK_CHARS) -> Column:
    """Judge results as feedback, with the required standard of each failed criterion; criteria where unscored."""
    bullets = _lines(
        F.slice(criteria, 1, SHOWN_CRITERIA),
        lambda c: F.concat(
            F.lit("- "), text_or(c["id"]), F.lit(" "), text_or(c["title"]), F.lit(": "), text_or(c["match_criteria"])
        ),
    )

    def block(result: Column) -> Column:
        verdict = F.upper(F.coalesce(result["verdict"], F.lit(FAILED)))
        judged = F.concat(
            F.lit("- "), verdict, F.lit(" "), text_or(result["id"]), F.lit(": "), text_or(result["title"]),
            F.lit(REASONING_LABEL), text_or(result["reasoning"]),
        )
        same_id = F.filter(criteria, lambda c: c["id"].eqNullSafe(result["id"]))
        standard = text_or(F.get(same_id, F.lit(0))["match_criteria"])
        required = F.concat(F.lit(STANDARD_LABEL), standard)
        return F.when((verdict == FAILED) & (standard != ""), F.concat(judged, required)).otherwise(judged)

    results = F.coalesce(scores["criteria_results"], F.array().cast(RESULTS_TYPE))
    summary = F.coalesce(scores["summary"], F.lit(DEFAULT_SUMMARY))
    judged = F.array_join(F.concat(F.array(summary), F.transform(results, block)), "\n")
    return trim_text(F.when(is_scored(scores), judged).otherwise(bullets), limit)


def scores_json(scores: Column) -> Column:
    """The scores as compact JSON with sorted keys, all fields of the judge's text among them; ``{}`` where there are none.

    Scores that came without a text hold the known fields only, and leave out those without a value.
    """
    results = F.transform(
        scores["criteria_results"],
        lambda r: F.struct(
            r["id"].alias("id"), r["reasoning"].alias("reasoning"), r["title"].alias("title"),
            r["verdict"].alias("verdict"),
        ),
    )
    ordered = F.struct(
        scores["all_pass"].alias("all_pass"), results.alias("criteria_results"),
        scores["score"].alias("score"), scores["summary"].alias("summary"),
    )
    members = _members(scores)
    # A variant drops the zeros of 0.0, so the score's digits are those of the text.
    digits = F.from_json(scores["whole"], "map<string,string>")["score"]

    def member(name: Column) -> Column:
        written = F.to_json(F.create_map(name, F.element_at(members, name)))
        as_read = F.when((name == "score") & scores["score"].isNotNull(), F.concat(F.lit('"score":'), digits))
        return F.coalesce(as_read, F.substr(written, F.lit(2), F.length(written) - 2))

    whole = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_keys(members)), member), ","), F.lit("}"))
    return F.when(is_scored(scores), F.coalesce(whole, F.to_json(ordered))).otherwise("{}")
