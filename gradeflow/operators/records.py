"""Trainer-ready chat records from question rows, conversations and distillation prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeflow.functions.text import as_col, fill_template, first_filled, strip, text_or

# Default prompts of the record builders.
ANSWER_SUFFIX = 'Let us think step by step and output the final answer after "####".'
LARGE_MODEL_SUFFIX = 'Think carefully and put the final answer after "####".'
TRAJECTORY_FEEDBACK = "Successful reference trajectory:\n"
TEACHER_HINT = "\n\nPrivileged feedback: "
LARGE_MODEL_FAMILY = "kimi-k2.6"
REPROMPT = (
    "{prompt}\n\nPrevious attempt:\n{solution}\n\nEnvironment feedback:\n{feedback}\n\n"
    "Use the feedback to produce a corrected solution."
)
RECORD_COLUMNS = ("data_source", "prompt", "ability", "reward_model", "extra_info")
LARGE_MODEL_REPROMPT = REPROMPT + " Keep only useful reasoning."


def make_prompt(base: Column, attempt: Column, feedback: Column, suffix: str = "", template: str = REPROMPT) -> Column:
    """The training prompt: the template where there is an attempt or feedback, else the bare question."""
    asked = strip(base)
    if suffix:
        asked = F.concat(asked, F.lit(" " + suffix))
    filled = fill_template(template, prompt=asked, solution=attempt, feedback=feedback)
    return F.when((attempt != "") | (feedback != ""), filled).otherwise(asked)


def teacher_prompt(base: Column, hint: Column) -> Column:
    return F.concat(base, F.lit(TEACHER_HINT), hint)


def chat_columns(
    *, data_source: Column, content: Column, ability: Column, truth: Column, extra: dict[str, Column]
) -> list[Column]:
    """The five columns every trainer record has."""
    return [
        data_source.alias("data_source"),
        F.array(F.struct(F.lit("user").alias("role"), content.alias("content"))).alias("prompt"),
        ability.alias("ability"),
        F.struct(F.lit("rule").alias("style"), truth.alias("ground_truth")).alias("reward_model"),
        F.struct(*[value.alias(name) for name, value in extra.items()]).alias("extra_info"),
    ]


def _source_columns(df: DataFrame) -> list[str]:
    """The input columns that stay beside a record; the record's own columns replace any of the same name."""
    return [c for c in df.columns if c not in RECORD_COLUMNS]


def feedback_record(
    *,
    question: Column,
    answer: Column,
    feedback: Column,
    attempt: Column,
    split: Column,
    index: Column,
    data_source: str,
    ability: str,
    suffix: str,
    template: str,
    family: str | None = None,
) -> list[Column]:
    extra = {
        "split": split,
        "index": index.cast("bigint"),
        "original_prompt": question,
        "answer": answer,
        "feedback_raw": feedback,
        "previous_attempt": attempt,
        "sdpo_bridge": F.lit(True),
    }
    if family:
        extra["target_model_family"] = F.lit(family)
    return chat_columns(
        data_source=F.lit(data_source),
        content=make_prompt(question, attempt, feedback, suffix, template),
        ability=F.lit(ability),
        truth=answer,
        extra=extra,
    )


def question_records(
    df: DataFrame,
    *,
    index: Column | str,
    split: Column | str,
    data_source: str,
    question: Column | str = "question",
    answer: Column | str = "answer",
    feedback: Column | str | None = None,
    attempt: Column | str | None = None,
    ability: str = "math",
    suffix: str = ANSWER_SUFFIX,
    static_feedback: str = "",
    template: str = REPROMPT,
    family: str | None = None,
    keep_source: bool = False,
) -> DataFrame:
    """Question rows as feedback-conditioned records; ``family`` and ``keep_source`` give the large-model form."""
    record = feedback_record(
        question=text_or(question),
        answer=text_or(answer),
        feedback=first_filled(text_or(feedback), F.lit(static_feedback)),
        attempt=text_or(attempt),
        split=as_col(split),
        index=as_col(index),
        data_source=data_source,
        ability=ability,
        suffix=suffix,
        template=template,
        family=family,
    )
    return df.select(*(_source_columns(df) if keep_source else []), *record)


def conversation_records(
    fields: DataFrame,
    *,
    index: Column | str,
    split: Column | str,
    data_source: str,
    feedback: Column | str | None = None,
    attempt: Column | str | None = None,
    ability: str = "agent",
    suffix: str = "",
    static_feedback: str = "",
    template: str = REPROMPT,
) -> DataFrame:
    """Conversations (``prompt, answer, trajectory``) as records whose default hint is the trajectory."""
    trajectory = F.col("trajectory")
    shown = first_filled(text_or(feedback), F.lit(static_feedback))
    hint = F.when(shown != "", shown).otherwise(F.concat(F.lit(TRAJECTORY_FEEDBACK), trajectory))
    return fields.select(
        *feedback_record(
            question=F.col("prompt"),
            answer=F.col("answer"),
            feedback=hint,
            attempt=first_filled(text_or(attempt), trajectory),
            split=as_col(split),
            index=as_col(index),
            data_source=data_source,
            ability=ability,
            suffix=suffix,
            template=template,
        )
    )


def distillation_records(
    df: DataFrame,
    *,
    index: Column | str,
    split: Column | str,
    data_source: str,
    question: Column | str = "question",
    answer: Column | str | None = "answer",
    ability: str = "general",
    suffix: str = "",
) -> DataFrame:
    """Question rows as distillation records. The question is not stripped, source columns stay, a null reads ``None``."""
    asked = F.coalesce(as_col(question).cast("string"), F.lit("None"))
    told = F.lit("") if answer is None else F.coalesce(as_col(answer).cast("string"), F.lit("None"))
    content = F.concat(asked, F.lit(" " + suffix)) if suffix else asked
    extra = {"split": as_col(split), "index": as_col(index).cast("bigint"), "answer": told, "prompt": asked}
    record = chat_columns(
        data_source=F.lit(data_source), content=content, ability=F.lit(ability), truth=told, extra=extra
    )
    return df.select(*_source_columns(df), *record)


def split_counts(df: DataFrame, split: Column | str = "split") -> DataFrame:
    return df.groupBy(as_col(split).alias("split")).agg(F.count("*").alias("rows"))
