"""Expressions over single training-log lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradeflow.functions.text import BOUNDARY, WORD_START, WS, all_matches, contains_any, first_match

# The texts a trainer prints when it fails, progresses or resumes.
FAILURE_TEXTS = (
    "Traceback (most recent call last)",
    "subprocess.CalledProcessError",
    "RuntimeError:",
    "ValueError:",
    "IndexError:",
    "ImportError:",
    "ModuleNotFoundError:",
    "CUDA out of memory",
    "CUDA error",
)
PROGRESS_TEXTS = (
    "training/global_step",
    "train/critic/rewards/mean",
    "critic/rewards/mean",
    "distillation/loss",
    "actor/pg_loss",
    "Saving checkpoint",
    "local_global_step_folder",
)
RESUME_TEXTS = ("Found checkpoint", "Load from checkpoint", "Resuming from", "Setting global step")

# How a line says that a step was reached, and how many steps there will be.
STEP_REACHED = (
    "training/global_step:{}",
    "training/global_step: {}",
    "step:{} -",
    "step: {} -",
    "global_step_{}",
    "'global_step': {}",
    '"global_step": {}',
)
STEPS_IN_ALL = "Total training steps:"

# The spellings of a step and of each metric, a separator, and a number.
STEP_NAMES = "training/global_step|global_step|step"
METRIC_NAMES = {
    "distillation_loss": "distillation/loss|distillation_loss",
    "reward": "critic/rewards/mean|train/critic/rewards/mean|reward",
    "teacher_kl": "teacher_kl|kl_loss|kl",
}
STEP_WORD = "step"  # in every step name
APP_ID_START = "ap-"
SEPARATOR = rf"{WS}*[:=]{WS}*"
PLAIN_NUMBER = r"-?[0-9]+(?:\.[0-9]+)?"
# Also reads exponents, nan and inf, which the plain form cuts short or misses.
WIDE_NUMBER = r"-?(?:[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|nan|inf)"


def step_of(line: Column) -> Column:
    """The first step number in the line; any word ending in a step name counts."""
    return first_match(line, f"(?:{STEP_NAMES}){SEPARATOR}([0-9]+)").try_cast("bigint")


def metric_of(line: Column, metric: str, wide_numbers: bool = False) -> Column:
    number = WIDE_NUMBER if wide_numbers else PLAIN_NUMBER
    found = first_match(line, f"(?:{METRIC_NAMES[metric]}){SEPARATOR}({number})")
    if wide_numbers:
        found = F.replace(found, F.lit("inf"), F.lit("Infinity"))
    return found.try_cast("double")


def app_id_of(line: Column) -> Column:
    return first_match(line, f"{WORD_START}{APP_ID_START}[A-Za-z0-9]+{BOUNDARY}", 0)


def configured_steps_of(line: Column) -> Column:
    found = all_matches(line, f"{STEPS_IN_ALL}{WS}*([0-9]+)")
    return F.try_element_at(found, F.lit(-1)).try_cast("bigint")


def is_failure(line: Column) -> Column:
    return contains_any(line, FAILURE_TEXTS)


def is_progress(line: Column) -> Column:
    return contains_any(line, PROGRESS_TEXTS)


def is_resume(line: Column) -> Column:
    return contains_any(line, RESUME_TEXTS)


def is_fresh_step(line: Column, step: int, exact: bool = False) -> Column:
    """The line reports reaching ``step`` and does not speak of resuming from it.

    By default step 1 is also found in ``global_step_10``; ``exact`` rules that out.
    """
    spellings = tuple(form.format(step) for form in STEP_REACHED)
    if exact:
        found = F.lit(False)
        for text in spellings:
            found = found | line.rlike(r"\Q" + text + r"\E(?![0-9])")
    else:
        found = contains_any(line, spellings)
    return found & ~is_resume(line)


# What must not be shown of a line: the pattern of each kind; a first group, where there is one, stays.
SECRETS = {
    "bearer": r"(?i)(\bbearer )[A-Za-z0-9._~+/=-]{8,}",
    "access_key": r"()\b(?:sk-|sk_|hf_|ghp_|AKIA)[A-Za-z0-9_-]{12,}",
    "signed_url": r"(?i)([?&](?:x-amz-signature|signature|sig|token)=)[^&\s]+",
    "assigned": r"(?i)(\b(?:password|passwd|secret|api_key|apikey)\s?[=:]\s?)[^\s,;]+",
}
MASK = "[redacted]"


def redact(line: Column) -> Column:
    """``struct<line, and per kind of secret the number of hits>``; kinds are masked in turn, null stays null."""
    hits, left = [], line
    for kind, pattern in SECRETS.items():
        hits.append(F.regexp_count(left, F.lit(pattern)).alias(kind))
        left = F.regexp_replace(left, pattern, rf"$1{MASK}")
    return F.struct(left.alias("line"), *hits)


# Kinds of failure and the texts, in lower case, that tell them; the first kind with a text in the line is its kind.
FAILURE_KINDS = {
    "memory": ("out of memory", "oom-kill", "cannot allocate"),
    "device": ("cuda error", "nccl", "ecc error"),
    "time": ("timeout", "timed out", "deadline exceeded"),
    "import": ("importerror", "modulenotfounderror"),
    "access": ("permission denied", "unauthorized", "forbidden"),
    "storage": ("no space left", "filenotfounderror"),
    "value": ("valueerror", "indexerror", "keyerror", "typeerror"),
}
OTHER_FAILURE = "other"


def failure_kind(line: Column) -> Column:
    """The kind of failure that a line tells; ``other`` for a failure of no kind, null for a line without one."""
    lowered = F.lower(line)
    kinds = [F.when(contains_any(lowered, texts), F.lit(kind)) for kind, texts in FAILURE_KINDS.items()]
    return F.coalesce(*kinds, F.when(is_failure(line), F.lit(OTHER_FAILURE)))
