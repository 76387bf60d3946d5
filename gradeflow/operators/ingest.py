"""Ingest of run payloads: metrics, traces and logs that replace a run's earlier ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeflow.operators.registry import newest

# Why a payload is refused.
NOT_AN_OBJECT = "JSON body must be an object"
NOT_ARRAYS = "metrics, traces, and logs must be arrays"

# Read out of the elements of a run's arrays; other members stay in the element itself.
METRIC_FIELDS = {"step": "bigint", "distillation_loss": "double", "reward": "double", "teacher_kl": "double"}
TOKEN_FIELDS = {"text": "string", "delta": "double", "student_logprob": "double", "teacher_logprob": "double", "selected": "boolean"}
TRACE_FIELDS = {
    **dict.fromkeys(("id", "prompt", "teacher_prompt", "hint", "response"), "string"),
    **dict.fromkeys(("reward", "kl"), "double"),
    "judge_selected": "bigint",
    "tokens": f"array<struct<{','.join(f'{name}:{kind}' for name, kind in TOKEN_FIELDS.items())}>>",
}
ARRAYS = ("metrics", "traces", "logs")
OBJECTS = {"metrics": METRIC_FIELDS, "traces": TRACE_FIELDS}


def is_object(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>").isNotNull()


def read_object(value: Column, fields: dict[str, str]) -> Column:
    """The fields of a JSON object (``variant``) and the object as ``whole``; null where a member is absent or of another type."""
    read = [F.try_variant_get(value, f"$.{name}", kind).alias(name) for name, kind in fields.items()]
    return F.struct(*read, value.alias("whole"))


def fits(value: Column, fields: dict[str, str]) -> Column:
    """Whether an element is an object whose known members, where not null, are of their types."""
    fit = is_object(value)
    for name, kind in fields.items():
        member = F.try_variant_get(value, f"$.{name}", "variant")
        blank = member.isNull() | F.is_variant_null(member)
        fit = fit & (blank | F.try_variant_get(value, f"$.{name}", kind).isNotNull())
    return F.coalesce(fit, F.lit(False))


def read_texts(values: Column) -> Column:
    """Elements as texts; those that aren't texts as JSON."""
    return F.transform(values, lambda v: F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v)))


def parse_payloads(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Payload texts with their arrays read out, and ``error`` set where a payload is refused.

    Metrics and traces are arrays of ``variant``, kept as they come; :func:`typed` reads them. An absent array stays
    null, which leaves the run's earlier one in place. What is read out of a refused payload means nothing. Batch or stream.
    """
    parsed = payloads.withColumn("_body", F.try_parse_json(payload))
    body = F.col("_body")
    arrays = {name: F.try_variant_get(body, f"$.{name}", "array<variant>") for name in ARRAYS}
    well_typed = F.lit(True)
    for name, array in arrays.items():
        absent = F.try_variant_get(body, f"$.{name}", "variant").isNull()
        well_typed = well_typed & (absent | array.isNotNull())
    refused = F.when(F.coalesce(~is_object(body), F.lit(True)), NOT_AN_OBJECT).when(~well_typed, NOT_ARRAYS)
    return parsed.select(
        *payloads.columns,
        refused.alias("error"),
        *[arrays[name].alias(name) for name in OBJECTS],
        read_texts(arrays["logs"]).alias("logs"),
        F.try_variant_get(body, "$.status", "string").alias("status"),
    )


def _read_fitting(elements: str, fields: dict[str, str]) -> Column:
    fitting = F.filter(elements, lambda v: fits(v, fields))
    return F.transform(fitting, lambda v: read_object(v, fields))


def _not_fitting(elements: str, fields: dict[str, str]) -> Column:
    left = F.filter(F.coalesce(elements, F.array().cast("array<variant>")), lambda v: ~fits(v, fields))
    return F.transform(left, lambda v: F.struct(F.lit(elements).alias("array"), F.to_json(v).alias("element")))


def typed(runs: DataFrame) -> DataFrame:
    """Runs with their metrics and traces as arrays of structs, of the elements that fit; each holds its element as ``whole``."""
    return runs.withColumns({name: _read_fitting(name, fields) for name, fields in OBJECTS.items()})


def misfits(runs: DataFrame, *keep: str) -> DataFrame:
    """``keep, array, element``: the metrics and traces that :func:`typed` leaves out, as JSON."""
    left = F.concat(*[_not_fitting(name, fields) for name, fields in OBJECTS.items()])
    return runs.select(*keep, F.explode(left).alias("_e")).select(*keep, "_e.*")


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("error").isNull()).drop("error")


def quarantined(parsed: DataFrame, payload: str = "payload") -> DataFrame:
    return parsed.where(F.col("error").isNotNull()).drop(*ARRAYS, "status")


def current(versions: DataFrame, key: str = "run_id", sequence: str = "seq") -> DataFrame:
    """Each run's newest arrays and status, over all ingested versions."""
    return newest(versions, key, sequence, [*ARRAYS, "status"])
