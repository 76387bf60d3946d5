"""The run registry as an append-only table of changes, read back as newest state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeflow.operators.ordering import with_previous

# Run states and the steps allowed between them; a run starts from draft or failed.
ALLOWED_STEPS = (
    ("draft", "queued"),
    ("failed", "queued"),
    ("queued", "running"),
    ("queued", "failed"),
    ("running", "completed"),
    ("running", "failed"),
)
LAUNCHABLE = ("draft", "failed")
SUMMARY_FIELDS = ("id", "name", "status", "created_at", "updated_at", "config", "metrics")

# The training catalogue and the limits a configuration is checked against.
MODELS_BY_ALGORITHM = {
    "sdpo": ("Qwen/Qwen3.5-0.8B", "Qwen/Qwen3.5-4B", "Qwen/Qwen3.5-35B-A3B"),
    "opd": ("Qwen/Qwen3.5-0.8B", "Qwen/Qwen3.5-4B"),
    "harvey-sdpo": ("Qwen/Qwen3.5-35B-A3B",),
    "kimi-sdpo": ("moonshotai/Kimi-K2.5",),
}
MAX_STEPS = 100
MAX_TRAIN_ROWS = 2048
MAX_VAL_ROWS = 512
DEFAULTS = {
    "algorithm": "sdpo",
    "steps": 10,
    "train_rows": 64,
    "val_rows": 16,
    "hint_placement": "before-mistake",
    "hint": "",
    "topology": "single-gpu",
    "smoke_gpu": False,
}

CONFIG_FIELDS = (
    "algorithm", "model", "teacher_model", "dataset", "steps", "train_rows", "val_rows",
    "hint_placement", "hint", "topology", "smoke_gpu",
)
TRIMMED = ("model", "dataset")


def newest(changes: DataFrame, key: str, sequence: str, fields: Sequence[str], cleared: Column | None = None) -> DataFrame:
    """One row per key. Each field holds its newest value; a null leaves it as it was, so a change may leave fields out.

    ``cleared``, an array of names, says which fields a change sets to null. ``sequence`` is unique within a key, and its largest value is
    returned as well.
    """

    def given(field: str) -> Column:
        known = F.col(field).isNotNull()
        return known if cleared is None else known | F.coalesce(F.array_contains(cleared, field), F.lit(False))

    latest = [F.max_by(f, F.when(given(f), F.col(sequence))).alias(f) for f in fields]
    return changes.groupBy(key).agg(F.max(sequence).alias(sequence), *latest)


def newest_rows(versions: DataFrame, keys: Sequence[str], sequence: str) -> DataFrame:
    """The whole newest row of every key."""
    rest = [c for c in versions.columns if c not in keys]
    picked = versions.groupBy(*keys).agg(F.max_by(F.struct(*rest), sequence).alias("_newest"))
    return picked.select(*keys, "_newest.*")


def run_list(runs: DataFrame) -> DataFrame:
    """Run summaries, newest first."""
    present = [f for f in SUMMARY_FIELDS if f in runs.columns]
    return runs.select(*present).orderBy(F.desc("created_at"), F.desc("id"))


def run_lookup(runs: DataFrame, run_id: str) -> DataFrame:
    return runs.where(F.col("id") == run_id)


def run_summary(metrics: DataFrame, key: str = "run_id") -> DataFrame:
    """Metrics of each run's last step, the reward gained since its first, and its loss range."""
    values = F.struct("distillation_loss", "reward", "teacher_kl")
    ends = metrics.groupBy(key).agg(
        F.max_by(values, "step").alias("_last"),
        F.min_by("reward", "step").alias("_first_reward"),
        F.min("distillation_loss").alias("min_loss"),
        F.max("distillation_loss").alias("max_loss"),
        F.count("*").alias("steps"),
    )
    gained = F.coalesce(F.col("_last.reward"), F.lit(0.0)) - F.coalesce(F.col("_first_reward"), F.lit(0.0))
    return ends.select(
        key,
        "steps",
        F.col("_last.distillation_loss").alias("last_loss"),
        F.col("_last.reward").alias("last_reward"),
        gained.alias("reward_change"),
        F.col("_last.teacher_kl").alias("last_kl"),
        "min_loss",
        "max_loss",
    )


def with_trace_counts(summary: DataFrame, traces: DataFrame, key: str = "run_id") -> DataFrame:
    counts = traces.groupBy(key).agg(F.count("*").alias("traces"))
    return summary.join(counts, key, "left").withColumn("traces", F.coalesce("traces", F.lit(0)))


def transitions(events: DataFrame, key: str, order: Sequence[str], status: str, chunk: Column) -> DataFrame:
    """Status events with the status before each, and whether that step is allowed.

    A run's first event must be ``draft``. ``chunk`` cuts a long history into pieces, see
    :func:`gradeflow.operators.ordering.with_previous`.
    """
    with_before = with_previous(events, key, order, status, chunk, "previous_status")
    pairs = F.array(*[F.lit(f"{a}>{b}") for a, b in ALLOWED_STEPS])
    step = F.concat(F.col("previous_status"), F.lit(">"), F.col(status))
    allowed = F.when(F.col("previous_status").isNull(), F.col(status) == "draft").otherwise(
        F.array_contains(pairs, step)
    )
    return with_before.withColumn("allowed", allowed)


def launchable(status: Column) -> Column:
    return status.isin(*LAUNCHABLE)


def launch(runs: DataFrame, at: Column) -> DataFrame:
    """Launch requests for the given runs: ``id, status, updated_at, error``.

    A draft or failed run is queued. Any other keeps its status and gets an error.
    """
    ready, status = launchable(F.col("status")), F.col("status")
    return runs.select(
        "id",
        F.when(ready, "queued").otherwise(status).alias("status"),
        F.when(ready, at).otherwise(F.col("updated_at")).alias("updated_at"),
        F.when(~ready, F.concat(F.lit("cannot launch a "), status, F.lit(" run"))).alias("error"),
    )


def draft_runs(configs: DataFrame, key: str, at: Column) -> DataFrame:
    """Checked configurations as draft runs; those that break a rule are left to :func:`violations`.

    A run's id is a hash of the caller's unique ``key`` and the time, so a repeated task gives the same id.
    """
    valid = violations(with_defaults(configs)).where(F.size("violations") == 0)
    stamp = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ssXXX")
    named = F.col("name") if "name" in configs.columns else F.lit(None).cast("string")
    usual_name = F.concat_ws("_", "algorithm", "dataset")
    config = F.struct(*[F.trim(c).alias(c) if c in TRIMMED else F.col(c) for c in CONFIG_FIELDS])
    return valid.select(
        F.concat(F.lit("run_"), F.md5(F.concat_ws("@", F.col(key).cast("string"), stamp))).alias("id"),
        F.coalesce(F.nullif(named, F.lit("")), usual_name).alias("name"),
        F.lit("draft").alias("status"),
        stamp.alias("created_at"),
        stamp.alias("updated_at"),
        config.alias("config"),
    )


def with_defaults(configs: DataFrame) -> DataFrame:
    """Configurations with defaults filled in; the teacher defaults to the model."""
    filled = configs
    for name, default in DEFAULTS.items():
        here = F.col(name) if name in configs.columns else F.lit(None)
        filled = filled.withColumn(name, F.coalesce(here, F.lit(default)))
    teacher = F.col("teacher_model") if "teacher_model" in configs.columns else F.lit(None).cast("string")
    return filled.withColumn("teacher_model", F.coalesce(teacher, F.trim("model")))


def violations(
    configs: DataFrame,
    catalogue: DataFrame | None = None,
    max_steps: int = MAX_STEPS,
    max_train_rows: int = MAX_TRAIN_ROWS,
    max_val_rows: int = MAX_VAL_ROWS,
) -> DataFrame:
    """Configurations with an array naming every rule they break, in rule order; a null field breaks its rule.

    The model must be in some algorithm's list. With a ``catalogue`` table (``id, models``) that is
    a join whose strategy Spark picks by size; without one the fixed catalogue is an in-list.
    """
    model, dataset = F.trim(F.coalesce("model", F.lit(""))), F.trim(F.coalesce("dataset", F.lit("")))
    checked, known = _known_model(configs, model, catalogue)
    rules = {
        "algorithm": F.col("algorithm").isin(*MODELS_BY_ALGORITHM),
        "model and dataset": (model != "") & (dataset != ""),
        "model catalogue": (model == "") | known,
        "steps": F.col("steps").between(1, max_steps),
        "train_rows": F.col("train_rows").between(1, max_train_rows),
        "val_rows": F.col("val_rows").between(1, max_val_rows),
    }
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return checked.withColumn("violations", broken).drop("_known")


def _known_model(configs: DataFrame, model: Column, catalogue: DataFrame | None) -> tuple[DataFrame, Column]:
    if catalogue is None:
        listed = sorted({m for models in MODELS_BY_ALGORITHM.values() for m in models})
        return configs, model.isin(*listed)
    allowed = catalogue_models(catalogue).select(F.col("model").alias("_listed"), F.lit(True).alias("_known"))
    joined = configs.withColumn("_model", model).join(allowed, F.col("_model") == F.col("_listed"), "left")
    return joined.drop("_model", "_listed"), F.coalesce("_known", F.lit(False))


def catalogue_models(catalogue: DataFrame) -> DataFrame:
    """Every model any algorithm allows, once."""
    return catalogue.select(F.explode("models").alias("model")).distinct()


def lookup_catalogue(spark: SparkSession) -> DataFrame:
    """The fixed catalogue as a table, for joins with a caller's own additions."""
    rows = [(name, list(models)) for name, models in MODELS_BY_ALGORITHM.items()]
    return spark.createDataFrame(rows, "id string, models array<string>")


def append_log(prior: DataFrame, added: DataFrame) -> DataFrame:
    """Prior log lines and new ones together."""
    return prior.unionByName(added)

