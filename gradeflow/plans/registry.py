"""Run registry, ingest, configuration checks and token tables over events, orders and embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeflow.operators import ingest
from gradeflow.operators import logs as log_ops
from gradeflow.operators import registry, traces
from gradeflow.plans import Query, table
from gradeflow.plans.logs import STEP_METRICS_SQL, _lines
from gradeflow.session import fresh_path
from gradeflow.sources import runs
from gradeflow.streaming import runs as live

STATUS_BY_EVENT = {
    "signup": "draft", "view": "queued", "click": "running", "purchase": "completed", "error": "failed"
}
CHUNK_EVENTS = 4096


def _status() -> Column:
    pairs = [F.lit(x) for pair in STATUS_BY_EVENT.items() for x in pair]
    return F.create_map(*pairs)[F.col("event_type")]


STATUS_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS_BY_EVENT.items()) + " END"


def _changes(spark: SparkSession, folder: str) -> DataFrame:
    """Run changes: each event sets the status, and some fields depending on its type."""
    kind = F.col("event_type")
    return table(spark, folder, "events").select(
        F.col("user_id").alias("id"),
        F.col("event_id").alias("seq"),
        F.col("ts").alias("updated_at"),
        _status().alias("status"),
        F.when(kind == "signup", F.concat(F.lit("run "), "props")).alias("name"),
        F.when(kind == "purchase", F.col("value")).alias("reward"),
        F.when(kind == "click", F.concat(F.lit("ap-"), F.col("event_id").cast("string"))).alias("app_id"),
    )


FIELDS = ["updated_at", "status", "name", "reward", "app_id"]


def run_latest(spark: SparkSession, folder: str) -> DataFrame:
    return registry.newest(_changes(spark, folder), "id", "seq", FIELDS)


RUN_LATEST_SQL = f"""
SELECT user_id AS id, max(event_id) AS seq, arg_max(ts, event_id) AS updated_at,
  arg_max({STATUS_SQL}, event_id) AS status,
  arg_max('run ' || props, event_id) FILTER (event_type = 'signup') AS name,
  arg_max(value, event_id) FILTER (event_type = 'purchase') AS reward,
  arg_max('ap-' || event_id, event_id) FILTER (event_type = 'click') AS app_id
FROM events GROUP BY user_id
"""


def run_list(spark: SparkSession, folder: str) -> DataFrame:
    """Summaries of all runs, newest first."""
    created = table(spark, folder, "events").groupBy(F.col("user_id").alias("id")).agg(F.min("ts").alias("created_at"))
    return registry.run_list(run_latest(spark, folder).join(created, "id"))


def run_summary(spark: SparkSession, folder: str) -> DataFrame:
    lines = _lines(spark, folder)
    summary = registry.run_summary(log_ops.step_metrics(lines))
    shown = lines.where(F.col("line").startswith("loading")).select("run_id")
    return registry.with_trace_counts(summary, shown)


RUN_SUMMARY_SQL = f"""
WITH m AS ({STEP_METRICS_SQL}),
r AS (SELECT run_id, count(*) AS steps, arg_max({{'l': distillation_loss, 'r': reward, 'k': teacher_kl}}, step) AS last,
        arg_min({{'r': reward}}, step) AS first, min(distillation_loss) AS min_loss, max(distillation_loss) AS max_loss
      FROM m GROUP BY run_id),
t AS (SELECT 'run-' || user_id || '-' || (event_id // 1000) AS run_id, count(*) AS traces FROM events
      WHERE event_type = 'view' AND event_id % 7 <> 0 GROUP BY 1)
SELECT r.run_id, steps, last.l AS last_loss, last.r AS last_reward,
  coalesce(last.r, 0) - coalesce(first.r, 0) AS reward_change, last.k AS last_kl, min_loss, max_loss,
  coalesce(traces, 0) AS traces
FROM r LEFT JOIN t ON r.run_id = t.run_id
"""


def _stores(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as a run store holding one run."""
    event = F.col("event_id").cast("string")
    number = (F.col("event_id") % 10).cast("string")
    body = F.concat(
        F.lit('{"runs": [{"id": "run-'), event, F.lit('", "status": "'), _status(),
        F.lit('", "config": {"model": "m", "steps": '), number, F.lit('}, "metrics": [{"step": '), number,
        F.lit(', "reward": 0.5}, {"step": 10}], "logs": ["line '), event, F.lit('", "'), F.col("event_type"),
        F.lit('"]}]}'),
    )
    return runs.parse_run_stores(table(spark, folder, "events").select(body.alias("value")))


def run_store_metrics(spark: SparkSession, folder: str) -> DataFrame:
    stored = _stores(spark, folder)
    configured = stored.select(F.col("id").alias("run_id"), "status", F.col("config.steps").alias("configured"))
    # Sizes are estimated far too low where variants are left behind; by them Spark would broadcast a side that grows with the runs.
    return runs.run_metrics(stored).join(configured.hint("merge"), "run_id").drop("distillation_loss", "teacher_kl", "whole")


STORE_METRICS_SQL = f"""
SELECT 'run-' || event_id AS run_id, {STATUS_SQL} AS status, event_id % 10 AS configured, event_id % 10 AS step,
  0.5::DOUBLE AS reward FROM events
UNION ALL SELECT 'run-' || event_id, {STATUS_SQL}, event_id % 10, CAST(10 AS BIGINT), NULL FROM events
"""


def run_store_logs(spark: SparkSession, folder: str) -> DataFrame:
    """Stored log lines with one more line appended to each run."""
    prior = runs.run_logs(_stores(spark, folder))
    submitted = prior.select("run_id").distinct().select(
        "run_id", F.lit(2).alias("line_no"), F.lit("Submitted").alias("line")
    )
    return registry.append_log(prior, submitted)


STORE_LOGS_SQL = """
SELECT 'run-' || event_id AS run_id, n AS line_no, CASE n WHEN 0 THEN 'line ' || event_id WHEN 1 THEN event_type
  ELSE 'Submitted' END AS line
FROM events, (VALUES (0), (1), (2)) AS v(n)
"""


def _payloads(spark: SparkSession, folder: str) -> DataFrame:
    return as_payloads(table(spark, folder, "events"))


def as_payloads(events: DataFrame) -> DataFrame:
    """Events as ingest payloads: some with arrays, some with a status, some that must be refused."""
    kind, event = F.col("event_type"), F.col("event_id")
    number = event.cast("string")
    step, cents = (event % 10).cast("string"), F.floor(F.col("value") * 100).cast("string")
    measured = F.concat(
        F.lit('{"metrics": [1, {"step": '), step, F.lit(', "reward": "'), cents, F.lit('", "entropy": '), step,
        F.lit('}, {"step": 99}, {"step": "x"}], "status": "running"}'),
    )
    told = F.concat(
        F.lit('{"logs": ["line '), number, F.lit('", "done"], "traces": [{"id": "t'), number,
        F.lit('", "kl": 0.5}]}'),
    )
    body = (
        F.when(kind == "purchase", measured)
        .when(kind == "view", told)
        .when(kind == "click", F.lit('{"status": "completed"}'))
        .when((kind == "error") & (event % 2 == 0), F.lit('{"metrics": {"step": 1}, "status": "failed"}'))
        .when(kind == "error", F.lit('{"logs": null}'))
        .when(event % 2 == 0, F.lit("[1, 2]"))
        .otherwise(F.lit('{"metrics": ['))
    )
    return events.select(F.col("user_id").cast("string").alias("run_id"), event.alias("seq"), body.alias("payload"))


def _shown(current: DataFrame) -> DataFrame:
    entropy = F.try_variant_get(F.get("metrics", F.lit(0))["whole"], "$.entropy", "bigint")
    return ingest.typed(current).select(
        "run_id",
        "seq",
        "status",
        F.when(F.col("metrics").isNotNull(), F.size("metrics")).alias("n_metrics"),
        F.get("metrics", F.lit(0))["step"].alias("first_step"),
        F.get("metrics", F.lit(0))["reward"].alias("first_reward"),
        entropy.alias("first_entropy"),
        F.get("traces", F.lit(0))["id"].alias("trace"),
        F.array_join("logs", "|").alias("logs"),
    )


def ingest_versions(spark: SparkSession, folder: str) -> DataFrame:
    parsed = ingest.parse_payloads(_payloads(spark, folder))
    return _shown(ingest.current(ingest.accepted(parsed)))


INGEST_SQL = """
SELECT CAST(user_id AS VARCHAR) AS run_id, max(event_id) AS seq,
  arg_max(CASE event_type WHEN 'purchase' THEN 'running' ELSE 'completed' END, event_id)
    FILTER (event_type IN ('purchase', 'click')) AS status,
  max(CASE WHEN event_type = 'purchase' THEN 2 END) AS n_metrics,
  arg_max(event_id % 10, event_id) FILTER (event_type = 'purchase') AS first_step,
  arg_max(CAST(floor(value * 100) AS DOUBLE), event_id) FILTER (event_type = 'purchase') AS first_reward,
  arg_max(event_id % 10, event_id) FILTER (event_type = 'purchase') AS first_entropy,
  arg_max('t' || event_id, event_id) FILTER (event_type = 'view') AS trace,
  arg_max('line ' || event_id || '|done', event_id) FILTER (event_type = 'view') AS logs
FROM events WHERE event_type IN ('purchase', 'view', 'click') GROUP BY user_id
"""


def ingest_refused(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.quarantined(ingest.parse_payloads(_payloads(spark, folder))).select("run_id", "seq", "error")


REFUSED_SQL = """
SELECT CAST(user_id AS VARCHAR) AS run_id, event_id AS seq,
  CASE event_type WHEN 'error' THEN 'metrics, traces, and logs must be arrays' ELSE 'JSON body must be an object' END
    AS error
FROM events WHERE event_type IN ('error', 'signup')
"""


def stream_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """The same ingest as a stream; accepted versions are folded on read."""
    schema = table(spark, folder, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    out = fresh_path(spark, "ingest")
    live.ingest_payloads(as_payloads(events), f"{out}/data", f"{out}/refused", f"{out}/state").awaitTermination()
    return _shown(ingest.current(spark.read.parquet(f"{out}/data")))


def stream_run_upserts(spark: SparkSession, folder: str) -> DataFrame:
    """Run rows arriving as a stream of changes, folded to the newest row of each."""
    schema = table(spark, folder, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    changes = events.select("user_id", "event_id", "ts", _status().alias("status"))
    out = fresh_path(spark, "upserts")
    live.upsert_runs(changes, f"{out}/data", f"{out}/state").awaitTermination()
    versions = spark.read.parquet(f"{out}/data").drop(live.BATCH)
    return registry.newest_rows(versions, ["user_id"], "event_id")


UPSERTS_SQL = f"""
SELECT user_id, max(event_id) AS event_id, arg_max(ts, event_id) AS ts, arg_max({STATUS_SQL}, event_id) AS status
FROM events GROUP BY user_id
"""


def run_transitions(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("user_id", "event_id", _status().alias("status"))
    chunk = F.floor(F.col("event_id") / CHUNK_EVENTS)
    steps = registry.transitions(events, "user_id", ["event_id"], "status", chunk)
    return steps.withColumn("launchable", registry.launchable(F.col("status")))


TRANSITIONS_SQL = f"""
SELECT user_id, event_id, status, previous_status, status IN ('draft', 'failed') AS launchable,
  CASE WHEN previous_status IS NULL THEN status = 'draft' ELSE previous_status || '>' || status IN
    ('draft>queued', 'failed>queued', 'queued>running', 'queued>failed', 'running>completed', 'running>failed') END
    AS allowed
FROM (SELECT *, lag(status) OVER (PARTITION BY user_id ORDER BY event_id) AS previous_status
      FROM (SELECT user_id, event_id, {STATUS_SQL} AS status FROM events))
"""


def _configs(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as run configurations, good and bad."""
    priority = F.substring("o_orderpriority", 1, 1)
    by_priority = ("1", "sdpo", "2", "opd", "3", "harvey-sdpo", "4", "kimi-sdpo", "5", "ppo")
    names = F.create_map(*[F.lit(x) for x in by_priority])
    model = (
        F.when(F.col("o_orderstatus") == "F", " ")
        .when(F.col("o_custkey") % 5 == 0, "acme/unknown")
        .when(F.col("o_custkey") % 5 == 1, " Qwen/Qwen3.5-4B ")
        .otherwise("moonshotai/Kimi-K2.5")
    )
    return table(spark, folder, "orders").select(
        "o_orderkey",
        names[priority].alias("algorithm"),
        model.alias("model"),
        F.when(F.col("o_orderkey") % 11 != 0, F.lit("traces")).alias("dataset"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 150).alias("steps"),
        (F.col("o_custkey") % 3000).alias("train_rows"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey") % 700).alias("val_rows"),
    )


def config_violations(spark: SparkSession, folder: str) -> DataFrame:
    checked = registry.violations(registry.with_defaults(_configs(spark, folder)))
    return checked.select(
        "o_orderkey", "algorithm", "teacher_model", "steps", "train_rows", "val_rows", "topology",
        F.array_join("violations", ",").alias("violations"),
    )


CONFIGS_SQL = """
SELECT o_orderkey,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'sdpo' WHEN '2' THEN 'opd' WHEN '3' THEN 'harvey-sdpo'
    WHEN '4' THEN 'kimi-sdpo' ELSE 'ppo' END AS algorithm,
  CASE WHEN o_orderstatus = 'F' THEN '' WHEN o_custkey % 5 = 0 THEN 'acme/unknown'
    WHEN o_custkey % 5 = 1 THEN 'Qwen/Qwen3.5-4B' ELSE 'moonshotai/Kimi-K2.5' END AS model,
  CASE WHEN o_orderkey % 11 <> 0 THEN 'traces' ELSE '' END AS dataset,
  CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 150 ELSE 10 END AS steps, o_custkey % 3000 AS train_rows,
  CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 700 ELSE 16 END AS val_rows FROM orders
"""
VIOLATIONS_SQL = f"""
SELECT o_orderkey, algorithm, model AS teacher_model, steps, train_rows, val_rows, 'single-gpu' AS topology, concat_ws(',',
  CASE WHEN algorithm = 'ppo' THEN 'algorithm' END,
  CASE WHEN model = '' OR dataset = '' THEN 'model and dataset' END,
  CASE WHEN model = 'acme/unknown' THEN 'model catalogue' END,
  CASE WHEN steps NOT BETWEEN 1 AND 100 THEN 'steps' END,
  CASE WHEN train_rows NOT BETWEEN 1 AND 2048 THEN 'train_rows' END,
  CASE WHEN val_rows NOT BETWEEN 1 AND 512 THEN 'val_rows' END) AS violations
FROM ({CONFIGS_SQL})
"""


def draft_runs(spark: SparkSession, folder: str) -> DataFrame:
    at = F.lit("2024-01-02 03:04:05").cast("timestamp")
    made = registry.draft_runs(_configs(spark, folder), "o_orderkey", at)
    return made.select("id", "name", "status", "created_at", "config.model", "config.teacher_model", "config.steps")


DRAFT_RUNS_SQL = f"""
SELECT 'run_' || md5(o_orderkey || '@2024-01-02T03:04:05Z') AS id, algorithm || '_' || dataset AS name,
  'draft' AS status, '2024-01-02T03:04:05Z' AS created_at, model, model AS teacher_model, steps
FROM ({CONFIGS_SQL}) WHERE o_orderkey IN (SELECT o_orderkey FROM ({VIOLATIONS_SQL}) WHERE violations = '')
"""


def launch_requests(spark: SparkSession, folder: str) -> DataFrame:
    """A launch asked for every run in its newest state."""
    return registry.launch(run_latest(spark, folder), F.lit("2030-01-01 00:00:00").cast("timestamp_ntz"))


LAUNCH_SQL = f"""
SELECT id, CASE WHEN status IN ('draft', 'failed') THEN 'queued' ELSE status END AS status,
  CASE WHEN status IN ('draft', 'failed') THEN TIMESTAMP '2030-01-01 00:00:00' ELSE updated_at END AS updated_at,
  CASE WHEN status NOT IN ('draft', 'failed') THEN 'cannot launch a ' || status || ' run' END AS error
FROM ({RUN_LATEST_SQL})
"""


def config_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as configurations, checked against a catalogue table made of the part types of each brand."""
    catalogue = table(spark, folder, "part").groupBy(F.col("p_brand").alias("id")).agg(
        F.array_sort(F.collect_set("p_type")).alias("models")
    )
    parts = table(spark, folder, "part").select(
        "p_partkey",
        F.lit("sdpo").alias("algorithm"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(F.col("p_name")).alias("model"),
        F.col("p_brand").alias("dataset"),
        F.col("p_size").cast("bigint").alias("steps"),
        F.lit(64).alias("train_rows"),
        F.lit(16).alias("val_rows"),
    )
    checked = registry.violations(parts, catalogue)
    return checked.select("p_partkey", F.array_join("violations", ",").alias("violations"))


CATALOGUE_SQL = """
SELECT p_partkey, CASE WHEN m IN (SELECT p_type FROM part) THEN '' ELSE 'model catalogue' END AS violations
FROM (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_name END AS m FROM part)
"""


def _traces(spark: SparkSession, folder: str) -> DataFrame:
    return traces.with_tokens(table(spark, folder, "embeddings"), "embedding")


def token_preferences(spark: SparkSession, folder: str) -> DataFrame:
    return traces.token_table(_traces(spark, folder), "vec_id").drop("text")


TOKENS_SQL = """
SELECT vec_id, CAST(i - 1 AS INTEGER) AS position, delta, round(-1.7::DOUBLE + delta, 3) AS student_logprob,
       round(-1.7::DOUBLE + 2 * delta, 3) AS teacher_logprob, abs(delta) >= 0.25::DOUBLE AS selected
FROM (SELECT vec_id, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS delta FROM embeddings)
"""


def selected_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return _traces(spark, folder).select("vec_id", "label", "judge_selected")


QUERIES: dict[str, Query] = {
    "run_latest": run_latest,
    "run_list": run_list,
    "run_summary": run_summary,
    "run_store_metrics": run_store_metrics,
    "run_store_logs": run_store_logs,
    "ingest_versions": ingest_versions,
    "ingest_refused": ingest_refused,
    "stream_ingest": stream_ingest,
    "stream_run_upserts": stream_run_upserts,
    "run_transitions": run_transitions,
    "config_violations": config_violations,
    "draft_runs": draft_runs,
    "launch_requests": launch_requests,
    "config_catalogue": config_catalogue,
    "token_preferences": token_preferences,
    "selected_tokens": selected_tokens,
}

ORACLES: dict[str, str] = {
    "run_latest": RUN_LATEST_SQL,
    "run_list": f"""SELECT id, name, status, created_at, updated_at FROM ({RUN_LATEST_SQL})
        JOIN (SELECT user_id AS id, min(ts) AS created_at FROM events GROUP BY 1) USING (id)""",
    "run_summary": RUN_SUMMARY_SQL,
    "run_store_metrics": STORE_METRICS_SQL,
    "run_store_logs": STORE_LOGS_SQL,
    "ingest_versions": INGEST_SQL,
    "ingest_refused": REFUSED_SQL,
    "stream_ingest": INGEST_SQL,
    "stream_run_upserts": UPSERTS_SQL,
    "run_transitions": TRANSITIONS_SQL,
    "config_violations": VIOLATIONS_SQL,
    "draft_runs": DRAFT_RUNS_SQL,
    "launch_requests": LAUNCH_SQL,
    "config_catalogue": CATALOGUE_SQL,
    "token_preferences": TOKENS_SQL,
    "selected_tokens": """SELECT vec_id, label,
        CAST(len(list_filter(embedding, lambda d: abs(d::DOUBLE) >= 0.25::DOUBLE)) AS INTEGER) AS judge_selected
        FROM embeddings""",
}
