"""Files written in many shapes and read back: JSON lists and documents, task trees, listings, arriving JSON lines, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeflow.functions.rubric import scores_json
from gradeflow.operators import registry, rubric
from gradeflow.operators.ordering import first_rows
from gradeflow.plans import Query, table
from gradeflow.plans.live import _cut
from gradeflow.plans.logs import STATE_SQL, as_lines
from gradeflow.plans.registry import FIELDS, RUN_LATEST_SQL, _changes
from gradeflow.session import fresh_path
from gradeflow.sources import datasets, tasks
from gradeflow.sources.logs import stream_log_lines
from gradeflow.streaming import runs as live

ROW = "doc_id bigint, text string, lang string"
ROWS_PER_FILE = 100
CAP = 12_000


def _files_of_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in runs of ids, each run the rows of one file."""
    row = F.struct("doc_id", "text", "lang")
    near = F.floor(F.col("doc_id") / ROWS_PER_FILE).alias("file")
    return table(spark, folder, "documents").groupBy(near).agg(F.array_sort(F.collect_list(row)).alias("rows"))


def _bodies(spark: SparkSession, folder: str) -> DataFrame:
    """``shape, file, value``: each run of documents as a list and as an object. Runs are rows of one shuffle; being one row each, they need no other one."""
    files = _files_of_rows(spark, folder).select("file", F.to_json("rows").alias("rows"))
    wrapped = F.concat(F.lit('{"made": {"by": "x"}, "size": 1, "rows": '), "rows", F.lit(', "more": [1]}'))
    shapes = [F.struct(F.lit(name).alias("shape"), F.col("file"), body.alias("value")) for name, body in (("lists", F.col("rows")), ("objects", wrapped))]
    return files.select(F.inline(F.array(*shapes)))


def json_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as JSON lists, as objects with a named list, and as objects whose first list counts, each read back as a split."""
    out = fresh_path(spark, "json")
    _bodies(spark, folder).write.partitionBy("shape", "file").text(out)
    lists = datasets.read_splits(spark, f"{out}/shape=lists/*", None, reader=datasets.read_json_list, schema=ROW)
    named = datasets.read_json_member(spark, f"{out}/shape=objects/*", ROW, "rows").withColumn("split", F.lit("named"))
    first = datasets.read_json_member(spark, f"{out}/shape=objects/*", ROW).withColumn("split", F.lit("first"))
    return datasets.select_split(lists, "test").unionByName(datasets.select_split(lists, "train")).unionByName(named).unionByName(first)


JSON_SQL = "SELECT doc_id, text, lang, split FROM documents, (VALUES ('train'), ('test'), ('named'), ('first')) AS s(split)"


def task_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of documents as rubric tasks in a tree of files, half of them judged, read back and joined."""
    out = fresh_path(spark, "tree")
    docs = table(spark, folder, "documents")
    criterion = F.struct(
        F.concat(F.lit("C"), F.col("doc_id").cast("string")).alias("id"), F.coalesce("source", F.lit("")).alias("title"),
        F.coalesce("text", F.lit("")).alias("match_criteria"), F.array(F.concat("lang", F.lit(".md"))).alias("deliverables"),
    )
    place = F.floor(F.col("doc_id") / ROWS_PER_FILE)
    made = docs.groupBy((place % 3).alias("area"), place.alias("id")).agg(F.array_sort(F.collect_list(criterion)).alias("criteria"), F.max("n_chars").alias("chars"))
    body = F.struct(F.concat(F.lit("Task "), F.col("id").cast("string")).alias("title"), F.lit("work").alias("work_type"), F.lit(None).cast("string").alias("instructions"), "criteria")
    made.select("area", "id", F.to_json(body).alias("value")).repartition("area", "id").write.partitionBy("area", "id").text(f"{out}/tasks")
    judged = F.to_json(F.struct(F.lit("ok").alias("summary"), (F.col("chars") / 2).alias("score"), (F.col("chars") % 2 == 0).alias("all_pass")))
    made.where("id % 2 = 0").select("area", "id", judged.alias("value")).repartition("area", "id").write.partitionBy("area", "id").text(f"{out}/scores")
    both = rubric.with_scores(tasks.read_tasks(spark, out, "part-*"), tasks.read_scores(spark, out, "part-*"))
    return both.select(
        "task_id", "practice_area", "title", "work_type", "instructions", F.array_join("deliverables", "|").alias("deliverables"),
        F.size("criteria").cast("long").alias("criteria"), F.md5(F.array_join(F.transform("criteria", lambda c: F.concat(c["id"], F.lit("/"), c["match_criteria"])), "|")).alias("digest"),
        F.col("scores.score").alias("score"), F.col("scores.all_pass").alias("all_pass"), (scores_json(F.col("scores")) == "{}").alias("unjudged"),
    )


TREE_SQL = f"""
WITH t AS (SELECT doc_id // {ROWS_PER_FILE} AS id, max(n_chars) AS chars, count(*) AS criteria, list_sort(list(DISTINCT lang || '.md')) AS files,
             md5(string_agg('C' || doc_id || '/' || coalesce(text, ''), '|' ORDER BY 'C' || doc_id)) AS digest FROM documents GROUP BY 1)
SELECT 'area=' || id % 3 || '/id=' || id AS task_id, 'area=' || id % 3 AS practice_area, 'Task ' || id AS title, 'work' AS work_type, '' AS instructions,
  array_to_string(files, '|') AS deliverables, criteria, digest, CASE WHEN id % 2 = 0 THEN chars / 2::DOUBLE END AS score,
  CASE WHEN id % 2 = 0 THEN chars % 2 = 0 END AS all_pass, id % 2 <> 0 AS unjudged FROM t
"""


def document_listing(spark: SparkSession, folder: str) -> DataFrame:
    """Documents written below their task in folders two deep, counted from the paths, folders among them."""
    out = fresh_path(spark, "listing")
    docs = table(spark, folder, "documents").select(
        F.col("lang").alias("task"), F.lit("documents").alias("kind"), F.coalesce("source", F.lit("none")).alias("source"), (F.col("doc_id") % 4).alias("part"), F.coalesce("text", F.lit("")).alias("value")
    )
    # One file for each folder: the rows of one are dealt to one task.
    docs.repartition("task", "source", "part").write.partitionBy("task", "kind", "source", "part").text(f"{out}/tasks")
    return rubric.entry_counts(tasks.list_documents(spark, out, "kind=documents"))


LISTING_SQL = """
SELECT 'task=' || lang AS task_id, n AS documents_read, n AS total_vdr_files FROM (
  SELECT lang, count(DISTINCT coalesce(source, 'none')) + 2 * count(DISTINCT coalesce(source, 'none') || '/' || doc_id % 4) AS n FROM documents GROUP BY lang)
"""


def stream_json_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Log lines that arrive as JSON records in parts, taken in by a stream after each."""
    out = fresh_path(spark, "json-lines")
    for part in _cut(table(spark, folder, "events")):
        as_lines(part).withColumn("line", F.concat("line", F.lit(" \t"))).write.mode("append").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(f"{out}/in")
        live.run_state(stream_log_lines(spark, f"{out}/in"), f"{out}/data", f"{out}/state").awaitTermination()
    found = live.read_newest(spark, f"{out}/data", ["run_id"])
    return found.withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))


def run_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """The runs that belong to the busiest user, looked up in stored runs by a filter that the scan takes."""
    out = fresh_path(spark, "runs")
    registry.newest(_changes(spark, folder).withColumn("id", F.col("id").cast("string")), "id", "seq", FIELDS).write.parquet(out)
    busiest = table(spark, folder, "events").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").first()
    return registry.run_lookup(spark.read.parquet(out), str(busiest["user_id"]) if busiest else "")


LOOKUP_SQL = f"""SELECT * REPLACE (CAST(id AS VARCHAR) AS id) FROM ({RUN_LATEST_SQL})
WHERE id = (SELECT user_id FROM events GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 1)"""


def capped_many(spark: SparkSession, folder: str) -> DataFrame:
    """A cap above what one task sorts: positions are counted over all partitions."""
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return first_rows(rows, CAP, ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"])


CAPPED_SQL = f"SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem ORDER BY ALL LIMIT {CAP}"


def run_latest_cleared(spark: SparkSession, folder: str) -> DataFrame:
    """Newest fields of runs, where an error clears the app id and a view the reward."""
    cleared = F.when(F.col("status") == "failed", F.array(F.lit("app_id"))).when(F.col("status") == "queued", F.array(F.lit("reward"), F.lit("no such field")))
    return registry.newest(_changes(spark, folder), "id", "seq", FIELDS, cleared)


CLEARED_SQL = """
SELECT * EXCLUDE (user_id, last_app, last_error, last_paid, last_view)
  REPLACE (CASE WHEN last_app > coalesce(last_error, -1) THEN app_id END AS app_id, CASE WHEN last_paid > coalesce(last_view, -1) THEN reward END AS reward)
FROM (%s) r JOIN (SELECT user_id, max(event_id) FILTER (event_type = 'click') AS last_app, max(event_id) FILTER (event_type = 'error') AS last_error,
    max(event_id) FILTER (event_type = 'purchase' AND value IS NOT NULL) AS last_paid, max(event_id) FILTER (event_type = 'view') AS last_view FROM events GROUP BY user_id) c ON id = user_id
""" % RUN_LATEST_SQL

QUERIES: dict[str, Query] = {
    "json_sources": json_sources,
    "task_tree": task_tree,
    "document_listing": document_listing,
    "stream_json_lines": stream_json_lines,
    "run_lookup": run_lookup,
    "capped_many": capped_many,
    "run_latest_cleared": run_latest_cleared,
}

ORACLES: dict[str, str] = {
    "json_sources": JSON_SQL,
    "task_tree": TREE_SQL,
    "document_listing": LISTING_SQL,
    "stream_json_lines": STATE_SQL,
    "run_lookup": LOOKUP_SQL,
    "capped_many": CAPPED_SQL,
    "run_latest_cleared": CLEARED_SQL,
}
