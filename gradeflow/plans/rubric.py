"""Rubric-graded tasks made from documents, labels and conversations."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeflow.functions import rubric as rf
from gradeflow.operators import rubric, splits
from gradeflow.plans import Query, table
from gradeflow.plans.conversations import FIELDS_SQL, fields, hash_split
from gradeflow.plans.scoring import line_criteria, trim_sql
from gradeflow.sources.documents import extract_documents
from gradeflow.sources.tasks import parse_scores, parse_tasks

STAMP = "2024-01-02 03:04:05"
STAMP_TEXT = "20240102T030405Z"


def _raw_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as a task whose criteria are its lines."""
    two_files = F.create_map(F.lit("b"), F.concat("lang", F.lit(".md")), F.lit("a"), F.lit("z.md"))
    named = F.when(F.col("n_chars") % 3 == 0, two_files)
    criteria = F.transform(
        line_criteria(F.col("text")),
        lambda c, i: F.struct(
            c["id"].alias("id"), c["title"].alias("title"), c["match_criteria"].alias("match_criteria"),
            F.when(
                F.col("n_chars") % 2 == 0, F.array(F.concat(F.lit("part"), (i % 3).cast("string")), F.lit("memo.docx"))
            ).otherwise(F.array().cast("array<string>")).alias("deliverables"),
        ),
    )
    return table(spark, folder, "documents").select(
        F.concat("lang", F.lit("/"), F.col("doc_id").cast("string")).alias("task_id"),
        F.substring("text", 1, 30).alias("title"),
        F.col("source").alias("work_type"),
        F.when(F.col("n_chars") % 5 != 0, F.col("text")).alias("instructions"),
        named.alias("deliverables"),
        criteria.alias("criteria"),
    )


def _tasks(spark: SparkSession, folder: str) -> DataFrame:
    """The same tasks, by way of the JSON text a task file holds."""
    body = F.struct("title", "work_type", "instructions", "deliverables", "criteria")
    return parse_tasks(_raw_tasks(spark, folder).select("task_id", F.to_json(body).alias("value")))


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents as judged tasks: results for two criteria and one unknown id, fields the engine doesn't know."""
    results = F.array(
        F.struct(F.lit("C1").alias("id"), F.lit("first").alias("title"),
                 F.when(F.col("quality") == 1, "pass").otherwise("fail").alias("verdict"), F.lit("seen").alias("reasoning"),
                 F.lit(2).alias("weight")),
        F.struct(F.lit("C2").alias("id"), F.lit("second").alias("title"),
                 F.lit(None).cast("string").alias("verdict"), F.lit("not seen").alias("reasoning"),
                 F.lit(None).cast("int").alias("weight")),
        F.struct(F.lit("X").alias("id"), F.lit("third").alias("title"),
                 F.lit("Fail").alias("verdict"), F.lit("odd").alias("reasoning"),
                 F.lit(None).cast("int").alias("weight")),
    )
    scores = F.struct(
        F.when(F.col("toxic") == 1, "Judged toxic").alias("summary"),
        (F.col("quality") / 2).alias("score"),
        (F.col("toxic") == 0).alias("all_pass"),
        results.alias("criteria_results"),
        F.col("lang").alias("judge_model"),
    )
    judged = table(spark, folder, "labels").join(table(spark, folder, "documents").select("doc_id", "lang"), "doc_id")
    task_id = F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"))
    return parse_scores(judged.select(task_id.alias("task_id"), F.to_json(scores).alias("value")))


TASKS_SQL = """
SELECT doc_id, lang || '/' || doc_id AS task_id, lang AS practice_area, substr(text, 1, 30) AS title, source AS work_type,
  CASE WHEN n_chars % 5 <> 0 THEN text ELSE '' END AS instructions, n_chars, lang,
  list_transform(string_split(text, chr(10)), lambda l, i:
    {'id': 'C' || i, 'title': substr(l, 1, 40), 'match_criteria': l}) AS criteria
FROM documents
"""
DELIVERABLES_SQL = """CASE WHEN n_chars % 2 = 0 THEN list_sort(list_distinct(
    list_transform(criteria, lambda c, i: 'part' || ((i - 1) % 3)) || ['memo.docx']))
  WHEN n_chars % 3 = 0 THEN list_sort([lang || '.md', 'z.md']) ELSE ['output.md'] END"""


def deliverables(spark: SparkSession, folder: str) -> DataFrame:
    return _tasks(spark, folder).select(
        "task_id", "practice_area", "instructions", F.array_join("deliverables", "|").alias("deliverables")
    )


def feedback_text(spark: SparkSession, folder: str) -> DataFrame:
    judged = rubric.with_scores(_tasks(spark, folder), _scores(spark, folder))
    return judged.select("task_id", "feedback", rf.scores_json(F.col("scores")).alias("scores_json"))


JUDGED_SQL = f"""
SELECT t.*, l.quality, l.toxic, l.doc_id IS NOT NULL AS judged,
  CASE WHEN l.doc_id IS NULL THEN
    array_to_string(list_transform(criteria[1:12], lambda c:
      '- ' || c.id || ' ' || c.title || ': ' || c.match_criteria), chr(10))
  ELSE CASE WHEN toxic = 1 THEN 'Judged toxic' ELSE 'Harvey LAB rubric feedback' END || chr(10)
    || CASE WHEN quality = 1 THEN '- PASS' ELSE '- FAIL' END || ' C1: first' || chr(10) || '  Judge reasoning: seen'
    || CASE WHEN quality = 0 AND criteria[1].match_criteria <> ''
         THEN chr(10) || '  Required standard: ' || criteria[1].match_criteria ELSE '' END
    || chr(10) || '- FAIL C2: second' || chr(10) || '  Judge reasoning: not seen'
    || CASE WHEN coalesce(criteria[2].match_criteria, '') <> ''
         THEN chr(10) || '  Required standard: ' || criteria[2].match_criteria ELSE '' END
    || chr(10) || '- FAIL X: third' || chr(10) || '  Judge reasoning: odd' END AS told
FROM ({TASKS_SQL}) t LEFT JOIN labels l ON t.doc_id = l.doc_id
"""
SCORES_JSON_SQL = """CASE WHEN judged THEN '{"all_pass":' || (toxic = 0) || ',"criteria_results":['
  || '{"id":"C1","reasoning":"seen","title":"first","verdict":"'
  || CASE WHEN quality = 1 THEN 'pass' ELSE 'fail' END || '","weight":2},{"id":"C2","reasoning":"not seen","title":"second"},'
  || '{"id":"X","reasoning":"odd","title":"third","verdict":"Fail"}],"judge_model":"' || lang || '","score":'
  || CASE WHEN quality = 1 THEN '0.5' ELSE '0.0' END || CASE WHEN toxic = 1 THEN ',"summary":"Judged toxic"}' ELSE '}' END
  ELSE '{}' END"""
FEEDBACK_SQL = f"SELECT task_id, {trim_sql('told', 3200)} AS feedback, {SCORES_JSON_SQL} AS scores_json FROM ({JUDGED_SQL})"


def fallback_attempt(spark: SparkSession, folder: str) -> DataFrame:
    """Attempts are at hand for long documents; the others get the fallback draft."""
    docs = table(spark, folder, "documents").where(F.col("n_chars") > 2000)
    attempts = docs.select(
        F.concat("lang", F.lit("/"), F.col("doc_id").cast("string")).alias("task_id"),
        F.concat(F.lit("Attempt on "), "source").alias("attempt"),
    )
    return rubric.with_attempts(_tasks(spark, folder), attempts).select("task_id", "attempt")


FALLBACK_SQL = """'# Draft work product for ' || title || chr(10) || chr(10)
  || 'This is an intentionally sparse baseline attempt generated for the SDPO smoke path.' || chr(10) || chr(10)
  || 'Open rubric-sensitive issues to address:' || chr(10)
  || array_to_string(list_transform(criteria[1:12], lambda c: '- TODO ' || c.id || ': ' || c.title), chr(10)) || chr(10)"""
ATTEMPT_SQL = f"""
SELECT task_id, CASE WHEN n_chars > 2000 THEN 'Attempt on ' || work_type ELSE {FALLBACK_SQL} END AS attempt
FROM ({TASKS_SQL})
"""


def _source_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """Each source of the documents as one task."""
    counted = (F.count("*").alias("n"), F.min("lang").alias("lang"))
    sources = table(spark, folder, "documents").groupBy("source").agg(*counted)
    return sources.select(
        F.col("source").alias("task_id"),
        F.concat(F.lit("Review of "), "source").alias("title"),
        F.col("lang").alias("work_type"),
        F.concat(F.lit("Read all "), F.col("n").cast("string"), F.lit(" documents.")).alias("instructions"),
        F.array(F.lit("memo.md"), F.concat("source", F.lit(".xlsx"))).alias("deliverables"),
        F.array(
            F.struct(F.lit("A").alias("id"), F.col("source").alias("title"), F.lit("cites all").alias("match_criteria"),
                     F.array().cast("array<string>").alias("deliverables"))
        ).alias("criteria"),
    )


def _source_documents(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    folder_end = F.when(F.col("doc_id") % 2 == 0, "/").otherwise("-a/")
    path = F.concat("lang", folder_end, F.col("doc_id").cast("string"), F.lit(".md"))
    return rubric.trimmed_documents(docs.select(F.col("source").alias("task_id"), path.alias("path"), "text"))


def prompt_build(spark: SparkSession, folder: str) -> DataFrame:
    tasks, documents = _source_tasks(spark, folder), _source_documents(spark, folder)
    plain = rubric.with_prompt(tasks, documents, prompt_chars=60_000).select("task_id", "prompt")
    graded = rubric.with_prompt(tasks, documents, include_rubric=True)
    return plain.join(graded.select("task_id", F.col("prompt").alias("graded_prompt")), "task_id")


def _prompt_sql(rubric_text: str, limit: int) -> str:
    gap = "chr(10) || chr(10)"
    whole = f"""'You are completing a Harvey LAB legal-agent benchmark task.' || {gap} || 'Task ID: ' || source || {gap}
      || 'Title: Review of ' || source || {gap} || 'Work type: ' || min(lang) || {gap}
      || 'Instructions: Read all ' || count(*) || ' documents.' || {gap} || 'Expected deliverables:' || {gap}
      || '- memo.md' || chr(10) || '- ' || source || '.xlsx' || {gap} || 'Source document excerpts:' || {gap}
      || string_agg(chr(10) || '### ' || path || chr(10) || body, {gap} ORDER BY string_split(path, '/')) || {gap}
      {rubric_text}
      || 'Draft the requested legal work product. Use clear headings and cite source documents when possible.'"""
    return f"""SELECT source AS task_id, {trim_sql("whole", limit)} AS prompt FROM (SELECT source, {whole} AS whole FROM (
      SELECT source, lang, lang || CASE WHEN doc_id % 2 = 0 THEN '/' ELSE '-a/' END || doc_id || '.md' AS path,
        {trim_sql("text", 1200)} AS body FROM documents) GROUP BY source)"""


GRADED_PART = """|| 'Rubric criteria for training feedback construction:' || chr(10) || chr(10)
  || '- A: ' || source || chr(10) || '  cites all' || chr(10) || chr(10)"""
PROMPT_SQL = f"""SELECT a.task_id, a.prompt, b.prompt AS graded_prompt FROM ({_prompt_sql("", 60_000)}) a
  JOIN ({_prompt_sql(GRADED_PART, 9000)}) b ON a.task_id = b.task_id"""


def _dialogue_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as tasks: the question's lines are the criteria, the answer is the attempt."""
    found = fields(spark, folder)
    return found.select(
        F.concat(F.lit("talk/"), F.col("conv_id").cast("string")).alias("task_id"),
        F.lit("talk").alias("practice_area"),
        F.lit("chat").alias("work_type"),
        hash_split("conv_id").alias("split"),
        F.col("prompt"),
        F.substring("prompt", 1, 20).alias("title"),
        line_criteria(F.col("prompt")).alias("criteria"),
        F.col("answer"),
    )


def rubric_records(spark: SparkSession, folder: str) -> DataFrame:
    tasks = _dialogue_tasks(spark, folder)
    attempts = tasks.where(F.col("answer") != "").select("task_id", F.col("answer").alias("attempt"))
    ready = rubric.with_scores(rubric.with_attempts(tasks, attempts), None)
    made = rubric.rubric_records(ready)
    return made.select(
        "data_source", "ability", "reward_model.ground_truth", F.col("prompt")[0]["content"].alias("prompt_content"),
        *[f"extra_info.{name}" for name in (
            "split", "task_id", "practice_area", "work_type", "original_prompt", "answer", "feedback_raw",
            "previous_attempt", "harvey_scores_json", "sdpo_bridge")],
        F.size("extra_info.reward_terms").alias("n_terms"),
    )


RUBRIC_RECORDS_SQL = rf"""
WITH t AS (SELECT 'talk/' || conv_id AS task_id, prompt, answer, substr(prompt, 1, 20) AS title,
    CASE WHEN substr(md5(CAST(conv_id AS VARCHAR)), 1, 1) < 'c' THEN 'train' ELSE 'test' END AS split,
    list_transform(string_split(prompt, chr(10)), lambda l, i:
      {{'id': 'C' || i, 'title': substr(l, 1, 40), 'match_criteria': l}}) AS criteria
  FROM ({FIELDS_SQL})),
a AS (SELECT *, CASE WHEN answer <> '' THEN answer ELSE {FALLBACK_SQL} END AS attempt,
    array_to_string(list_transform(criteria[1:12], lambda c:
      '- ' || c.id || ' ' || c.title || ': ' || c.match_criteria), chr(10)) AS told,
    regexp_replace(array_to_string(list_transform(criteria, lambda c: c.title || ' ' || c.match_criteria), ' '),
      '[^\x00-\x7F]', '_', 'g') AS raw FROM t),
f AS (SELECT *, {trim_sql("told", 3200)} AS feedback FROM a)
SELECT 'harvey/lab' AS data_source, 'legal_agent' AS ability, 'harvey_lab_rubric' AS ground_truth,
  CASE WHEN split = 'train' THEN prompt || chr(10) || chr(10) || 'Previous attempt:' || chr(10) || attempt
    || chr(10) || chr(10) || 'Harvey LAB rubric feedback:' || chr(10) || feedback || chr(10) || chr(10)
    || 'Use the feedback to produce a corrected legal work product. Preserve the requested deliverable structure.'
    ELSE prompt END AS prompt_content,
  split, task_id, 'talk' AS practice_area, 'chat' AS work_type, prompt AS original_prompt, 'harvey_lab_rubric' AS answer,
  CASE WHEN split = 'train' THEN feedback ELSE '' END AS feedback_raw,
  CASE WHEN split = 'train' THEN attempt ELSE '' END AS previous_attempt, '{{}}' AS harvey_scores_json, true AS sdpo_bridge,
  CAST(least(48, len(list_distinct(list_filter(list_transform(
      regexp_extract_all(raw, '["''`]([^"''`]{{3,80}})["''`]', 1)
      || regexp_extract_all(raw, '\b[0-9]+(?:\.[0-9]+)?%?x?\b')
      || regexp_extract_all(raw, '\b[A-Z][A-Za-z0-9&/-]*(?:\s+[A-Z][A-Za-z0-9&/-]*){{0,5}}\b'),
      lambda t: trim(regexp_replace(t, '\s+', ' ', 'g'))),
    lambda t: length(t) >= 3 AND lower(t) NOT IN ('pass', 'fail', 'agent', 'issue'))))) AS INTEGER) AS n_terms
FROM f
"""


def _split_tasks(spark: SparkSession, folder: str) -> DataFrame:
    tasks = table(spark, folder, "documents").select(
        F.concat("lang", F.lit("/"), F.col("doc_id").cast("string")).alias("task_id"), F.col("lang").alias("practice_area")
    )
    return splits.stratified_split(tasks, "task_id", "practice_area", train=8, preview=2)


def _runs(spark: SparkSession, folder: str, split: DataFrame) -> DataFrame:
    at = F.lit(STAMP).cast("timestamp")
    return rubric.run_rows(splits.generation_set(split), _scores(spark, folder), at)


def run_rows(spark: SparkSession, folder: str) -> DataFrame:
    return _runs(spark, folder, _split_tasks(spark, folder))


POSITIONS_SQL = """SELECT *, row_number() OVER (ORDER BY rank, lang) AS position FROM (
    SELECT doc_id, lang, lang || '/' || doc_id AS task_id,
      row_number() OVER (PARTITION BY lang ORDER BY md5('17/' || lang || '/' || doc_id)) AS rank FROM documents)"""
RUN_ROWS_SQL = f"""
SELECT p.task_id, CASE WHEN position <= 8 THEN 'train' ELSE 'eval_preview' END AS split,
  'harvey_sdpo/' || p.task_id || '/qwen36_35b_a3b/{STAMP_TEXT}' AS run_id, quality / 2 AS score, toxic = 0 AS all_pass
FROM ({POSITIONS_SQL}) p LEFT JOIN labels l ON p.doc_id = l.doc_id WHERE position <= 10
"""


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    split = _split_tasks(spark, folder)
    return rubric.manifest(
        split, _runs(spark, folder, split), id_col="task_id", created_at=F.lit(STAMP), model="student",
        paths={"train_parquet": "records/split=train", "test_parquet": "records/split=test"},
    )


_LISTED = "string_agg('\"' || task_id || '\"', ',' ORDER BY position) FILTER ({which})"
_NOTES_JSON = json.dumps(rubric.NOTES, separators=(",", ":")).replace("'", "''")
MANIFEST_SQL = f"""
SELECT '{{"created_at":"{STAMP}","model":"student","train_tasks":[' || train || '],"heldout_eval_count":' || held
  || ',"eval_preview_tasks":[' || preview || '],"runs":[' || runs
  || '],"paths":{{"train_parquet":"records/split=train","test_parquet":"records/split=test"}},"notes":{_NOTES_JSON}}}' AS manifest
FROM (SELECT {_LISTED.format(which="position <= 8")} AS train, {_LISTED.format(which="position IN (9, 10)")} AS preview,
        count(*) FILTER (position > 8) AS held FROM ({POSITIONS_SQL})),
  (SELECT string_agg('{{"task_id":"' || task_id || '","split":"' || split || '","run_id":"' || run_id || '"'
      || CASE WHEN score IS NULL THEN '' WHEN score = 0 THEN ',"score":0.0' ELSE ',"score":0.5' END
      || coalesce(',"all_pass":' || all_pass, '') || '}}', ',' ORDER BY task_id) AS runs FROM ({RUN_ROWS_SQL}))
"""


def document_counts(spark: SparkSession, folder: str) -> DataFrame:
    return rubric.document_counts(_source_documents(spark, folder))


def document_extract(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and pages as files of four kinds: mail, web mail, plain and unknown."""
    docs = table(spark, folder, "documents")
    number = F.col("doc_id").cast("string")
    kind = F.when(F.col("doc_id") % 3 == 0, ".MD").when(F.col("doc_id") % 3 == 1, ".txt").otherwise(".pdf")
    plain = docs.select(
        F.concat(F.lit("notes/"), number, kind).alias("path"), F.encode("text", "utf-8").alias("content")
    )
    head = F.lit("Subject: note\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n")
    mail = docs.select(
        F.concat(F.lit("mail/"), number, F.lit(".eml")).alias("path"),
        F.encode(F.concat(head, "text"), "utf-8").alias("content"),
    )
    head = F.lit("Subject: page\nContent-Type: text/html; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n")
    pages = table(spark, folder, "pages").select(
        F.concat(F.lit("web/"), F.col("page_id").cast("string"), F.lit(".eml")).alias("path"),
        F.encode(F.concat(head, F.regexp_replace("html", r"\r\n?", "\n")), "utf-8").alias("content"),
    )
    return extract_documents(plain.unionByName(mail).unionByName(pages), 1200)


DOCUMENTS_SQL = f"""
SELECT 'notes/' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.MD' WHEN 1 THEN '.txt' ELSE '.pdf' END AS path,
  CASE WHEN doc_id % 3 = 2 THEN '(document available but not extracted: ' || doc_id || '.pdf)'
    ELSE {trim_sql("text", 1200)} END AS text FROM documents
UNION ALL SELECT 'mail/' || doc_id || '.eml', {trim_sql("text", 1200)} FROM documents
UNION ALL SELECT 'web/' || page_id || '.eml', {trim_sql("body", 1200)}
  FROM (SELECT page_id, regexp_replace(html, '\\r\\n?', chr(10), 'g') AS body FROM pages)
"""

QUERIES: dict[str, Query] = {
    "deliverables": deliverables,
    "feedback_text": feedback_text,
    "fallback_attempt": fallback_attempt,
    "prompt_build": prompt_build,
    "rubric_records": rubric_records,
    "run_rows": run_rows,
    "manifest": manifest,
    "document_counts": document_counts,
    "document_extract": document_extract,
}

ORACLES: dict[str, str] = {
    "deliverables": f"""SELECT task_id, practice_area, instructions, array_to_string({DELIVERABLES_SQL}, '|') AS deliverables
        FROM ({TASKS_SQL})""",
    "feedback_text": FEEDBACK_SQL,
    "fallback_attempt": ATTEMPT_SQL,
    "prompt_build": PROMPT_SQL,
    "rubric_records": RUBRIC_RECORDS_SQL,
    "run_rows": RUN_ROWS_SQL,
    "manifest": MANIFEST_SQL,
    "document_counts": """SELECT source AS task_id, count(*) AS documents_read, count(*) AS total_vdr_files
        FROM documents GROUP BY 1""",
    "document_extract": DOCUMENTS_SQL,
}
