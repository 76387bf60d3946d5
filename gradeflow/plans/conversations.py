"""Conversations and documents as chat records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeflow.functions.conversation import HINT_PLACEMENTS, exported_conversation_fields, first_turn, trajectory_of, with_hint
from gradeflow.operators import records
from gradeflow.operators.conversations import conversation_fields, turn_arrays, with_hints
from gradeflow.operators.ordering import first_rows, with_row_index
from gradeflow.operators.traces import with_teacher_prompt
from gradeflow.plans import Query, table
from gradeflow.session import fresh_path
from gradeflow.sources import datasets

DIALOGUE_SUFFIX = "Answer in full."
STATIC_FEEDBACK = "Check every step."


def hash_split(key: str) -> Column:
    """Three of four rows to train, by the first hex digit of the key's hash."""
    return F.when(F.substring(F.md5(F.col(key).cast("string")), 1, 1) < "c", "train").otherwise("test")


HASH_SPLIT_SQL = "CASE WHEN substr(md5(CAST({key} AS VARCHAR)), 1, 1) < 'c' THEN 'train' ELSE 'test' END"


def fields(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_fields(table(spark, folder, "conversations"))


FIELDS_SQL = """
SELECT conv_id,
       coalesce(arg_min(text, turn) FILTER (role IN ('human', 'user')), arg_min(text, turn), '') AS prompt,
       coalesce(arg_max(text, turn) FILTER (role IN ('gpt', 'assistant', 'agent')), '') AS answer,
       string_agg(CASE WHEN role = '' THEN 'turn' ELSE role END || ': ' || text, chr(10) ORDER BY turn) AS trajectory
FROM (SELECT conv_id, turn, lower(coalesce(role, '')) AS role, coalesce(text, '') AS text FROM conversations)
GROUP BY conv_id
"""


def flat(record: DataFrame, *extra: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """A record's scalar parts, so that results compare column by column."""
    return record.select(
        *keep,
        "data_source",
        "ability",
        F.col("prompt")[0]["role"].alias("prompt_role"),
        F.col("prompt")[0]["content"].alias("prompt_content"),
        "reward_model.style",
        "reward_model.ground_truth",
        *[f"extra_info.{name}" for name in extra],
    )


FEEDBACK_EXTRA = (
    "split", "index", "original_prompt", "answer", "feedback_raw", "previous_attempt", "sdpo_bridge"
)


def chat_records(spark: SparkSession, folder: str) -> DataFrame:
    split = fields(spark, folder).withColumn("split", hash_split("conv_id"))
    indexed = with_row_index(split, ["conv_id"], by=["split"])
    made = records.conversation_records(
        indexed, index="index", split="split", data_source="agent/dialogues", suffix=DIALOGUE_SUFFIX
    )
    return flat(made, *FEEDBACK_EXTRA)


TRIM = "trim({x}, ' ' || chr(9) || chr(10) || chr(13))"
FILLED_SQL = """'' || asked || chr(10) || chr(10) || 'Previous attempt:' || chr(10) || previous_attempt
       || chr(10) || chr(10) || 'Environment feedback:' || chr(10) || feedback_raw
       || chr(10) || chr(10) || 'Use the feedback to produce a corrected solution.'"""

CHAT_RECORDS_SQL = f"""
WITH f AS ({FIELDS_SQL}),
s AS (SELECT *, {HASH_SPLIT_SQL.format(key="conv_id")} AS split FROM f),
r AS (SELECT split, row_number() OVER (PARTITION BY split ORDER BY conv_id) - 1 AS index, prompt, answer,
             'Successful reference trajectory:' || chr(10) || trajectory AS feedback_raw,
             trajectory AS previous_attempt,
             {TRIM.format(x="prompt")} || ' {DIALOGUE_SUFFIX}' AS asked FROM s)
SELECT 'agent/dialogues' AS data_source, 'agent' AS ability, 'user' AS prompt_role, {FILLED_SQL} AS prompt_content,
       'rule' AS style, answer AS ground_truth, split, index, prompt AS original_prompt, answer, feedback_raw,
       previous_attempt, true AS sdpo_bridge FROM r
"""


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as question rows; feedback and attempt are null where there is no such label."""
    judged = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    return judged.select(
        "doc_id",
        F.col("text").alias("question"),
        F.col("source").alias("answer"),
        F.when(F.col("quality") == 0, F.concat(F.lit("Graded low: "), "lang")).alias("note"),
        F.when(F.col("toxic") == 1, F.concat(F.lit("Draft of "), "source")).alias("draft"),
        hash_split("doc_id").alias("split"),
    )


LABELLED_SQL = f"""
SELECT d.doc_id, d.text AS question, d.source AS answer,
       CASE WHEN quality = 0 THEN 'Graded low: ' || lang END AS note,
       CASE WHEN toxic = 1 THEN 'Draft of ' || source END AS draft,
       {HASH_SPLIT_SQL.format(key="d.doc_id")} AS split,
       row_number() OVER (PARTITION BY {HASH_SPLIT_SQL.format(key="d.doc_id")} ORDER BY d.doc_id) - 1 AS index
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""


def question_records(spark: SparkSession, folder: str) -> DataFrame:
    rows = with_row_index(_labelled(spark, folder), ["doc_id"], by=["split"])
    made = records.question_records(
        rows, index="index", split="split", data_source="docs/qa", feedback="note", attempt="draft", ability="text"
    )
    return flat(made, *FEEDBACK_EXTRA)


def _question_sql(suffix: str, static: str, closing: str, family: str) -> str:
    shown = f"coalesce(nullif(note, ''), '{static}')"
    template = FILLED_SQL.removesuffix("corrected solution.'") + f"corrected solution.{closing}'"
    return f"""
WITH s AS ({LABELLED_SQL}),
r AS (SELECT doc_id, split, index, question, answer, {shown} AS feedback_raw, coalesce(draft, '') AS previous_attempt,
             {TRIM.format(x="question")} || ' {suffix}' AS asked FROM s)
SELECT {"doc_id," if family else ""} 'docs/qa' AS data_source, 'text' AS ability, 'user' AS prompt_role,
       CASE WHEN previous_attempt <> '' OR feedback_raw <> '' THEN {template} ELSE asked END AS prompt_content,
       'rule' AS style, answer AS ground_truth, split, index, question AS original_prompt, answer, feedback_raw,
       previous_attempt, true AS sdpo_bridge{f", '{family}' AS target_model_family" if family else ""} FROM r
"""


def large_model_records(spark: SparkSession, folder: str) -> DataFrame:
    rows = with_row_index(_labelled(spark, folder), ["doc_id"], by=["split"])
    made = records.question_records(
        rows,
        index="index",
        split="split",
        data_source="docs/qa",
        feedback="note",
        attempt="draft",
        ability="text",
        suffix=records.LARGE_MODEL_SUFFIX,
        static_feedback=STATIC_FEEDBACK,
        template=records.LARGE_MODEL_REPROMPT,
        family=records.LARGE_MODEL_FAMILY,
        keep_source=True,
    )
    return flat(made, *FEEDBACK_EXTRA, "target_model_family", keep=("doc_id",))


def distillation_records(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    rows = with_row_index(docs.withColumn("part", hash_split("doc_id")), ["doc_id"], by=["part"], name="at")
    made = records.distillation_records(
        rows, index="at", split="part", data_source="docs/distil", question="text", answer="quality", suffix="Go on."
    )
    return made.select(
        "doc_id", "lang", "source", "n_chars", "data_source", "ability",
        F.col("prompt")[0]["content"].alias("prompt_content"),
        "reward_model.ground_truth", "extra_info.split", "extra_info.index", "extra_info.answer",
        F.col("extra_info.prompt").alias("original_prompt"),
    )


DISTILLATION_SQL = f"""
SELECT d.doc_id, lang, source, n_chars, 'docs/distil' AS data_source, 'general' AS ability,
       text || ' Go on.' AS prompt_content, coalesce(CAST(quality AS VARCHAR), 'None') AS ground_truth,
       {HASH_SPLIT_SQL.format(key="d.doc_id")} AS split,
       row_number() OVER (PARTITION BY {HASH_SPLIT_SQL.format(key="d.doc_id")} ORDER BY d.doc_id) - 1 AS index,
       coalesce(CAST(quality AS VARCHAR), 'None') AS answer, text AS original_prompt
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""


def capped_records(spark: SparkSession, folder: str) -> DataFrame:
    """The row cap itself: the first rows of the split, in id order."""
    return first_rows(table(spark, folder, "documents").select("doc_id", "lang", "n_chars"), 64, ["doc_id"])


def split_counts(spark: SparkSession, folder: str) -> DataFrame:
    return records.split_counts(table(spark, folder, "documents"), hash_split("doc_id"))


def exported_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations written as JSON lines of ``from``/``value`` turns and read back as records."""
    path = fresh_path(spark, "exported")
    whole = turn_arrays(table(spark, folder, "conversations"))
    turns = F.transform("turns", lambda t: F.struct(t["role"].alias("from"), t["text"].alias("value")))
    whole.select("conv_id", turns.alias("conversations")).write.json(path)
    back = datasets.read_json_lines(spark, path, "conv_id bigint, conversations variant")
    read = back.select("conv_id", exported_conversation_fields(F.col("conversations")).alias("f"))
    return read.select("conv_id", "f.*")


def record_files(spark: SparkSession, folder: str) -> DataFrame:
    """Records written as plain Parquet by split, read back split by split."""
    rows = with_row_index(_labelled(spark, folder), ["doc_id"], by=["split"])
    made = records.question_records(
        rows, index="index", split="split", data_source="docs/qa", ability="text", suffix="", static_feedback=""
    )
    path = fresh_path(spark, "records")
    datasets.write_records(made, path)
    parts = [datasets.read_records(spark, path, name) for name in ("train", "test")]
    return parts[0].unionByName(parts[1]).select(
        "split", "extra_info.index", F.col("prompt")[0]["content"].alias("content"), "reward_model.ground_truth"
    )


def teacher_prompts(spark: SparkSession, folder: str) -> DataFrame:
    return with_teacher_prompt(fields(spark, folder), "prompt", "answer").select("conv_id", "teacher_prompt")


def _wrong(role: Column, text: Column) -> Column:
    return (role == "assistant") & (F.char_length(text) % 3 == 0)


def _hints(turns: DataFrame) -> DataFrame:
    """A hint for four of five conversations."""
    told = F.when(F.col("conv_id") % 5 != 0, F.concat(F.lit("Mind the "), F.count("*").cast("string"), F.lit(" turns")))
    return turns.groupBy("conv_id").agg(told.alias("hint"))


def hint_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Each conversation with its hint in each place, turn by turn."""
    turns = table(spark, folder, "conversations")
    wrong = _wrong(F.col("role"), F.col("text"))
    placed = [with_hints(turns, _hints(turns), p, wrong).withColumn("placement", F.lit(p)) for p in HINT_PLACEMENTS]
    return placed[0].union(placed[1]).union(placed[2])


def hint_arrays(spark: SparkSession, folder: str) -> DataFrame:
    """The same as one array of turns for each conversation and place, written as a trajectory."""
    turns = table(spark, folder, "conversations")
    held = turn_arrays(turns).join(_hints(turns), "conv_id")
    mistake = first_turn(F.col("turns"), lambda t: _wrong(t["role"], t["text"]))
    plain = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    shown = [F.struct(F.lit(p).alias("placement"), trajectory_of(with_hint(plain, F.col("hint"), p, mistake)).alias("trajectory")) for p in HINT_PLACEMENTS]
    return held.select("conv_id", F.explode(F.array(*shown)).alias("s")).select("conv_id", "s.placement", "s.trajectory")


HINT_TURNS_SQL = """
WITH e AS (SELECT conv_id, min(turn) AS first, max(turn) AS last, min(turn) FILTER (role = 'assistant' AND length(text) % 3 = 0) AS mistake,
             CASE WHEN conv_id % 5 <> 0 THEN 'Mind the ' || count(*) || ' turns' END AS hint FROM conversations GROUP BY conv_id),
p AS (SELECT conv_id, hint, placement, CASE WHEN hint IS NOT NULL THEN CASE placement WHEN 'system' THEN first WHEN 'after-trace' THEN last + 1 ELSE mistake END END AS place
      FROM e, (VALUES ('before-mistake'), ('after-trace'), ('system')) AS v(placement))
SELECT conv_id, turn + coalesce(CAST(turn >= place AS INTEGER), 0) AS turn, role, text, placement FROM conversations JOIN p USING (conv_id)
UNION ALL SELECT conv_id, place, CASE placement WHEN 'system' THEN 'system' ELSE 'user' END, hint, placement FROM p WHERE place IS NOT NULL
"""
HINT_ARRAYS_SQL = f"""SELECT conv_id, placement, string_agg(CASE WHEN coalesce(role, '') = '' THEN 'turn' ELSE lower(role) END || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS trajectory
FROM ({HINT_TURNS_SQL}) GROUP BY conv_id, placement"""

QUERIES: dict[str, Query] = {
    "conversation_fields": fields,
    "chat_records": chat_records,
    "question_records": question_records,
    "large_model_records": large_model_records,
    "distillation_records": distillation_records,
    "capped_records": capped_records,
    "split_counts": split_counts,
    "exported_conversations": exported_conversations,
    "record_files": record_files,
    "teacher_prompts": teacher_prompts,
    "hint_turns": hint_turns,
    "hint_arrays": hint_arrays,
}

ORACLES: dict[str, str] = {
    "conversation_fields": FIELDS_SQL,
    "chat_records": CHAT_RECORDS_SQL,
    "question_records": _question_sql(records.ANSWER_SUFFIX, "", "", ""),
    "large_model_records": _question_sql(
        records.LARGE_MODEL_SUFFIX, STATIC_FEEDBACK, " Keep only useful reasoning.", records.LARGE_MODEL_FAMILY
    ),
    "distillation_records": DISTILLATION_SQL,
    "capped_records": "SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 64",
    "split_counts": f"SELECT {HASH_SPLIT_SQL.format(key='doc_id')} AS split, count(*) AS rows FROM documents GROUP BY 1",
    "exported_conversations": f"SELECT conv_id, prompt, answer, trajectory FROM ({FIELDS_SQL})",
    "record_files": f"""SELECT split, index, {TRIM.format(x="question")} AS content, answer AS ground_truth
        FROM ({LABELLED_SQL})""",
    "teacher_prompts": f"""SELECT conv_id, prompt || chr(10) || chr(10) || 'Privileged feedback: ' || answer
        AS teacher_prompt FROM ({FIELDS_SQL})""",
    "hint_turns": HINT_TURNS_SQL,
    "hint_arrays": HINT_ARRAYS_SQL,
}
