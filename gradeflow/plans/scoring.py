"""Answer extraction, rewards and text functions over the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeflow.functions import reward, text
from gradeflow.operators.scoring import score, score_responses
from gradeflow.plans import Query, table
from gradeflow.plans.conversations import FIELDS_SQL, fields


def _cased(cases: list[Column]) -> Column:
    picked = cases[-1]
    for at, value in enumerate(cases[:-1]):
        picked = F.when(F.col("doc_id") % len(cases) == at, value).otherwise(picked)
    return picked


def responses(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as a response, with its final answer given in one of six ways, and the truth."""
    body = F.col("text")
    doc, size = F.col("doc_id").cast("string"), F.col("n_chars").cast("string")
    solution = _cased([
        F.concat(body, F.lit("\n#### "), size, F.lit(",000 ")),
        F.concat(body, F.lit(" <Answer>\n"), F.col("lang"), F.lit(" </ANSWER> tail")),
        F.concat(F.lit("\\boxed{"), doc, F.lit("} "), body),
        F.concat(body, F.lit(" total -"), size, F.lit(".5 kg")),
        F.concat(body, F.lit(" so it is b")),
        body,
    ])
    truth = _cased([
        F.concat(size, F.lit("000")),
        F.concat(F.upper("lang"), F.lit(" ")),
        F.concat(F.lit("x"), doc),
        F.concat(F.lit("- "), size, F.lit(".5")),
        F.lit("B"),
        F.lit("the"),
    ])
    judged = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    return judged.select(
        "doc_id",
        "lang",
        solution.alias("solution"),
        truth.alias("truth"),
        F.when(F.col("quality") == 0, F.col("source")).alias("feedback"),
    )


RESPONSES_SQL = r"""
SELECT d.doc_id, lang,
  CASE d.doc_id % 6 WHEN 0 THEN text || chr(10) || '#### ' || n_chars || ',000 '
    WHEN 1 THEN text || ' <Answer>' || chr(10) || lang || ' </ANSWER> tail'
    WHEN 2 THEN '\boxed{' || d.doc_id || '} ' || text
    WHEN 3 THEN text || ' total -' || n_chars || '.5 kg'
    WHEN 4 THEN text || ' so it is b' ELSE text END AS solution,
  CASE d.doc_id % 6 WHEN 0 THEN n_chars || '000' WHEN 1 THEN upper(lang) || ' ' WHEN 2 THEN 'x' || d.doc_id
    WHEN 3 THEN '- ' || n_chars || '.5' WHEN 4 THEN 'B' ELSE 'the' END AS truth,
  CASE WHEN quality = 0 THEN source END AS feedback
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""

SQL_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
# A step that finds nothing is null, and the first step that finds something is the answer.
EXTRACT_SQL = r"""coalesce(
  trim(list_extract(regexp_extract_all({x}, '####\s*([^\n]+)', 1), -1), {spaces}),
  trim(list_extract(regexp_extract_all({x}, '(?is)<answer>\s*(.*?)\s*</answer>', 1), -1), {spaces}),
  trim(list_extract(regexp_extract_all({x}, '\\boxed\{{([^{{}}]+)\}}', 1), -1), {spaces}),
  list_extract(regexp_extract_all(replace({x}, ',', ''), '-?[0-9]+(?:\.[0-9]+)?'), -1),
  {letters}
  trim({x}, {spaces}))"""
# Letters outside ASCII stand as underscores, so that the ASCII word boundary sees a word there.
LETTER_SQL = r"list_extract(regexp_extract_all(regexp_replace(upper({x}), '[^\x00-\x7F]', '_', 'g'), '\b([A-D])\b', 1), -1),"


def extract_sql(x: str, letters: bool = True) -> str:
    step = LETTER_SQL.format(x=x) if letters else ""
    return EXTRACT_SQL.format(x=x, spaces=SQL_SPACES, letters=step)


def normalize_sql(x: str, restrip: bool = True) -> str:
    single = rf"regexp_replace(replace(trim(coalesce({x}, ''), {SQL_SPACES}), ',', ''), '\s+', ' ', 'g')"
    return f"lower(trim({single}, {SQL_SPACES}))" if restrip else f"lower({single})"


def answer_extract(spark: SparkSession, folder: str) -> DataFrame:
    return responses(spark, folder).select(
        "doc_id",
        text.extract_answer(F.col("solution")).alias("answer"),
        text.extract_answer(F.col("solution"), letters=False).alias("answer_no_letter"),
    )


def exact_score(spark: SparkSession, folder: str) -> DataFrame:
    graded = reward.exact_score(F.col("solution"), F.col("truth"), F.col("feedback"))
    return responses(spark, folder).select("doc_id", graded.alias("r")).select("doc_id", "r.*")


EXACT_SQL = f"""
SELECT doc_id, CAST(CASE WHEN {normalize_sql("extracted_answer")} = {normalize_sql("truth")} THEN 1 ELSE 0 END AS DOUBLE)
         AS score, extracted_answer, coalesce(feedback, '') AS feedback_raw,
       coalesce(feedback, '') <> '' AS sdpo_feedback_available
FROM (SELECT *, {extract_sql("solution")} AS extracted_answer FROM ({RESPONSES_SQL}))
"""


def graded_score(spark: SparkSession, folder: str) -> DataFrame:
    graded = reward.graded_score(F.col("solution"), F.col("truth"), F.col("feedback"))
    return responses(spark, folder).select("doc_id", graded.alias("r")).select("doc_id", "r.*")


GRADED_SQL = f"""
SELECT doc_id, CAST(CASE WHEN exact THEN 1 WHEN held THEN 0.5 ELSE 0 END AS DOUBLE) AS score, extracted_answer, exact,
       held AS contains_ground_truth, coalesce(feedback, '') AS feedback_raw,
       coalesce(feedback, '') <> '' AS sdpo_feedback_available
FROM (SELECT *, wanted <> '' AND {normalize_sql("extracted_answer", False)} = wanted AS exact,
             wanted <> '' AND contains({normalize_sql("solution", False)}, wanted) AS held
      FROM (SELECT *, {extract_sql("solution", False)} AS extracted_answer, {normalize_sql("truth", False)} AS wanted
            FROM ({RESPONSES_SQL})))
"""


def _graded_dialogues(spark: SparkSession, folder: str) -> DataFrame:
    """Answers with the capitalised words of the question as rubric terms."""
    terms = text.all_matches(F.col("prompt"), "[A-Z][a-z]+", 0)
    return fields(spark, folder).select(
        "conv_id",
        F.col("answer").alias("solution"),
        terms.alias("terms"),
        F.when(F.length("prompt") > 200, F.col("prompt")).alias("feedback"),
        F.substring("prompt", 1, 1).alias("truth"),
        F.when(F.length("answer") % 2 == 0, reward.RUBRIC_SOURCE).otherwise("dialogues").alias("source"),
    )


DIALOGUES_SQL = f"""
SELECT conv_id, answer AS solution, regexp_extract_all(prompt, '[A-Z][a-z]+') AS terms,
       CASE WHEN length(prompt) > 200 THEN prompt END AS feedback, substr(prompt, 1, 1) AS truth,
       CASE WHEN length(answer) % 2 = 0 THEN 'harvey/lab' ELSE 'dialogues' END AS source
FROM ({FIELDS_SQL})
"""


def rubric_score(spark: SparkSession, folder: str) -> DataFrame:
    graded = reward.rubric_score(F.col("solution"), F.col("terms"), F.col("feedback"))
    return _graded_dialogues(spark, folder).select("conv_id", graded.alias("r")).select("conv_id", "r.*")


RUBRIC_PARTS_SQL = f"""
SELECT *, len(wanted) AS n, len(list_filter(wanted, lambda t: contains(body, t))) AS hits,
       CASE WHEN len(regexp_extract_all(coalesce(solution, ''), '\\S+')) >= 80 THEN 0.2::DOUBLE ELSE 0::DOUBLE END AS bonus,
       CASE WHEN contains(body, 'cannot provide legal advice') OR contains(body, 'i can''t') THEN 0.3::DOUBLE
            ELSE 0::DOUBLE END AS penalty
FROM (SELECT *, {normalize_sql("solution")} AS body,
             list_filter(list_transform(terms, lambda t: {normalize_sql("t")}), lambda t: t <> '') AS wanted
      FROM ({DIALOGUES_SQL}))
"""
COVERAGE_SQL = "greatest(0::DOUBLE, least(1::DOUBLE, hits::DOUBLE / greatest(n, 1) + bonus - penalty))"
RUBRIC_SQL = f"""
SELECT conv_id, {COVERAGE_SQL} AS score, CAST(n AS INTEGER) AS harvey_reward_terms,
       CAST(hits AS INTEGER) AS harvey_reward_hits, coalesce(feedback, '') <> '' AS sdpo_feedback_available
FROM ({RUBRIC_PARTS_SQL})
"""


def routed_score(spark: SparkSession, folder: str) -> DataFrame:
    """Responses joined to their records and scored by each record's source."""
    dialogues = _graded_dialogues(spark, folder)
    records_of = dialogues.select(
        "conv_id",
        F.col("source").alias("data_source"),
        F.struct(F.lit("rule").alias("style"), F.col("truth").alias("ground_truth")).alias("reward_model"),
        F.struct(F.col("terms").alias("reward_terms"), F.col("feedback").alias("feedback_raw")).alias("extra_info"),
    )
    answers = dialogues.select("conv_id", F.col("solution").alias("solution_str"))
    return score_responses(answers, records_of, "conv_id").drop("extra_info", "solution_str")


ROUTED_SQL = f"""
SELECT conv_id, source AS data_source, truth AS ground_truth,
       CASE WHEN graded THEN {COVERAGE_SQL} ELSE
         CAST(CASE WHEN {normalize_sql("extracted")} = {normalize_sql("truth")} THEN 1 ELSE 0 END AS DOUBLE) END AS score,
       CASE WHEN NOT graded THEN extracted END AS extracted_answer,
       CASE WHEN NOT graded THEN coalesce(feedback, '') END AS feedback_raw,
       CASE WHEN graded THEN CAST(n AS INTEGER) END AS harvey_reward_terms,
       CASE WHEN graded THEN CAST(hits AS INTEGER) END AS harvey_reward_hits,
       coalesce(feedback, '') <> '' AS sdpo_feedback_available
FROM (SELECT *, source = 'harvey/lab' AS graded, {extract_sql("solution")} AS extracted FROM ({RUBRIC_PARTS_SQL}))
"""


def _scorable(spark: SparkSession, folder: str) -> DataFrame:
    return _graded_dialogues(spark, folder).select(
        "conv_id",
        F.col("source").alias("data_source"),
        F.col("solution").alias("solution_str"),
        F.col("truth").alias("ground_truth"),
        F.struct(F.col("feedback").alias("feedback_raw")).alias("extra_info"),
    )


def custom_reward(spark: SparkSession, folder: str) -> DataFrame:
    """A user's Column reward: the answer's length against a target, if it opens like the question."""

    def by_length(source: Column, solution: Column, truth: Column, info: Column) -> Column:
        words = text.count_words(solution) / 64
        return F.struct(words.alias("score"), F.startswith(solution, truth).alias("same_start"))

    return score(_scorable(spark, folder), by_length).select("conv_id", "score", "same_start")


def python_reward(spark: SparkSession, folder: str) -> DataFrame:
    """A user's Python reward, called in Arrow batches."""

    def starts_alike(data_source: str, solution_str: str, ground_truth: str, extra_info: dict) -> dict:
        same = solution_str.startswith(ground_truth)
        return {"score": 1.0 if same else 0.0, "hinted": bool(extra_info["feedback_raw"])}

    fn = reward.python_reward(starts_alike, "score double, hinted boolean")
    return score(_scorable(spark, folder), fn).select("conv_id", "score", "hinted")


def line_criteria(body: Column) -> Column:
    """Every line of a text as a criterion."""
    return F.transform(
        F.split(body, "\n"),
        lambda line, i: F.struct(
            F.concat(F.lit("C"), (i + 1).cast("string")).alias("id"),
            F.substring(line, 1, 40).alias("title"),
            line.alias("match_criteria"),
            F.array().cast("array<string>").alias("deliverables"),
        ),
    )


def reward_terms(spark: SparkSession, folder: str) -> DataFrame:
    quoted = F.concat(F.lit('"'), F.col("source"), F.lit('" at '), F.col("n_chars").cast("string"), F.lit("% "), "text")
    docs = table(spark, folder, "documents").select("doc_id", reward.reward_terms(line_criteria(quoted)).alias("terms"))
    return docs.select("doc_id", F.size("terms").alias("n_terms"), F.array_join("terms", "|").alias("terms"))


REWARD_TERMS_SQL = rf"""
SELECT doc_id, CAST(len(terms) AS INTEGER) AS n_terms, array_to_string(terms, '|') AS terms FROM (
  SELECT doc_id, list_filter(kept, lambda t, i: list_position(kept, t) = i)[1:48] AS terms FROM (
    SELECT doc_id, list_filter(list_transform(
        regexp_extract_all(raw, '["''`]([^"''`]{{3,80}})["''`]', 1)
          || regexp_extract_all(plain, '\b[0-9]+(?:\.[0-9]+)?%?x?\b')
          || regexp_extract_all(plain, '\b[A-Z][A-Za-z0-9&/-]*(?:\s+[A-Z][A-Za-z0-9&/-]*){{0,5}}\b'),
        lambda t: trim(regexp_replace(t, '\s+', ' ', 'g'))),
      lambda t: length(t) >= 3 AND lower(t) NOT IN ('pass', 'fail', 'agent', 'issue')) AS kept
    FROM (SELECT doc_id, raw, regexp_replace(raw, '[^\x00-\x7F]', '_', 'g') AS plain FROM (
      SELECT doc_id, array_to_string(list_transform(
               string_split('"' || source || '" at ' || n_chars || '% ' || text, chr(10)),
               lambda l: substr(l, 1, 40) || ' ' || l), ' ') AS raw FROM documents))))
"""


def trim_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", text.trim_text(F.col("text"), 1200).alias("text"))


def trim_sql(x: str, limit: int) -> str:
    tidy = rf"regexp_replace(trim({x}, {SQL_SPACES}), '\n{{3,}}', chr(10) || chr(10), 'g')"
    return rf"""CASE WHEN length({tidy}) <= {limit} THEN {tidy}
      ELSE regexp_replace(substring({tidy}, 1, {limit}), '\n[^\n]*$', '') || chr(10) || '[truncated]' END"""


def text_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Comparison forms of whole texts, safe names and stamped run names."""
    at = F.timestamp_seconds(F.col("n_chars"))
    return table(spark, folder, "documents").select(
        "doc_id",
        text.normalize(F.col("text")).alias("normal"),
        text.normalize(F.concat(F.lit(" ,"), "text", F.lit(" ,")), restrip=False).alias("normal_open"),
        text.safe_name(F.col("text")).alias("name"),
        text.stamped_name(F.col("source"), "sdpo", at).alias("run_name"),
    )


QUERIES: dict[str, Query] = {
    "answer_extract": answer_extract,
    "exact_score": exact_score,
    "graded_score": graded_score,
    "rubric_score": rubric_score,
    "routed_score": routed_score,
    "custom_reward": custom_reward,
    "python_reward": python_reward,
    "reward_terms": reward_terms,
    "trim_text": trim_text,
    "text_forms": text_forms,
}

ORACLES: dict[str, str] = {
    "answer_extract": f"""SELECT doc_id, {extract_sql("solution")} AS answer,
        {extract_sql("solution", False)} AS answer_no_letter FROM ({RESPONSES_SQL})""",
    "exact_score": EXACT_SQL,
    "graded_score": GRADED_SQL,
    "rubric_score": RUBRIC_SQL,
    "routed_score": ROUTED_SQL,
    "custom_reward": f"""SELECT conv_id, len(regexp_extract_all(solution, '\\S+')) / 64.0::DOUBLE AS score,
        starts_with(solution, truth) AS same_start FROM ({DIALOGUES_SQL})""",
    "python_reward": f"""SELECT conv_id, CASE WHEN starts_with(solution, truth) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
        AS score, coalesce(feedback, '') <> '' AS hinted FROM ({DIALOGUES_SQL})""",
    "reward_terms": REWARD_TERMS_SQL,
    "trim_text": f"SELECT doc_id, {trim_sql('text', 1200)} AS text FROM documents",
    "text_forms": rf"""SELECT doc_id, {normalize_sql("text")} AS normal,
        {normalize_sql("' ,' || text || ' ,'", False)} AS normal_open,
        regexp_replace(text, '[^\p{{L}}\p{{N}}_-]', '_', 'g') AS name,
        source || '-sdpo-' || strftime(make_timestamp(n_chars * 1000000), '%Y%m%dT%H%M%SZ') AS run_name
        FROM documents""",
}
