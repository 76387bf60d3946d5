"""The operators over the test tables, with production parameters, each beside its SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeflow.llm import decontamination, fingerprints, hard_negatives, id_files, importance, language, mixing, near_dedup, packing, passages, quality, token_counts, toxicity
from gradeflow.plans import Query, table
from gradeflow.session import fresh_path

BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("byte_bpe_50k.tiktoken")


def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, folder, "documents"), words=3, numerator=85, denominator=100)


def document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.neighbour_fingerprints(table(spark, folder, "documents"))


def packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), BYTE_TOKENIZER)


def mixed(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def toxic(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.toxicity(docs, toxicity.train(docs, table(spark, folder, "labels")))


def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality.quality(docs, quality.train(docs, table(spark, folder, "labels")))


def piece_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"), PIECES)


def document_languages(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return language.languages(docs, language.train(docs))


def shared_passages(spark: SparkSession, folder: str) -> DataFrame:
    return passages.repeated_passages(table(spark, folder, "documents"))


def ids_read_back(spark: SparkSession, folder: str) -> DataFrame:
    return id_files.round_trip(table(spark, folder, "documents"), WORD_TOKENIZER, fresh_path(spark, "id-files"))


def drawn_documents(spark: SparkSession, folder: str) -> DataFrame:
    return importance.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def contaminated_documents(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.decontaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated", F.size("near").cast("long").alias("n_near"))


def mined_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, folder, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_near_dedup": near_duplicates,
    "op2_fingerprints": document_fingerprints,
    "op3_pack": packed,
    "op4_mix": mixed,
    "op5_toxicity": toxic,
    "op6_quality": quality_rules,
    "op7_token_counts": piece_counts,
    "op8_language": document_languages,
    "op9_passages": shared_passages,
    "op10_id_files": ids_read_back,
    "op11_hard_negatives": mined_negatives,
    "op12_importance": drawn_documents,
    "op13_decontamination": contaminated_documents,
}

MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
      FROM d GROUP BY source),
w AS (SELECT source, source_size, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS nth FROM w),
l AS (SELECT nth, source_size, weight,
             (CAST(1.5 AS DOUBLE) * sum(source_size) OVER ()
              - coalesce(sum(2 * source_size) OVER (ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
v AS (SELECT arg_min(level, nth) FILTER (WHERE 2 * source_size > weight * level) AS level FROM l),
t AS (SELECT source, source_size, CASE WHEN v.level IS NULL OR 2 * source_size <= weight * v.level
             THEN CAST(2 * source_size AS DOUBLE) ELSE weight * v.level END AS target FROM w, v),
r AS (SELECT doc_id, size, source_size, target,
             CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
             CAST('0x' || substr(md5('mix/' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT)
             / CAST(281474976710656 AS DOUBLE) AS chance
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN chance < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""

TERMS_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

# The CRC-32 of each different word by its bytes, with a table that SQL makes.
IMPORTANCE_SQL = f"""
WITH c AS (SELECT list(v ORDER BY n) AS crcs FROM (SELECT n, list_reduce(list_prepend(n, range(8)),
             lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) r(n))),
d AS (SELECT doc_id, coalesce({TERMS_SQL}, []) AS words FROM documents),
b AS (SELECT unnest({TERMS_SQL}) AS word FROM benchmark),
w AS (SELECT doc_id, unnest(words) AS word FROM d),
k AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(hex(encode(word))) // 2),
             lambda i: CAST('0x' || substr(hex(encode(word)), 2 * i + 1, 2) AS BIGINT))),
             lambda crc, byte: xor(crc // 256, crcs[xor(crc, byte) % 256 + 1])), 4294967295) % 10000 AS bucket
      FROM (SELECT word FROM w UNION SELECT word FROM b) v, c),
s AS (SELECT bucket, count(*) AS s FROM w JOIN k USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN k USING (word) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * ((SELECT count(*) FROM w) + 10000)
             / (CAST(s + 1 AS DOUBLE) * ((SELECT count(*) FROM b) + 10000)))) AS gain FROM s LEFT JOIN t USING (bucket)),
m AS (SELECT doc_id, CAST(floor(avg(gain)) AS BIGINT) AS weight FROM w JOIN k USING (word) JOIN g USING (bucket) GROUP BY doc_id),
e AS (SELECT doc_id, len(words) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
             (CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
      FROM d LEFT JOIN m USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
             count(*) FILTER (n_features >= 20) OVER () AS n FROM e)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score,
       CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM r
"""

# Windows as lists of words: equal ones are joined, near ones looked up around each place of their rarest word.
DECONTAMINATION_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({TERMS_SQL}, []) AS words FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {TERMS_SQL} AS words FROM benchmark),
w AS (SELECT item_id, words[k : k + 9] AS win FROM (SELECT *, unnest(range(1, greatest(2, len(words) - 8))) AS k FROM i WHERE len(words) > 0)),
z AS (SELECT DISTINCT len(win) AS size FROM w),
o AS (SELECT doc_id, words, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM d),
x AS (SELECT doc_id, item_id, p, len(win) AS size FROM (SELECT doc_id, p, words[p : p + size - 1] AS win FROM o, z WHERE p + size - 1 <= len(words)) y JOIN w USING (win)),
h AS (SELECT doc_id, count(DISTINCT p + j) AS n_hit FROM (SELECT doc_id, p, unnest(range(0, size)) AS j FROM x) GROUP BY doc_id),
f AS (SELECT word, count(*) AS n FROM o GROUP BY word),
a AS (SELECT item_id, win, arg_min(word, (n, word)) AS word FROM (SELECT item_id, win, unnest(win) AS word FROM w) JOIN f USING (word)
      GROUP BY item_id, win HAVING count(*) = len(win)),
r AS (SELECT DISTINCT doc_id, item_id FROM (SELECT doc_id, item_id, words, win, unnest(range(greatest(1, p - 19), p + 1)) AS b FROM o JOIN a USING (word))
      WHERE list_has_all(words[b : b + 19], win)),
e AS (SELECT DISTINCT doc_id, item_id FROM x),
n AS (SELECT doc_id, count(*) AS n_near FROM (FROM r EXCEPT FROM e) GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM e GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN g USING (doc_id) LEFT JOIN n USING (doc_id)
"""

NEGATIVES_SQL = """
WITH v AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS INTEGER) AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
           FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER n AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW n AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER n <= 10
"""

# No SQL: op2, op3 and op10 hash or encode in ways SQL lacks, op5, op6 and op8 are trained, op7 is a greedy scan,
# op9 compares word sequences and op1 all sets; tests hold them against brute force.
ORACLES: dict[str, str] = {"op4_mix": MIX_SQL, "op11_hard_negatives": NEGATIVES_SQL, "op12_importance": IMPORTANCE_SQL, "op13_decontamination": DECONTAMINATION_SQL}
