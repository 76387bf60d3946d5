"""Stratified order, split, and leak checks over the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeflow.operators import splits
from gradeflow.plans import Query, table

TRAIN, PREVIEW = 200, 20


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "lang", "source")


def stratified_order(spark: SparkSession, folder: str) -> DataFrame:
    return splits.round_robin(_documents(spark, folder), "doc_id", "lang")


def many_strata_order(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as strata of their orders: many small strata."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return splits.round_robin(orders, "o_orderkey", "o_custkey")


def _order_sql(source: str, id_col: str, stratum: str) -> str:
    return f"""
SELECT {id_col}, {stratum}, rank, row_number() OVER (ORDER BY rank, {stratum}) AS position FROM (
  SELECT {id_col}, {stratum},
         row_number() OVER (PARTITION BY {stratum} ORDER BY md5('17/' || {id_col}), {id_col}) AS rank FROM {source})
"""


ORDER_SQL = _order_sql("documents", "doc_id", "lang")


def _split(spark: SparkSession, folder: str) -> DataFrame:
    return splits.stratified_split(_documents(spark, folder), "doc_id", "lang", train=TRAIN, preview=PREVIEW)


SPLIT_SQL = f"""
SELECT doc_id, lang, position, CASE WHEN position <= {TRAIN} THEN 'train' ELSE 'heldout' END AS split,
       position > {TRAIN} AND position <= {TRAIN + PREVIEW} AS in_preview FROM ({ORDER_SQL})
"""


def generation_set(spark: SparkSession, folder: str) -> DataFrame:
    return splits.generation_set(_split(spark, folder)).select("doc_id", "split", "position")


def heldout(spark: SparkSession, folder: str) -> DataFrame:
    """All documents without the train ones, by id."""
    train = _split(spark, folder).where(F.col("split") == "train")
    return splits.without(_documents(spark, folder), train, "doc_id").groupBy("source").agg(F.count("*").alias("rows"))


def split_leak_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Train against held-out ids, with feedback kept on train rows only."""
    split = _split(spark, folder).withColumn("feedback", F.when(F.col("split") == "train", "hint").otherwise(""))
    train, test = split.where(F.col("split") == "train"), split.where(F.col("split") == "heldout")
    return splits.leak_report(train, test, "doc_id", "feedback")


def split_leak_found(spark: SparkSession, folder: str) -> DataFrame:
    """The same gate on parts that do overlap: documents against their labels."""
    documents = table(spark, folder, "documents").select("doc_id", F.col("source").alias("feedback"))
    return splits.leak_report(table(spark, folder, "labels"), documents, "doc_id", "feedback")


def strata_balance(spark: SparkSession, folder: str) -> DataFrame:
    return _split(spark, folder).groupBy("lang", "split").agg(F.count("*").alias("rows"))


QUERIES: dict[str, Query] = {
    "stratified_order": stratified_order,
    "many_strata_order": many_strata_order,
    "stratified_split": _split,
    "strata_balance": strata_balance,
    "generation_set": generation_set,
    "heldout_rows": heldout,
    "split_leak_gate": split_leak_gate,
    "split_leak_found": split_leak_found,
}

ORACLES: dict[str, str] = {
    "stratified_order": ORDER_SQL,
    "many_strata_order": _order_sql("orders", "o_orderkey", "o_custkey"),
    "stratified_split": SPLIT_SQL,
    "strata_balance": f"SELECT lang, split, count(*) AS rows FROM ({SPLIT_SQL}) GROUP BY ALL",
    "generation_set": f"""SELECT doc_id, CASE WHEN in_preview THEN 'eval_preview' ELSE split END AS split, position
        FROM ({SPLIT_SQL}) WHERE split = 'train' OR in_preview""",
    "heldout_rows": f"""SELECT source, count(*) AS rows FROM documents
        WHERE doc_id NOT IN (SELECT doc_id FROM ({SPLIT_SQL}) WHERE split = 'train') GROUP BY source""",
    "split_leak_gate": f"""SELECT count(*) FILTER (split = 'heldout' AND doc_id IN
          (SELECT doc_id FROM ({SPLIT_SQL}) WHERE split = 'train')) AS shared_ids,
        CAST(0 AS BIGINT) AS test_rows_with_feedback FROM ({SPLIT_SQL})""",
    "split_leak_found": """SELECT count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS shared_ids,
        count(*) FILTER (source <> '') AS test_rows_with_feedback FROM documents""",
}
