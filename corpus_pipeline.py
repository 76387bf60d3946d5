"""Documents to packed training sequences, one operator at a time.

Each stage takes what the one before kept, written as Parquet and read back, and gives the columns of ``documents``;
the last gives the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gradeflow.llm import mixing, near_dedup, packing, passages, toxicity
from gradeflow.llm.common import stored
from gradeflow.llm.queries import BYTE_TOKENIZER
from gradeflow.plans import table

# Chunks that a worker remembers for packing; the workers of the stages before are still there and share the memory.
REMEMBERED = 300_000


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic; the classifier learns from the labels of the folder."""
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return near_dedup.without_near_duplicates(docs)


def without_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay in the first document that has them."""
    return passages.without_repeats(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixture(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 1024 tokens."""
    return packing.pack(docs, BYTE_TOKENIZER, remembered=REMEMBERED)


STAGES = [("toxicity", clean), ("near_dedup", one_of_each), ("passage_dedup", without_passages), ("mix", mixed), ("pack", packed)]

# Training, near duplicates and passages can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
