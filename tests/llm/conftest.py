from __future__ import annotations

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)
WORDS = [f"w{chr(97 + k % 26)}{k}" for k in range(700)]


def text(start: int, n: int, step: int = 1) -> str:
    return " ".join(WORDS[(start + step * k) % 700] for k in range(n))


def messy_rows() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties, repeated rows, near copies, a shared passage."""
    passage, long_text = text(5, 60), " ".join(f"x{k}" for k in range(40_000))
    rows = [
        (1, text(0, 120), "en", "b", 1), (2, text(0, 120), "en", "b", 1), (3, text(0, 120).upper(), "en", None, None),
        (4, text(0, 118) + " other end", None, "a", 1), (5, None, "en", "a", None), (6, "", None, None, 0), (7, " \n\t ", "de", "c", 4),
        (8, "one", "de", "c", 3), (9, "one two", "fr", "c", 7), (10, long_text, "fr", "c", 1), (11, long_text + " end", "fr", "d", 1),
        (12, text(300, 90, 3) + " " + passage, "de", "a", 1), (13, passage + " " + text(200, 80, 7), "es", "a", 1),
        (14, "É é ß 한 👍 ½  x", "es", "a", 1), (14, "É é ß 한 👍 ½  x", "es", "a", 1), (None, text(40, 60, 9), "en", "e", 1),
        (15, "w " * 300, "en", "a", 1), (16, "12 34 %%", "en", "a", 1), (17, "<|endoftext|> x\x1cy", "en", "a", 1),
    ]
    return rows


@pytest.fixture(scope="session")
def messy(spark):
    """The messy rows with extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    names = ["id", "node", "size", "target", "copies", "start", "length", "score", "label", "row", "kind", "rank", "copy", "slice", "at"]
    return spark.createDataFrame(messy_rows(), SCHEMA).repartition(3).withColumns({n: F.lit("extra") for n in names})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")
