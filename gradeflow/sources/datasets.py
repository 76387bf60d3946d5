"""Raw datasets (Parquet, JSON lines, JSON documents) and prepared record sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Schema = T.StructType | str


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_json_lines(spark: SparkSession, path: str, schema: Schema) -> DataFrame:
    """One object per non-blank line. Files are split, so one large file is read by many tasks."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json_list(spark: SparkSession, path: str, schema: Schema) -> DataFrame:
    """Documents that are one list of objects. A document is parsed by one task; prefer JSON lines."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_json_member(spark: SparkSession, path: str, schema: Schema, member: str | None = None) -> DataFrame:
    """Documents that are one object; the rows are the list under ``member``, or its first list if none is named."""
    row = schema if isinstance(schema, str) else schema.simpleString()
    struct = row if row.startswith("struct<") else f"struct<{_fields(row)}>"
    missing = F.raise_error(F.lit("no list in the JSON document"))
    if member:
        whole = read_json_list(spark, path, f"`{member}` array<{struct}>")
        rows = F.coalesce(F.col(member), missing.cast(f"array<{struct}>"))
        return whole.select(F.explode(rows).alias("_row")).select("_row.*")
    document = spark.read.text(path, wholetext=True)
    members = F.map_values(F.from_json("value", "map<string,variant>"))
    lists = F.filter(members, lambda m: F.try_variant_get(m, "$", "array<variant>").isNotNull())
    first = F.get(lists, F.lit(0))
    rows = F.variant_get(F.coalesce(first, missing.cast("variant")), "$", f"array<{struct}>")
    return document.select(F.explode(rows).alias("_row")).select("_row.*")


def _fields(ddl: str) -> str:
    return T.StructType.fromDDL(ddl).simpleString()[len("struct<") : -1]


def read_splits(spark: SparkSession, train: str, test: str | None, reader=read_table, **options) -> DataFrame:
    """Train and test sources as one table with a ``split`` column; test defaults to the train source."""
    parts = {"train": train, "test": test or train}
    frames = [reader(spark, path, **options).withColumn("split", F.lit(name)) for name, path in parts.items()]
    return frames[0].unionByName(frames[1])


def select_split(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col("split") == name)


def write_records(records: DataFrame, path: str, split: str = "extra_info.split") -> None:
    """Records as plain Parquet, one folder per split."""
    records.withColumn("split", F.col(split)).write.mode("overwrite").partitionBy("split").parquet(path)


def read_records(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Prepared records; naming a split reads only its folder."""
    records = spark.read.parquet(path)
    return records if split is None else select_split(records, split)
