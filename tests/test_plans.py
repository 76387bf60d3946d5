"""What Spark makes of the operators: pruning, pushdown, partial aggregation."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from gradeflow.operators import logs, ordering, registry, splits
from gradeflow.plans import table
from gradeflow.plans.logs import as_lines
from gradeflow.sources import datasets

QUERIES = entry_module.queries()
READ = {
    "document_counts": {"source"},
    "split_counts": {"doc_id"},
    "selected_tokens": {"vec_id", "embedding", "label"},
    "log_app_id": {"event_id", "user_id", "event_type"},
    "run_rows": {"doc_id", "lang", "quality", "toxic"},
}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def columns_read(df) -> set[str]:
    schemas = re.findall(r"ReadSchema: struct<([^\n]*)>", plan_of(df))
    return {field for schema in schemas for field in re.findall(r"(\w+):", schema)}


@pytest.fixture(scope="module")
def lines(spark, folder, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lines") / "t")
    as_lines(table(spark, folder, "events")).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("name", sorted(READ))
def test_only_needed_columns_are_read(spark, folder, name):
    assert columns_read(QUERIES[name](spark, folder)) == READ[name]


def test_strata_are_ranked_from_two_columns(spark, folder):
    """The order itself is read from its checkpoint, so the ranks before it are looked at."""
    assert columns_read(splits.stratum_ranks(table(spark, folder, "documents"), "doc_id", "lang")) == {"doc_id", "lang"}


def test_metrics_are_hash_aggregated_before_the_shuffle(lines):
    plan = plan_of(logs.step_metrics(lines))
    assert "SortAggregate" not in plan and plan.count("HashAggregate") == 2 and plan.count("Exchange") == 1
    assert plan.index("Exchange") < plan.index("partial_max_by")


def test_status_scans_once_and_shuffles_once(lines):
    plan = plan_of(logs.run_status(lines))
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1 and "partial_max_by" in plan


def test_tail_is_cut_before_each_shuffle(lines):
    assert plan_of(logs.tail(lines)).count("WindowGroupLimit") == 4


def test_small_caps_are_a_top_k(lines):
    assert "TakeOrderedAndProject" in plan_of(ordering.first_rows(lines, 10, ["line_no"]))


def test_lookup_is_pushed_to_the_scan(lines):
    plan = plan_of(registry.run_lookup(lines.withColumnRenamed("run_id", "id"), "run-1-0"))
    assert "EqualTo(run_id,run-1-0)" in plan


def test_reading_a_split_reads_only_its_folder(spark, tmp_path):
    rows = spark.createDataFrame([("train", 1), ("test", 2)], "s string, n int").select(F.struct(F.col("s").alias("split")).alias("extra_info"), "n")
    datasets.write_records(rows, str(tmp_path / "r"))
    plan = plan_of(datasets.read_records(spark, str(tmp_path / "r"), "test"))
    assert re.search(r"PartitionFilters: \[[^]]*split#\d+ = test", plan)
