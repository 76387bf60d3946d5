"""Every query against its SQL on the smallest tables, and rules on the plans."""

from __future__ import annotations

import json
import re

import oracle
import pytest

import __spark_entry__ as entry_module

# Those of the training-data operators have tests of their own.
QUERIES = {"scored_split": entry_module.scored_split} | {k: v for topic in entry_module.TOPICS for k, v in topic.QUERIES.items()}
ORACLES = {k: v for k, v in entry_module.oracle_sql().items() if k in QUERIES}
KINDS = {
    "BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean",
    "TIMESTAMP": "timestamp_ntz", "FLOAT": "float",
}


@pytest.fixture(scope="module")
def con(folder):
    return oracle.connect(folder)


def test_every_oracle_has_a_query():
    assert set(ORACLES) == set(QUERIES)


NEED_PYTHON = {"document_extract", "python_reward"}


def check_plan(df, name: str) -> None:
    """No cross join, no window that would sort the table in one task, and Python only where it must be.

    The row index sums over ``_part``, which has one row per partition.
    """
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", plan)
    uses_python = bool(re.search(r"ArrowEvalPython|BatchEvalPython|MapInPandas", plan))
    assert uses_python == (name in NEED_PYTHON)
    for line in plan.splitlines():
        if re.search(r"\bWindow \[", line) and "windowspecdefinition(_part#" not in line:
            assert line.count("], [") >= 2, line


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, folder, con, name):
    df = QUERIES[name](spark, folder)
    check_plan(df, name)
    assert oracle.differences(df, con, ORACLES[name]) == []
    described = {row[0]: KINDS.get(row[1], row[1]) for row in con.execute(f"DESCRIBE {ORACLES[name]}").fetchall()}
    assert {f.name: f.dataType.simpleString() for f in df.schema} == described


def test_manifest_names_the_generation_set(spark, folder):
    made = QUERIES["manifest"](spark, folder)
    check_plan(made, "manifest")
    body = json.loads(made.first()["manifest"])
    assert len(body["train_tasks"]) == 8 and len(body["eval_preview_tasks"]) == 2
    assert body["heldout_eval_count"] == QUERIES["stratified_order"](spark, folder).count() - 8
    assert {r["task_id"] for r in body["runs"]} == {*body["train_tasks"], *body["eval_preview_tasks"]}
    assert not set(body["train_tasks"]) & set(body["eval_preview_tasks"])


def test_entry_gives_rows(spark):
    assert entry_module.entry(spark).count() > 0
