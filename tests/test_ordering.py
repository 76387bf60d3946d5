"""Ordered operators and splits against plain Python, with one group holding most rows."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from gradeflow.operators import ordering, splits


@pytest.fixture(scope="module")
def skewed(spark):
    """Group ``hot`` holds two thirds of the rows; ids are spread unevenly."""
    dice = random.Random(5)
    ids = dice.sample(range(10**6), 900)
    rows = [("hot" if i % 3 else f"g{i % 7}", key, dice.choice("abc")) for i, key in enumerate(ids)]
    return spark.createDataFrame(rows, "g string, id bigint, v string").repartition(7)


def grouped(df):
    groups: dict[str, list] = {}
    for row in sorted(df.collect(), key=lambda r: r["id"]):
        groups.setdefault(row["g"], []).append(row)
    return groups


def test_row_index_is_dense_in_every_group(skewed):
    got = {(r["g"], r["id"]): r["index"] for r in ordering.with_row_index(skewed, ["id"], by=["g"]).collect()}
    assert got == {(g, r["id"]): i for g, rows in grouped(skewed).items() for i, r in enumerate(rows)}


def test_row_index_over_the_whole_table(skewed):
    got = [r["id"] for r in ordering.row_index(skewed, ["id"]).orderBy("index").collect()]
    assert got == sorted(r["id"] for r in skewed.collect())


@pytest.mark.parametrize("rows", [-1, 0, 5, 10_000])
def test_row_cap(skewed, rows):
    ids = sorted(r["id"] for r in skewed.collect())
    assert sorted(r["id"] for r in ordering.first_rows(skewed, rows, ["id"]).collect()) == (ids[:rows] if rows > 0 else ids)


def test_row_cap_past_the_top_k_size(skewed, monkeypatch):
    monkeypatch.setattr(ordering, "TOP_ROWS", 10)
    ids = sorted(r["id"] for r in skewed.collect())
    assert sorted(r["id"] for r in ordering.first_rows(skewed, 500, ["id"]).collect()) == ids[:500]


def test_top_per_group(skewed):
    got = ordering.top_per_group(skewed, ["g"], [F.col("id").desc()], 20).collect()
    assert {r["id"] for r in got} == {r["id"] for rows in grouped(skewed).values() for r in rows[-20:]}


def test_previous_value_crosses_chunks(skewed):
    some_null = skewed.withColumn("v", F.when(F.col("v") != "c", F.col("v")))
    chunk = F.floor(F.col("id") / 50_000)
    got = ordering.with_previous(some_null, "g", ["id"], "v", chunk, "before").collect()
    wanted = {}
    for rows in grouped(some_null).values():
        for before, row in zip([None, *rows], rows, strict=False):
            wanted[row["id"]] = before and before["v"]
    assert {r["id"]: r["before"] for r in got} == wanted


def test_paths_sort_part_by_part(spark):
    paths = spark.createDataFrame([("a-b/c",), ("a/b",), ("a",)], "p string")
    assert [r["p"] for r in paths.orderBy(ordering.path_order(F.col("p"))).collect()] == ["a", "a/b", "a-b/c"]


def dealt(rows, seed):
    """Round robin by hand: shuffle each stratum by hash, then take one of each in turn."""
    piles: dict[str, list] = {}
    for row in rows:
        piles.setdefault(row["g"], []).append(row["id"])
    for pile in piles.values():
        pile.sort(key=lambda i: hashlib.md5(f"{seed}/{i}".encode()).hexdigest())
    order = []
    while any(piles.values()):
        order += [piles[g].pop(0) for g in sorted(piles) if piles[g]]
    return order


def test_round_robin_deals_one_of_each_stratum_in_turn(skewed):
    got = [r["id"] for r in splits.round_robin(skewed, "id", "g", seed=3).orderBy("position").collect()]
    assert got == dealt(skewed.collect(), 3)


def test_rows_without_a_group_are_kept(spark):
    rows = spark.createDataFrame([(i, None if i % 2 else "a", f"v{i}") for i in range(9)], "id long, g string, v string")
    dealt_out = splits.round_robin(rows, "id", "g").orderBy("position").collect()
    assert [r["position"] for r in dealt_out] == list(range(1, 10))
    assert [r["g"] for r in dealt_out] == [None, "a"] * 4 + ["a"]
    assert ordering.with_row_index(rows, ["id"], by=["g"]).count() == 9
    assert ordering.with_previous(rows, "g", ["id"], "v", F.floor(F.col("id") / 3), "before").count() == 9


def test_split_takes_one_of_each_stratum_first(spark):
    rows = spark.createDataFrame([(f"{g}{i}", g) for g, n in (("a", 5), ("b", 1), ("c", 3)) for i in range(n)], "id string, g string")
    split = splits.stratified_split(rows, "id", "g", train=4, preview=2).collect()
    train = sorted(r["g"] for r in split if r["split"] == "train")
    assert train == ["a", "a", "b", "c"] and len([r for r in split if r["in_preview"]]) == 2
    assert {r["split"] for r in split if r["in_preview"]} == {"heldout"}


def test_split_edges(spark):
    rows = spark.createDataFrame([("x", "a"), ("y", "a"), ("z", "a")], "id string, g string")
    with pytest.raises(ValueError):
        splits.stratified_split(rows, "id", "g", train=0, preview=1)
    assert splits.stratified_split(rows, "id", "g", train=1, preview=0).where("in_preview").count() == 1
    assert splits.stratified_split(rows, "id", "g", train=9, preview=2).where("split = 'heldout'").count() == 0


def test_leaks_are_counted(spark):
    train = spark.createDataFrame([("x", ""), ("x", ""), ("y", "")], "id string, fb string")
    test = spark.createDataFrame([("x", "hint"), ("z", None), ("w", "")], "id string, fb string")
    assert tuple(splits.leak_report(train, test, "id", "fb").first()) == (1, 1)
    assert tuple(splits.leak_report(train, test.where("id = 'none'"), "id", "fb").first()) == (0, 0)


def test_without(spark):
    rows = spark.createDataFrame([("x",), ("y",)], "id string")
    assert [r["id"] for r in splits.without(rows, rows.where("id = 'x'"), "id").collect()] == ["y"]


def test_ties_are_numbered_once(spark, monkeypatch):
    monkeypatch.setattr(ordering, "TOP_ROWS", 2)
    rows = spark.createDataFrame([(1, k) for k in range(5)], "a int, b int")
    made = ordering.with_row_index(rows, ["a"])
    assert sorted(tuple(r)[2] for r in made.collect()) == list(range(5)) and made.columns == ["a", "b", "index"]
    assert ordering.first_rows(rows, 4, ["a"]).count() == 4
