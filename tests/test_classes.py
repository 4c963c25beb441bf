"""Pairs of rows from pairs of classes: whole, in few bytes, and in memory that parts of classes bound."""

import os

import pytest
from pyspark.sql import functions as F

from heddle import plans
from heddle.operators import classes

from test_people_joins import folder  # noqa: F401


def test_pairs_take_few_bytes_in_a_file(spark, tmp_path):
    """One class of either side: a file holds runs that repeat, not two ids a pair."""
    left = spark.range(300).select(F.lit(1).alias("a"), F.xxhash64("id").alias("lid"))
    right = spark.range(20_000).select(F.lit(2).alias("b"), F.xxhash64("id", F.lit(1)).alias("rid"))
    pairs = spark.sql("SELECT 1 AS a, 2 AS b, 0.5D AS score")
    classes.expanded(left, ["a"], "lid", pairs, right, ["b"], "rid").write.parquet(out := f"{tmp_path}/pairs")
    got = spark.read.parquet(out).agg(F.count("*").alias("n"), F.count_distinct("lid").alias("l"), F.count_distinct("rid").alias("r")).first()
    assert tuple(got) == (6_000_000, 300, 20_000)
    assert sum(os.path.getsize(f"{out}/{f}") for f in os.listdir(out) if f.endswith(".parquet")) < 0.4 * 6_000_000


def test_null_ids_and_null_classes(spark):
    left = spark.createDataFrame([(1, 10), (1, None), (None, 12), (2, 13)], "a int, lid long")
    right = spark.createDataFrame([(5, 20), (5, None), (None, 22), (6, 23)], "b int, rid long")
    pairs = spark.createDataFrame([(1, 5, "x"), (2, 6, "y"), (2, 7, "z")], "a int, b int, told string")
    got = classes.expanded(left, ["a"], "lid", pairs, right, ["b"], "rid")
    want = [(10, 20, "x"), (10, None, "x"), (None, 20, "x"), (None, None, "x"), (13, 23, "y")]
    assert got.columns == ["lid", "rid", "told"] and sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_a_split_class_gives_each_pair_once(spark):
    """5,003 rows of a class are over classes.ROWS, so they go in parts; 6 are left over from whole runs."""
    left = spark.range(5_003).select(F.lit(1).alias("a"), F.col("id").alias("lid"))
    right = spark.range(103).select(F.lit(2).alias("b"), F.col("id").alias("rid"))
    got = classes.expanded(left, ["a"], "lid", spark.sql("SELECT 1 AS a, 2 AS b"), right, ["b"], "rid")
    assert got.count() == got.distinct().count() == 5_003 * 103


def test_lists_are_short_where_parts_are_large(spark):
    """A task holds the pairs of one list with a part (a thousandth of all left rows) before it goes on."""
    right = spark.range(5_000).select(F.lit(2).alias("b"), F.col("id").alias("rid"))
    left, pairs = spark.range(10).select(F.lit(1).alias("a"), F.col("id").alias("lid")), spark.sql("SELECT 1 AS a, 2 AS b")
    for total in (1_000, 10_000_000):
        got = classes.expanded(left, ["a"], "lid", pairs, right, ["b"], "rid", total)
        assert got.count() == 50_000
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert f"/ {classes.PAIRS / max(classes.ROWS, total / 1000):.1f})" in plan


def test_equal_keys_are_left_out(spark):
    left = spark.createDataFrame([(1, 10, "m"), (1, 11, None), (1, 12, "n"), (2, 13, "m")], "a int, lid long, lkey string")
    right = spark.createDataFrame([(5, 20, "m"), (5, 21, None), (5, 22, "n"), (6, 23, None)], "b int, rid long, rkey string")
    pairs = spark.createDataFrame([(1, 5, "x"), (2, 5, "y")], "a int, b int, told string")
    got = classes.expanded_apart(left, ["a"], "lid", "lkey", pairs, right, ["b"], "rid", "rkey", 4)
    want = [(lid, rid, t) for a, lid, k in left.collect() for b, rid, q in right.collect() for x, y, t in pairs.collect() if (a, b) == (x, y) and (k is None or k != q)]
    assert got.columns == ["lid", "rid", "told"] and sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("name", ("join_pairwise_criteria", "join_pairwise_checks"))
def test_people_without_a_common_key_are_not_compared(spark, folder, name):  # noqa: F811
    """Keys are looked at before rows become pairs, and pair by pair only where both have one."""
    plan = plans.queries()[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "isnull(rkey#" in plan and "isnull(lkey#" in plan
    assert sum("__lid" in x and "__rid" in x and ".lkey = " in x for x in plan.splitlines() if "Filter" in x) == 1
