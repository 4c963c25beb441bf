"""Pairs of rows that are alike on either side: what depends on the likeness alone is worked out once per pair of classes, and rows follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._loop import counted
from .skew import HOT_SHARE, salted


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt by keys into as many tasks as there are shuffle partitions. A number that is asked for is kept, while Spark would
    merge partitions by what goes into a join, however many rows come out."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _every(rows: DataFrame, member: str) -> Column:
    """All of member in a group, nulls included, as an array."""
    nulls = F.array_repeat(F.lit(None).cast(rows.schema[member].dataType), F.count_if(F.col(member).isNull()).cast("int"))
    return F.concat(F.collect_list(member), nulls)


def members(rows: DataFrame, keys: list[str], member: str, size: int = 1024) -> DataFrame:
    """(keys, members): lists of the members of each class, about size of them in one."""
    parts = rows.groupBy(*keys).agg(F.ceil(F.count("*") / size).cast("int").alias("__parts"))
    dealt = rows.select(*keys, member).join(parts, keys).withColumn("__part", F.pmod(F.xxhash64(member), F.col("__parts")))
    return dealt.groupBy(*keys, "__part").agg(_every(rows, member).alias("members")).drop("__part")


def least_members(rows: DataFrame, keys: list[str], member: str, k: int) -> DataFrame:
    """(keys, member): the k least members of each class."""
    w = Window.partitionBy(*keys).orderBy(member)
    return rows.select(*keys, member).withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= k).drop("__k")


#: Left rows of a class that one task pairs with all that match them, at most (and a thousandth of all rows).
ROWS = 2_000

#: Pairs that a task makes of one right list, and holds before it goes on, at most (where left classes are split into parts of 25,000 rows or fewer).
PAIRS = 200_000

#: Left rows that stand one after another for each right row. A multiple of eight, by which Parquet packs numbers into bytes: their
#: bytes are then the same for the next right row.
RUN = 256


def expanded(left: DataFrame, left_on: list[str], left_id: str, pairs: DataFrame, right: DataFrame, right_on: list[str], right_id: str, total: int | None = None) -> DataFrame:
    """pairs of classes (left_on, right_on and what holds of the pair) as pairs of left_id and right_id, with what holds of the pair.

    Either side comes in lists, so that a row of the join gives many pairs; left classes that many rows have are split, and a task keeps no more
    of them at a time than one part has, while right lists pass by, shorter ones where parts are larger. A run of left rows is repeated for one right row after another, which
    takes little more in a compressed file than the run itself. Either id may be a struct of all that is needed of a row. total is the
    number of left rows, or of the rows that they are some of; without it they are counted.
    """
    told = [c for c in pairs.columns if c not in {*left_on, *right_on}]
    rows = left.select(*left_on, left_id).dropna(subset=left_on)
    if total is None:
        rows, n = counted(rows)
        total = n["rows"]
    size = max(8, int(PAIRS / max(ROWS, total * HOT_SHARE)))
    lists = pairs.join(members(right, right_on, right_id, size), right_on).select(*left_on, *told, "members")
    rows, lists, on = salted(rows, lists, left_on, [left_id], total, least=ROWS)
    runs = F.transform(F.sequence(F.lit(1), F.size("__all"), F.lit(RUN)), lambda i: F.slice("__all", i, RUN))
    rows = spread(rows, *on).groupBy(*on).agg(_every(left, left_id).alias("__all")).select(*on, F.explode(runs).alias("__run"))
    # Of rows with so many matches neither side may be broadcast: the pairs would be made where the other lies, in a few tasks.
    met = lists.join(rows.hint("merge"), on).select("__run", F.explode("members").alias(right_id), *told)
    return met.select(F.explode("__run").alias(left_id), right_id, *told)


def expanded_apart(left: DataFrame, left_on: list[str], left_id: str, left_key: str, pairs: DataFrame, right: DataFrame, right_on: list[str], right_id: str, right_key: str, total: int) -> DataFrame:
    """expanded, without the pairs whose keys are equal; a null key equals none.

    Keys that the other side lacks should be null: rows without a key are expanded by their ids alone, and only what is left is compared pair by pair.
    """
    some = lambda rows, key, on, member: (rows.where(F.col(key).isNotNull()).select(*on, F.struct(member, key).alias("__" + member)), rows.where(F.col(key).isNull()))
    (left_keyed, left_free), (right_keyed, right_free) = some(left, left_key, left_on, left_id), some(right, right_key, right_on, right_id)
    told = [c for c in pairs.columns if c not in {*left_on, *right_on}]
    met = expanded(left_keyed, left_on, "__" + left_id, pairs, right_keyed, right_on, "__" + right_id, total)
    met = met.where(F.col(f"__{left_id}.{left_key}") != F.col(f"__{right_id}.{right_key}")).select(f"__{left_id}.{left_id}", f"__{right_id}.{right_id}", *told)
    free = expanded(left, left_on, left_id, pairs, right_free, right_on, right_id, total)
    return free.unionByName(expanded(left_free, left_on, left_id, pairs, right_keyed.select(*right_on, f"__{right_id}.{right_id}"), right_on, right_id, total)).unionByName(met)
