"""Joins of rows with a table of their keys where single keys may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than this share of all rows is hot. There can be no more than 1 / HOT_SHARE of such keys.
HOT_SHARE = 0.001


def spread_join(rows: DataFrame, table: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with table, which is unique by key and says in column count how many rows have it.

    Rows of hot keys stay where they are and meet a broadcast of those keys, of which there are 1,000 at most at
    any size (more than a thousandth of total each); the rest is joined by a shuffle in which no key holds more than a
    thousandth of the rows. how is inner or left; rows with a null key match nothing. count is not returned.
    """
    least = total * HOT_SHARE
    hot = F.broadcast(table.where(F.col(count) > least).drop(count))
    rest = rows.join(hot.select(key), key, "left_anti").join(table.where(F.col(count) <= least).drop(count), key, how)
    return rows.join(hot, key).unionByName(rest)
