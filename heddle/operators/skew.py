"""Joins in which one key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more than this share of all rows, and more than so many, is hot; there are no more than 1 / HOT_SHARE such keys at any size.
HOT_SHARE, HOT_ROWS = 0.001, 20_000


def hot_keys(rows: DataFrame, keys: list[str], salts: str, total: int, least: int | None = None) -> DataFrame:
    """keys of the hot ones, and in column salts into how many parts such a key goes. A thousand rows at most."""
    limit = max(HOT_ROWS if least is None else least, total * HOT_SHARE)
    return rows.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > limit).select(*keys, F.ceil(F.col("__n") / limit).cast("int").alias(salts))


def salted(a: DataFrame, b: DataFrame, keys: list[str], spread_a: list[str], rows_a: int, spread_b: list[str] | None = None, rows_b: int = 0, least: int | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """a and b, and the columns to join them on instead of keys: the rows of a key that is hot in a are dealt by spread_a into parts,
    each of which meets a copy of b's rows of that key; with spread_b, b's hot keys are dealt likewise.

    rows_a and rows_b are the numbers of rows; a side of least (HOT_ROWS) or fewer has no hot key. Parts hold a thousandth of a side or
    least at most, and the hot keys that both sides are told are a thousand rows at most, so broadcasting them is
    safe at any size. Rows with a null key stay, and match nothing.
    """
    joined, sides = list(keys), [a, b]
    least = HOT_ROWS if least is None else least
    # Both sides' keys are counted before copies are made.
    hot = [F.broadcast(hot_keys(s, keys, f"__parts_{i}", n, least)) if spread and n > least else None for i, (s, spread, n) in enumerate(((a, spread_a, rows_a), (b, spread_b, rows_b)))]
    for i, spread in enumerate((spread_a, spread_b)):
        if hot[i] is None:
            continue
        parts, salt = F.coalesce(f"__parts_{i}", F.lit(1)), f"__salt_{i}"
        sides[i] = sides[i].join(hot[i], keys, "left").withColumn(salt, F.pmod(F.xxhash64(*spread), parts).cast("int")).drop(f"__parts_{i}")
        sides[1 - i] = sides[1 - i].join(hot[i], keys, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), parts - 1))).drop(f"__parts_{i}")
        joined.append(salt)
    return sides[0], sides[1], joined
