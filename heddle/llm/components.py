"""Connected components of an edge table by alternating star contractions, as joins and aggregations."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import staged


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _forest(edges: DataFrame) -> DataFrame:
    """Edges of each partition without those between ends that its earlier edges connect: no more than it has ends."""

    def thin(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while parent.setdefault(top, top) != top:
                top = parent[top]
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for batch in batches:
            keep = []
            for i, (u, v) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                a, b = root(u), root(v)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64()))

    return edges.mapInArrow(thin, "u long, v long")


#: Distinct edges up to which one partition holds them all, so that rounds need no exchange; more are dealt out.
ONE_PARTITION = 200_000


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, component_id) of every endpoint of edges(u, v); component_id is the smallest id reachable.

    Self-loops and repeated or reversed edges change nothing; rows with a null endpoint are left out. Each
    round is written to the shared folder, so that no plan grows with the number of rounds; the driver sees
    two numbers a round. The number of rounds grows with the logarithm of the longest path.
    """
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u is not null and v is not null and u <> v").distinct()
    now = staged(_forest(now), "edges")
    small = now.count() <= ONE_PARTITION
    seen = None
    for _ in range(rounds):
        # A star contraction never adds edges, so what fits once fits in all rounds.
        now = staged(_small_star(_large_star(now.coalesce(1) if small else now)), "star")
        mark = now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
    return staged(now.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(roots), "components")
