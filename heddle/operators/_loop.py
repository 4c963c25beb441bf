"""Lineage cuts for iterative operators: written tables in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


_own: dict[str, str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A path below spark.checkpoint.dir; below a temporary folder where that is unset and Spark runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if "dir" not in _own:
            _own["dir"] = "file://" + tempfile.mkdtemp(prefix="spark-")
        base = _own["dir"]
    return f"{base.rstrip('/')}/heddle-{name}"


def staged(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read back."""
    path = shared_path(df.sparkSession, f"loop-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, **tests: Column) -> tuple[DataFrame, dict[str, int]]:
    """staged(df), and how many rows it has (rows) and how many of them pass each test, observed while they are written."""
    seen = Observation()
    marked = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(t).alias(k) for k, t in tests.items()])
    return staged(marked), seen.get


@contextmanager
def bucketed(df: DataFrame, key: str) -> Iterator[DataFrame]:
    """df written once in buckets of key, so that joins on it leave these rows where they are. The table's name is given up at the end; its
    files, below the shared folder, stay for tasks that run again."""
    spark = df.sparkSession
    name = f"heddle_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(parts, key).write.bucketBy(parts, key).sortBy(key).option("path", shared_path(spark, f"bucketed-{name}")).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


#: Rows of one task where groups are made into lists.
TASK_ROWS = 500_000


def in_tasks(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df, of about so many rows, dealt by keys into tasks of TASK_ROWS at most on average, and no fewer than shuffle partitions. A number that is asked for
    is kept, so tasks don't grow with the input as those that Spark merges by compressed size do."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS)), *keys)


def is_empty(df: DataFrame) -> bool:
    return not df.limit(1).count()


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with further columns behind a generator, so that no filter or projection above it computes them again."""
    made = F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))).alias(*columns)
    return df.select(*[c for c in df.columns if c not in columns], made)
