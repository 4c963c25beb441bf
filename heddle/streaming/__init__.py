"""Newly arriving exports as a stream: each id once, told by keyed state, whatever the order of arrival."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Keyed state lives in RocksDB: on an executor's disk with changes kept in the checkpoint folder, not in its heap.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def new_responses(stream: DataFrame, id_column: str, time_column: str, lateness: str = "7 days") -> DataFrame:
    """Rows of a stream whose id was not seen within the lateness; state is bounded by the watermark. Rows that come
    later than that are dropped: for those, and for exports in any order, take first_responses."""
    return stream.withWatermark(time_column, lateness).dropDuplicatesWithinWatermark([id_column])


def first_responses(stream: DataFrame, id_column: str, remember: str = "400 days") -> DataFrame:
    """One row of a stream for each id, the first that comes; rows without an id count as one id.

    Rows are stamped with the time of their micro-batch, and the watermark goes by that stamp. So no row is ever late, whatever its event
    time, and an id's state, which is its stamp, goes when it has been remembered for so long.
    """
    stamped = stream.withColumn("__arrived", F.current_timestamp()).withWatermark("__arrived", remember)
    return stamped.dropDuplicatesWithinWatermark([id_column]).drop("__arrived")


def state_rows(query: StreamingQuery) -> list[int]:
    """How many keys the state held after each micro-batch."""
    return [sum(op["numRowsTotal"] for op in p["stateOperators"]) for p in query.recentProgress if p["stateOperators"]]


def response_delta(spark: SparkSession, folder: str, schema: str, id_column: str, keep: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files: int = 100, remember: str = "400 days") -> StreamingQuery:
    """Runs through the files that lie in the folder and writes each id's row once below out, then ends; called again with the same
    checkpoint, it goes on with the files that have come since.

    keep is applied to the stream (for instance an anti-join with a baseline). Which ids were there is keyed state in the checkpoint; earlier output
    is never read, and the file sink writes each micro-batch once, also when it is run again.
    """
    stream = keep(spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder))
    first = first_responses(stream, id_column, remember)
    key, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(key, ROCKSDB)
    try:
        # A query keeps the settings with which it starts.
        return first.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(key, before)
