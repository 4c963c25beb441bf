"""Scans, snapshots and sinks of the lineage tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.operators._loop import staged
from heddle.operators.describe import numbered_within, positions


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Header CSV as text columns, byte-order mark tolerated; required columns are asserted."""
    out = spark.read.option("header", True).option("escape", '"').option("encoding", "UTF-8").csv(path)
    out = out.toDF(*[c.lstrip("﻿") for c in out.columns])
    gone = [c for c in columns or [] if c not in out.columns]
    if gone:
        raise ValueError(f"missing columns: {gone}")
    return out


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, record): the records of CSV files whose quoted fields may hold line ends, read by as many tasks as the files have blocks.

    Lines are read block by block. Whether a block begins inside a quoted field follows from the number of quotes in
    the blocks before it: one sum per block, then sums over those. With that each task puts its lines together; only what reaches
    over a block's edge, two pieces a block at most, is joined afterwards. Quotes are doubled inside quoted fields and stand in no others
    (RFC 4180). A record is at the block in which it begins.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    quotes = (F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))) % 2
    blocks = lines.groupBy("file", "block").agg(F.sum(quotes).alias("quotes"))
    before = F.coalesce(F.sum("quotes").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A row for each block of the files, some millionth of what is read.
    opened = staged(blocks.select("file", "block", (before % 2 == 1).alias("inside")))
    schema = "file string, block long, at long, record string, head boolean, tail boolean"

    def assemble(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, parts, inside, at, first = None, [], False, 0, True
        out: list[tuple] = []

        def close(tail: bool) -> None:
            # The piece before a block's first record belongs to one of an earlier block.
            out.append((*place, -1 if first and begun else at, "\n".join(parts), first and begun, tail))

        for batch in batches:
            for file, block, value, starts_inside in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (file, block) != place:
                    if parts:
                        close(True)
                    place, parts, inside, at, first, begun = (file, block), [], starts_inside, 0, True, starts_inside
                parts.append(value)
                inside ^= value.count('"') % 2 == 1
                if not inside:
                    close(False)
                    at += 0 if first and begun else 1
                    parts, first = [], False
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                out = []
        if parts:
            close(True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    types, names = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()], ["file", "block", "at", "record", "head", "tail"]
    made = staged(lines.join(F.broadcast(opened), ["file", "block"]).select("file", "block", "value", "inside").mapInArrow(assemble, schema))
    edges = made.where("head or tail")
    starts = F.last(F.when(~F.col("head"), F.struct("block", "at")), ignorenulls=True).over(Window.partitionBy("file").orderBy("block", "at"))
    joined = edges.withColumn("of", starts).groupBy("file", "of").agg(F.array_join(F.array_sort(F.collect_list(F.struct("block", "at", "record")))["record"], "\n").alias("record"))
    return made.where("not (head or tail)").select("file", "block", "at", "record").unionByName(joined.select("file", "of.block", "of.at", "record"))


def read_survey(spark: SparkSession, path: str, id_column: str, pattern: str = "R\\_%", columns: list[str] | None = None) -> DataFrame:
    """Multi-line export without its metadata rows, which are those whose id is not like the pattern. Files are split (csv_records); the
    first record of each is its header, and all have the same."""
    header = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).columns
    names = [c.lstrip("\ufeff") for c in header]
    gone = [c for c in [id_column, *(columns or [])] if c not in names]
    if gone:
        raise ValueError(f"missing columns: {gone}")
    rows = csv_records(spark, path).where("not (block = 0 and at = 0) and trim(record) not in ('', '\r')")
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in names)
    parsed = F.from_csv(F.regexp_replace("record", "\r$", ""), schema, {"escape": '"', "multiLine": "true"})
    return rows.select(parsed.alias("r")).select("r.*").where(F.col(id_column).like(pattern))


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str, policy: str = "strict") -> DataFrame:
    """JSON lines under a schema. strict: a bad line fails the read; report: it is kept in _bad; skip: it is dropped."""
    mode = {"strict": "FAILFAST", "report": "PERMISSIVE", "skip": "DROPMALFORMED"}[policy]
    reader = spark.read.option("mode", mode)
    if policy == "report":
        return reader.option("columnNameOfCorruptRecord", "_bad").schema(schema + ", _bad string").json(path)
    return reader.schema(schema).json(path)


def skipped_lines(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """(file, skipped): how many lines the policy skip drops from each file."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})["_bad"].alias("bad"))
    return lines.where("bad is not null").groupBy("file").agg(F.count("*").alias("skipped"))


def read_ordered(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """JSON lines of several paths, folders or globs with src_index, the place in the list of the first of them that names the row's file,
    and src_order (file, block, at), by which rows stand as in their files. Each row comes once.

    An index of the files comes from listing every path; rows find theirs by the exact name.
    """
    distinct = list(dict.fromkeys(paths))
    # The binary source lists files; no content is read for their names alone.
    listed = [spark.read.format("binaryFile").load(p).select(F.col("_metadata.file_path").alias("__file"), F.lit(i).alias("i")) for i, p in enumerate(distinct)]
    index = reduce(DataFrame.unionByName, listed).groupBy("__file").agg(F.min("i").alias("src_index"))
    # A file that several paths name is read for each of them, and its rows count for the first.
    each = [read_jsonl(spark, p, schema, "skip").select("*", F.lit(i).alias("src_index"), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__at")) for i, p in enumerate(distinct)]
    rows = reduce(DataFrame.unionByName, each).join(index, ["__file", "src_index"])
    names = [c for c in rows.columns if c not in ("__file", "__block", "__at", "src_index")]
    return rows.select(*names, "src_index", F.struct(F.col("__file").alias("file"), F.col("__block").alias("block"), F.col("__at").alias("at")).alias("src_order"))


def as_of(table: DataFrame, date: str, requested: str, exact: bool = False) -> DataFrame:
    """Rows of the latest snapshot not after the requested date; with exact, of that date only. The date is found
    by an aggregate that Spark pushes down as a scalar subquery, so only the chosen partition is read."""
    day = F.lit(requested).cast("date")
    if exact:
        return table.where(F.col(date) == day)
    last = table.where(F.col(date) <= day).agg(F.max(date).alias("__last"))
    return table.join(F.broadcast(last), F.col(date) == F.col("__last")).drop("__last")


def token_date(token: Column) -> Column:
    """Date of a MMddyy token; text order is not date order."""
    return F.to_date(token, "MMddyy")


def latest_snapshot(table: DataFrame, token: str) -> DataFrame:
    return table.agg(F.max(token_date(F.col(token))).alias("latest"))


def common_snapshot(tables: list[DataFrame], date: str) -> DataFrame:
    """Latest date that every table has."""
    days = tables[0].select(date).distinct()
    for t in tables[1:]:
        days = days.intersect(t.select(date).distinct())
    return days.agg(F.max(date).alias("latest"))


def snapshot_lock(tables: dict[str, DataFrame], date: str) -> DataFrame:
    """(source, latest, state): conflict where a table's latest date is not that of the newest table."""
    each = None
    for name, t in tables.items():
        one = t.agg(F.max(date).alias("latest")).select(F.lit(name).alias("source"), "latest")
        each = one if each is None else each.unionByName(one)
    newest = each.agg(F.max("latest").alias("newest"))
    return each.crossJoin(F.broadcast(newest)).select("source", "latest", F.when(F.col("latest") == F.col("newest"), "ok").otherwise("conflict").alias("state"))


def write_table(df: DataFrame, path: str, columns: list[str], fill: str = "", order: list[str] | None = None) -> None:
    """Fixed columns in order, missing ones and blanks filled; refuses to overwrite. Rows stand in order (of the columns of df named, else of all that are
    written), in files by ranges whose names follow it."""
    kept = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit(fill)).alias(c) if c in df.columns else F.lit(fill).alias(c) for c in columns], *[F.col(c).alias(f"__{c}") for c in order or []])
    by = [f"__{c}" for c in order or []] + columns
    kept.repartitionByRange(*by).sortWithinPartitions(*by).select(*columns).write.mode("errorifexists").parquet(path)


def entity_documents(rows: DataFrame, key: str, children: DataFrame, order: str, public: Column, size: int = 10_000) -> DataFrame:
    """(key, chunk, doc): a JSON document per entity with its children in order; redacted where not public. An entity of more than size children has further
    documents, numbered from 0, with so many each."""
    rest = [c for c in children.columns if c != key]
    placed = numbered_within(children.where(F.col(key).isNotNull()), [key], [order, *[c for c in rest if c != order]], "__at")
    kids = placed.groupBy(key, F.floor((F.col("__at") - 1) / size).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("__at", F.struct(order, *[c for c in rest if c != order]).alias("x"))))["x"].alias("items"))
    both = rows.join(kids, key, "left")
    doc = F.to_json(F.struct(*[F.when(public, F.col(c)).alias(c) if c != key else F.col(c) for c in rows.columns], F.when(public, F.col("items")).alias("items")))
    return both.select(key, F.coalesce("chunk", F.lit(0)).cast("long").alias("chunk"), doc.alias("doc"))


def batches(rows: DataFrame, order: str, size: int) -> DataFrame:
    """rows with batch number: consecutive in order, size rows each; no task sorts all rows."""
    return positions(rows, "__at", F.col(order)).withColumn("batch", F.floor((F.col("__at") - 1) / size)).drop("__at")


def write_batches(rows: DataFrame, order: str, size: int, folder: str, stem: str, token: str) -> DataFrame:
    """Writes the batches (from 1) as JSON lines, each in a folder of its own named stem_Batch_NN_token.jsonl, numbers padded to the width of the last and two digits
    at least. Returns path and rows of each. An empty table gives one batch number in the width, and no folder."""
    numbered = staged(batches(rows, order, size).withColumn("batch", F.col("batch") + 1))
    total = numbered.agg(F.coalesce(F.max("batch"), F.lit(1))).first()[0]
    name = F.concat(F.lit(f"{stem}_Batch_"), F.lpad(F.col("batch").cast("string"), max(2, len(str(total))), "0"), F.lit(f"_{token}.jsonl"))
    # A batch is bounded, so each is one task's and one file.
    numbered.select(name.alias("file"), *rows.columns).repartition("file").sortWithinPartitions("file", order).write.partitionBy("file").json(folder)
    return numbered.groupBy("batch").agg(F.count("*").alias("rows")).select(F.concat(F.lit(f"{folder}/file="), name).alias("path"), "rows")


def _files(spark: SparkSession, path: str):
    """Hadoop's file context of a path, and the path."""
    jvm = spark._jvm.org.apache.hadoop.fs
    place = jvm.Path(path)
    return jvm.FileContext.getFileContext(place.toUri(), spark._jsc.hadoopConfiguration()), place


def publish(spark: SparkSession, target: str, version: str) -> None:
    """Makes version the one that readers of target see: a pointer is written aside and renamed over the old one, which is one step of the file system."""
    aside = f"{target}/next-{uuid.uuid4().hex}"
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.text(aside)
    context, folder = _files(spark, aside)
    listing = context.util().listStatus(folder)
    part = next(f.getPath() for f in listing if f.getPath().getName().startswith("part-"))
    overwrite = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(part, _files(spark, f"{target}/current.pointer")[1], overwrite)
    context.delete(folder, True)


def published(spark: SparkSession, target: str) -> DataFrame:
    """The published version of target as it is now."""
    pointer = spark.read.format("binaryFile").load(f"{target}/current.pointer").select(F.decode("content", "UTF-8").alias("v")).first()["v"]
    return spark.read.parquet(f"{target}/{pointer.strip()}")


def write_validated(df: DataFrame, target: str, rules: Callable[[DataFrame], DataFrame]) -> bool:
    """Writes df once, as a new version below target that never changes, and publishes it if the rules give no high issue on what was
    written. Readers (published) see the old version or the new one whole; a version that fails stays unread."""
    version, spark = f"version={uuid.uuid4().hex}", df.sparkSession
    df.write.mode("errorifexists").parquet(f"{target}/{version}")
    if rules(spark.read.parquet(f"{target}/{version}")).where("severity = 'high'").limit(1).count():
        return False
    publish(spark, target, version)
    return True
