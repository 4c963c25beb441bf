"""Snapshot, sink, JSON and streaming queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle import functions as H
from heddle import sources as S
from heddle.operators._loop import shared_path

from . import register, table


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("snapshot_date", F.to_date("ts"))


def written(df: DataFrame, kind: str) -> str:
    """Path of df written in a format to the shared folder."""
    path = shared_path(df.sparkSession, f"{kind}-{uuid.uuid4().hex}")
    (df.write.option("header", True) if kind == "csv" else df.write).format(kind).save(path)
    return path


@register("src_csv", "SELECT c_custkey::VARCHAR AS id, c_name AS name FROM customer")
def src_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.read_csv(spark, written(table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_name AS name"), "csv"), ["id", "name"])


@register("src_survey", "SELECT 'R_' || c_custkey AS ResponseId, c_name || chr(10) || c_mktsegment AS Q1 FROM customer WHERE c_custkey % 10 > 0")
def src_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").selectExpr("CASE WHEN c_custkey % 10 > 0 THEN 'R_' || c_custkey ELSE 'Response ID' END AS ResponseId", "c_name || chr(10) || c_mktsegment AS Q1")
    return S.read_survey(spark, written(c, "csv"), "ResponseId", columns=["Q1"])


@register("src_jsonl", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events WHERE event_id % 9 > 0")
def src_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of JSON, some of them broken: those are skipped."""
    lines = table(spark, sf_dir, "events").selectExpr("CASE WHEN event_id % 9 > 0 THEN '{\"event_id\": ' || event_id || ', \"props\": ' || props || '}' ELSE '{\"event_id\": ' || event_id END AS value")
    return S.read_jsonl(spark, written(lines, "text"), "event_id bigint, props struct<k: int>", "skip").select("event_id", F.col("props.k").alias("k"))


@register("src_glob", "SELECT c_custkey, CASE c_custkey % 4 WHEN 2 THEN 0 WHEN 1 THEN 1 WHEN 3 THEN 2 ELSE 1 END AS src_index, row_number() OVER (PARTITION BY c_custkey % 4 ORDER BY c_custkey) AS place FROM customer")
def src_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders whose names hold one another, one with a space, and a glob that takes up two; the row's place in its folder comes from the order in the files."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    base = shared_path(spark, f"glob-{uuid.uuid4().hex}")
    for k, name in enumerate(("x1", "x", "sp ace", "1")):
        c.where(f"c_custkey % 4 = {k}").repartitionByRange(3, "c_custkey").sortWithinPartitions("c_custkey").write.json(f"{base}/{name}")
    rows = S.read_ordered(spark, [f"{base}/sp ace", f"{base}/x*", f"{base}/1", f"{base}/x1"], "c_custkey bigint")
    place = F.row_number().over(Window.partitionBy(F.regexp_extract("src_order.file", "/([^/]+)/[^/]+$", 1)).orderBy("src_order"))
    return rows.select("c_custkey", "src_index", place.alias("place"))


@register("src_asof_snapshot", "SELECT event_id FROM events WHERE ts::DATE = (SELECT max(ts::DATE) FROM events WHERE ts::DATE <= DATE '2024-01-15')")
def src_asof_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.as_of(days(spark, sf_dir), "snapshot_date", "2024-01-15").select("event_id")


@register("src_latest_snapshot", "SELECT max(ts::DATE) AS latest FROM events")
def src_latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.latest_snapshot(table(spark, sf_dir, "events").select(F.date_format("ts", "MMddyy").alias("token")), "token")


@register("src_common_snapshot", "SELECT max(d) AS latest FROM (SELECT ts::DATE AS d FROM events WHERE event_type = 'purchase' INTERSECT SELECT ts::DATE FROM events WHERE event_type = 'error' AND day(ts) < 25)")
def src_common_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = days(spark, sf_dir)
    return S.common_snapshot([d.where("event_type = 'purchase'"), d.where("event_type = 'error' and day(ts) < 25")], "snapshot_date")


@register("src_snapshot_lock", "WITH e AS (SELECT 'all' AS source, max(ts::DATE) AS latest FROM events UNION ALL SELECT 'early', max(ts::DATE) FROM events WHERE day(ts) < 20) SELECT source, latest, CASE WHEN latest = (SELECT max(latest) FROM e) THEN 'ok' ELSE 'conflict' END AS state FROM e")
def src_snapshot_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = days(spark, sf_dir)
    return S.snapshot_lock({"all": d, "early": d.where("day(ts) < 20")}, "snapshot_date")


@register("sink_table", "SELECT c_custkey::VARCHAR AS id, '' AS note, c_name AS name FROM customer")
def sink_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, f"sink-{uuid.uuid4().hex}")
    S.write_table(table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_name AS name", "1 AS extra"), path, ["id", "note", "name"])
    return spark.read.parquet(path)


@register("sink_json_doc", "SELECT n_nationkey, 0::BIGINT AS chunk, '{\"n_nationkey\":' || n_nationkey || CASE WHEN n_nationkey % 2 = 0 THEN ',\"n_name\":\"' || n_name || '\"' || coalesce(',\"items\":[' || string_agg('{\"s_suppkey\":' || s_suppkey || ',\"s_name\":\"' || s_name || '\"}', ',' ORDER BY s_suppkey) || ']', '') ELSE '' END || '}' AS doc FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_name")
def sink_json_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    kids = table(spark, sf_dir, "supplier").selectExpr("s_nationkey AS n_nationkey", "s_suppkey", "s_name")
    return S.entity_documents(n, "n_nationkey", kids, "s_suppkey", F.col("n_nationkey") % 2 == 0)


@register("sink_batches", "WITH b AS (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 500 + 1 AS n FROM orders) SELECT o_orderkey, 'Orders_Batch_' || lpad(n::VARCHAR, greatest(2, len((SELECT max(n) FROM b)::VARCHAR))::INTEGER, '0') || '_010124.jsonl' AS file FROM b")
def sink_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch files of 500 orders, written and read back."""
    folder = shared_path(spark, f"batches-{uuid.uuid4().hex}")
    S.write_batches(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 500, folder, "Orders", "010124")
    return spark.read.schema("o_orderkey bigint, file string").json(folder)


@register("sink_validated", "SELECT count(*) AS rows FROM customer")
def sink_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    target = shared_path(spark, f"target-{uuid.uuid4().hex}")
    rule = lambda rows: rows.where("c_custkey is null").selectExpr("'high' AS severity")
    S.write_validated(c, target, rule)
    # Has a row without a key, so what is published stays.
    S.write_validated(c.selectExpr("nullif(c_custkey, 1) AS c_custkey"), target, rule)
    return S.published(spark, target).agg(F.count("*").alias("rows"))


@register("json_props", "SELECT event_type, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS total FROM events GROUP BY event_type")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k bigint")["k"].alias("k"))
    return e.groupBy("event_type").agg(F.sum("k").alias("total"))


@register("g_parse_listing", r"SELECT p_partkey, p_name AS name, 'u' || p_partkey || '@d.org' AS email, CASE WHEN p_partkey % 4 > 0 THEN 2000 + p_partkey % 20 END::INTEGER AS year FROM part WHERE p_partkey % 5 > 0")
def g_parse_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free-text listings, one line per person or note, taken apart to name, e-mail and year; notes are left out."""
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", "'* a note' || chr(10) || CASE WHEN p_partkey % 5 = 0 THEN p_name || ' dropped out' ELSE p_name || ' (old place), ' || CASE WHEN p_partkey % 4 > 0 THEN cast(2000 + p_partkey % 20 as string) || ', ' ELSE '' END || 'u' || p_partkey || ' d.org' END AS listing")
    lines = p.select("p_partkey", F.explode(F.split("listing", "\n")).alias("line")).withColumn("f", H.text_flags("line")).where("not f.skip and not f.disqualified")
    fixed = lines.select("p_partkey", H.fix_email("line").alias("line"))
    rest = fixed.select("p_partkey", H.extract_emails("line").alias("emails"), H.without_emails("line").alias("rest"))
    parts = rest.select("p_partkey", "emails", H.extract_year("rest").alias("year"), F.filter(F.transform(F.split(H.without_year("rest"), ","), lambda x: H.clean_name(x)), lambda x: H.looks_like_name(x)).alias("names"))
    return parts.select("p_partkey", F.coalesce(F.get("names", F.lit(0)), H.name_from_email(F.get("emails", F.lit(0)))).alias("name"), F.array_join("emails", ";").alias("email"), "year")


@register("st_response_delta", "SELECT event_type, count(*) AS n FROM events WHERE event_id % 7 <> 0 GROUP BY event_type")
def st_response_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two exports that share rows, as files of a stream: each event once, those of a baseline left out."""
    from heddle.streaming import response_delta

    e = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    folder, out = shared_path(spark, f"exports-{uuid.uuid4().hex}"), shared_path(spark, f"delta-{uuid.uuid4().hex}")
    e.write.parquet(folder)
    e.where("event_id % 3 = 0").write.mode("append").parquet(folder)
    baseline = e.where("event_id % 7 = 0").select("event_id")

    keep = lambda rows: rows.join(baseline, "event_id", "left_anti")
    response_delta(spark, folder, "event_id bigint, ts timestamp, event_type string", "event_id", keep, out, f"{out}-state", files=2).awaitTermination()
    return spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n"))
