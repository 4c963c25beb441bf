"""Quality-rule queries; violations come from key classes of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle import functions as H
from heddle.operators import describe as D
from heddle.operators import rules as R

from . import register, table


@register("dq_schema", "SELECT p_partkey, list_filter([CASE WHEN p_partkey % 5 = 0 THEN 'name: required' END, CASE WHEN p_type NOT IN ('SMALL', 'ECONOMY') THEN 'kind: not allowed' END, CASE WHEN p_partkey % 7 = 0 THEN 'year: not a whole number' END, CASE WHEN p_size > 40 AND p_type = 'SMALL' THEN 'size: too large for its kind' END], lambda x: x IS NOT NULL) AS errors FROM part")
def dq_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", "CASE WHEN p_partkey % 5 = 0 THEN ' ' ELSE p_name END AS name", "p_type AS kind", "CASE WHEN p_partkey % 7 = 0 THEN '12a' ELSE '12' END AS year", "p_size")
    cross = {"size: too large for its kind": (F.col("p_size") > 40) & (F.col("kind") == "SMALL")}
    return p.select("p_partkey", R.record_errors(["name"], {"kind": ["SMALL", "ECONOMY"]}, ["year"], cross).alias("errors"))


@register("dq_cross_source", "WITH x AS (SELECT p_partkey, p_partkey % 4 <> 0 AS nm, CASE WHEN p_partkey % 3 > 0 THEN (p_partkey % 10) / 10.0 END AS ov, p_size AS h, p_size * 40 AS c, CASE WHEN p_partkey % 6 > 0 THEN 2020 - p_partkey % 20 END AS y FROM part), r AS (SELECT p_partkey, NOT nm AS f, coalesce(ov < 0.5, false) OR (y IS NOT NULL AND (h > 5 * greatest(1, 2024 - y) OR c > 50 * greatest(1, 2024 - y))) AS w FROM x) SELECT p_partkey, CASE WHEN f THEN 'fail' WHEN w THEN 'warn' ELSE 'pass' END AS overall FROM r")
def dq_cross_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_partkey % 4 <> 0 AS nm", "CASE WHEN p_partkey % 3 > 0 THEN (p_partkey % 10) / 10.0 END AS ov", "p_size AS h", "p_size * 40 AS c", "CASE WHEN p_partkey % 6 > 0 THEN 2020 - p_partkey % 20 END AS y", "'https://a.org/x' AS u")
    return p.select("p_partkey", R.cross_source(F.col("nm"), F.col("ov"), F.col("h"), F.col("c"), F.col("y"), 2024, F.col("u"))["overall"].alias("overall"))


@register("dq_coverage", "SELECT o_custkey AS id, 'orphan_advisor' AS issue FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 > 0)) UNION ALL SELECT c_custkey, 'isolated' FROM customer WHERE c_custkey % 3 > 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)")
def dq_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").where("c_custkey % 3 > 0").selectExpr("c_custkey AS id")
    edges = table(spark, sf_dir, "orders").selectExpr("o_custkey AS src")
    return R.union(R.orphans(edges, people), R.missing(people, edges.selectExpr("src AS id"), "id", "isolated"))


GEN = "CASE WHEN p_partkey % 4 > 0 THEN p_partkey % 4 END AS told, CASE WHEN p_partkey % 5 > 0 THEN p_partkey % 3 + 1 END AS final"


@register("dq_generation", f"WITH g AS (SELECT p_partkey, {GEN} FROM part) SELECT p_partkey, 'blank' AS issue FROM g WHERE final IS NULL UNION ALL SELECT p_partkey, 'filled' FROM g WHERE told IS NULL AND final IS NOT NULL UNION ALL SELECT p_partkey, 'overridden' FROM g WHERE told <> final")
def dq_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    told, final = F.col("told"), F.col("final")
    g = table(spark, sf_dir, "part").selectExpr("p_partkey", *GEN.split(", "))
    return R.when_issues(g, "p_partkey", {"blank": final.isNull(), "filled": told.isNull() & final.isNotNull(), "overridden": told != final})


@register("dq_canon", "SELECT p_brand AS raw, count(*) AS n FROM part WHERE p_brand NOT IN ('Brand#1', 'Brand#2') GROUP BY p_brand")
def dq_canon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw spellings that no dictionary entry covers, with their counts."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("raw"))
    return p.where(H.lookup(H.canon_key("raw"), {"brand#1": "One", "brand#2": "Two"}).isNull()).groupBy("raw").agg(F.count("*").alias("n"))


@register("dq_readiness", "SELECT CASE WHEN count(*) FILTER (c_acctbal < -900) > 0 THEN 'FAIL' WHEN count(*) FILTER (c_acctbal < 0) > 0 THEN 'WARN' ELSE 'PASS' END AS status, count(*) FILTER (c_acctbal < -900) AS high, count(*) FILTER (c_acctbal < 0) AS issues FROM customer")
def dq_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.status_rollup(table(spark, sf_dir, "customer").where("c_acctbal < 0").selectExpr("CASE WHEN c_acctbal < -900 THEN 'high' ELSE 'low' END AS severity"))


@register("dq_pair_audit", "WITH c AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem) SELECT s || '-' || p AS pair, 'unaudited' AS issue FROM c WHERE p % 10 = 0 UNION ALL SELECT s || '-' || p, 'duplicate' FROM c WHERE p % 10 <> 0 AND p % 7 = 0 UNION ALL SELECT s || '-x' || p, 'not_captured' FROM c WHERE p % 50 = 1")
def dq_pair_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows against captured edges: edges without an audit row, audit rows twice, and of no edge."""
    c = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    pair = c.selectExpr("l_suppkey || '-' || l_partkey AS pair", "l_partkey", "l_suppkey")
    good = pair.where("l_partkey % 10 <> 0").select("pair")
    audit = R.union(good, pair.where("l_partkey % 10 <> 0 and l_partkey % 7 = 0").select("pair"), pair.where("l_partkey % 50 = 1").selectExpr("l_suppkey || '-x' || l_partkey AS pair"))
    return R.union(R.missing(pair.select("pair"), audit, "pair", "unaudited"), R.duplicates(audit, "pair"), R.missing(audit, pair, "pair", "not_captured"))


@register("dq_capture_audit", """
WITH adv AS (SELECT s_suppkey AS a FROM supplier WHERE s_suppkey % 9 > 0),
lst AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS c FROM lineitem WHERE l_suppkey % 5 > 0),
aud AS (SELECT l_suppkey AS a, l_partkey + CASE WHEN l_linenumber = 2 THEN 1000000 ELSE 0 END AS c, CASE WHEN l_linenumber % 3 = 0 THEN 'absent' ELSE 'captured' END AS st, l_orderkey AS o FROM lineitem WHERE l_suppkey % 4 > 0),
kn AS (SELECT aud.*, lst.a IS NOT NULL AS ok FROM aud JOIN adv USING (a) LEFT JOIN lst ON lst.a = aud.a AND lst.c = aud.c),
b AS (SELECT a, c, bool_or(st = 'captured') AS cap FROM kn WHERE st <> 'captured' OR ok GROUP BY a, c),
h AS (SELECT a, 'audited' AS origin, count(*) AS n, count(*) FILTER (cap) AS k FROM b GROUP BY a),
m AS (SELECT adv.a, 'synthesised' AS origin, greatest(count(lst.c), 1) AS n, count(lst.c) AS k FROM adv LEFT JOIN lst USING (a) WHERE adv.a NOT IN (SELECT a FROM h) GROUP BY adv.a)
SELECT u.a AS advisor, u.origin, u.n AS rows, u.k AS captured, coalesce((SELECT count(*) FROM kn WHERE kn.a = u.a), 0) - CASE WHEN u.origin = 'audited' THEN u.n ELSE 0 END AS dropped FROM (SELECT * FROM h UNION ALL SELECT * FROM m) u""")
def dq_capture_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as advisors, the parts they ship as children, line items as rows of a hand-made audit with gaps."""
    line = table(spark, sf_dir, "lineitem")
    advisors = table(spark, sf_dir, "supplier").where("s_suppkey % 9 > 0").selectExpr("s_suppkey AS advisor")
    listed = line.where("l_suppkey % 5 > 0").selectExpr("l_suppkey AS advisor", "l_partkey AS child").distinct()
    audit = line.where("l_suppkey % 4 > 0").selectExpr("l_suppkey AS advisor", "l_partkey + CASE WHEN l_linenumber = 2 THEN 1000000 ELSE 0 END AS child", "CASE WHEN l_linenumber % 3 = 0 THEN 'absent' ELSE 'captured' END AS status", "l_orderkey AS at")
    return R.capture_audit(advisors, audit, listed)


@register("dq_gap_queue", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'recovered' WHEN s_acctbal > 5000 THEN 'high' WHEN s_acctbal > 0 THEN 'medium' ELSE 'low' END AS priority FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)")
def dq_gap_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advisors who say yes but list nobody: recovery status, then a ladder of priorities."""
    listed = table(spark, sf_dir, "lineitem").where("l_quantity > 49").selectExpr("l_suppkey AS s_suppkey")
    s = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").join(listed, "s_suppkey", "left_anti")
    return s.select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, "recovered").when(F.col("s_acctbal") > 5000, "high").when(F.col("s_acctbal") > 0, "medium").otherwise("low").alias("priority"))


@register("dq_pair_verify", "SELECT o_orderkey AS k, 'unknown_end' AS issue FROM orders WHERE o_custkey % 9 = 0 UNION ALL SELECT o_orderkey, 'bad_status' FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_orderkey, 'not_survey_backed' FROM orders WHERE o_custkey % 9 <> 0 AND o_orderkey % 5 = 0")
def dq_pair_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "customer").where("c_custkey % 9 <> 0").selectExpr("c_custkey AS o_custkey", "true AS known")
    o = table(spark, sf_dir, "orders").join(known, "o_custkey", "left").withColumnRenamed("o_orderkey", "k")
    return R.when_issues(o, "k", {"unknown_end": F.col("known").isNull(), "bad_status": ~F.col("o_orderstatus").isin("O", "F"), "not_survey_backed": F.col("known") & (F.col("k") % 5 == 0)})


@register("dq_alignment", "SELECT c_custkey AS k, CASE WHEN c_custkey % 11 = 0 THEN 'only_left' WHEN c_custkey % 4 = 0 THEN 'differs: segment' ELSE 'differs: name' END AS issue FROM customer WHERE c_custkey % 11 = 0 OR c_custkey % 4 = 0 OR c_custkey % 6 = 0")
def dq_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "c_mktsegment AS segment", "c_name AS name")
    b = a.where("k % 11 <> 0").selectExpr("k", "CASE WHEN k % 4 = 0 THEN NULL ELSE segment END AS segment", "CASE WHEN k % 6 = 0 THEN 'x' ELSE name END AS name")
    return R.first_mismatch(a, b, "k", ["segment", "name"])


@register("dq_domain", "SELECT s_suppkey, 'state_without_us' AS issue FROM supplier WHERE s_suppkey % 3 = 0 AND s_nationkey > 5 UNION ALL SELECT s_suppkey, 'state_not_two_letters' FROM supplier WHERE s_suppkey % 6 = 0 UNION ALL SELECT s_suppkey, 'placeholder' FROM supplier WHERE s_suppkey % 10 = 0")
def dq_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "CASE WHEN s_suppkey % 6 = 0 THEN 'Ohio' WHEN s_suppkey % 3 = 0 THEN 'OH' END AS state", "CASE WHEN s_nationkey > 5 THEN 'FR' ELSE 'US' END AS country", "CASE WHEN s_suppkey % 10 = 0 THEN ' TBD' ELSE s_name END AS note")
    rules = R.when_issues(s, "s_suppkey", {"state_without_us": F.col("state").isNotNull() & (F.col("country") != "US"), "state_not_two_letters": ~F.col("state").rlike("^[A-Z]{2}$")})
    return R.union(rules, R.placeholders(s, "s_suppkey", ["note", "state"], ["tbd", "n/a", "unknown"]).select("s_suppkey", F.lit("placeholder").alias("issue")))


@register("dq_pii_scan", r"SELECT doc_id, len(f)::INTEGER AS n, f[1] AS sample FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\.[A-Za-z0-9_]+') AS f FROM documents) WHERE len(f) > 0")
def dq_pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.pii_scan(table(spark, sf_dir, "documents"), "doc_id", "text")


@register("dq_research", "SELECT p_name AS value, count(DISTINCT p_brand) AS owners FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) > 1")
def dq_research(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that rows of different owners share."""
    return R.reused(table(spark, sf_dir, "part").selectExpr("p_name AS value", "p_brand AS owner"), "value", "owner")


@register("dq_reconcile", "SELECT o_orderstatus AS k, count(*) + 1 AS expected, count(*) AS actual FROM orders WHERE o_orderstatus = 'P' GROUP BY 1")
def dq_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    actual = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("k")).agg(F.count("*").alias("n"))
    return R.reconcile(actual.select("k", (F.col("n") + (F.col("k") == "P").cast("int")).alias("n")), actual, "k")


@register("dq_decisions", "SELECT c_custkey AS k, 'bad_decision' AS issue FROM customer WHERE c_custkey % 8 = 0 UNION ALL SELECT c_custkey, 'missing_id' FROM customer WHERE c_custkey % 8 = 1 AND c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'duplicate' FROM customer WHERE c_custkey % 30 = 0")
def dq_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "CASE c_custkey % 8 WHEN 0 THEN 'maybe' WHEN 1 THEN 'approve_match' ELSE 'reject_match' END AS decision", "CASE WHEN c_custkey % 3 > 0 THEN 7 END AS proposed")
    every = R.union(d, d.where("k % 30 = 0"))
    enum = ["approve_match", "replace_match", "keep_match", "reject_match", "needs_more_review"]
    return R.union(R.when_issues(d, "k", {"bad_decision": ~F.col("decision").isin(*enum), "missing_id": F.col("decision").isin("approve_match", "replace_match") & F.col("proposed").isNull()}), R.duplicates(every, "k"))


@register("dq_unique", "SELECT l_orderkey || '-' || l_linenumber AS k, 'duplicate' AS issue FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def dq_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.duplicates(table(spark, sf_dir, "lineitem").selectExpr("l_orderkey || '-' || l_linenumber AS k"), "k")


@register("dq_row_count", "SELECT (SELECT count(*) FROM customer) AS rows_in, (SELECT count(*) FROM customer) AS rows_out, true AS ok")
def dq_row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows out of a many-to-one join equal rows in."""
    c = table(spark, sf_dir, "customer")
    out = c.join(table(spark, sf_dir, "nation").selectExpr("n_nationkey AS c_nationkey", "n_name"), "c_nationkey", "left")
    both = c.agg(F.count("*").alias("rows_in")).crossJoin(out.agg(F.count("*").alias("rows_out")))
    return both.withColumn("ok", F.col("rows_in") == F.col("rows_out"))
