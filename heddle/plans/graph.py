"""Graph queries over the lineage ROOT -> region -> nation -> supplier -> part, in which parts have many parents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle import functions as H
from heddle.operators import graph as G

from . import register, table

EDGES = """
e AS (SELECT 'ROOT' AS src, 'R' || r_regionkey AS dst FROM region
  UNION ALL SELECT 'R' || n_regionkey, 'N' || n_nationkey FROM nation
  UNION ALL SELECT 'N' || s_nationkey, 'S' || s_suppkey FROM supplier
  UNION ALL SELECT DISTINCT 'S' || l_suppkey, 'P' || l_partkey FROM lineitem)"""
NODES = """
v AS (SELECT 'ROOT' AS node, 'root' AS label, 0 AS generation, true AS respondent, true AS has_students
  UNION ALL SELECT 'R' || r_regionkey, r_name, 1, true, true FROM region
  UNION ALL SELECT 'N' || n_nationkey, n_name, 2, n_nationkey % 5 <> 0, true FROM nation
  UNION ALL SELECT 'S' || s_suppkey, s_name, 3, s_suppkey % 3 <> 0, s_suppkey % 4 <> 0 FROM supplier
  UNION ALL SELECT 'P' || p_partkey, p_name, 4, p_partkey % 2 = 0, p_partkey % 10 = 0 FROM part)"""
REACH = "WITH RECURSIVE" + EDGES + ", d AS (SELECT src AS focal, dst AS node FROM e WHERE src LIKE 'R%' AND src <> 'ROOT' UNION SELECT d.focal, e.dst FROM d JOIN e ON e.src = d.node)"


def edges(spark: SparkSession, sf_dir: str, repeated: bool = False) -> DataFrame:
    """The edges, each once; repeated: as lines have them, for operators to which an edge that comes again tells nothing new."""
    t = lambda n: table(spark, sf_dir, n)
    lines = t("lineitem").select("l_suppkey", "l_partkey")
    parts = [
        t("region").selectExpr("'ROOT' AS src", "'R' || r_regionkey AS dst"),
        t("nation").selectExpr("'R' || n_regionkey AS src", "'N' || n_nationkey AS dst"),
        t("supplier").selectExpr("'N' || s_nationkey AS src", "'S' || s_suppkey AS dst"),
        (lines if repeated else lines.distinct()).selectExpr("'S' || l_suppkey AS src", "'P' || l_partkey AS dst"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    root = t("region").agg(F.count("*").alias("n")).selectExpr("'ROOT' AS node", "'root' AS label", "0 AS generation", "true AS respondent", "true AS has_students")
    return (
        root.unionByName(t("region").selectExpr("'R' || r_regionkey AS node", "r_name AS label", "1 AS generation", "true AS respondent", "true AS has_students"))
        .unionByName(t("nation").selectExpr("'N' || n_nationkey AS node", "n_name AS label", "2 AS generation", "n_nationkey % 5 <> 0 AS respondent", "true AS has_students"))
        .unionByName(t("supplier").selectExpr("'S' || s_suppkey AS node", "s_name AS label", "3 AS generation", "s_suppkey % 3 <> 0 AS respondent", "s_suppkey % 4 <> 0 AS has_students"))
        .unionByName(t("part").selectExpr("'P' || p_partkey AS node", "p_name AS label", "4 AS generation", "p_partkey % 2 = 0 AS respondent", "p_partkey % 10 = 0 AS has_students"))
    )


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").selectExpr("'R' || r_regionkey AS focal")


@register("win_rank_subtree", REACH + "SELECT focal, count(*) AS descendants, row_number() OVER (ORDER BY count(*) DESC, focal)::INTEGER AS rank FROM d GROUP BY focal")
def win_rank_subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    focal = regions(spark, sf_dir)
    kept, _ = G.remove_cycles(edges(spark, sf_dir, True))
    return G.rank_subtrees(G.descendant_counts(focal, G.descendants(kept, focal)))


@register("g_descendants_blocked", "WITH RECURSIVE" + EDGES + ", f AS (SELECT 'N' || n_nationkey AS focal FROM nation UNION ALL SELECT 'R' || r_regionkey FROM region), x AS (SELECT * FROM e WHERE dst NOT IN (SELECT focal FROM f)), d AS (SELECT src AS focal, dst AS node FROM x WHERE src IN (SELECT focal FROM f) UNION SELECT d.focal, x.dst FROM d JOIN x ON x.src = d.node) SELECT * FROM d")
def g_descendants_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    focal = regions(spark, sf_dir).unionByName(table(spark, sf_dir, "nation").selectExpr("'N' || n_nationkey AS focal"))
    return G.descendants(edges(spark, sf_dir, True), focal)


@register("g_descendant_summary", REACH + "SELECT count(DISTINCT node) AS unique_nodes, count(*) AS summed, count(*) - count(DISTINCT node) AS overlap FROM d")
def g_descendant_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.descendant_summary(G.descendants(edges(spark, sf_dir, True), regions(spark, sf_dir)))


@register("agg_overlap", REACH + ", c AS (SELECT focal, count(*) AS n FROM d GROUP BY focal) SELECT sum(n)::BIGINT - (SELECT count(DISTINCT node) FROM d) AS overlap FROM c")
def agg_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.descendant_summary(G.descendants(edges(spark, sf_dir, True), regions(spark, sf_dir))).select("overlap")


@register("agg_subtree_stats", REACH + ", c AS (SELECT focal, count(*) AS n FROM d GROUP BY focal) SELECT avg(n) AS mean, median(n)::DOUBLE AS median, min(n) AS least, max(n) AS most, coalesce(stddev_samp(n), 0) AS deviation FROM c")
def agg_subtree_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    focal = regions(spark, sf_dir)
    c = G.descendant_counts(focal, G.descendants(edges(spark, sf_dir, True), focal))
    return c.agg(F.avg("descendants").alias("mean"), F.median("descendants").alias("median"), F.min("descendants").alias("least"), F.max("descendants").alias("most"), F.coalesce(F.stddev_samp("descendants"), F.lit(0.0)).alias("deviation"))


BACK = "b AS (SELECT * FROM e UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier WHERE s_suppkey % 7 = 0 UNION ALL SELECT 'P' || p_partkey, 'P' || p_partkey FROM part WHERE p_partkey % 500 = 0)"


@register("g_cycle_edges", "WITH" + EDGES + ", " + BACK + " SELECT src, dst FROM b WHERE src = dst OR (src LIKE 'S%' AND dst LIKE 'N%')")
def g_cycle_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Back edges from suppliers to their nations, and self-loops, are what the component rule removes."""
    back = table(spark, sf_dir, "supplier").where("s_suppkey % 7 = 0").selectExpr("'S' || s_suppkey AS src", "'N' || s_nationkey AS dst")
    loops = table(spark, sf_dir, "part").where("p_partkey % 500 = 0").selectExpr("'P' || p_partkey AS src", "'P' || p_partkey AS dst")
    _, removed = G.remove_cycles(edges(spark, sf_dir).unionByName(back).unionByName(loops))
    # Ids sort N < S, so within a component of a nation and its suppliers the edge to the nation is the one to go.
    return removed


@register("g_generation", "WITH" + EDGES + ", " + NODES + " SELECT node, generation FROM v WHERE node NOT LIKE 'P%' OR node IN (SELECT dst FROM e) UNION ALL SELECT node, 9 FROM v WHERE node LIKE 'P%' AND node NOT IN (SELECT dst FROM e)")
def g_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reported generations are wrong or missing below the root, and topology puts them right."""
    told = nodes(spark, sf_dir).select("node", F.when(F.col("node") == "ROOT", 0).when(F.col("node").startswith("P"), 9).otherwise(F.lit(None)).cast("int").alias("generation"))
    return G.generations(told, edges(spark, sf_dir, True))


@register("g_primary_parent", "WITH" + EDGES + ", " + NODES + " SELECT dst AS node, arg_min(src, (CASE WHEN c.generation = 1 AND src = 'ROOT' THEN 0 WHEN src <> 'ROOT' THEN 1 ELSE 2 END, -p.generation, p.label, src)) AS parent FROM e JOIN v c ON c.node = dst JOIN v p ON p.node = src GROUP BY dst")
def g_primary_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.primary_parents(edges(spark, sf_dir, True), nodes(spark, sf_dir), "ROOT")


PRIMARY = "pp AS (SELECT dst AS node, arg_min(src, (p.label, src)) AS parent FROM e JOIN v p ON p.node = src GROUP BY dst)"


@register("g_secondary_parents", "WITH" + EDGES + ", " + NODES + ", " + PRIMARY + " SELECT dst AS node, string_agg(label, ', ' ORDER BY label) AS others FROM e JOIN v ON v.node = src WHERE NOT EXISTS (SELECT 1 FROM pp WHERE pp.node = dst AND pp.parent = src) GROUP BY dst")
def g_secondary_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, v = edges(spark, sf_dir, True), nodes(spark, sf_dir)
    return G.secondary_parents(e, G.primary_parents(e, v, "ROOT"), v)


PATHS = "WITH RECURSIVE" + EDGES + ", " + NODES + ", " + PRIMARY + ", w AS (SELECT node, parent AS top, [parent] AS path FROM pp UNION ALL SELECT w.node, pp.parent, list_prepend(pp.parent, w.path) FROM w JOIN pp ON pp.node = w.top)"


@register("g_ancestor_path", PATHS + "SELECT node, array_to_string(arg_max(path, len(path)), '/') AS path FROM w GROUP BY node")
def g_ancestor_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, v = edges(spark, sf_dir, True), nodes(spark, sf_dir)
    return G.ancestor_paths(G.primary_parents(e, v, "ROOT")).select("node", F.array_join("path", "/").alias("path"))


@register("g_tree_counts", PATHS + "SELECT top AS node, count(*) AS descendants FROM w GROUP BY top")
def g_tree_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, v = edges(spark, sf_dir, True), nodes(spark, sf_dir)
    return G.tree_counts(G.primary_parents(e, v, "ROOT"))


@register("g_neighbours", "WITH" + EDGES + ", " + NODES + ", u AS (SELECT dst AS node, string_agg(DISTINCT label, '|' ORDER BY label) AS a FROM e JOIN v ON v.node = src GROUP BY dst), w AS (SELECT src AS node, string_agg(DISTINCT label, '|' ORDER BY label) AS s FROM e JOIN v ON v.node = dst GROUP BY src) SELECT node, 0::BIGINT AS chunk, coalesce(a, '') AS advisors, coalesce(s, '') AS students FROM v LEFT JOIN u USING (node) LEFT JOIN w USING (node)")
def g_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.neighbours(edges(spark, sf_dir, True), nodes(spark, sf_dir)).select("node", "chunk", F.array_join("advisors", "|").alias("advisors"), F.array_join("students", "|").alias("students"))


@register("g_child_status", "WITH" + EDGES + ", " + NODES + ", b AS (SELECT src AS node, max(generation) AS deepest FROM e JOIN v ON v.node = dst GROUP BY src) SELECT node, CASE WHEN NOT respondent THEN 'non_respondent' WHEN NOT has_students THEN 'answered_no' WHEN deepest IS NULL THEN 'no_outgoing_edges' WHEN deepest > generation THEN 'has_descendants' ELSE 'same_generation_only' END AS status FROM v LEFT JOIN b USING (node)")
def g_child_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.child_status(nodes(spark, sf_dir), edges(spark, sf_dir))


@register("g_isolated", "WITH" + EDGES + ", " + NODES + " SELECT node, 'isolated' AS issue FROM v WHERE node NOT IN (SELECT src FROM e UNION SELECT dst FROM e) UNION ALL SELECT node, 'yes_without_children' FROM v WHERE has_students AND node NOT IN (SELECT src FROM e)")
def g_isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.isolated(nodes(spark, sf_dir), edges(spark, sf_dir))


@register("agg_degree", "WITH" + EDGES + ", u AS (SELECT src AS node, 1 AS o, 0 AS r FROM e UNION ALL SELECT dst, 0, CASE WHEN src = 'ROOT' THEN 1 ELSE 0 END FROM e) SELECT node, count(*) AS incident, sum(o)::BIGINT AS outgoing, sum(r)::BIGINT AS from_root FROM u GROUP BY node")
def agg_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degrees(edges(spark, sf_dir), "ROOT")


@register("g_tree_shape", "WITH" + NODES + " SELECT generation, count(*) AS nodes FROM v GROUP BY generation")
def g_tree_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.tree_shape(nodes(spark, sf_dir))


PEOPLE = {
    "choice": "CASE p_partkey % 6 WHEN 0 THEN 'is my advisor' WHEN 1 THEN 'advisor of my advisor,member of my dissertation committee' WHEN 2 THEN 'of my phd advisor' WHEN 3 THEN 'member of my dissertation committee' WHEN 4 THEN 'other' END",
    "final": "CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 END",
    "promoted": "CASE WHEN p_partkey % 6 = 3 AND p_partkey % 5 = 0 THEN 'committee_only' WHEN p_partkey % 6 = 1 AND p_partkey % 5 = 0 THEN 'mixed' END",
}
DISCREPANCIES = f"""
p AS (SELECT 'P' || p_partkey AS node, {PEOPLE['final']} AS g, {PEOPLE['promoted']} AS promoted, p_partkey % 6 AS k FROM part),
q AS (SELECT *, k = 0 OR promoted IS NOT NULL AS direct FROM p),
x AS (SELECT node, 'committee_only_promoted' AS category FROM q WHERE promoted = 'committee_only'
  UNION ALL SELECT node, 'mixed_promoted' FROM q WHERE promoted = 'mixed'
  UNION ALL SELECT node, 'manual_review' FROM q WHERE k = 1 AND promoted IS NULL
  UNION ALL SELECT node, 'unsure_unassigned' FROM q WHERE k = 4 AND g IS NULL
  UNION ALL SELECT node, CASE WHEN direct THEN 'direct_not_first' WHEN g = 1 THEN 'first_not_direct' ELSE 'committee_only_unassigned' END FROM q
    WHERE (direct AND coalesce(g, 0) <> 1) OR (NOT direct AND g = 1) OR (k = 3 AND NOT direct AND g IS NULL))"""


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part").selectExpr("'P' || p_partkey AS node", f"{PEOPLE['choice']} AS choice", f"{PEOPLE['final']} AS generation", f"{PEOPLE['promoted']} AS promoted")
    r = t.withColumn("r", H.relation_class("choice"))
    return r.select("node", "generation", "promoted", "r.direct", "r.committee", "r.indirect", "r.manual_review", H.text_flags("choice")["unsure"].alias("unsure"))


@register("g_discrepancies", "WITH" + DISCREPANCIES + " SELECT * FROM x")
def g_discrepancies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.discrepancies(people(spark, sf_dir))


@register("g_exclusions", "WITH" + DISCREPANCIES + " SELECT CASE category WHEN 'manual_review' THEN 'under review' ELSE category END AS label, count(*) AS rows FROM x WHERE node NOT IN (SELECT 'P' || l_partkey FROM lineitem WHERE l_suppkey % 3 = 0) GROUP BY 1")
def g_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    focal = table(spark, sf_dir, "lineitem").where("l_suppkey % 3 = 0").selectExpr("'P' || l_partkey AS focal").distinct()
    return G.exclusions(G.discrepancies(people(spark, sf_dir)), focal, {"manual_review": "under review"})


@register("g_gen_initial", "SELECT 'P' || p_partkey AS node, CASE p_partkey % 6 WHEN 0 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 1 END AS generation FROM part")
def g_gen_initial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policy before topology: a committee alone counts as the first generation, mixed evidence goes to review."""
    t = table(spark, sf_dir, "part").selectExpr("'P' || p_partkey AS node", f"{PEOPLE['choice']} AS choice").withColumn("r", H.relation_class("choice"))
    return t.select("node", F.when(F.col("r.committee") & ~F.col("r.direct") & ~F.col("r.indirect"), 1).otherwise(F.col("r.generation")).alias("generation"))


@register("set_union_edges", "WITH a AS (SELECT o_custkey AS src, o_orderkey % 50 AS dst, o_orderstatus AS type, CASE WHEN o_orderdate < DATE '1998-01-01' THEN 0 ELSE 1 END AS p, CASE WHEN o_orderdate < DATE '1998-01-01' THEN 'high' ELSE 'medium' END AS confidence FROM orders) SELECT src, dst, type, arg_min(confidence, p) AS confidence FROM a GROUP BY src, dst, type")
def set_union_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").selectExpr("o_custkey AS src", "o_orderkey % 50 AS dst", "o_orderstatus AS type", "o_orderdate")
    early, late = o.where("o_orderdate < date '1998-01-01'"), o.where("o_orderdate >= date '1998-01-01'")
    return G.union_edges(early.withColumn("confidence", F.lit("high")), late.withColumn("confidence", F.lit("medium")))


BUILD = """
l AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem),
c AS (SELECT p, min('R-' || s) AS src FROM l GROUP BY p),
f AS (SELECT p, src, 'S-' || src || '-' || lpad((row_number() OVER (PARTITION BY src ORDER BY 'u' || p || '@d.org'))::VARCHAR, 4, '0') AS node FROM c WHERE NOT (p % 20 = 0 AND p // 20 IN (SELECT s_suppkey FROM supplier))),
i AS (SELECT c.p, coalesce(f.node, 'R-' || c.p // 20) AS dst FROM c LEFT JOIN f ON f.p = c.p)"""


def built(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from heddle.operators.build import build

    s = table(spark, sf_dir, "supplier").selectExpr("'R-' || s_suppkey AS node", "s_name AS name", "'r' || s_suppkey || '@d.org' AS email")
    listed = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct().join(table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS known"), F.expr("l_partkey % 20 = 0 and l_partkey div 20 = known"), "left")
    listed = listed.selectExpr("'R-' || l_suppkey AS src", "'child ' || l_partkey AS name", "CASE WHEN known IS NOT NULL THEN 'R' || known || '@D.org;' ELSE 'u' || l_partkey || '@d.org' END AS email")
    curated = table(spark, sf_dir, "nation").selectExpr("'M-' || n_nationkey AS node", "n_name AS name", "CASE WHEN n_nationkey < 3 THEN 'r' || n_nationkey || '@d.org' END AS email")
    resolved = table(spark, sf_dir, "supplier").where("s_suppkey > 0").selectExpr("'R-0' AS src", "'R-' || s_suppkey AS dst")
    links = table(spark, sf_dir, "nation").selectExpr("'R-0' AS src", "'M-' || n_nationkey AS dst")
    return build(s, listed, curated, resolved, links)


@register("g_build", "WITH" + BUILD + " SELECT 'R-0' AS src, 'R-' || s_suppkey AS dst, 'advisor' AS type FROM supplier WHERE s_suppkey > 0 UNION ALL SELECT DISTINCT 'R-' || l.s, i.dst, 'listing' FROM l JOIN i ON i.p = l.p UNION ALL SELECT 'R-0', CASE WHEN n_nationkey < 3 THEN 'R-' || n_nationkey ELSE 'M-' || n_nationkey END, 'manual' FROM nation")
def g_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir)[1].select("src", "dst", "type")


@register("g_build_nodes", "WITH" + BUILD + " SELECT 'R-' || s_suppkey AS node, 'respondent' AS source FROM supplier UNION ALL SELECT node, 'listing' FROM f UNION ALL SELECT 'M-' || n_nationkey, 'curated' FROM nation WHERE n_nationkey >= 3")
def g_build_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir)[0].select("node", "source")
