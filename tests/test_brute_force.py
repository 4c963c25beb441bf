"""Queries and operators that SQL cannot express, against plain Python."""

import os
import random
from difflib import SequenceMatcher, get_close_matches

import pytest
from pyspark.sql import functions as F

from heddle import functions as H
from heddle import plans
from heddle.operators import describe, match
from heddle.streaming import response_delta

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def words(seed, n):
    rnd = random.Random(seed)
    base = ["ann stone", "anna stone", "bo li", "karl berg", "jo", "a", "", "smith john", "john smith", "jon smyth", "maria del mar", "oconnor"]
    out = set(base)
    while len(out) < n:
        w = list(rnd.choice(base) or "xy")
        for _ in range(rnd.randint(0, 3)):
            i = rnd.randrange(len(w) + 1)
            w[i : i + rnd.randint(0, 1)] = rnd.choice(["", "a", "n", "t", " "])
        out.add("".join(w).strip())
    return sorted(out)


def test_near_pairs_lose_nothing(spark):
    names = words(1, 220)
    frame = spark.createDataFrame([(n,) for n in names], "probe string")
    got = {(r["probe"], r["name"]) for r in match.near_pairs(frame, frame.withColumnRenamed("probe", "name"), 0.75).collect()}
    want = {(a, b) for a in names for b in names if a and b and SequenceMatcher(None, b, a).ratio() >= 0.75}
    assert want <= got
    with pytest.raises(ValueError):
        match.near_pairs(frame, frame, 0.6)


@pytest.mark.parametrize("cutoff,gap", [(0.75, 0.05), (0.8, 0.0)])
def test_fuzzy_names_are_the_close_matches(spark, cutoff, gap):
    names, probes = [n for n in words(2, 120) if n], [n for n in words(3, 120) if n]
    frame = match.fuzzy_names(spark.createDataFrame([(p,) for p in probes], "probe string"), spark.createDataFrame([(n,) for n in names], "name string"), cutoff, gap)
    got = {r["probe"]: (r["name"], r["confidence"]) for r in frame.collect()}
    for p in probes:
        best = get_close_matches(p, names, n=2, cutoff=cutoff)
        if not best:
            assert p not in got
            continue
        ratio = [SequenceMatcher(None, p, b).ratio() for b in best]
        state = "high" if best[0] == p else "ambiguous" if len(best) > 1 and ratio[0] - ratio[1] < gap else "medium"
        assert got[p] == (best[0], state), p


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_pair_criteria_lose_nothing(spark):
    rnd = random.Random(4)
    people = [(i, *((w.split(" ") + [""])[:2]), rnd.choice(["u1@a.org", "u1@b.org", "u2@a.org", "", None])) for i, w in enumerate(words(5, 90))]
    left, right = people[::2], people[1::2]
    schema = "id long, first string, last string, email string"
    got = {(r["lid"], r["rid"]): r["criteria"] for r in match.pair_criteria(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)).collect()}
    want = {}
    for i, f, last, e in left:
        for j, g, m, d in right:
            full, other, e, d = f"{f} {last}", f"{g} {m}", e or "", d or ""
            (lo, _, dom), (ro, _, rom) = e.partition("@"), d.partition("@")
            hit = {
                "exact_email": e and e == d, "exact_name": f and last and (f, last) == (g, m), "email_local": lo and lo == ro and dom and rom and dom != rom,
                "last_initial": last and last == m and f[:1] == g[:1] and f and g and f != g, "last_only": last and last == m and f != g, "near_full_name": 0 < distance(full, other) <= 3,
                "same_first_near_last": f and f == g and 0 < distance(last, m) <= 2, "reversed_name": f and last and (f, last) == (m, g), "same_domain_last": dom and dom == rom and last and last == m and e != d,
                "left_last_in_right": len(last) >= 3 and last in other and last not in (m, g), "right_last_in_left": len(m) >= 3 and m in full and m not in (last, f),
            }
            if any(hit.values()):
                want[i, j] = sorted(k for k, v in hit.items() if v)
    assert {k: (got.get(k), want.get(k)) for k in got.keys() | want.keys() if got.get(k) != want.get(k)} == {}


def ladder(a, b, groups):
    x, y = a.split(), b.split()
    if not x or not y:
        return None
    if x == y:
        return "exact"
    (f, l), (g, m) = (x[0], x[-1]), (y[0], y[-1])
    initial = (len(f) == 1 and g[:1] == f) or (len(g) == 1 and f[:1] == g)
    if l == m:
        if f == g:
            return "first_last"
        if any(f in group and g in group for group in groups):
            return "nickname"
        if initial:
            return "initial"
        if min(len(f), len(g)) >= 4 and (f.startswith(g) or g.startswith(f)):
            return "prefix"
    if SequenceMatcher(None, l, m).ratio() >= 0.9:
        return "fuzzy_last" if f == g else "fuzzy_full" if SequenceMatcher(None, f, g).ratio() >= 0.85 else "initial_fuzzy_last" if initial else None
    return None


def test_same_person_ladder(spark):
    groups = [["ann", "anna"], ["bo", "bob"]]
    names = ["", "ann stone", "anna stone", "andrew stone", "a stone", "ann van stone", "andr stone", "ann stonehouse", "ann stonehousse", "anne stonehouses", "a stonehousse", "bo li", "bob li", "li"]
    pairs = [(a, b) for a in names for b in names]
    frame = spark.createDataFrame(pairs, "a string, b string")
    (f, last), (g, m) = H.ends(F.col("a")), H.ends(F.col("b"))
    got = frame.select("a", "b", H.same_person(F.col("a"), F.col("b"), groups, H.ro_ratio(f, g), H.ro_ratio(last, m)).alias("r")).collect()
    assert {(r["a"], r["b"]): r["r"] for r in got} == {p: ladder(*p, groups) for p in pairs}
    assert {r["r"] for r in got} == {None, "exact", "first_last", "nickname", "initial", "prefix", "fuzzy_last", "fuzzy_full", "initial_fuzzy_last"}


@needs_data
def test_queries_without_sql(spark):
    import duckdb

    names = sorted({r[0] for r in duckdb.sql(f"SELECT p_name FROM '{DATA}/part.parquet'").fetchall()})
    got = {(r["a"], r["b"]): r["ratio"] for r in plans.queries()["fn_ro_ratio"](spark, DATA).collect()}
    want = {(a, b): r for a in names for b in names if (r := SequenceMatcher(None, a, b).ratio()) >= 0.75}
    assert got == want
    from heddle.plans.text import GROUPS, SPELLED

    spelled = sorted({" ".join(r[0].split()) for r in duckdb.sql(f"SELECT {SPELLED} FROM '{DATA}/part.parquet'").fetchall()})
    got = {(r["a"], r["b"]): r["reason"] for r in plans.queries()["fn_same_person"](spark, DATA).collect()}
    assert got == {(a, b): r for a in spelled for b in spelled if (r := ladder(a, b, GROUPS))}
    rows = duckdb.sql(f"SELECT p_partkey, p_name FROM '{DATA}/part.parquet'").fetchall()
    probes = {n if k % 3 == 0 else n + "s" for k, n in rows}
    got = {r["probe"]: r["name"] for r in plans.queries()["join_fuzzy_name"](spark, DATA).collect()}
    assert got == {p: b[0] for p in probes if (b := get_close_matches(p, names, n=2, cutoff=0.75))}
    probes = {n + ("x" if k % 2 == 0 else "") for k, n in rows}
    got = {r["probe"]: r["label"] for r in plans.queries()["join_fuzzy_single"](spark, DATA).collect()}
    assert got == {p: "exact" if p in names else f"fuzzy({b[0]})" for p in probes if (b := get_close_matches(p, names, n=1, cutoff=0.8))}


def test_coauthors(spark):
    works = spark.createDataFrame([(1, 0, "Stone, Ann; Li, Bo and Ann B. Stone & Solo"), (1, 1, "Ann Stone Berg. & Mead, Carl"), (2, 0, None), (3, 0, "Bo Li; Bo Li Jr; BO LI")], "id int, at int, authors string")
    selves = spark.createDataFrame([(1, "Carl Mead")], "id int, name string")
    got = sorted((r["id"], r["author_key"], r["display"]) for r in describe.coauthors(works, selves).collect())
    assert got == [(1, "ann::berg", "Ann Stone Berg"), (1, "ann::stone", "Ann B. Stone"), (1, "bo::li", "Bo Li"), (3, "bo::jr", "Bo Li Jr")]


def test_alternative_names(spark):
    cases = {
        "Ann Stone (but was Ann Berg while in Rome)": ["Ann Stone", "Ann Berg"], "Ann Stone (née Mead, at Yale)": ["Ann Stone", "Ann Mead"], "Ann Stone formerly Berg": ["Ann Berg"],
        "Ann Stone (of Rome)": ["Ann Stone"], "Ann Stone (Berg)": ["Ann Stone", "Ann Berg"], "Ann Stone (one two three)": ["Ann Stone"],
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", H.alt_names("t", []).alias("x")).collect()
    assert {r["t"]: r["x"] for r in rows} == cases


def test_positions(spark):
    rnd = random.Random(6)
    rows = [(i, rnd.randint(0, 40)) for i in range(500)]
    frame = spark.createDataFrame(rows, "id int, k int").repartition(7)
    got = {r["id"]: r["place"] for r in describe.positions(frame, "place", F.desc("k"), F.col("id")).collect()}
    assert got == {i: n + 1 for n, (i, _) in enumerate(sorted(rows, key=lambda x: (-x[1], x[0])))}
    assert describe.positions(frame.limit(0), "place", F.col("id")).count() == 0


def test_late_rows_of_a_stream_are_kept(spark, tmp_path):
    for n, (day, ids) in enumerate([("2024-03-01", range(5)), ("2024-01-01", range(3, 9)), ("2024-02-01", range(0, 12, 2))]):
        spark.createDataFrame([(i, f"{day} 00:00:00") for i in ids], "id int, ts string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    response_delta(spark, f"{tmp_path}/in", "id int, ts string", "id", lambda rows: rows.where("id <> 8"), f"{tmp_path}/out", f"{tmp_path}/state", files=1).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [0, 1, 2, 3, 4, 5, 6, 7, 10]


def test_pairs_of_classes_are_the_pairs_of_their_rows(spark):
    from heddle.operators import classes

    people = spark.range(500).selectExpr("id AS a", "id % 3 AS block", "CASE WHEN id % 5 > 0 THEN id % 5 END AS kind").select("a", "block", F.struct("kind").alias("x"))
    others = spark.range(70).selectExpr("id AS b", "id % 4 AS block", "CASE WHEN id % 6 > 0 THEN id % 6 END AS kind").select("b", "block", F.struct("kind").alias("y"))
    pairs = people.select("block", "x").distinct().join(others.select("block", "y").distinct(), "block").withColumn("s", F.coalesce(F.col("x.kind"), F.lit(10)) - F.coalesce(F.col("y.kind"), F.lit(20)))
    got = classes.expanded(people, ["block", "x"], "a", pairs, others, ["block", "y"], "b")
    want = [(a, b, (a % 5 or 10) - (b % 6 or 20)) for a in range(500) for b in range(70) if a % 3 == b % 4]
    assert sorted((r["a"], r["b"], r["s"]) for r in got.collect()) == sorted(want)
    assert "SortMergeJoin" in got._jdf.queryExecution().executedPlan().toString()  # pairs are made in as many tasks as there are partitions
    lists = classes.members(others.withColumn("y", F.lit(1)), ["y"], "b", 10).collect()
    assert sorted(b for r in lists for b in r["members"]) == list(range(70)) and len(lists) > 3


def test_scores_are_worked_out_once_per_pair_of_classes(spark, tmp_path):
    from heddle.plans import scoring

    spark.range(300).selectExpr("id AS c_custkey", "id % 2 AS c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(240).selectExpr("id AS s_suppkey", "id % 2 AS s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    rows = scoring.scored_classes(spark, str(tmp_path))
    assert rows.count() == 2 * 30 * 30 and rows.agg(F.sum("n")).first()[0] == 2 * 30 * 120
    found = {r["node"]: r["best"] for r in scoring.join_candidate_score(spark, str(tmp_path)).collect()}
    every = scoring.scored(spark, str(tmp_path), "score").groupBy("node").agg(F.max("score").alias("best")).collect()
    assert len(found) == 300 and found == {r["node"]: r["best"] for r in every}
