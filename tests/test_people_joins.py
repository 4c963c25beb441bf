"""Joins of two lists of people with many namesakes against their SQL, on keys with gaps, and what their plans shuffle."""

import pytest

from heddle import plans

from test_queries import norm

#: join_pairwise_criteria reads null names as blank, which its SQL does not; tests/test_brute_force.py holds it against loops.
NAMES = ("join_pairwise_checks", "join_best_score", "join_alias_dup", "join_dup_candidates", "join_cascade", "join_curated_cascade")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("people"))
    spark.range(900).selectExpr("id * 7 AS c_custkey", "CASE WHEN id % 11 = 0 THEN NULL ELSE id % 3 END AS c_nationkey").write.parquet(f"{out}/customer.parquet")
    spark.range(120).selectExpr("id * 3 AS s_suppkey", "CASE WHEN id % 13 = 0 THEN NULL ELSE id % 4 END AS s_nationkey").write.parquet(f"{out}/supplier.parquet")
    return out


@pytest.mark.parametrize("name", NAMES)
def test_people_joins_with_namesakes_and_nulls(spark, folder, name):
    import duckdb

    con = duckdb.connect()
    for t in ("customer", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got, want = plans.queries()[name](spark, folder), con.sql(plans.oracle_sql()[name])
    at = [want.columns.index(c) for c in got.columns]
    a = sorted((tuple(norm(v) for v in r) for r in got.collect()), key=str)
    assert a == sorted((tuple(norm(r[i]) for i in at) for r in want.fetchall()), key=str)


@pytest.mark.parametrize("name", ("join_pairwise_checks", "join_dup_candidates"))
def test_pairs_are_not_shuffled(spark, folder, name):
    plan = plans.queries()[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [lid" not in plan and "Aggregate [aid" not in plan


@pytest.mark.parametrize("name", ("join_best_score", "join_cascade", "join_alias_dup"))
def test_rows_meet_classes_of_the_other_side(spark, folder, name):
    # Without the fold the join itself makes all pairs of namesakes, whatever is kept of them later.
    plan = plans.queries()[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    joins = plan[plan.index("Join Inner"):] if "Join Inner" in plan else plan
    assert "Aggregate [" in joins.split("Join Inner")[-1] or "Generate explode" in plan
