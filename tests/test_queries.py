"""Every registered query of the lineage library against its DuckDB oracle at the smallest scale."""

import os

import pytest

from heddle import plans

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def norm(v):
    if v is None:
        return None
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return f"{float(v):.9g}"
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return v if isinstance(v, (str, int, bool)) else str(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@needs_data
@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_matches_oracle(spark, duck, name):
    got = plans.queries()[name](spark, DATA)
    cols = sorted(got.columns)
    want = duck.sql(plans.oracle_sql()[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    a = sorted((tuple(norm(r[c]) for c in cols) for r in got.collect()), key=str)
    b = sorted((tuple(norm(r[i]) for i in at) for r in want.fetchall()), key=str)
    assert a == b


@needs_data
def test_queries_without_oracle_are_held_against_python():
    assert set(plans.queries()) - set(plans.oracle_sql()) == {"fn_ro_ratio", "fn_same_person", "join_fuzzy_name", "join_fuzzy_single"}  # tests/test_brute_force.py
