"""Iterative graph operators on deep, cyclic and random graphs, against plain Python; pairs of names by blocks against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from heddle.operators import _loop, graph, match, skew


def rounds(monkeypatch):
    """Counts the tables that loops write."""
    calls = []
    plain = _loop.staged
    for module in (_loop, graph):
        monkeypatch.setattr(module, "staged", lambda df: calls.append(1) or plain(df))
    return calls


def reach(pairs):
    after = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    out = {}
    for start in {x for p in pairs for x in p}:
        seen, todo = set(), list(after.get(start, ()))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += after.get(x, ())
        out[start] = seen
    return out


def random_pairs(seed, n, m):
    rnd = random.Random(seed)
    pairs = {(f"n{rnd.randrange(n)}", f"n{rnd.randrange(n)}") for _ in range(m)}
    # Chains between random nodes, a ring that hangs on, and a path that leads nowhere.
    for c in range(4):
        run = [f"n{rnd.randrange(n)}", *(f"c{c}x{i}" for i in range(rnd.randrange(1, 9))), f"n{rnd.randrange(n)}"]
        pairs |= set(zip(run, run[1:], strict=False))
    ring = [f"r{i}" for i in range(7)]
    pairs |= set(zip(ring, ring[1:] + ring[:1], strict=True)) | {(f"p{i}", f"p{i + 1}") for i in range(12)} | {("s", "s1"), ("s1", "s2"), ("s2", "s"), ("n0", "s")}
    return sorted(pairs)


def test_cycles_and_descendants_of_a_random_graph(spark):
    pairs = random_pairs(3, 9, 14)
    below = reach(pairs)
    edges = spark.createDataFrame(pairs, "src string, dst string")
    together = {x: frozenset(y for y in below[x] if x in below[y]) | {x} for x in below}
    got = {}
    for r in graph.strong_components(edges).collect():
        assert r["node"] not in got
        got[r["node"]] = r["component"]
    assert set(got) == {x for x, c in together.items() if len(c) > 1}
    names = {}
    for x, c in got.items():
        names.setdefault(c, set()).add(x)
    assert all(together[x] == frozenset(names[c]) for x, c in got.items())

    focal = ["n0", "n1", "r2", "p3", "c0x0", "s1", "nowhere"] + [f"p{i}" for i in range(13)] + [f"extra{i}" for i in range(70)]
    frame = spark.createDataFrame([(f,) for f in [*focal, "n0", None]], "focal string")
    assert sorted(tuple(r) for r in graph.descendants(edges, frame, blocked=False).collect()) == sorted((f, x) for f in set(focal) for x in below.get(f, ()) if x != f)
    assert graph.strong_components(edges.limit(0)).count() == 0 and graph.descendants(edges.limit(0), frame).count() == 0


def test_blocked_descendants_of_a_random_graph_without_cycles(spark):
    pairs = sorted({(a, b) for a, b in random_pairs(2, 40, 60) if a < b})
    focal = ["n0", "n1", "n2", "r2", "p3"] + [f"n{i}" for i in range(20, 30)]
    cut = reach([(a, b) for a, b in pairs if b not in focal])
    got = graph.descendants(spark.createDataFrame(pairs, "src string, dst string"), spark.createDataFrame([(f,) for f in focal], "focal string"))
    assert sorted(tuple(r) for r in got.collect()) == sorted((f, x) for f in focal for x in cut.get(f, ()))


def test_a_long_ring_takes_few_rounds(spark, monkeypatch):
    calls = rounds(monkeypatch)
    ring = spark.range(10_000).selectExpr("cast(id as string) as src", "cast((id + 1) % 10000 as string) as dst")
    got = graph.strong_components(ring)
    assert got.agg(F.count("*"), F.countDistinct("node"), F.countDistinct("component")).first()[:] == (10_000, 10_000, 1)
    assert len(calls) < 40


def test_a_long_chain_is_counted_in_few_rounds(spark, monkeypatch):
    calls = rounds(monkeypatch)
    n = 10_000
    chain = spark.range(1, n).selectExpr("cast(id as string) as node", "cast(id - 1 as string) as parent")
    got = graph.tree_counts(chain)
    assert got.where(f"descendants <> {n - 1} - cast(node as int)").count() == 0 and got.count() == n - 1
    assert len(calls) < 36
    short = graph.ancestor_paths(chain.where("cast(node as int) < 150"))
    assert short.where("size(path) <> cast(node as int) or path[0] <> '0' or element_at(path, -1) <> cast(cast(node as int) - 1 as string)").count() == 0
    assert short.count() == 149


def walked(parent, node):
    path, x = [], parent.get(node)
    while x is not None and x not in path and x != node:
        path.insert(0, x)
        x = parent.get(x)
    return path


@pytest.mark.parametrize("seed", range(2))
def test_paths_and_counts_of_random_parents(spark, seed):
    rnd = random.Random(seed)
    parent = {f"n{i}": f"n{rnd.randrange(40)}" for i in range(3, 40) if rnd.random() < 0.9}
    if seed == 0:
        parent = {f"n{i}": f"n{rnd.randrange(i)}" for i in range(1, 40)}
    parent = {k: v for k, v in parent.items() if k != v}
    rows = spark.createDataFrame([*parent.items(), ("own", "own")], "node string, parent string")
    want = {n: walked(parent, n) for n in parent}
    assert {r["node"]: r["path"] for r in graph.ancestor_paths(rows).collect()} == want
    counts = {}
    for path in want.values():
        for x in path:
            counts[x] = counts.get(x, 0) + 1
    assert {r["node"]: r["descendants"] for r in graph.tree_counts(rows).collect()} == counts
    assert graph.ancestor_paths(rows.limit(0)).count() == 0 and graph.tree_counts(rows.limit(0)).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("edits", [1, 3])
def test_edit_pairs_lose_nothing_and_meet_once(spark, edits):
    rnd = random.Random(edits)
    texts = {"", "a", "ab"} | {"".join(rnd.choice("ab") for _ in range(rnd.randrange(12))) for _ in range(120)} | {"".join(rnd.choice("abcdefgh ") for _ in range(rnd.randrange(4, 16))) for _ in range(40)}
    left, right = sorted(texts)[::2], sorted({*sorted(texts)[1::2], "ab"})
    got = [tuple(r) for r in match.edit_pairs(spark.createDataFrame([(x,) for x in [*left, None]], "a string"), spark.createDataFrame([(x,) for x in [*right, None]], "b string"), edits).collect()]
    assert sorted(got) == sorted((a, b) for a in left for b in right if distance(a, b) <= edits)


def test_substring_pairs(spark):
    rnd = random.Random(9)
    texts = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randrange(9))) for _ in range(150)})
    parts = sorted({"".join(rnd.choice("abcd") for _ in range(rnd.randrange(5))) for _ in range(100)})
    got = match.substring_pairs(spark.createDataFrame([(p,) for p in parts], "part string"), spark.createDataFrame([(t,) for t in texts], "text string"))
    assert sorted(tuple(r) for r in got.collect()) == sorted((p, t) for p in parts for t in texts if len(p) >= 3 and p in t)


def test_hot_keys_are_dealt_and_no_row_is_lost(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 10)
    monkeypatch.setattr(skew, "HOT_SHARE", 0.05)
    a = spark.createDataFrame([("hot" if i % 3 else f"k{i % 50}", i) for i in range(600)] + [(None, -1)], "k string, x long")
    b = spark.createDataFrame([("hot" if i % 2 else f"k{i % 60}", i) for i in range(200)] + [(None, -1)], "k string, y long")
    p, q, on = skew.salted(a, b, ["k"], ["x"], 601, ["y"], 201)
    assert len(on) == 3
    assert max(r["count"] for r in p.groupBy(*on).count().where("k is not null").collect()) < 0.12 * 601 * 4  # copies for the other side's parts
    assert sorted(tuple(r) for r in p.join(q, on).select("k", "x", "y").collect()) == sorted(tuple(r) for r in a.join(b, "k").select("k", "x", "y").collect())
    p, q, on = skew.salted(a, b, ["k"], ["x"], 5)
    assert on == ["k"]
