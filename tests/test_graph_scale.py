"""What tasks of the graph operators hold and send, told by their plans and tables, and their results against plain loops."""

import random

from heddle.operators import graph


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def lineage(spark, seed, repeated=2):
    """(edges, nodes, generation, label) of random layers below a root, edges repeated."""
    rnd = random.Random(seed)
    generation = {"root": 0} | {f"n{i}": rnd.choice([1, 1, 2, 3, None]) for i in range(40)}
    label = {x: rnd.choice("abcdefg") for x in generation}
    pairs = {("root", f"n{i}") for i in range(12)} | {(f"n{i}", f"n{rnd.randrange(i + 1, 40)}") for i in range(35) for _ in range(4)}
    edges = spark.createDataFrame(sorted(pairs) * repeated, "src string, dst string")
    nodes = spark.createDataFrame([(n, generation[n], label[n]) for n in generation], "node string, generation int, label string")
    return pairs, edges, nodes, generation, label


def best_parents(pairs, generation, label):
    of = {}
    for a, b in pairs:
        of.setdefault(b, []).append(a)
    key = lambda n, p: (0 if generation[n] == 1 and p == "root" else 1 if p != "root" else 2, -(99 if generation[p] is None else generation[p]), label[p], p)
    return {n: min(ps, key=lambda p: key(n, p)) for n, ps in of.items()}


def test_primary_parents_take_the_least_rank_without_a_sort_of_edges(spark):
    pairs, edges, nodes, generation, label = lineage(spark, 5)
    got = graph.primary_parents(edges, nodes, "root")
    assert {r["node"]: r["parent"] for r in got.collect()} == best_parents(pairs, generation, label)
    # A least struct is no number: it would be found by sorting all edges, with their labels, by node.
    assert "SortAggregate" not in plan_of(got)
    # Unknown nodes have no row, unknown parents count as generation 99.
    odd = spark.createDataFrame([("x", "n1"), ("n2", "n1"), ("root", "y")], "src string, dst string")
    assert [tuple(r) for r in graph.primary_parents(odd, nodes.where("node <> 'x'"), "root").collect()] == [("n1", "x")]
    assert graph.primary_parents(edges.limit(0), nodes, "root").count() == 0


def test_secondary_parents_in_tasks_by_rows(spark, monkeypatch):
    from heddle.operators import _loop

    pairs, edges, nodes, generation, label = lineage(spark, 6)
    best = best_parents(pairs, generation, label)
    primary = spark.createDataFrame(sorted(best.items()), "node string, parent string")
    want = {n: sorted(label[a] for a, b in pairs if b == n and a != p) for n, p in best.items()}
    want = {n: ", ".join(x) for n, x in want.items() if x}
    monkeypatch.setattr(_loop, "TASK_ROWS", 10, raising=False)
    got = graph.secondary_parents(edges, primary, nodes)
    assert {r["node"]: r["others"] for r in got.collect()} == want
    # 277 rows or so go to 28 tasks or so; no merging by size brings them together.
    assert "hashpartitioning(node#" in plan_of(got) and f", {-(-edges.count() // 10)})" in plan_of(got)


def swept(pairs, generation):
    now = dict(generation)
    for _ in range(100):
        told = {}
        for a, b in pairs:
            if now[a] is not None:
                told[b] = min(told.get(b, 10**6), now[a] + 1)
        fresh = now | told
        if fresh == now:
            return now
        now = fresh


def test_generations_where_reports_are_too_low_or_too_high(spark):
    for seed in range(3):
        pairs, edges, nodes, generation, _ = lineage(spark, seed)
        told = {n: None if n == "n3" else 0 if n == "root" else (i * 7 + seed) % 11 if i % 3 else None for i, n in enumerate(generation)}
        got = graph.generations(spark.createDataFrame([*told.items()], "node string, generation int"), edges)
        assert {r["node"]: r["generation"] for r in got.collect()} == swept(pairs, told)


def test_generations_are_sent_by_nodes_that_moved_alone(spark, monkeypatch):
    sent, counted = [], graph.counted

    def seen(df, **tests):
        out = counted(df, **tests)
        sent.extend([out[1]["rows"]] if df.columns == ["src", "generation"] else [])
        return out

    monkeypatch.setattr(graph, "counted", seen)
    chain = spark.createDataFrame([(i, i + 1) for i in range(12)], "src int, dst int")
    got = graph.generations(spark.createDataFrame([(i, 0 if i == 0 else None) for i in range(13)], "node int, generation int"), chain)
    assert sorted((r["node"], r["generation"]) for r in got.collect()) == [(i, i) for i in range(13)]
    assert sent == [1] * 12 + [0]


def test_neighbours_are_numbered_on_large_sides_alone(spark, monkeypatch):
    pairs, edges, nodes, _, label = lineage(spark, 7)
    numbered, seen = graph.numbered_within, []
    monkeypatch.setattr(graph, "numbered_within", lambda rows, *rest: seen.extend(r["node"] for r in rows.select("node").distinct().collect()) or numbered(rows, *rest))
    want = {n: (sorted({label[a] for a, b in pairs if b == n}), sorted({label[b] for a, b in pairs if a == n})) for n in label}
    got = graph.neighbours(edges, nodes, 1000)
    assert {r["node"]: (r["chunk"], r["advisors"], r["students"]) for r in got.collect()} == {n: (0, *w) for n, w in want.items()}
    assert not seen
    for size in (2, 20):
        seen.clear()
        got = graph.neighbours(edges, nodes, size).collect()
        assert {(r["node"], r["chunk"]): (r["advisors"], r["students"]) for r in got} == {(n, c): (a[c * size:][:size], s[c * size:][:size]) for n, (a, s) in want.items() for c in range(max(1, -(-max(len(a), len(s)) // size)))}
        assert sorted(seen) == sorted(n for ends in zip(*pairs) for n in set(ends) if 2 * ends.count(n) > size)


def test_edges_to_nodes_that_none_leaves_stay_out_of_the_rounds(spark, monkeypatch):
    dealt, bucketed = [], graph.bucketed
    monkeypatch.setattr(graph, "bucketed", lambda df, key: dealt.append(df.count()) or bucketed(df, key))
    rnd = random.Random(3)
    pairs = {("r", f"a{i}") for i in range(4)} | {(f"a{i}", f"b{j}") for i in range(4) for j in range(6) if rnd.random() < 0.6} | {(f"b{i}", f"c{rnd.randrange(90)}") for i in range(6) for _ in range(30)}
    edges = spark.createDataFrame(sorted(pairs) * 2 + [("a0", "a0")], "src string, dst string")
    focal = [*[f"a{i}" for i in range(4)], "r", "b0", "c0", "c1", *[f"none{i}" for i in range(70)]]
    frame = spark.createDataFrame([(f,) for f in focal], "focal string")
    below = {}
    for f in focal:
        seen, todo = set(), [f]
        while todo:
            x = todo.pop()
            fresh = {b for a, b in pairs if a == x} - seen
            seen |= fresh
            todo += fresh
        below[f] = seen
    got = graph.descendants(edges, frame, blocked=False)
    assert sorted(tuple(r) for r in got.collect()) == sorted((f, n) for f in focal for n in below[f])
    assert dealt == [2 * sum(b[0] != "c" for _, b in pairs)]


def test_edges_without_cycles_are_written_once(spark, monkeypatch):
    written, staged = [], graph.staged
    monkeypatch.setattr(graph, "staged", lambda df: written.append(df.columns) or staged(df))
    edges = spark.createDataFrame([(f"a{i}", f"b{j}", i) for i in range(5) for j in range(9)] + [("a0", "a0", 9)], "src string, dst string, w int")
    kept, removed = graph.remove_cycles(edges)
    assert kept.count() == 45 and [tuple(r) for r in removed.collect()] == [("a0", "a0", 9)]
    assert len([c for c in written if "w" in c]) == 1
