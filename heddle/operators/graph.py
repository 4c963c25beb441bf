"""Multi-parent lineage graphs as edge tables (src, dst): cycle removal, generations, descendants, trees.

Loops run in the driver, one round of joins per level; each round is written to the shared folder, and the driver
sees only whether anything changed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._loop import bucketed, counted, in_tasks, is_empty, staged
from .describe import numbered_within, positions


def union_edges(*sources: DataFrame) -> DataFrame:
    """Edges (src, dst, type, confidence) of several sources, distinct on the first three; of repeated ones the
    earliest source's confidence stays, within a source the smallest."""
    tagged = [s.select("src", "dst", "type", "confidence", F.lit(i).alias("priority")) for i, s in enumerate(sources)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    return out.groupBy("src", "dst", "type").agg(F.min(F.struct("priority", "confidence")).alias("x")).select("src", "dst", "type", "x.confidence")


def _tops(parents: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(node, top): the root that each node's chain of parents (node, parent; one per node) leads to; and the nodes that lie on
    rings, null where there are none. Nodes that lead to a ring have no top.

    Pointers are doubled, so rounds grow with the logarithm of the longest chain. Chains that still go on end in
    rings as soon as two rounds in a row leave the same nodes at their ends: those are the rings' nodes.
    """
    state, n = counted(parents.join(parents.select(F.col("node").alias("parent"), F.lit(True).alias("open")), "parent", "left").select("node", F.col("parent").alias("top"), F.coalesce("open", F.lit(False)).alias("open")), open=F.col("open"))
    done, going, ends = [state.where("not open").select("node", "top")], state.where("open"), None
    while n["open"]:
        tops = going.select("top").distinct()
        last, ends = ends, tops.count()
        if ends == last:
            return reduce(DataFrame.unionByName, done), staged(tops.select(F.col("top").alias("node")))
        known = reduce(DataFrame.unionByName, [*[d.withColumn("open", F.lit(False)) for d in done], going]).select(F.col("node").alias("top"), F.col("top").alias("next"), "open")
        moved, n = counted(going.select("node", "top").join(known, "top").select("node", F.col("next").alias("top"), "open"), open=F.col("open"))
        done.append(moved.where("not open").select("node", "top"))
        going = moved.where("open")
    return reduce(DataFrame.unionByName, done), None


def _ring_names(parents: DataFrame) -> DataFrame:
    """(node, ring): the least node of the ring that each node lies on. parents holds rings alone."""
    now = staged(parents.select("node", F.col("parent").alias("top"), F.col("node").alias("ring")))
    while True:
        far = now.select(F.col("node").alias("top"), F.col("top").alias("next"), F.col("ring").alias("other"))
        fresh, n = counted(now.join(far, "top").select("node", F.col("next").alias("top"), F.least("ring", "other").alias("ring"), (F.col("other") < F.col("ring")).alias("moved")), moved=F.col("moved"))
        now = fresh.select("node", "top", "ring")
        # Windows of equal power-of-two length that agree along their jumps cover the ring between them.
        if not n["moved"]:
            return now.select("node", "ring")


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges without those from nodes that none leads to, and those to nodes that none leaves."""
    return edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")


def _shrunk(edges: DataFrame) -> tuple[DataFrame, list[DataFrame], DataFrame | None]:
    """Edges with the same strong components after dead ends are cut and chains contracted, again and again; what each contraction took out (node,
    head, tail: of one component with both ends, if those are of one); and (node, component) of rings that were contracted whole.

    A chain is a run of nodes with one edge in and one out. Its ends are found by pointer doubling, so a path of any
    length goes in logarithmically many rounds, and trees in logarithmically many contractions.
    """
    taken, rings = [], None
    # Most edges of a lineage lead to nodes that none leaves. Those that do not are few, and only they are made distinct.
    now = edges.select("src", "dst").where("src <> dst")
    sources = staged(now.select(F.col("src").alias("dst")).distinct())
    now, n = counted(now.join(sources, "dst", "left_semi").select("src", "dst").distinct())
    size = n["rows"]
    while size:
        now, n = counted(_trimmed(now))
        if not n["rows"]:
            break
        ins, outs = now.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("i"), F.min("src").alias("before")), now.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("o"), F.min("dst").alias("after"))
        chain, runs = counted(ins.join(outs, "node").where("i = 1 and o = 1").select("node", "before", "after"))
        if runs["rows"]:
            tails, on_rings = _tops(chain.select("node", F.col("after").alias("parent")))
            if on_rings is not None:
                named = _ring_names(chain.join(on_rings, "node", "left_semi").select("node", F.col("after").alias("parent"))).withColumnRenamed("ring", "component")
                rings = named if rings is None else rings.unionByName(named)
                heads, _ = _tops(chain.join(on_rings, "node", "left_anti").select("node", F.col("before").alias("parent")))
            else:
                heads, _ = _tops(chain.select("node", F.col("before").alias("parent")))
            members = staged(heads.withColumnRenamed("top", "head").join(tails.withColumnRenamed("top", "tail"), "node"))
            taken.append(members)
            inner = chain.select("node")
            kept = now.join(inner.withColumnRenamed("node", "src"), "src", "left_anti").join(inner.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")
            now, n = counted(kept.unionByName(members.where("head <> tail").select(F.col("head").alias("src"), F.col("tail").alias("dst"))).distinct())
        if n["rows"] == size:
            break
        size = n["rows"]
    return now, taken, rings


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes that lie on cycles of two nodes or more.

    Dead ends are cut and chains contracted first. What is left goes by colours: in each pass every node takes the greatest id
    that reaches it; the nodes that a colour's own node is reached from, within the colour, are its component. Found
    ones are taken off and the rest starts again. Nodes of contracted chains follow last.
    """
    kinds = edges.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    left, taken, rings = _shrunk(edges)
    parts = [kinds] if rings is None else [rings]
    layers = [taken]
    while not is_empty(left):
        nodes = left.select(F.col("src").alias("node")).union(left.select("dst")).distinct()
        colour = staged(nodes.withColumn("colour", F.col("node")))
        moved = colour
        while True:
            offered = left.join(moved, left["src"] == moved["node"]).groupBy(F.col("dst").alias("n")).agg(F.max("colour").alias("offer"))
            fresh, n = counted(colour.join(offered, colour["node"] == offered["n"], "left").select("node", F.greatest("colour", F.coalesce("offer", "colour")).alias("colour"), (F.coalesce("offer", "colour") > F.col("colour")).alias("moved")), moved=F.col("moved"))
            colour, moved = fresh.select("node", "colour"), fresh.where("moved").select("node", "colour")
            if not n["moved"]:
                break
        inner = left.join(colour.withColumnsRenamed({"node": "src", "colour": "cs"}), "src").join(colour.withColumnsRenamed({"node": "dst", "colour": "cd"}), "dst").where("cs = cd").select("src", "dst", F.col("cs").alias("colour"))
        inner = staged(inner)
        reached = staged(colour.where("node = colour"))
        frontier = reached
        while True:
            step = frontier.join(inner, (inner["dst"] == frontier["node"]) & (inner["colour"] == frontier["colour"])).select(inner["src"].alias("node"), inner["colour"]).distinct()
            frontier, n = counted(step.join(reached, ["node", "colour"], "left_anti"))
            if not n["rows"]:
                break
            reached = staged(reached.unionByName(frontier))
        sized = reached.groupBy("colour").agg(F.count("*").alias("n"))
        parts.append(reached.join(sized.where("n > 1"), "colour").select("node", F.col("colour").alias("component")))
        done = reached.select("node")
        left, taken, rings = _shrunk(left.join(done.withColumnRenamed("node", "src"), "src", "left_anti").join(done.withColumnRenamed("node", "dst"), "dst", "left_anti"))
        layers.append(taken)
        if rings is not None:
            parts.append(rings)
    found = staged(reduce(DataFrame.unionByName, parts))
    for members in (m for layer in reversed(layers) for m in reversed(layer)):
        # A chain from a node back to itself is a component with it, whether or not that node lies on another cycle.
        both = members.join(found.withColumnsRenamed({"node": "head", "component": "ch"}), "head", "left").join(found.withColumnsRenamed({"node": "tail", "component": "ct"}), "tail", "left")
        both = both.withColumn("component", F.when(F.col("head") == F.col("tail"), F.coalesce("ch", "head")).when(F.col("ch") == F.col("ct"), F.col("ch"))).where("component is not null")
        both = staged(both.select("node", "head", "component", (F.col("ch").isNull() & (F.col("head") == F.col("tail"))).alias("fresh")))
        found = staged(found.unionByName(both.select("node", "component")).unionByName(both.where("fresh").select(F.col("head").alias("node"), "component").distinct()))
    return found


def remove_cycles(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, removed) edges: within a strong component, and for self-loops, edges to a node that is not greater
    are removed, so that the rest has no cycle and the outcome depends on nothing but the edges."""
    edges = staged(edges)
    parts = strong_components(edges)
    if is_empty(parts):
        return edges.where("src <> dst"), edges.where("src = dst")
    marked = edges.join(parts.withColumnsRenamed({"node": "src", "component": "cs"}), "src", "left").join(parts.withColumnsRenamed({"node": "dst", "component": "cd"}), "dst", "left")
    drop = (F.col("src") == F.col("dst")) | (F.coalesce(F.col("cs") == F.col("cd"), F.lit(False)) & (F.col("dst") <= F.col("src")))
    marked = staged(marked.select(*[F.col(c) for c in edges.columns], drop.alias("__drop")))
    return marked.where("not __drop").drop("__drop"), marked.where("__drop").drop("__drop")


def generations(nodes: DataFrame, edges: DataFrame, limit: int = 100) -> DataFrame:
    """node and generation: one more than the least generation of the parents that have one, which overrides the
    reported generation; nodes without such a parent stay as reported. Sweeps use the state before them. Edges may repeat.

    After the first sweep only nodes that moved send to their children, as long as none moved up: told leasts can then
    only fall. After a sweep in which one moved up, all send again.
    """
    pairs = staged(edges.select("src", "dst"))
    sources = staged(pairs.select(F.col("src").alias("node")).distinct())
    now = nodes.select("node", "generation", F.lit(None).cast("int").alias("told"))
    senders, every = now, True
    for _ in range(limit):
        sent, n = counted(senders.where("generation is not null").join(sources, "node", "left_semi").select(F.col("node").alias("src"), "generation"))
        if not n["rows"]:
            return now.select("node", "generation")
        offers = pairs.join(sent, "src").groupBy("dst").agg((F.min("generation") + 1).alias("offer"))
        told = F.col("offer") if every else F.least("told", "offer")
        swept = now.join(offers, now["node"] == offers["dst"], "left").select("node", "generation", told.alias("told")).select("node", "told", F.coalesce("told", "generation").alias("generation"), F.col("generation").alias("before"))
        fresh, n = counted(swept.withColumn("moved", ~F.col("generation").eqNullSafe(F.col("before"))), moved=~F.col("generation").eqNullSafe(F.col("before")), up=F.col("generation") > F.col("before"))
        now = fresh.select("node", "generation", "told")
        if not n["moved"]:
            return now.select("node", "generation")
        every = n["up"] > 0
        senders = now if every else fresh.where("moved")
    raise RuntimeError("generations did not settle; remove cycles first")


def _bits_down(edges: DataFrame, seeds: DataFrame) -> tuple[DataFrame, bool]:
    """(node, word, bits): of which seeds (node, word, bits) each node holds a bit or is reached from (a node may have a row of its own bits and one of others),
    and whether edges were left over because of cycles. edges are read three times; one that comes again brings the same bits.

    Nodes go in topological order: one is ready when all edges into it have brought the bits of their other ends, so each edge
    is used once, whatever the number of paths. Rounds, of which there is one per layer of the graph, shuffle bits and counts alone.
    Word -1 counts arrivals. Nodes that no edge leaves wait for nothing: the edges to them, which are most of a lineage's, stay out of
    the rounds and are used once at the end.
    """
    sources = staged(edges.select("src").distinct())
    inner = sources.withColumnRenamed("src", "dst")
    last = edges.join(inner, "dst", "left_anti").select("src", "dst")
    starts = sources.select(F.col("src").alias("node"), F.lit(-1).alias("word"), F.lit(0).cast("long").alias("bits")).unionByName(seeds)
    with bucketed(edges.join(inner, "dst", "left_semi").select("src", "dst"), "src") as dealt:
        need, n = counted(dealt.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("need")))
        expected = n["rows"]
        ready = staged(starts.join(need, "node", "left_anti"))
        waiting, passed = None, [ready]
        while expected:
            sent = dealt.join(ready.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node"), "word").agg(F.bit_or("bits").alias("bits"), F.count("*").alias("came"))
            if waiting is not None:
                sent = sent.unionByName(waiting).groupBy("node", "word").agg(F.bit_or("bits").alias("bits"), F.sum("came").alias("came"))
            waiting = staged(sent)
            full = waiting.where("word = -1").join(need, "node").where("came = need").select("node")
            ready, n = counted(waiting.select("node", "word", "bits").unionByName(seeds).join(full, "node", "left_semi").groupBy("node", "word").agg(F.bit_or("bits").alias("bits")), nodes=F.col("word") == -1)
            if not n["nodes"]:
                break
            expected -= n["nodes"]
            passed.append(ready)
            waiting = waiting.join(full, "node", "left_anti")
    held = reduce(DataFrame.unionByName, passed).where("word >= 0")
    ends = last.join(held.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node"), "word").agg(F.bit_or("bits").alias("bits"))
    return held.unionByName(ends), expected > 0


def descendants(edges: DataFrame, focal: DataFrame, blocked: bool = True) -> DataFrame:
    """(focal, node) pairs: what each focal node reaches, itself left out; blocked: neither counting nor passing
    through other focal nodes.

    Focal nodes are numbered, and each node takes the bits of all that reach it, 64 in a row, from the nodes above it; pairs are
    only made of the final bits. Cycles are contracted to their strong components where there are any. Edges may repeat; they are read three
    times, so ones that are dear to make should be written first.
    """
    pairs = edges.select("src", "dst").where("src <> dst")
    numbered = staged(positions(focal.select("focal").where("focal is not null").distinct(), "n", F.col("focal")))
    if blocked:
        pairs = pairs.join(numbered.select(F.col("focal").alias("dst")), "dst", "left_anti").select("src", "dst")
    seeds = numbered.select(F.col("focal").alias("node"), F.expr("n div 64").cast("int").alias("word"), F.expr("shiftleft(1L, n % 64)").alias("bits"))
    bits, cyclic = _bits_down(pairs, seeds)
    if cyclic:
        pairs = staged(pairs)
        of = strong_components(pairs)
        rows = pairs.join(of.withColumnsRenamed({"node": "src", "component": "cs"}), "src", "left").join(of.withColumnsRenamed({"node": "dst", "component": "cd"}), "dst", "left")
        whole = rows.select(F.coalesce("cs", "src").alias("src"), F.coalesce("cd", "dst").alias("dst")).where("src <> dst").distinct()
        placed = seeds.join(of, "node", "left").select(F.coalesce("component", "node").alias("node"), "word", "bits").groupBy("node", "word").agg(F.bit_or("bits").alias("bits"))
        bits, _ = _bits_down(staged(whole), staged(placed))
        bits = bits.join(of.select(F.col("component").alias("node"), F.col("node").alias("member")), "node", "left").select(F.coalesce("member", "node").alias("node"), "word", "bits")
    word = numbered.select("focal", F.expr("n div 64").cast("int").alias("word"), F.expr("cast(n % 64 as int)").alias("bit"))
    return bits.join(word, "word").where("getbit(bits, bit) = 1 and focal <> node").select("focal", "node")


def descendant_counts(focal: DataFrame, pairs: DataFrame) -> DataFrame:
    """focal and descendants, 0 where there are none."""
    return focal.join(pairs.groupBy("focal").agg(F.count("*").alias("descendants")), "focal", "left").select("focal", F.coalesce("descendants", F.lit(0)).cast("long").alias("descendants"))


def descendant_summary(pairs: DataFrame) -> DataFrame:
    """One row: unique nodes, sum over focal nodes, and overlap (sum less unique)."""
    return pairs.agg(F.countDistinct("node").alias("unique_nodes"), F.count("*").alias("summed"), (F.count("*") - F.countDistinct("node")).alias("overlap"))


def rank_subtrees(counts: DataFrame, tie: Column | None = None) -> DataFrame:
    """counts with rank: 1..n by descendants, then tie (the focal id)."""
    return positions(counts, "rank", F.desc("descendants"), tie if tie is not None else F.col("focal"))


def primary_parents(edges: DataFrame, nodes: DataFrame, root: str) -> DataFrame:
    """(node, parent): the root for first-generation nodes that have it as a parent; else of the other parents the
    one of the highest generation number (none counts as 99), then the smallest label.

    Parents are ranked once, each, and nodes take the least rank of theirs as a number, so edges are neither sorted by node nor carry
    labels. Edges may repeat.
    """
    info = nodes.select(F.col("node").alias("parent"), F.col("generation").alias("pg"), F.col("label").alias("pl"))
    other = F.when(F.col("parent") != root, 1).otherwise(2)
    order = [other, -F.coalesce("pg", F.lit(99)), F.col("pl"), F.col("parent")]
    # Written, so that the planner knows how small it is.
    ranked = staged(positions(edges.select(F.col("src").alias("parent")).distinct().join(info, "parent", "left"), "rank", *order).select("parent", "rank", (F.col("parent").eqNullSafe(root)).alias("top")))
    best = edges.join(ranked, F.col("src").eqNullSafe(F.col("parent"))).groupBy(F.col("dst").alias("node")).agg(F.min("rank").alias("rank"), F.bool_or("top").alias("top"))
    firsts = nodes.groupBy("node").agg(F.bool_or(F.col("generation") == 1).alias("first"))
    return best.join(firsts, "node").join(ranked.select("rank", "parent"), "rank").select("node", F.when(F.col("top") & F.col("first"), F.lit(root)).otherwise(F.col("parent")).alias("parent"))


def secondary_parents(edges: DataFrame, primary: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, others): labels of the parents that are not the primary one, sorted and joined by ", ". Edges may repeat."""
    pairs, n = counted(edges.select(F.col("src").alias("parent"), F.col("dst").alias("node")))
    # Labels of nodes without children are of no use.
    label = staged(nodes.select(F.col("node").alias("parent"), "label").join(pairs.select("parent").distinct(), "parent", "left_semi"))
    rest = in_tasks(pairs.join(label, "parent"), n["rows"], "node").groupBy("node").agg(F.collect_set(F.struct("label", "parent")).alias("all")).join(primary.select("node", F.col("parent").alias("main")), "node", "left")
    rest = rest.select("node", F.filter("all", lambda x: ~x["parent"].eqNullSafe(F.col("main"))).alias("rest")).where(F.size("rest") > 0)
    return rest.select("node", F.array_join(F.transform(F.array_sort("rest"), lambda x: x["label"]), ", ").alias("others"))


def _forest(primary: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(node, parent) rows off rings, and those on them (null where there are none). Nodes that are their own parent count as roots."""
    parents = staged(primary.select("node", "parent").where("node <> parent"))
    _, rings = _tops(parents)
    if rings is None:
        return parents, None
    return staged(parents.join(rings, "node", "left_anti")), staged(parents.join(rings, "node", "left_semi"))


def ancestor_paths(primary: DataFrame) -> DataFrame:
    """(node, path): ancestors by primary parents (node, parent; one per node), root first, the node left out. A parent chain that bites its
    own tail ends where it would repeat; a node that is its own parent is a root and has no row.

    Paths double in each round, so a chain takes rounds by the logarithm of its length; the result holds every path in full.
    """
    parents, rings = _forest(primary)
    state = staged(parents.join(parents.select(F.col("node").alias("parent"), F.lit(True).alias("open")), "parent", "left").select("node", F.col("parent").alias("top"), F.array("parent").alias("path"), F.coalesce("open", F.lit(False)).alias("open")))
    done, going = [state.where("not open").drop("open")], state.where("open")
    while not is_empty(going):
        known = reduce(DataFrame.unionByName, [*[d.withColumn("open", F.lit(False)) for d in done], going]).select(F.col("node").alias("top"), F.col("top").alias("next"), F.col("path").alias("above"), "open")
        moved = staged(going.drop("open").join(known, "top").select("node", F.col("next").alias("top"), F.concat("above", "path").alias("path"), "open"))
        done.append(moved.where("not open").drop("open"))
        going = moved.where("open")
    paths = reduce(DataFrame.unionByName, done)
    if rings is None:
        return paths.select("node", "path")
    # Round its ring a node meets all others of it, nearest last; a path that enters the ring goes on with those of its first node there.
    now = staged(rings.select("node", F.col("parent").alias("top"), F.array("parent").alias("path")))
    closed = []
    while not is_empty(now):
        back = F.array_position(F.reverse("path"), F.col("node")).cast("int")
        whole = now.where(back > 0).select("node", F.reverse(F.slice(F.reverse("path"), F.lit(1), back - 1)).alias("path"))
        closed.append(whole)
        above = now.select(F.col("node").alias("top"), F.col("top").alias("next"), F.col("path").alias("above"))
        now = staged(now.where(back == 0).join(above, "top").select("node", F.col("next").alias("top"), F.concat("above", "path").alias("path")))
    ring_paths = staged(reduce(DataFrame.unionByName, closed))
    entered = paths.join(ring_paths.select(F.col("node").alias("top"), F.col("path").alias("round")), "top", "left")
    return entered.select("node", F.when(F.col("round").isNotNull(), F.concat("round", "path")).otherwise(F.col("path")).alias("path")).unionByName(ring_paths)


def tree_counts(primary: DataFrame) -> DataFrame:
    """(node, descendants) by primary parents (node, parent; one per node), of nodes that have any; on a ring all nodes have each other and what hangs below them.

    Sums double: with the descendants less than d steps below known, a node adds those of the nodes exactly d steps below it.
    Each round is an aggregation and a join, and rounds grow with the logarithm of the depth.
    """
    parents, rings = _forest(primary)
    roots = parents.select(F.col("parent").alias("node")).distinct().join(parents.select("node"), "node", "left_anti")
    now = staged(parents.select("node", F.col("parent").alias("up"), F.lit(1).cast("long").alias("n")).unionByName(roots.select("node", F.lit(None).cast(parents.schema["parent"].dataType).alias("up"), F.lit(1).cast("long").alias("n"))))
    while not is_empty(now.where("up is not null")):
        below = now.where("up is not null").groupBy(F.col("up").alias("node")).agg(F.sum("n").alias("more"))
        far = now.where("up is not null").select(F.col("node").alias("up"), F.col("up").alias("next"))
        now = staged(now.join(below, "node", "left").join(far, "up", "left").select("node", F.col("next").alias("up"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")))
    if rings is not None:
        named = _ring_names(rings).join(now.select("node", "n"), "node", "left").select("node", "ring", F.coalesce("n", F.lit(1)).alias("n"))
        sums = named.groupBy("ring").agg(F.sum("n").alias("n"))
        now = now.select("node", "n").join(named.select("node"), "node", "left_anti").unionByName(named.select("node", "ring").join(sums, "ring").select("node", "n"))
    return now.where("n > 1").select("node", (F.col("n") - 1).alias("descendants"))


def neighbours(edges: DataFrame, nodes: DataFrame, size: int = 10_000) -> DataFrame:
    """(node, chunk, advisors, students): sorted distinct labels of the nodes around each node. A node with more than size on a side has several rows, chunks from 0
    with so many labels of a side each; no list is longer. Edges may repeat.

    Sides with no more than size edges are listed at once, in tasks by numbers of rows; places are only given within the others.
    """
    pairs, n = counted(edges.select("src", "dst"))
    label = nodes.select("node", "label")
    # Labels of nodes without children are of no use to advisors.
    above = staged(label.join(pairs.select(F.col("src").alias("node")).distinct(), "node", "left_semi"))
    ups = pairs.join(above.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "label")
    downs = pairs.join(label.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), "label")
    lists, parts = [], []
    for side, end, rows in (("advisors", "dst", ups), ("students", "src", downs)):
        many = staged(pairs.groupBy(F.col(end).alias("node")).agg(F.count("*").alias("n")).where(F.col("n") > size).select("node"))
        few = in_tasks(rows.join(many, "node", "left_anti"), n["rows"], "node")
        lists.append(few.groupBy("node").agg(F.array_sort(F.collect_set("label")).alias(side)).select("node", F.lit(0).cast("long").alias("chunk"), side))
        if not is_empty(many):
            placed = numbered_within(rows.join(many, "node", "left_semi").distinct(), ["node"], ["label"], "__at").withColumn("chunk", F.floor((F.col("__at") - 1) / size))
            parts.append(placed.groupBy("node", "chunk").agg(F.array_sort(F.collect_list("label")).alias(side)))
        else:
            parts.append(None)
    whole = [a if b is None else a.unionByName(b) for a, b in zip(lists, parts)]
    both = whole[0].join(whole[1], ["node", "chunk"], "full")
    none = F.array().cast("array<string>")
    return nodes.select("node").join(both, "node", "left").select("node", F.coalesce("chunk", F.lit(0)).cast("long").alias("chunk"), F.coalesce("advisors", none).alias("advisors"), F.coalesce("students", none).alias("students"))


def child_status(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, status): non_respondent, answered_no, no_outgoing_edges, same_generation_only or has_descendants.
    nodes has node, generation, respondent and has_students."""
    g = nodes.select(F.col("node").alias("dst"), F.col("generation").alias("child"))
    below = edges.select("src", "dst").distinct().join(g, "dst").groupBy(F.col("src").alias("node")).agg(F.max("child").alias("deepest"), F.count("*").alias("children"))
    status = F.when(~F.col("respondent"), "non_respondent").when(~F.col("has_students"), "answered_no").when(F.col("children").isNull(), "no_outgoing_edges").when(F.coalesce(F.col("deepest") > F.col("generation"), F.lit(False)), "has_descendants").otherwise("same_generation_only")
    return nodes.join(below, "node", "left").select("node", status.alias("status"))


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without any edge, and nodes that say they have students but have no outgoing edge."""
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    alone = nodes.join(ends, "node", "left_anti").select("node", F.lit("isolated").alias("issue"))
    gap = nodes.where("has_students").join(edges.select(F.col("src").alias("node")).distinct(), "node", "left_anti").select("node", F.lit("yes_without_children").alias("issue"))
    return alone.unionByName(gap)


def degrees(edges: DataFrame, root: str) -> DataFrame:
    """(node, incident, outgoing, from_root) edge counts."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("root")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("out"), (F.col("src") == root).cast("int").alias("root")))
    return ends.groupBy("node").agg(F.count("*").alias("incident"), F.sum("out").alias("outgoing"), F.sum("root").alias("from_root"))


def tree_shape(nodes: DataFrame) -> DataFrame:
    """Nodes per generation (null: unassigned)."""
    return nodes.groupBy("generation").agg(F.count("*").alias("nodes"))


def exclusions(discrepancies: DataFrame, focal: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Counts by label of discrepancy rows whose node is not focal."""
    label = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), F.col("category")), F.col("category"))
    return discrepancies.join(focal.select(F.col("focal").alias("node")), "node", "left_anti").groupBy(label.alias("label")).agg(F.count("*").alias("rows"))


def discrepancies(people: DataFrame) -> DataFrame:
    """(node, category) where raw evidence and final generation disagree. people: node, generation, direct,
    committee, indirect, manual_review, unsure, promoted (committee_only, mixed or null)."""
    direct = F.col("direct") | F.col("promoted").isNotNull()
    none = F.col("generation").isNull()
    first = F.coalesce(F.col("generation") == 1, F.lit(False))
    only = F.col("committee") & ~F.col("direct") & ~F.col("indirect") & ~F.col("manual_review") & none
    rules = F.array(
        F.when(F.col("promoted") == "committee_only", "committee_only_promoted"),
        F.when(F.col("promoted") == "mixed", "mixed_promoted"),
        F.when(F.col("manual_review") & F.col("promoted").isNull(), "manual_review"),
        F.when(F.col("unsure") & none, "unsure_unassigned"),
        F.when(direct & ~first, "direct_not_first").when(~direct & first, "first_not_direct").when(only, "committee_only_unassigned"),
    )
    return people.select("node", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("category"))
