"""Near-duplicate vectors by sorted projection passes.

In each pass vectors get a key of several concatenated random hashes, are ordered lexicographically by it over the
whole cluster, and compared with a bounded number of neighbours in that order; pairs whose cosine reaches the threshold
are united across passes. The first hash is the nearest of some random centres; the others are the largest coordinate,
with its sign, of a random projection of what is left after taking the centre off. In tables that are dense in places,
vectors of one topic would all agree in hashes of the whole vector; what is left tells them apart.

Passes carry vectors as bytes (a component is a 127th part of the largest); a bound on the rounding keeps every pair
that could reach the threshold, and only these candidates meet the vectors themselves, in double precision.

How many passes a table needs is learnt from a bounded sample of it: each sampled vector gets a made neighbour at the
threshold, trial passes tell how many hashes both share and how many vectors of the table share them too, and so many
passes are taken that neighbours meet within a window with the recall wanted, and half as many again. Several numbers of centres are tried, and
the one with the fewest passes is taken. A table of random directions of the same size is the least that is assumed.

Every link lies within a component, so exact counts of links need comparisons within components only; these are
taken block by block as matrix products that give a count per vector, and no pair is emitted.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import staged
from .components import components

#: Least passes, least hashes in a key, neighbours compared to either side, vectors in a block.
PASSES, HASHES, REACH, BLOCK = 20, 4, 12, 512
#: Probability with which a pair at the threshold should be found, and passes taken over those that this needs.
RECALL, SURPLUS = 0.98, 1.5
#: Sampled vectors (and bytes of them at most), trial passes, made neighbours, hashes tried, numbers of centres tried.
SAMPLE, SAMPLE_BYTES, TRIALS, MADE, TRIED, CENTRES = 4096, 16_000_000, 8, 512, 12, (1, 16, 64, 256)
#: Passes at most; a table that would need more warns.
MOST = 512


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _classes(vectors: DataFrame) -> DataFrame:
    """vec_id and vec (bytes of its doubles, the largest component made 1 in size; null where it can link with
    nothing). Scaled like this, squares neither overflow nor vanish, and vectors of one direction stay links."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(1)
            sizes = np.asarray(pc.fill_null(pc.list_value_length(col), 0)).astype(np.int64)
            flat = col.flatten()
            values = np.where(np.asarray(flat.is_valid()), flat.fill_null(0.0).to_numpy(zero_copy_only=False), np.nan).astype("<f8")
            ends = np.cumsum(sizes)
            out: list[bytes | None] = [None] * len(sizes)
            some = np.flatnonzero(sizes)
            if len(some):
                with np.errstate(invalid="ignore", divide="ignore"):
                    top = np.maximum.reduceat(np.abs(values), (ends - sizes)[some])
                    good = np.isfinite(top) & (top > 0)
                    scaled = values / np.repeat(np.where(good, top, 1.0), sizes[some])
                for i in some[good].tolist():
                    out[i] = scaled[ends[i] - sizes[i] : ends[i]].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["vec_id", "vec"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(pack, "vec_id long, vec binary")


@dataclass(frozen=True)
class Plan:
    """What passes over vectors of one dimension need: how many, hashes in a key, and the centres to choose from."""

    passes: int
    hashes: int
    centres: np.ndarray


def _centres(x: np.ndarray, k: int, seed: int, rounds: int = 3) -> np.ndarray:
    """Means of k groups of the sample; one centre is the mean of all."""
    if k == 1:
        return x.mean(0, keepdims=True)
    c = x[np.random.default_rng((seed, k)).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        at = (x @ c.T - (c**2).sum(1) / 2).argmax(1)
        sums, n = np.zeros_like(c), np.bincount(at, minlength=k)
        np.add.at(sums, at, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def pass_keys(x: np.ndarray, plan: Plan, t: int, seed: int, drawn: dict | None = None) -> np.ndarray:
    """Keys of unit vectors in pass t, a row of numbers each: centre, then hashes. Half of the centres, drawn anew,
    take part in a pass, so that borders between them lie elsewhere each time."""
    d = x.shape[1]
    drawn = {} if drawn is None else drawn
    if (d, t) not in drawn:
        rnd = np.random.default_rng((seed, d, t))
        c = plan.centres
        if len(c) > 1:
            c = c[rnd.permutation(len(c))[: max(1, len(c) // 2)]]
        projections = rnd.standard_normal((plan.hashes, d, min(d, 128)))
        drawn[d, t] = (c, (c**2).sum(1) / 2, projections, np.einsum("kd,hdm->hkm", c, projections, optimize=True))
    c, half, projections, moved = drawn[d, t]
    cell = (x @ c.T - half).argmax(1)
    key = np.zeros((len(x), plan.hashes + 1), ">u2")
    key[:, 0] = cell
    for h in range(plan.hashes):
        y = x @ projections[h] - moved[h][cell]
        top = np.abs(y).argmax(1)
        key[:, h + 1] = 2 * top + (y[np.arange(len(y)), top] > 0)
    return key


def _needs(x: np.ndarray, n: float, centres: np.ndarray, threshold: float, reach: int, recall: float, seed: int) -> tuple[int, int]:
    """Passes and hashes that n vectors need of which x is a sample."""
    rnd = np.random.default_rng((seed, len(centres), 5))
    plan = Plan(TRIALS, TRIED, centres)
    # Links are commonest where the table is dense; half of the made neighbours stand there. What a vector links with
    # doesn't stand in its way.
    some = rnd.permutation(len(x))[: MADE // 2]
    dense = np.ones(len(x))
    for i in range(0, len(x), 512):
        cosine = x @ x[i : i + 512].T
        dense += ((cosine >= threshold - 0.1) & (cosine < threshold)).sum(1)
    some = np.concatenate([some, rnd.choice(len(x), MADE // 2, p=dense / dense.sum())])
    others = x[some] @ x.T < threshold
    a = x[some]
    b = rnd.standard_normal(a.shape)
    b -= (a * b).sum(1, keepdims=True) * a
    b = threshold * a + math.sqrt(max(0.0, 1 - threshold**2)) * b / np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
    shared, crowd, pairs = [], [], np.zeros(TRIED + 2)
    for t in range(TRIALS):
        keys, near = pass_keys(x, plan, t, seed), pass_keys(b, plan, t, seed)
        shared.append(np.cumprod(keys[some] == near, axis=1).sum(1))
        group, counts = np.zeros(len(x), np.int64), np.zeros((TRIED + 2, len(some)), np.int64)
        counts[0] = others.sum(1)
        for j in range(TRIED + 1):
            group = np.unique(group * 65536 + keys[:, j], return_inverse=True)[1]
            counts[j + 1] = ((group[some][:, None] == group[None]) & others).sum(1)
            if counts[j + 1].max() < 8:
                break
        pairs += counts.sum(1)
        crowd.append(counts)
    # Share of all vectors with the same first j parts of the key; where the sample is too thin, by the ratio of pairs.
    ratio, last = np.ones(TRIED + 2), 0.5
    for j in range(1, TRIED + 2):
        if pairs[j - 1] >= 50 * TRIALS and pairs[j]:
            last = max(min(pairs[j], pairs[j - 1]), 1.0) / pairs[j - 1]
        ratio[j] = last
    met = np.zeros(len(some))
    level = np.zeros(TRIED + 2)
    for t in range(TRIALS):
        part = np.ones((TRIED + 2, len(some)))
        for j in range(1, TRIED + 2):
            seen = crowd[t][j]
            part[j] = np.where(seen >= 8, seen / max(len(x) - 1, 1), np.minimum(part[j - 1] * ratio[j], 8 / max(len(x) - 1, 1)))
        level += part.mean(1) / TRIALS
        inside = np.maximum(n * part[shared[t], np.arange(len(some))], 1.0)
        met += np.minimum(1.0, 2 * reach / inside) / TRIALS
    halves = np.split(met, [len(some) - MADE // 2])
    halves = [np.clip((TRIALS * m + 2 * m.mean()) / (TRIALS + 2), 1e-6, 1 - 1e-9) for m in halves]
    low, high = 1, 1 << 20
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if all(((1 - m) ** middle).mean() <= 1 - recall for m in halves) else (middle + 1, high)
    below = np.flatnonzero(n * level <= reach / 2)
    return math.ceil(SURPLUS * low), int(min(max(below[0] if len(below) else TRIED, HASHES), TRIED))


def plan_passes(x: np.ndarray, n: float, threshold: float, reach: int, recall: float = RECALL, least: int = PASSES, seed: int = 7) -> Plan:
    """The plan for n vectors of which the unit vectors x are a sample."""
    passes, hashes = passes_for(int(n), x.shape[1], threshold, reach, recall, least)
    tried = []
    for k in CENTRES:
        if k == 1 or 8 * k <= len(x):
            centres = _centres(x, k, seed)
            tried.append((*_needs(x, n, centres, threshold, reach, recall, seed), centres))
    wanted, deep, centres = min(tried, key=lambda r: r[0])
    if wanted > MOST:
        warnings.warn(f"{wanted} passes would be needed for a recall of {recall}; {MOST} are made", stacklevel=2)
    return Plan(max(passes, min(wanted, MOST)), max(hashes, deep), centres)


def _keyed(classes: DataFrame, plans: dict[int, Plan], seed: int) -> DataFrame:
    """One row per vector and pass: lane (dimension and pass), key, rep, code (the components in 127ths)."""

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            reps, raw = np.asarray(batch.column(0)), batch.column(1).to_pylist()
            sizes = np.array([len(x) for x in raw])
            for size in np.unique(sizes):
                mine = np.flatnonzero(sizes == size)
                for a in range(0, len(mine), 4096):
                    part = mine[a : a + 4096]
                    some = [raw[i] for i in part]
                    x = _unit(some)
                    d = x.shape[1]
                    plan = plans.get(d) or plans[0]
                    plan = plan if plan.centres.shape[1] == d else Plan(plan.passes, plan.hashes, np.zeros((1, d)))
                    codes = np.rint(127 * np.frombuffer(b"".join(some), "<f8").reshape(x.shape)).astype(np.int8)
                    codes = pa.array([c.tobytes() for c in codes], pa.binary())
                    for t in range(plan.passes):
                        keys = [k.tobytes() for k in pass_keys(x, plan, t, seed, drawn)]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), d * 1_000_000 + t), pa.int64()), pa.array(keys, pa.binary()), pa.array(reps[part]), codes], ["lane", "key", "rep", "code"])

    return classes.select("rep", "vec").mapInArrow(emit, "lane long, key binary, rep long, code binary")


def _neighbours(lane: np.ndarray, rep: np.ndarray, codes: list[bytes], threshold: float, reach: int, split: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs at most reach apart in the order given that could reach the threshold; with split, only pairs across
    that position. A code is off by half a 127th per component, which turns it by an angle that is bounded."""
    for size in {len(c) for c in codes}:
        pick = np.array([i for i, c in enumerate(codes) if len(c) == size])
        x = np.frombuffer(b"".join(codes[i] for i in pick), np.int8).reshape(len(pick), size).astype(np.float32)
        norm = np.linalg.norm(x, axis=1)
        unit, r, p = x / norm[:, None], rep[pick], lane[pick]
        turn = np.arcsin(np.minimum(1.0, 0.5 * math.sqrt(size) / norm))
        for step in range(1, min(reach, len(pick) - 1) + 1):
            limit = np.cos(np.minimum(math.pi, math.acos(threshold) + turn[:-step] + turn[step:])) - 1e-5
            ok = (np.einsum("ij,ij->i", unit[:-step], unit[step:]) >= limit) & (p[:-step] == p[step:])
            if split is not None:
                ok &= (pick[:-step] < split) & (pick[step:] >= split)
            at = np.flatnonzero(ok)
            yield r[at], r[at + step]


def _links(keyed: DataFrame, threshold: float, reach: int, parts: int) -> DataFrame:
    """(u, v) pairs of neighbours that could reach the threshold, across the borders of partitions too."""
    ordered = keyed.repartitionByRange(parts, "lane", "key", "rep").sortWithinPartitions("lane", "key", "rep")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        tail: pa.Table | None = None
        head: list[tuple] = []
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if len(head) < reach:
                head += list(zip(*(rows.column(c).slice(0, reach - len(head)).to_pylist() for c in (0, 2, 3)), strict=True))
            if tail is not None:
                rows = pa.concat_tables([tail, rows])
            for a in range(0, len(rows), 8192):
                b = max(0, a - reach)
                chunk = rows.slice(b, 8192 + a - b)
                lane, rep, raw = np.asarray(chunk.column(0)), np.asarray(chunk.column(2)), chunk.column(3).to_pylist()
                for u, v in _neighbours(lane, rep, raw, threshold, reach):
                    if len(u):
                        yield pairs(u, v)
            tail = rows.slice(max(0, len(rows) - reach))
        if tail is not None:
            last = list(zip(*(tail.column(c).to_pylist() for c in (0, 2, 3)), strict=True))
            edge = [(part, *x) for x in last] + [(part - 1, *x) for x in head]
            side = [0] * len(last) + [1] * len(head)
            cols = list(zip(*edge, strict=True))
            nothing = pa.nulls(len(edge), pa.int64())
            order = list(range(len(last))) + list(range(len(head)))
            yield pa.RecordBatch.from_arrays([nothing, nothing, pa.array(cols[0], pa.int32()), pa.array(side, pa.int32()), pa.array(order, pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary())], names)

    names = ["u", "v", "border", "side", "place", "lane", "rep", "code"]

    def pairs(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        n = len(u)
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v)), *(pa.nulls(n, pa.int32()) for _ in range(3)), *(pa.nulls(n, pa.int64()) for _ in range(2)), pa.nulls(n, pa.binary())], names)

    made = staged(ordered.mapInArrow(compare, "u long, v long, border int, side int, place int, lane long, rep long, code binary"), "passes")

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "place"])
        split = int((pdf["side"] == 0).sum())
        found = [(np.maximum(u, v), np.minimum(u, v)) for u, v in _neighbours(pdf["lane"].to_numpy(), pdf["rep"].to_numpy(), pdf["code"].tolist(), threshold, reach, split)]
        u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (list(zip(*found, strict=True)) or ([], [])))
        return pd.DataFrame({"u": u, "v": v}, dtype="int64")

    borders = made.where("border is not null").groupBy("border").applyInPandas(across, "u long, v long")
    return made.where("border is null").select("u", "v").unionByName(borders).distinct()


def agreement(threshold: float, width: int, draws: int = 4000) -> float:
    """Probability that a hash of two vectors at the threshold is the same, from seeded draws of such pairs."""
    rnd = np.random.default_rng(11)
    same, batch = 0, 200
    for _ in range(draws // batch):
        a, b = rnd.standard_normal((2, batch, width))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b -= (a * b).sum(1, keepdims=True) * a
        b = threshold * a + math.sqrt(max(0.0, 1 - threshold**2)) * b / np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
        projection = rnd.standard_normal((width, min(width, 128)))
        y, z = a @ projection, b @ projection
        i, j = np.abs(y).argmax(1), np.abs(z).argmax(1)
        same += int(((i == j) & (np.sign(y[np.arange(batch), i]) == np.sign(z[np.arange(batch), j]))).sum())
    return max(same, 1) / draws


def passes_for(n: int, width: int, threshold: float, reach: int, recall: float = RECALL, least: int = PASSES) -> tuple[int, int]:
    """Passes, and hashes in a key, for n vectors of a dimension."""
    values = max(2, 2 * min(width, 128))
    needed = max(1.0, math.log(max(n / reach, 1.0)) / math.log(values))
    alike = min(agreement(threshold, width) ** needed, 1 - 1e-9)
    return max(least, math.ceil(SURPLUS * math.log(1 - recall) / math.log(1 - alike))), max(HASHES, math.ceil(needed) + 2)


def _plans(classes: DataFrame, threshold: float, reach: int, recall: float, least: int, seed: int) -> dict[int, Plan]:
    """A plan per dimension that a bounded sample of the classes holds; 0 is the plan of all others."""
    n, width = classes.agg(F.count("*"), F.max(F.octet_length("vec"))).first()
    if not n:
        return {}
    some = classes.select("vec").orderBy(F.xxhash64("vec")).limit(max(64, min(SAMPLE, SAMPLE_BYTES // width))).collect()
    raw: dict[int, list[bytes]] = {}
    for r in some:
        raw.setdefault(len(r["vec"]) // 8, []).append(bytes(r["vec"]))
    plans = {d: plan_passes(_unit(x), n * len(x) / len(some), threshold, reach, recall, least, seed) for d, x in raw.items()}
    passes, hashes = passes_for(n, width // 8, threshold, reach, recall, least)
    return {0: Plan(passes, hashes, np.zeros((1, 0)))} | plans


def _verified(candidates: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The candidates whose vectors reach the threshold. A vector has a bounded number of candidates."""

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            sizes, ok = np.array([len(x) for x in a], np.int64), np.zeros(len(a), bool)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                ok[at] = np.einsum("ij,ij->i", _unit([a[i] for i in at]), _unit([b[i] for i in at])) >= threshold
            yield batch.select([0, 1]).filter(pa.array(ok))

    one, other = (classes.select(F.col("rep").alias(k), F.col("vec").alias(x)) for k, x in (("u", "a"), ("v", "b")))
    return candidates.join(one, "u").join(other, "v").select("u", "v", "a", "b").mapInArrow(verify, "u long, v long")


def embedding_duplicates(vectors: DataFrame, threshold: float = 0.9, passes: int = PASSES, reach: int = REACH, seed: int = 7, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of vectors (vec_id, embedding).

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of
    different dimension don't link. Equal vectors fall into one class before anything is compared. Rows that repeat
    a vec_id are vectors of their own, each counted, and a component's id is the least vec_id in it. A null vec_id
    links like any other and never names a component, unless all its ids are null. An empty table stays empty; other
    columns, whatever their names, are ignored.
    """
    packed = staged(_classes(vectors), "vectors")
    classes = packed.where("vec is not null").groupBy("vec").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    # Numbered once, as the table is written; vec_id may repeat.
    classes = staged(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    plans = _plans(classes, threshold, reach, recall, passes, seed)
    near = _links(_keyed(classes.select("rep", "vec"), plans, seed), threshold, reach, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    labels = components(_verified(near, classes, threshold))

    # Exact links within each component, in blocks of vectors against blocks of vectors.
    placed = classes.join(labels, classes["rep"] == labels["id"]).select("component_id", "rep", "vec", "weight")
    sizes = labels.groupBy("component_id").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = placed.join(sizes, "component_id").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    one = placed.select("component_id", "rep", "vec", "weight", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    one = one.select("component_id", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "vec", "weight")

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        i = int(pdf["i"].iloc[0])
        a, b = (pdf, pdf) if pdf["i"].iloc[0] == pdf["j"].iloc[0] else (pdf[pdf["block"] == i], pdf[pdf["block"] != i])
        out = []
        for p, q in ((a, b),) if a is b else ((a, b), (b, a)):
            if len(p) and len(q):
                y, w = _unit(q["vec"].tolist()), q["weight"].to_numpy(float)
                n = np.concatenate([(_unit(p["vec"].iloc[k : k + 1024].tolist()) @ y.T >= threshold) @ w for k in range(0, len(p), 1024)])
                out.append(pd.DataFrame({"rep": p["rep"].to_numpy(), "n": n.astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({"rep": [], "n": []}, dtype="int64")

    counts = one.groupBy("component_id", "i", "j").applyInPandas(count, "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n"))
    named = classes.join(labels, classes["rep"] == labels["id"], "left").select("vec", "weight", "rep", "least", F.coalesce("component_id", "rep").alias("component"))
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_class = named.join(names, "component").join(counts, "rep", "left").select(F.col("vec").alias("v"), "component_id", (F.coalesce("n", "weight") - 1).alias("links"))
    out = packed.join(by_class, packed["vec"] == by_class["v"], "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
