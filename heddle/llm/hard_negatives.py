"""Hard-negative mining with exact integer scores by the method of the four Russians.

Vectors are integers. For a group of eight dimensions all 256 sums of a subset of an anchor's components are tabulated once; of a
candidate, the bits of one weight in those eight components form a byte, which picks the sum that these bits contribute. A
score is the sum of these lookups over groups, shifted by the weight and added over the bit planes (the sign's
plane is subtracted), and equals the inner product exactly.

Anchors and candidates meet in blocks: a grid cell holds a bounded number of both, whatever the sizes of the table and of single labels.
Labels are scored with themselves first, for the positives; the best of all cells bound what each anchor looks for when it meets
the rows of other labels.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import staged
from .skew import spread_join

#: Anchors and candidates in a grid cell, and anchors whose tables are held at a time.
ANCHOR_BLOCK, ROW_BLOCK, TABLES = 4096, 8192, 256
#: Components' size and scores' bounds are held below this power of two, so that every product fits in 64 bits.
BITS = 55


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """(groups, 256, anchors): for each group of eight dimensions the sums of all subsets of each anchor's components."""
    n, d = anchors.shape
    groups = -(-d // 8)
    padded = np.zeros((n, 8 * groups), anchors.dtype)
    padded[:, :d] = anchors
    parts = padded.reshape(n, groups, 8).transpose(1, 2, 0)
    out = np.zeros((groups, 256, n), anchors.dtype)
    for bit in range(8):
        np.add(out[:, : 1 << bit], parts[:, bit : bit + 1], out=out[:, 1 << bit : 2 << bit])
    return out


def bit_planes(rows: np.ndarray) -> np.ndarray:
    """(planes, groups, rows) bytes: bit k of eight components at a time in two's complement; the last plane is the sign."""
    n, d = rows.shape
    width = int(max(rows.max(initial=0), -1 - rows.min(initial=0))).bit_length() + 1
    bits = (rows[None] >> np.arange(width)[:, None, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little").transpose(0, 2, 1).copy()


def scores(anchors: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(rows, anchors) exact inner products; anchors are integers, planes those of the rows."""
    width, groups, n = planes.shape
    bound = int(np.abs(anchors).sum(1).max(initial=0)) << width
    if bound >> BITS:
        raise OverflowError("scores of these vectors don't fit in 64 bits")
    kind = np.int32 if bound < 1 << 31 else np.int64
    tables = subset_sums(anchors.astype(kind))
    out = np.zeros((n, len(anchors)), kind)
    for a in range(0, n, 2048):
        total = out[a : a + 2048]
        plane, looked = np.empty_like(total), np.empty_like(total)
        for k in range(width):
            plane[:] = 0
            for g in range(groups):
                plane += np.take(tables[g], planes[k, g, a : a + 2048], axis=0, out=looked, mode="clip")
            plane <<= k
            if k < width - 1:
                total += plane
            else:
                total -= plane
    return out


def _quantised(vectors: DataFrame, label: Column, factor: float) -> DataFrame:
    """vec_id, label, dim and q (little-endian int64 of floor(factor * x)) of the rows that take part."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(2)
            sizes = np.asarray(pc.list_value_length(col)).astype(np.int64)
            flat = col.flatten()
            x = np.where(np.asarray(flat.is_valid()), flat.fill_null(0.0).to_numpy(zero_copy_only=False), np.nan)
            with np.errstate(over="ignore", invalid="ignore"):
                scaled = np.floor(factor * x)
            ends = np.cumsum(sizes)
            out: list[bytes | None] = [None] * len(sizes)
            wide = np.abs(scaled) >= 1 << (BITS - 2)
            q = np.where(np.isfinite(x) & ~wide, scaled, 0).astype("<i8")
            for i, (a, b) in enumerate(zip((ends - sizes).tolist(), ends.tolist(), strict=True)):
                if np.isfinite(x[a:b]).all():
                    if wide[a:b].any():
                        raise OverflowError("a component of a vector is too large for exact 64-bit scores")
                    out[i] = q[a:b].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes.astype(np.int32)), pa.array(out, pa.binary())], ["vec_id", "label", "dim", "q"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where("vec_id is not null and label is not null and embedding is not null")
    return rows.mapInArrow(pack, "vec_id long, label long, dim int, q binary").where("q is not null")


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _cell(table: pa.Table) -> tuple[pa.Table, np.ndarray, pa.Table, np.ndarray]:
    """Anchors and candidates of a grid cell with their integers, candidates in order of vec_id."""
    is_anchor = _column(table, "is_anchor")
    some, rows = table.filter(pa.array(is_anchor)), table.filter(pa.array(~is_anchor)).sort_by("vec_id")

    def ints(t: pa.Table) -> np.ndarray:
        return np.frombuffer(b"".join(t.column("q").to_pylist()), "<i8").reshape(len(t), -1) if len(t) else np.zeros((0, 0), np.int64)

    return some, ints(some), rows, ints(rows)


def _best_positives(take: int):
    """Of a cell of one label, the best rows of each anchor: rid, positive_id, score."""

    def work(table: pa.Table) -> pa.Table:
        some, a, rows, c = _cell(table)
        rid, ids, other = _column(some, "rid"), _column(rows, "vec_id"), _column(rows, "rid")
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        planes = bit_planes(c)
        n = len(ids)
        for k in range(0, len(rid) if n else 0, TABLES):
            s = scores(a[k : k + TABLES], planes).T
            # One number ranks score and, on ties, place by vec_id; an anchor comes after all others of its own.
            rank = s.astype(np.int64) * n + np.arange(n - 1, -1, -1)
            self_ = rid[k : k + TABLES, None] == other[None]
            rank[self_] = np.iinfo(np.int64).min
            keep = min(take, n)
            top = np.argpartition(rank, n - keep, axis=1)[:, n - keep :]
            at = np.repeat(np.arange(len(s)), keep)
            top = top.ravel()
            fine = ~self_[at, top]
            at, top = at[fine], top[fine]
            found.append((rid[k : k + TABLES][at], ids[top], s[at, top].astype(np.int64)))
        cols = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("rid", "positive_id", "score"), cols, strict=True)))

    return work


def _best_negatives(take: int, low: int, high: int):
    """Of a cell, the best rows of other labels within low to high per cent of each positive's score: rid, place (of the positive),
    negative_id, score."""

    def work(table: pa.Table) -> pa.Table:
        some, a, rows, c = _cell(table)
        rid, label, bounds = _column(some, "rid"), _column(some, "label"), some.column("positive_scores").to_pylist()
        ids, other = _column(rows, "vec_id"), _column(rows, "label")
        found: list[tuple[int, int, int, int]] = []
        planes = bit_planes(c)
        for k in range(0, len(rid) if len(ids) else 0, TABLES):
            s = np.ascontiguousarray(scores(a[k : k + TABLES], planes).T).astype(np.int64)
            for i in range(len(s)):
                wanted = bounds[k + i]
                at = np.flatnonzero((100 * s[i] >= low * min(wanted)) & (100 * s[i] <= high * max(wanted)) & (other != label[k + i]))
                at = at[np.argsort(-s[i][at], kind="stable")]
                down = -100 * s[i][at]
                for place, p in enumerate(wanted):
                    first, stop = np.searchsorted(down, -high * p, "left"), np.searchsorted(down, -low * p, "right")
                    for j in at[first : min(stop, first + take)].tolist():
                        found.append((int(rid[k + i]), place, int(ids[j]), int(s[i][j])))
        cols = list(zip(*found, strict=True)) if found else [[], [], [], []]
        return pa.table({"rid": pa.array(cols[0], pa.int64()), "place": pa.array(cols[1], pa.int32()), "negative_id": pa.array(cols[2], pa.int64()), "score": pa.array(cols[3], pa.int64())})

    return work


def _blocks(n: Column, size: int) -> Column:
    return F.ceil(n / size).cast("int")


def _grid(anchors: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Anchors and rows in the cells (i, j) of their key; both have row_blocks and anchor_blocks."""
    of_row, of_anchor = F.pmod(F.xxhash64("rid"), F.col("row_blocks")).cast("int"), F.pmod(F.xxhash64("rid"), F.col("anchor_blocks")).cast("int")
    extra = [c for c in anchors.columns if c not in rows.columns]
    base = [*keys, *[c for c in ("rid", "vec_id", "label", "q") if c not in keys]]
    a = anchors.select(*base, *extra, of_anchor.alias("i"), F.explode(F.sequence(F.lit(0), F.col("row_blocks") - 1)).alias("j"), F.lit(True).alias("is_anchor"))
    b = rows.select(*base, *[F.lit(None).cast(anchors.schema[c].dataType).alias(c) for c in extra], F.explode(F.sequence(F.lit(0), F.col("anchor_blocks") - 1)).alias("i"), of_row.alias("j"), F.lit(False).alias("is_anchor"))
    return a.unionByName(b)


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column | None = None, factor: float = 256.0, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of each anchor's hard negatives.

    vectors has vec_id, label and embedding. Rows with a null vec_id, label or vector, or with a null or non-finite component, take no part;
    label (an expression) may say what to use as label. Components become floor(factor * x). Each anchor (is_anchor, an
    expression on vec_id) has as positives its best other rows of its label, and for each of them the best rows of
    other labels with a score of low to high per cent of the positive's. Equal scores are in order of vec_id. Vectors
    meet those of their dimension only. Rows that repeat a vec_id are rows of their own: as anchors, positives and
    negatives, so results repeat too. An empty vector scores 0 with others. Components or scores beyond some 2**53 raise.
    An empty table, or one without anchors, gives no row. Other columns, whatever their names, are ignored.
    """
    rows = staged(_quantised(vectors, F.col("label") if label is None else label, factor).withColumn("rid", F.monotonically_increasing_id()), "rows")
    rows = rows.withColumn("kind", F.struct("dim", "label"))
    anchors = rows.where(is_anchor)
    n_anchors, n_rows = anchors.count(), rows.count()

    # Positives: each label by itself, a large one in several blocks. Labels without anchors are not looked at.
    per_kind = anchors.groupBy("kind").agg(F.count("*").alias("a")).join(rows.groupBy("kind").agg(F.count("*").alias("n")), "kind")
    per_kind = staged(per_kind.select("kind", "n", _blocks(F.col("a"), ANCHOR_BLOCK).alias("anchor_blocks"), _blocks(F.col("n"), ROW_BLOCK).alias("row_blocks")), "labels")
    placed = spread_join(rows, per_kind, "kind", "n", n_rows)
    grid = _grid(placed.where(is_anchor), placed, ["dim", "label"])
    near = grid.groupBy("dim", "label", "i", "j").applyInArrow(_best_positives(positives), "rid long, positive_id long, score long")
    best = Window.partitionBy("rid").orderBy(F.desc("score"), "positive_id")
    near = near.withColumn("k", F.row_number().over(best)).where(F.col("k") <= positives)
    near = near.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("k", "positive_id", "score"))).alias("p"))
    bounded = staged(anchors.join(near, "rid").select("rid", "vec_id", "dim", "label", "q", F.col("p.positive_id").alias("positive_ids"), F.col("p.score").alias("positive_scores")), "positives")

    # Negatives: anchors against all rows.
    sizes = {"anchor_blocks": F.lit(max(1, -(-n_anchors // ANCHOR_BLOCK))), "row_blocks": F.lit(max(1, -(-n_rows // ROW_BLOCK)))}
    grid = _grid(bounded.drop("positive_ids").withColumns(sizes), rows.drop("kind").withColumns(sizes), ["dim"])
    far = grid.groupBy("dim", "i", "j").applyInArrow(_best_negatives(negatives, low, high), "rid long, place int, negative_id long, score long")
    best = Window.partitionBy("rid", "place").orderBy(F.desc("score"), "negative_id")
    far = far.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    named = bounded.select("rid", F.col("vec_id").alias("anchor_id"), F.posexplode(F.arrays_zip("positive_ids", "positive_scores")).alias("place", "p"))
    out = named.join(far, ["rid", "place"])
    return out.select("anchor_id", F.col("p.positive_ids").alias("positive_id"), "rank", "negative_id", F.col("p.positive_scores").alias("positive_score"), F.col("score").alias("negative_score"))


ORACLE = """
WITH q AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, list_inner_product(a.e, b.e)::BIGINT AS score FROM q a JOIN q b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.own AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
QUALIFY rank <= 3"""
