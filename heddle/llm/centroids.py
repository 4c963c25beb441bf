"""Centroid clustering in exact integers, with n-simplex projections that leave out centroids which cannot be nearest.

A few pivots span a simplex. From a vector's distances to them follow the coordinates of its apex over that simplex: all but
the last are those of its foot, the last is its height. Of two apices, the Euclidean distance bounds the distance of
the vectors from below, and the distance to the apex mirrored at the simplex bounds it from above. Vectors' apices are computed once
and kept; each round computes those of the centroids, drops the centroids whose lower bound exceeds the
least upper bound, and compares the others by exact integer distances.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import staged

#: Pivots at most, and the least height of a pivot over the simplex of those before it, as a share of the pivots' greatest distance.
PIVOTS, FLAT = 12, 1e-2
#: Part of the distances by which bounds are widened, far above the rounding of apex coordinates.
SLACK = 1e-5
#: Vectors compared in one go, and the power of two that components stay below, so that squared distances fit in 64 bits.
CHUNK, BITS = 8192, 26


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(rows of a, rows of b) exact squared distances of int64 vectors."""
    return np.stack([np.einsum("ij,ij->i", d, d) for d in (a - x for x in b)], 1) if len(b) else np.zeros((len(a), 0), np.int64)


class Simplex:
    """Base simplex of pivots, from their distances alone."""

    def __init__(self, candidates: np.ndarray, pivots: int = PIVOTS, flat: float = FLAT):
        """Takes from candidates the vector farthest from the first, then always the one highest over the simplex so far, as long as it
        is high enough for stable coordinates."""
        self.pivots = candidates[:1]
        self.corners = np.zeros((1, 0))
        if not len(candidates):
            return
        scale = float(np.sqrt(squared_distances(candidates, candidates).max()))
        while len(self.pivots) < pivots:
            high = self.apices(candidates)
            best = int(high[:, -1].argmax())
            if high[best, -1] <= flat * scale:
                break
            self.corners = np.vstack([np.pad(self.corners, ((0, 0), (0, 1))), high[best]])
            self.pivots = np.vstack([self.pivots, candidates[best]])

    def apices(self, vectors: np.ndarray) -> np.ndarray:
        """(rows, pivots) apex coordinates, the height last."""
        squared = squared_distances(vectors, self.pivots).astype(float)
        foot = np.zeros((len(vectors), self.corners.shape[1]))
        # Corner i has its last coordinate at i - 1, so each distance gives one further coordinate.
        for i in range(1, len(self.corners)):
            c = self.corners[i]
            foot[:, i - 1] = ((squared[:, 0] - squared[:, i] + (c**2).sum()) / 2 - foot[:, : i - 1] @ c[: i - 1]) / c[i - 1]
        height = np.sqrt(np.maximum(squared[:, 0] - (foot**2).sum(1), 0))
        return np.column_stack([foot, height])


def bounds(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the distances between vectors and centroids from their apices, widened for rounding."""
    foot = np.maximum((a[:, None, :-1] - b[None, :, :-1]) ** 2, 0).sum(2)
    reach = SLACK * (np.sqrt((a**2).sum(1))[:, None] + np.sqrt((b**2).sum(1))[None]) + 1e-6
    low, high = np.sqrt(foot + (a[:, None, -1] - b[None, :, -1]) ** 2), np.sqrt(foot + (a[:, None, -1] + b[None, :, -1]) ** 2)
    return np.maximum(low - reach, 0), high + reach


def nearest(vectors: np.ndarray, apices: np.ndarray, centroids: np.ndarray, simplex: Simplex) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of the nearest centroid (the smaller number on ties), and how many distances were computed."""
    low, high = bounds(apices, simplex.apices(centroids))
    left = low <= high.min(1, keepdims=True)
    best, least = np.full(len(vectors), -1), np.full(len(vectors), np.iinfo(np.int64).max)
    for j in range(len(centroids)):
        at = np.flatnonzero(left[:, j])
        diff = vectors[at] - centroids[j]
        d = np.einsum("ij,ij->i", diff, diff)
        closer = d < least[at]
        best[at[closer]], least[at[closer]] = j, d[closer]
    return best, least, int(left.sum())


def _kept(vectors: DataFrame, width: int, factor: float) -> DataFrame:
    """vec_id and q (little-endian int64 of floor(factor * x)) of vectors with width components, none null or non-finite."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column(1).flatten()
            x = np.where(np.asarray(flat.is_valid()), flat.fill_null(0.0).to_numpy(zero_copy_only=False), np.nan).reshape(-1, width)
            good = np.isfinite(x).all(1)
            with np.errstate(over="ignore"):
                q = np.floor(factor * x[good])
            if (np.abs(q) >= 1 << BITS).any():
                raise OverflowError("a component of a vector is too large for exact 64-bit distances")
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), pa.array([r.tobytes() for r in q.astype("<i8")], pa.binary())], ["vec_id", "q"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where(F.size("embedding") == width).mapInArrow(pack, "vec_id long, q binary")


def _ints(col: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), "<i8").reshape(-1, width)


def _with_apices(rows: DataFrame, simplex: Simplex, width: int) -> DataFrame:
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                apex = simplex.apices(_ints(batch.column(1), width))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a.tobytes() for a in apex], pa.binary())], ["vec_id", "q", "apex"])

    return rows.mapInArrow(work, "vec_id long, q binary, apex binary")


def _chunks(batch: pa.RecordBatch, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for a in range(0, batch.num_rows, CHUNK):
        part = batch.slice(a, CHUNK)
        yield part, _ints(part.column(1), width), np.frombuffer(b"".join(part.column(2).to_pylist()), float).reshape(part.num_rows, -1)


def _sums(rows: DataFrame, centroids: np.ndarray, simplex: Simplex) -> dict[int, tuple[int, list[int]]]:
    """Count and componentwise sums of the vectors nearest to each centroid: one partial sum per task and centroid, then one of all."""
    width = centroids.shape[1]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            for _, vectors, apices in _chunks(batch, width):
                best, _, _ = nearest(vectors, apices, centroids, simplex)
                order = np.argsort(best, kind="stable")
                which, first = np.unique(best[order], return_index=True)
                total[which] += np.add.reduceat(vectors[order], first, axis=0)
                count += np.bincount(best, minlength=len(centroids))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(centroids)), pa.int32()), pa.array(count), pa.array(total.tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    parts = rows.mapInArrow(work, "cluster int, n long, total array<long>")
    exact = [F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    return {r["cluster"]: (r["n"], [int(r[f"s{i}"]) for i in range(width)]) for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *exact).collect()}


def centroid_clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, width: int = 64, factor: float = 64.0, seed: int = 1, pivots: int = PIVOTS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector of width finite components.

    vectors has vec_id and embedding; others (null, of another length, with null or non-finite components) are left out.
    Components become floor(factor * x). The first centroids are the k vectors of smallest sha256 of "seed:vec_id" (on ties,
    which only repeated ids give, of the smaller bytes); fewer vectors give fewer centroids; a vector without
    vec_id starts none but is assigned (and starts one only if no vector has an id: then there is no centroid and no row).
    Rows that repeat a vec_id are vectors of their own. Each round assigns every vector to its nearest centroid (the smaller number on ties)
    and replaces each centroid that has vectors by floor(sum / count); then vectors are assigned once more. Components of
    2**26 or more raise. An empty table gives no row. Other columns, whatever their names, are ignored.

    The driver holds the centroids and their sums: k times width numbers.
    """
    plain = staged(_kept(vectors, width, factor), "integers")
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = plain.where("vec_id is not null").orderBy(mark, "q").limit(k).select("q").collect()
    if not first:
        return plain.limit(0).selectExpr("vec_id", "cast(null as int) as cluster", "vec_id as distance", "vec_id as cluster_inertia", "vec_id as inertia", "cast(null as string) as centroid_sha256")
    centroids = np.frombuffer(b"".join(bytes(r["q"]) for r in first), "<i8").reshape(-1, width).copy()
    simplex = Simplex(centroids, pivots)
    rows = staged(_with_apices(plain, simplex, width), "apices")
    for _ in range(rounds):
        for cluster, (n, total) in _sums(rows, centroids, simplex).items():
            if n:
                centroids[cluster] = [t // n for t in total]

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, ints, apices in _chunks(batch, width):
                best, least, _ = nearest(ints, apices, centroids, simplex)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(best, pa.int32()), pa.array(least, pa.int64())], ["vec_id", "cluster", "distance"])

    assigned = staged(rows.mapInArrow(assign, "vec_id long, cluster int, distance long"), "assigned")
    of = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    prints = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    pick = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster") + 1)
    inertia = F.lit(sum(of.values())).cast("long")
    return assigned.select("vec_id", "cluster", "distance", pick([of.get(j, 0) for j in range(len(centroids))], "long").alias("cluster_inertia"), inertia.alias("inertia"), pick(prints, "string").alias("centroid_sha256"))


def oracle(rounds: int = 3, k: int = 16) -> str:
    """DuckDB SQL of the same: a step per round, sums and floors in integers."""
    steps = [f"""
WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1)::INTEGER AS j, e AS c FROM q ORDER BY sha256('1:' || vec_id) LIMIT {k})"""]
    for r in range(rounds + 1):
        steps.append(f"""
d{r} AS (SELECT vec_id, e, j, list_sum(list_transform(list_zip(e, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS distance FROM q, c{r}),
a{r} AS (SELECT vec_id, any_value(e) AS e, arg_min(j, (distance, j)) AS cluster, min(distance) AS distance FROM d{r} GROUP BY vec_id)""")
        if r < rounds:
            steps.append(f"""
u{r} AS (SELECT cluster, i, sum(e[i])::BIGINT AS s, count(*) AS n FROM a{r}, range(1, 65) t(i) GROUP BY cluster, i),
m{r} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM u{r} GROUP BY cluster),
c{r + 1} AS (SELECT j, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} ON m{r}.cluster = c{r}.j)""")
    return ",".join(steps) + f"""
SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON j = cluster"""
