"""MinHash near-duplicate detection with SetSketch registers.

Register i of a set is max over its elements of floor(1 - log_b(x_i)), where x_i(d) is exponential with a rate
`a` and drawn by a hash of the element d, cut to 0..q+1. Registers of a union are the larger ones of its parts,
and two sets agree in a register with a probability near their Jaccard similarity (b is close to 1).

1. Equal shingle sets fall into one class by a 128-bit digest; only one representative goes on.
2. Registers are cut into bands; representatives that share a band are candidates. In a band's bucket each
   member is first paired with one centre; pairs of which the joint likelihood of the registers rules out the
   threshold are dropped, and the others are verified on full shingle sets.
3. Where members of a bucket still stand in different components, those outside the bucket's largest component
   are held against all its members, block by block: a task gets two blocks of bounded size with their texts,
   counts all intersections exactly with a product of incidence matrices, and returns a spanning forest of the
   components that it finds linked: fewer links than it has documents. So no pairs are emitted, no task takes a
   whole bucket, and no pair of a bucket is left out but those that are in one component already.

Documents are known inside by the number of their class, so ids may repeat.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import U64, mix64, shingle_sets, slices, staged, text_buffers
from .components import components

#: Bands and registers in a band: at a similarity of 0.85, 1 - (1 - 0.85**5)**24 > 0.999999.
BANDS, ROWS = 24, 5
#: SetSketch parameters: base of the spacing, rate, and largest register value.
BASE_B, RATE_A, Q = 1.001, 20.0, (1 << 16) - 2
#: Pairs whose likeliest similarity is this far below the threshold are not verified (over 6 standard errors).
MARGIN = 0.22

#: Documents in a block of the exact comparison, and shingles that go into one matrix product.
BLOCK, SLAB = 256, 1 << 14

_ODD = mix64(np.arange(1, BANDS * ROWS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def registers(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(n, BANDS * ROWS) uint16 registers of n non-empty sets; the hash of an element in register i is its
    multiple by an odd constant, of which the largest stands for the smallest exponential."""
    n = len(at) - 1
    out = np.zeros((n, len(_ODD)), np.uint16)
    full = np.flatnonzero(np.diff(at))
    if not len(full):
        return out
    start = at[:-1][full]
    spread = mix64(sets)
    for i, odd in enumerate(_ODD):
        u = (np.maximum.reduceat(spread * odd, start) >> U64(11)).astype(np.float64) * 2.0**-53
        x = -np.log1p(-(1.0 - np.maximum(u, 2.0**-53))) / RATE_A
        x = np.maximum(x, 1e-300)
        out[full, i] = np.clip(np.floor(1.0 - np.log(x) / np.log(BASE_B)), 0, Q + 1)
    return out


_GRID = np.linspace(0.0, 1.0, 201)


def likely_similarity(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of greatest likelihood given how many registers are larger, smaller and equal."""
    more = (a > b).sum(1)[:, None].astype(float)
    less = (a < b).sum(1)[:, None].astype(float)
    same = a.shape[1] - more - less
    u = (size_a / (size_a + size_b))[:, None]
    v = 1.0 - u

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE_B - 1) / BASE_B) / np.log(BASE_B)

    up, down = p(u - v * _GRID), p(v - u * _GRID)
    tie = np.maximum(1 - up - down, 1e-12)
    fit = more * np.log(np.maximum(up, 1e-12)) + less * np.log(np.maximum(down, 1e-12)) + same * np.log(tie)
    return _GRID[np.argmax(fit, axis=1)]


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text and th (hash of the text)."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, two digests of the set (0 for none), registers (little-endian uint16)."""

    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0))
            for i, j in slices(lengths):
                sets, at = shingle_sets(*text_buffers(batch.column(1).slice(i, j - i)), k)
                n = np.diff(at)
                total = np.concatenate([[U64(0)], np.cumsum(mix64(sets ^ U64(0x5851F42D4C957F2D)))])
                other = np.concatenate([[U64(0)], np.cumsum(mix64(sets + U64(0x14057B7EF767814F)))])
                regs = registers(sets, at).astype("<u2")
                width = regs.shape[1] * 2
                raw = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((np.arange(len(n) + 1) * width).astype(np.int32).tobytes()), pa.py_buffer(regs.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(n), pa.array((total[at[1:]] - total[at[:-1]]).view(np.int64)), pa.array((other[at[1:]] - other[at[:-1]]).view(np.int64)), raw],
                    ["doc_id", "th", "n_shingles", "digest_a", "digest_b", "registers"],
                )

    return _rows(docs).mapInArrow(sketch, "doc_id long, th long, n_shingles long, digest_a long, digest_b long, registers binary")


def _buckets(registers: list[bytes]) -> np.ndarray:
    """(n, BANDS) buckets: hashes of a band's registers and its number."""
    regs = np.frombuffer(b"".join(registers), "<u2").reshape(len(registers), -1).astype(U64)
    h = np.tile(mix64(np.arange(1, BANDS + 1, dtype=U64)), (len(regs), 1))
    for r in range(ROWS):
        h = mix64(h * U64(0x9E3779B97F4A7C15) + regs[:, r::ROWS])
    return h


def _bands(reps: DataFrame) -> DataFrame:
    """(bucket, doc_id) for each band of each representative; the band's number is part of the bucket's hash."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            h = _buckets(batch.column(1).to_pylist())
            ids = np.repeat(np.asarray(batch.column(0)), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(h.ravel().view(np.int64)), pa.array(ids)], ["bucket", "doc_id"])

    return reps.select("doc_id", "registers").mapInArrow(cut, "bucket long, doc_id long")


def _likely(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """pairs (u, v) with the likeliest similarity, without those below least."""
    a = reps.select(F.col("doc_id").alias("u"), F.col("registers").alias("ru"), F.col("n_shingles").alias("nu"))
    b = reps.select(F.col("doc_id").alias("v"), F.col("registers").alias("rv"), F.col("n_shingles").alias("nv"))
    # The smaller set must hold the whole intersection, so sizes that differ too much are out at once.
    both = pairs.join(a, "u").join(b, "v").where(F.least("nu", "nv") * 100 >= F.greatest("nu", "nv") * int((least + MARGIN) * 100 + 0.5))

    def rate(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                ru = np.frombuffer(b"".join(f["ru"]), "<u2").reshape(len(f), -1)
                rv = np.frombuffer(b"".join(f["rv"]), "<u2").reshape(len(f), -1)
                j = likely_similarity(ru, rv, f["nu"].to_numpy(float), f["nv"].to_numpy(float))
                yield pd.DataFrame({"u": f["u"], "v": f["v"], "likely": j})[j >= least]

    return both.mapInPandas(rate, "u long, v long, likely double")


def _verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (u, v) with 100 * intersection >= percent * union of the full shingle sets."""
    a = texts.select(F.col("doc_id").alias("u"), F.col("text").alias("tu"))
    b = texts.select(F.col("doc_id").alias("v"), F.col("text").alias("tv"))
    both = pairs.select("u", "v").join(a, "u").join(b, "v").select("u", "v", "tu", "tv")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.asarray(pc.add(pc.fill_null(pc.binary_length(batch.column(2)), 0), pc.fill_null(pc.binary_length(batch.column(3)), 0)))
            for i, j in slices(lengths):
                sa, at = shingle_sets(*text_buffers(batch.column(2).slice(i, j - i)), k)
                sb, bt = shingle_sets(*text_buffers(batch.column(3).slice(i, j - i)), k)
                owner = np.concatenate([np.repeat(np.arange(j - i), np.diff(at)), np.repeat(np.arange(j - i), np.diff(bt))])
                both = np.concatenate([sa, sb])
                order = np.lexsort((both, owner))
                both, owner = both[order], owner[order]
                twice = np.flatnonzero((both[1:] == both[:-1]) & (owner[1:] == owner[:-1]))
                inter = np.bincount(owner[twice], minlength=j - i)
                union = np.diff(at) + np.diff(bt) - inter
                ok = pa.array((100 * inter >= percent * union) & (union > 0))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).filter(ok), batch.column(1).slice(i, j - i).filter(ok)], ["u", "v"])

    return both.mapInArrow(compare, "u long, v long")


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows (bucket, doc_id, label, main) by pairs of blocks: bucket, i, j, side, doc_id, label.

    A bucket's q documents outside its main component and all its m documents are dealt by a hash into blocks of
    about BLOCK; each of the first meets each of the second, so a document is sent q / BLOCK or m / BLOCK times.
    """
    size = rows.groupBy("bucket").agg(F.ceil(F.count_if(F.col("label") != F.col("main")) / BLOCK).cast("int").alias("a"), F.ceil(F.count("*") / BLOCK).cast("int").alias("b"))
    rows = rows.join(size.where("a > 0"), "bucket").withColumn("h", F.xxhash64("doc_id"))
    mine = rows.where("label <> main").select("bucket", "doc_id", "label", F.lit(0).alias("side"), F.pmod("h", F.col("a")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("j"))
    all_ = rows.select("bucket", "doc_id", "label", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("a") - 1)).alias("i"), F.pmod("h", F.col("b")).cast("int").alias("j"))
    return mine.unionByName(all_)


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places in a and b (ends of links, by component) of links that connect the same components and hold no cycle."""
    kinds, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = code[: len(a)], code[len(a) :]
    link = np.full((len(kinds), len(kinds)), -1, np.int64)
    link[a, b] = link[b, a] = np.arange(len(a))
    seen, out = np.zeros(len(kinds), bool), []
    for root in range(len(kinds)):
        queue = [] if seen[root] else [root]
        seen[root] = True
        while queue:
            here = queue.pop()
            new = np.flatnonzero((link[here] >= 0) & ~seen)
            seen[new] = True
            out.append(link[here, new])
            queue += new.tolist()
    return np.concatenate(out)


def _across_blocks(mixed: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (u, v) between components within buckets; mixed has bucket, doc_id, label and the bucket's main label."""
    dealt = _dealt(mixed).join(texts, "doc_id").select("bucket", "i", "j", "side", "doc_id", "label", "text")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        sets, at = shingle_sets(*text_buffers(pa.array(pdf["text"], pa.string())), k)
        n = np.diff(at)
        side, ids, label = pdf["side"].to_numpy(), pdf["doc_id"].to_numpy(), pdf["label"].to_numpy()
        owner = np.repeat(np.arange(len(n)), n)
        kinds, code = np.unique(sets, return_inverse=True)
        both = np.ones(len(kinds), bool)
        for s in (0, 1):
            here = np.zeros(len(kinds), bool)
            here[code[side[owner] == s]] = True
            both &= here
        new = np.cumsum(both) - 1
        owner, code = owner[both[code]], new[code[both[code]]]
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        place = np.zeros(len(n), np.int64)
        place[left], place[right] = np.arange(len(left)), np.arange(len(right))
        inter = np.zeros((len(left), len(right)))
        for low in range(0, int(both.sum()), SLAB):
            part = (code >= low) & (code < low + SLAB)
            o, c = owner[part], code[part] - low
            x, y = (np.zeros((len(m), min(SLAB, int(both.sum()) - low)), np.float32) for m in (left, right))
            for m, s in ((x, 0), (y, 1)):
                of = side[o] == s
                m[place[o[of]], c[of]] = 1
            inter += x @ y.T
        union = n[left][:, None] + n[right][None, :] - inter
        r, c = np.nonzero((100 * inter >= percent * union) & (label[left][:, None] != label[right][None, :]))
        r, c = left[r], right[c]
        if not len(r):
            return pd.DataFrame({"u": [], "v": []}, dtype="int64")
        tree = _forest(label[r], label[c])
        r, c = r[tree], c[tree]
        return pd.DataFrame({"u": np.maximum(ids[r], ids[c]), "v": np.minimum(ids[r], ids[c])})

    return dealt.groupBy("bucket", "i", "j").applyInPandas(compare, "u long, v long")


def _linked(docs: DataFrame, k: int, percent: int, star_rounds: int) -> tuple[DataFrame, DataFrame]:
    """Sketches (doc_id, th, n_shingles, digests), and classes of equal sets: digests, n_shingles, doc_id and th of
    one document of the class, the least doc_id of the class's component, and first: whether the class holds it."""
    least = percent / 100 - MARGIN
    made = staged(sketches(docs, k), "sketch")
    named = made.where("n_shingles > 0 and doc_id is not null")
    digest = ["digest_a", "digest_b", "n_shingles"]
    # Classes are numbered once, as their table is written.
    classes = named.groupBy(*digest).agg(F.min(F.struct("doc_id", "th")).alias("one")).select(*digest, F.col("one.doc_id").alias("least"), "one.th").withColumn("rep", F.monotonically_increasing_id())
    classes = staged(classes, "class")
    numbers = classes.select(F.col("least").alias("doc_id"), "th", *digest, "rep")
    reps = named.join(numbers, ["doc_id", "th", *digest]).select(F.col("rep").alias("doc_id"), "n_shingles", "registers").dropDuplicates(["doc_id"])
    reps = staged(reps, "reps")
    bands = _bands(reps)
    shared = bands.groupBy("bucket").agg(F.count("*").alias("m"), F.min_by("doc_id", F.xxhash64("bucket", "doc_id")).alias("centre")).where("m > 1")
    members = staged(bands.join(shared.select("bucket", "centre"), "bucket"), "bands")
    wanted = members.select("doc_id").distinct()
    asked = numbers.join(wanted.withColumnRenamed("doc_id", "rep"), "rep").select("doc_id", "th", "rep")
    texts = staged(_rows(docs).join(asked, ["doc_id", "th"]).select(F.col("rep").alias("doc_id"), "text").dropDuplicates(["doc_id"]), "texts")
    lean = staged(reps.join(wanted, "doc_id", "left_semi"), "lean")

    pairs = members.where("doc_id <> centre").select(F.greatest("doc_id", "centre").alias("u"), F.least("doc_id", "centre").alias("v")).distinct()
    likely = staged(_likely(pairs, lean, least), "likely")
    edges, labels = None, None
    open_pairs = likely
    for _ in range(star_rounds):
        if labels is not None:
            # A pair that was verified is in one component now or no link; either way the next likeliest has its turn.
            open_pairs = staged(_across(open_pairs.join(best, ["u", "v"], "left_anti"), labels), "across")
            if not open_pairs.limit(1).count():
                break
        best = staged(open_pairs.groupBy("u").agg(F.max_by(F.struct("v", "likely"), F.struct("likely", "v")).alias("x")).select("u", "x.v"), "best")
        found = staged(_verified(best, texts, k, percent), "links")
        edges = found if edges is None else edges.unionByName(found)
        labels = components(edges)

    # What is left: pairs of one bucket in different components, one of them outside the bucket's largest.
    placed = members.join(labels, members["doc_id"] == labels["id"], "left").select("bucket", "doc_id", F.coalesce("component_id", "doc_id").alias("label"))
    largest = placed.groupBy("bucket", "label").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("labels")).where("labels > 1")
    mixed = staged(placed.join(largest.select("bucket", "main"), "bucket"), "mixed")
    if mixed.limit(1).count():
        edges = edges.unionByName(staged(_across_blocks(mixed, texts, k, percent), "links"))
        labels = components(edges)

    placed = classes.join(labels, classes["rep"] == labels["id"], "left").select(*digest, F.col("least").alias("doc_id"), "th", "rep", F.coalesce("component_id", "rep").alias("label"))
    firsts = placed.groupBy("label").agg(F.min(F.struct("doc_id", "rep")).alias("x")).select("label", F.col("x.doc_id").alias("component"), F.col("x.rep").alias("first"))
    return made, placed.join(firsts, "label").select(*digest, "doc_id", "th", "component", (F.col("rep") == F.col("first")).alias("first"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, star_rounds: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs (doc_id, text, ...).

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; a set holds the distinct k-word shingles, or the whole
    sequence as one where there are fewer words. Null, empty and wordless texts have the empty set and link
    with nothing. Ids that repeat are documents of their own, whatever the order of rows; a null doc_id links with
    nothing and is kept. Very long texts are read whole. An empty table gives an empty result. Other columns,
    whatever their names, are ignored.
    """
    made, classes = _linked(docs, k, percent, star_rounds)
    digest = ["digest_a", "digest_b", "n_shingles"]
    by_class = classes.select(*[F.col(c).alias(f"c_{c}") for c in digest], "component")
    out = made.join(by_class, (made["digest_a"] == F.col("c_digest_a")) & (made["digest_b"] == F.col("c_digest_b")) & (made["n_shingles"] == F.col("c_n_shingles")) & made["doc_id"].isNotNull(), "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, star_rounds: int = 2) -> DataFrame:
    """docs with one row of each group of near-duplicates: the one of least doc_id (of rows that repeat in id and
    text, any). Rows without words or with a null doc_id stay. Columns are those of docs, whatever their names."""
    made, classes = _linked(docs, k, percent, star_rounds)
    kept = classes.where("first").select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.lit(True).alias("__first"))
    linked = made.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id", "th").agg(F.count("*").alias("__copies")).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), "__copies")
    marks = staged(linked.join(kept, ["__id", "__th"], "left").where("__first is null or __copies > 1"), "marks")
    rows = docs.withColumns({"__id": F.col("doc_id").cast("long"), "__th": F.xxhash64(F.col("text").cast("string"))}).join(marks, ["__id", "__th"], "left")
    once = rows.where("__copies is null").select(*docs.columns)
    again = rows.where("__first and __copies > 1").dropDuplicates(["__id", "__th"]).select(*docs.columns)
    return once.unionByName(again)


def _across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends stand in different components."""
    a = labels.select(F.col("id").alias("u"), F.col("component_id").alias("cu"))
    b = labels.select(F.col("id").alias("v"), F.col("component_id").alias("cv"))
    return pairs.join(a, "u", "left").join(b, "v", "left").where("coalesce(cu, u) <> coalesce(cv, v)").select("u", "v", "likely")
