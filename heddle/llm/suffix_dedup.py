"""Removal of byte strings of `length` bytes that start more than once in the corpus, by suffix sorting.

Sorting every suffix of a corpus is needless: most of them share no long string with any other.

1. Each window of `length` bytes picks the k-gram of least hash in it as its anchor (winnowing). Equal windows
   pick equal anchors at equal offsets, so windows need comparing only where their anchors agree. Windows in a
   row with one anchor form a span, described by the hash of the anchor and of the whole span: a few bytes for
   some 80 bytes of text, and all that is shuffled for text that is not repeated.
2. Spans of one hash are repeated as a whole. Where different spans have one anchor, some of their windows may
   be equal: one copy of each such span goes, with its bytes, to a suffix sort. There the suffixes that start at
   the span's windows are merge-sorted; the common extension of suffixes is found by binary search over prefix
   polynomial hashes, so that a comparison takes a logarithmic number of steps, and suffixes that agree in
   `length` bytes are compared byte by byte before they count.
3. The covered bytes of each document are cut out.

The spans of an anchor that very many different spans share (the edges of a passage that stands in very many
documents) are too many for one sort. They are cut into blocks of windows; blocks whose common bytes stand nowhere
else drop out, and the windows of the others are counted by a 128-bit digest of their bytes. Counts are combined
before the shuffle and what is joined is written, so Spark can split it: no task takes a whole group of copies.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import U64, mix64, prefix_hashes, slices, span_hashes, staged, text_buffers

LENGTH, GRAM = 200, 40
#: Spans of one anchor beyond which windows are counted in blocks of so many offsets rather than sorted.
HOT_SPANS, BLOCK = 5_000, 16
#: Context bytes that one suffix sort takes; at these its arrays need some 400 MB.
SORT_BYTES = 2 << 20


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    step, out = 1, x
    while step * 2 <= w:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    if step < w:
        out = np.minimum(out[: len(x) - w + 1], out[w - step : w - step + len(x) - w + 1])
    return out


def spans(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Spans of texts laid end to end: text number, first window, last window, anchor (all positions within
    the text), anchor hash and span hash. Texts shorter than length have none."""
    w = length - gram + 1
    nothing = tuple(np.zeros(0, np.int64) for _ in range(6))
    if len(data) < length:
        return nothing
    prefix = prefix_hashes(data)
    at = np.arange(len(data) - gram + 1)
    g = span_hashes(prefix, at, at + gram)
    g ^= g >> U64(29)
    g *= U64(0xBF58476D1CE4E5B9)
    g ^= g >> U64(32)
    least = _sliding_min(g, w)
    # Windows that lie in one text, as runs of equal least hash.
    ok = np.zeros(len(least) + 1, bool)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= length:
            ok[a : b - length + 1] = True
    ok = ok[:-1]
    head = ok.copy()
    head[1:] &= (least[1:] != least[:-1]) | ~ok[:-1]
    first = offsets[:-1][np.diff(offsets) >= length]
    head[first] = True
    lo = np.flatnonzero(head)
    if not len(lo):
        return nothing
    last = ok.copy()
    last[:-1] &= head[1:] | ~ok[1:]
    hi = np.flatnonzero(last)
    value = least[lo]
    # Positions of these values, by value and position; the anchor of a window is the leftmost in it.
    mark = np.zeros(1 << 20, bool)
    mark[(value & U64((1 << 20) - 1)).astype(np.int64)] = True
    maybe = np.flatnonzero(mark[(g & U64((1 << 20) - 1)).astype(np.int64)])
    kinds, rank = np.unique(value, return_inverse=True)
    kind = np.searchsorted(kinds, g[maybe])
    hit = kinds[np.minimum(kind, len(kinds) - 1)] == g[maybe]
    place = np.sort(kind[hit].astype(np.int64) * (len(data) + 1) + maybe[hit])
    a = np.searchsorted(place, rank * (len(data) + 1) + lo)
    b = np.searchsorted(place, rank * (len(data) + 1) + hi)
    # A run of windows whose least hash occurs more than once in it falls into a piece for each.
    n = b - a + 1
    run = np.repeat(np.arange(len(lo)), n)
    nth = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    anchor = place[a[run] + nth] - rank[run] * (len(data) + 1)
    start = lo[run].copy()
    later = nth > 0
    start[later] = anchor[np.flatnonzero(later) - 1] + 1
    stop = np.minimum(hi[run], anchor)
    text = np.searchsorted(offsets, start, side="right") - 1
    base = offsets[text]
    whole = span_hashes(prefix, start, stop + length)
    whole = mix64(whole + mix64((anchor - start).astype(U64) * U64(1 << 32) + (stop - start).astype(U64)))
    return text, start - base, stop - base, anchor - base, value[run], whole


def equal_windows(data: np.ndarray, start: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which of the windows data[start : start + length] have an equal one, by a hash-compared suffix sort.

    Each round merge-sorts the suffixes of a group by the eight bytes at the depth to which they agree, splits
    the group where these differ, and finds the depth of each new group by binary search over prefix hashes.
    """
    prefix = prefix_hashes(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    found = np.zeros(len(start), bool)
    who = np.arange(len(start))
    group, depth = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    while len(who):
        # The last eight bytes of a window are read again rather than bytes behind it.
        at = start[who] + np.minimum(depth, length - 8)
        key = np.zeros(len(who), U64)
        for j in range(8):
            key = (key << U64(8)) | padded[at + j].astype(U64)
        order = np.argsort(key, kind="stable")
        order = order[np.argsort(group[order], kind="stable")]
        who, key, depth, group = who[order], key[order], depth[order], group[order]
        new = np.ones(len(who), bool)
        new[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        group = np.cumsum(new) - 1
        size = np.bincount(group)
        more = size[group] > 1
        who, depth, group = who[more], depth[more], group[more]
        if not len(who):
            break
        new = np.ones(len(who), bool)
        new[1:] = group[1:] != group[:-1]
        heads = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        chief = start[who[heads]][group]
        mine = start[who]
        # Longest common extension with the group's first suffix: least depth known, most depth possible.
        low, high = np.minimum(depth + 8, length), np.full(len(who), length)
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = span_hashes(prefix, chief, chief + mid) == span_hashes(prefix, mine, mine + mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        depth = np.minimum.reduceat(low, heads)[group]
        done = depth >= length
        for a in range(0, int(done.sum()), 1 << 14):
            part = np.flatnonzero(done)[a : a + (1 << 14)]
            reach = np.arange(length)
            real = (data[mine[part][:, None] + reach] == data[chief[part][:, None] + reach]).all(1)
            real &= mine[part] != chief[part]
            found[who[part[real]]] = True
            found[who[heads[group[part[real]]]]] = True
        who, depth, group = who[~done], depth[~done], group[~done]
    return found


def _text_rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumn("__text", text).withColumn("__key", F.xxhash64(F.col("doc_id").cast("long"), text))


def _span_rows(keyed: DataFrame, length: int) -> DataFrame:
    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.asarray(batch.column(0))
            for i, j in slices(np.asarray(pc.binary_length(batch.column(1))), 1 << 19):
                text, lo, hi, anchor, kh, sh = spans(*text_buffers(batch.column(1).slice(i, j - i)), length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[i + text]), pa.array(lo << 20 | hi - lo << 10 | anchor - lo), pa.array(kh.astype(U64).view(np.int64)), pa.array(sh.astype(U64).view(np.int64))],
                    ["key", "place", "kh", "sh"],
                )

    return keyed.select("__key", "__text").mapInArrow(emit, "key long, place long, kh long, sh long")


def _lo(place: str = "place") -> Column:
    """First window of a span; last window and anchor stand in the lower bits as offsets from it, so that a span
    takes four numbers in shuffles."""
    return F.shiftright(place, 20).cast("int")


def _hi(place: str = "place") -> Column:
    return _lo(place) + F.shiftright(place, 10).bitwiseAND(1023).cast("int")


def _anchor(place: str = "place") -> Column:
    return _lo(place) + F.col(place).bitwiseAND(1023).cast("int")


def _contexts(keyed: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Bytes of the wanted spans; those of hot anchors in blocks of offsets, with a hash (core) of the bytes that all
    windows of the block share, of the anchor and of the offset."""
    per_text = wanted.groupBy("key").agg(F.collect_list(F.struct("lo", "hi", "anchor", "kh", "sh", "hot")).alias("spans"))
    both = keyed.select(F.col("__key").alias("key"), "__text").join(per_text, "key").select("__text", "spans")

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = text.encode()
                for s in found:
                    lo, hi, anchor = s["lo"], s["hi"], s["anchor"]
                    if not s["hot"]:
                        out.append((s["kh"], s["sh"], None, lo, raw[lo : hi + length]))
                    else:
                        for block in range((anchor - hi) // BLOCK, (anchor - lo) // BLOCK + 1):
                            a, b = max(lo, anchor - block * BLOCK - BLOCK + 1), min(hi, anchor - block * BLOCK)
                            shared = raw[anchor - block * BLOCK : anchor - block * BLOCK - BLOCK + 1 + length]
                            core = hashlib.blake2b(shared, digest_size=8, key=struct.pack("<qq", s["kh"], block)).digest()
                            out.append((s["kh"], s["sh"], int.from_bytes(core, "little", signed=True), a, raw[a : b + length]))
                    held += hi - lo + length
                if held > SORT_BYTES:
                    yield pack(out)
                    out, held = [], 0
            if out:
                yield pack(out)

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["kh", "sh", "core", "at", "context"])

    return both.mapInArrow(emit, "kh long, sh long, core long, at int, context binary")


def _counted_windows(contexts: DataFrame, length: int) -> DataFrame:
    """kh, sh and runs (of one window each) of the windows that equal another's, for blocks of hot anchors."""
    cores = contexts.groupBy("core").agg(F.count("*").alias("m")).where("m > 1").select("core")
    met = contexts.join(staged(cores, "cores"), "core", "left_semi").select("kh", "sh", "at", "context")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(3).to_pylist()
            n = np.array([len(x) - length + 1 for x in raw], np.int64)
            owner = np.repeat(np.arange(len(raw)), n)
            window = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            digests = [hashlib.blake2b(raw[i][w : w + length], digest_size=16).digest() for i, w in zip(owner.tolist(), window.tolist(), strict=True)]
            at = np.asarray(batch.column(2))[owner] + window
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), batch.column(1).take(pa.array(owner)), pa.array(at.astype(np.int32)), pa.array(digests, pa.binary())], ["kh", "sh", "a", "digest"])

    windows = staged(met.mapInArrow(cut, "kh long, sh long, a int, digest binary"), "windows")
    again = windows.groupBy("digest").agg(F.count("*").alias("m")).where("m > 1").select("digest")
    return windows.join(staged(again, "again"), "digest", "left_semi").select("kh", "sh", "a", F.col("a").alias("b"))


def _sorted_contexts(contexts: DataFrame, length: int) -> DataFrame:
    """kh, sh and runs (first, last window) of the windows that equal another's; an anchor has HOT_SPANS contexts at most."""
    dealt = contexts.select("kh", "sh", "at", "context").repartition("kh").sortWithinPartitions("kh")

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.column(3).nbytes
            if size < SORT_BYTES:
                continue
            rows = pa.Table.from_batches(held)
            mark = np.asarray(rows.column(0))
            change = np.flatnonzero(mark[1:] != mark[:-1]) + 1
            if len(change):
                yield from solve(rows.slice(0, int(change[-1])))
                held = rows.slice(int(change[-1])).to_batches()
                size = sum(b.column(3).nbytes for b in held)
        if held:
            yield from solve(pa.Table.from_batches(held))

    def solve(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        raw = rows.column(3).combine_chunks()
        if isinstance(raw, pa.ChunkedArray):
            raw = raw.chunk(0)
        mark = np.asarray(rows.column(0))
        new = np.ones(len(raw), bool)
        new[1:] = mark[1:] != mark[:-1]
        group_at = np.append(np.flatnonzero(new), len(raw))
        sizes = np.asarray(pc.binary_length(raw))
        # Whole groups, as many as fit; a group that is larger goes alone.
        for i, j in slices(np.add.reduceat(sizes.astype(np.int64), group_at[:-1]), SORT_BYTES):
            a, b = int(group_at[i]), int(group_at[j])
            data, offsets = text_buffers(raw.slice(a, b - a))
            n = np.diff(offsets) - length + 1
            owner = np.repeat(np.arange(b - a), n)
            window = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            hit = equal_windows(data, offsets[:-1][owner] + window, length)
            head, tail = hit.copy(), hit.copy()
            head[1:] &= ~hit[:-1] | (owner[1:] != owner[:-1])
            tail[:-1] &= ~hit[1:] | (owner[1:] != owner[:-1])
            f, t = np.flatnonzero(head), np.flatnonzero(tail)
            if len(f):
                take = pa.array(a + owner[f])
                at = np.asarray(rows.column(2))[a + owner[f]]
                yield pa.RecordBatch.from_arrays([rows.column(0).take(take).combine_chunks(), rows.column(1).take(take).combine_chunks(), pa.array((at + window[f]).astype(np.int32)), pa.array((at + window[t]).astype(np.int32))], ["kh", "sh", "a", "b"])

    return dealt.mapInArrow(emit, "kh long, sh long, a int, b int")


def repeated_ranges(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """__key and ranges (array of byte ranges start, stop) of the documents that have repeated strings."""
    if not GRAM < length <= 500:
        raise ValueError("length must be over the anchor's and up to 500")
    keyed = _text_rows(docs)
    rows = staged(_span_rows(keyed, length), "spans")
    # Written, so that Spark can split a frequent anchor's rows in the join.
    twice = staged(rows.groupBy("kh").agg(F.count("*").alias("m")).where("m > 1").select("kh"), "twice")
    shared = staged(rows.join(twice, "kh"), "shared")
    kinds = shared.groupBy("kh", "sh").agg(F.count("*").alias("n"), F.min(F.struct("key", "place")).alias("x"))
    kinds = staged(kinds.select("kh", "sh", "n", "x.*"), "kinds")
    mixed = staged(kinds.groupBy("kh").agg(F.count("*").alias("m")).where("m > 1"), "mixed")
    wanted = kinds.join(mixed, "kh").select("key", _lo().alias("lo"), _hi().alias("hi"), _anchor().alias("anchor"), "kh", "sh", (F.col("m") > HOT_SPANS).alias("hot"))
    contexts = _contexts(keyed, wanted, length)
    if mixed.where(F.col("m") > HOT_SPANS).limit(1).count():
        contexts = staged(contexts, "contexts")
        partial = _sorted_contexts(contexts.where("core is null"), length).unionByName(_counted_windows(contexts.where("core is not null"), length))
    else:
        partial = _sorted_contexts(contexts, length)
    partial = partial.join(kinds.where("n = 1").select("kh", "sh", "key"), ["kh", "sh"]).select("key", F.col("a").alias("start"), (F.col("b") + length).alias("stop"))
    whole = shared.join(kinds.where("n > 1").select("kh", "sh"), ["kh", "sh"]).select("key", _lo().alias("start"), (_hi() + length).alias("stop"))
    return whole.unionByName(partial).groupBy(F.col("key").alias("__key")).agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with text reduced to the bytes outside repeated strings, and n_bytes, n_removed, n_spans, kept_sha256.

    Every byte covered by a string of `length` UTF-8 bytes that also starts elsewhere, in the same document or
    another, goes; overlapping occurrences count, all occurrences go, and strings are judged on the input.
    Null text is empty. Texts shorter than length lose nothing. Rows that repeat are documents of their own, so
    long ones lose everything. Where a cut falls within a character, kept_sha256 is of the bytes and the rest
    of that character is dropped from text. Other columns stay as they are; an empty table stays empty.
    """
    clash = [c for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256") if c in docs.columns]
    docs = docs.drop(*clash)
    keyed = _text_rows(docs)
    both = keyed.join(repeated_ranges(docs, length), "__key", "left")
    rest = [c for c in docs.columns if c != "text"]
    both = both.select(*rest, F.col("__text"), F.col("ranges.start").alias("__start"), F.col("ranges.stop").alias("__stop"))
    width = len(rest)
    schema = both.select(*rest).schema.add("text", "string").add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, made = batch.column(width).to_pylist(), []
            starts, stops = batch.column(width + 1), batch.column(width + 2)
            for i, text in enumerate(texts):
                raw = text.encode()
                removed = n_spans = 0
                kept = raw
                if starts[i].is_valid:
                    step = np.zeros(len(raw) + 1, np.int64)
                    np.add.at(step, np.asarray(starts[i].values), 1)
                    np.add.at(step, np.asarray(stops[i].values), -1)
                    gone = np.cumsum(step)[:-1] > 0
                    removed = int(gone.sum())
                    n_spans = int((gone[1:] & ~gone[:-1]).sum()) + int(gone[0])
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                made.append((kept.decode(errors="ignore"), len(raw), removed, n_spans, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*made, strict=True)) if made else [[]] * 5
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], [*rest, "text", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return both.mapInArrow(cut, schema)
