"""Helpers shared by the training-data operators: shared-folder staging, byte-budgeted batch
slicing, and vectorised 64-bit hashing of words and shingles.

Nothing in the rest of the library imports this subpackage.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python task looks at in one go; one longer document is handled alone.
CHUNK_BYTES = 2 << 20

U64 = np.uint64


def reachable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package where it isn't installed (a plain checkout on the driver's path)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)
    return spark


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share, from spark.checkpoint.dir; a temporary one where that is unset and Spark
    runs in one process (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if "dir" not in _own:
            _own["dir"] = "file://" + tempfile.mkdtemp(prefix="spark-")
        base = _own["dir"]
    return base.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df as Parquet in the shared folder and read it back.

    The written table outlives any executor, so a lost executor costs a task, not the stages before it.
    """
    path = f"{shared_dir(df.sparkSession)}/heddle-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with further columns behind a generator, so that no filter or projection above it computes them again."""
    made = F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))).alias(*columns)
    return df.select(*[c for c in df.columns if c not in columns], made)


def slices(lengths: np.ndarray, budget: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose lengths add up to the budget at most (a longer row makes a range of its own)."""
    start, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and total + n > budget:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column laid end to end, and the n+1 offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_binary())
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8) if col.buffers()[2] is not None and len(offsets) and offsets[-1] else np.zeros(0, np.uint8)
    if not len(offsets):
        return data, np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: A random 64-bit code per byte value and an odd base for polynomial hashes modulo 2**64.
BYTE_CODES = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
BASE = U64(0xD6E8FEB86659FD93)
_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE**i for i < n (or of its inverse), kept and grown between calls."""
    key = "inverse" if inverse else "plain"
    have = _powers.get(key)
    if have is None or len(have) < n:
        base = U64(pow(int(BASE), -1, 1 << 64)) if inverse else BASE
        out = np.full(max(n, 1 << 16), base, U64)
        out[0] = 1
        _powers[key] = have = np.multiply.accumulate(out)
    return have[:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """n+1 prefix sums of byte code times BASE**position."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_CODES[data] * powers(len(data)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Position-free polynomial hashes of data[start:stop]; equal bytes give equal values."""
    return (prefix[stop] - prefix[start]) * powers(len(prefix), inverse=True)[start]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ (A-Z lower-cased) of all texts, and n+1 word offsets by text."""
    n = len(data)
    if not n:
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = offsets[(offsets > 0) & (offsets < n)]
    first[cut] = inside[cut]
    start = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cut - 1] = inside[cut - 1]
    stop = np.flatnonzero(last) + 1
    h = span_hashes(prefix_hashes(_LOWER[data]), start, stop)
    h = mix64(h + (stop - start).astype(U64) * U64(0x9E3779B97F4A7C15))
    return h, np.searchsorted(start, offsets)


_SHINGLE = [U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9), U64(0x27D4EB2F165667C5), U64(0x85EBCA77C2B2AE63)]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of the k-word shingles of each text, and n+1 offsets.

    A text of 1 to k-1 words has its whole sequence as one shingle; one without words has none.
    """
    words, at = word_hashes(data, offsets)
    counts = np.diff(at)
    m = len(words)
    parts, owners = [], []
    if m >= k:
        h = np.zeros(m - k + 1, U64)
        for j in range(k):
            h += words[j : m - k + 1 + j] * _SHINGLE[j]
        owner = np.repeat(np.arange(len(counts)), counts)[: m - k + 1]
        ok = np.arange(m - k + 1) + k <= at[1:][owner]
        parts.append(mix64(h[ok]))
        owners.append(owner[ok])
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        h = U64(counts[i])
        with np.errstate(over="ignore"):
            for j in range(counts[i]):
                h += words[at[i] + j] * _SHINGLE[j]
        parts.append(mix64(np.array([h ^ U64(0xA5A5A5A5A5A5A5A5)], U64)))
        owners.append(np.array([i]))
    if not parts:
        return np.zeros(0, U64), np.zeros(len(counts) + 1, np.int64)
    h, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[keep], owner[keep]
    return h, np.searchsorted(owner, np.arange(len(counts) + 1))
