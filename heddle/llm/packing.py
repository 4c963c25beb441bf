"""Best-fit packing of documents into training sequences of several permitted lengths.

Variable-capacity best fit: pieces go, longest first, to the open bin that they fill most closely; where none
fits, a new bin is opened; at the end each bin is cut down to the smallest permitted length that holds its contents.
The permitted lengths are optimised jointly: which size a new bin gets follows a plan (the size preferred while
pieces of it or less are to be placed), every plan is packed to the end, bins cut down included, and the plan whose
bins cost least in all is taken. A sequence costs its length, a fixed overhead and attention, which grows with the
square of its length. Documents longer than the longest permitted length are cut into pieces of that length and a
rest.

Spark deals the pieces to shards by a hash of doc_id, so that every shard is a fair sample of all lengths and
has a bounded number of rows whatever the source or length that is frequent; a shard is packed by one task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import slices, staged
from .bpe import encoder

#: Permitted sequence lengths in tokens, what a sequence costs besides its length, and the length at which attention
#: costs as much as the rest does per token.
CAPACITIES = (1024, 2048, 4096, 8192)
OVERHEAD, ATTENTION = 64, 1 << 17
SHARD_PIECES = 20_000
#: Text bytes that are encoded in one go.
TEXT_BYTES = 8 << 20


def token_lengths(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and n_tokens (end id included) of every document; null text counts as empty."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            texts = batch.column(1)
            lengths = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
            n = [enc.counts(texts.slice(a, b - a)) for a, b in slices(lengths, TEXT_BYTES)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(n) + 1 if n else np.zeros(0, np.int64))], ["doc_id", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_tokens long")


def bin_cost(capacity: np.ndarray | int, overhead: int = OVERHEAD, attention: int = ATTENTION) -> np.ndarray | float:
    """Cost of bins of a capacity, in tokens."""
    return capacity + overhead + capacity * capacity / attention


def _filled(lengths: list[int], caps: list[int], preferred: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of pieces that come longest first, and what each bin holds, where a new bin has the preferred
    size, or the next that holds its first piece."""
    bins, offsets, used = [], [], []
    free: list[list[int]] = [[] for _ in range(caps[-1] + 1)]
    mask = 0
    for n in lengths:
        fitting = mask >> n
        if fitting:
            gap = n + (fitting & -fitting).bit_length() - 1
            b = free[gap].pop()
            if not free[gap]:
                mask ^= 1 << gap
        else:
            gap = next(c for c in caps if c >= n and c >= preferred)
            b = len(used)
            used.append(0)
        bins.append(b)
        offsets.append(used[b])
        used[b] += n
        gap -= n
        if gap:
            free[gap].append(b)
            mask |= 1 << gap
    return bins, offsets, used


def pack(lengths: np.ndarray, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, attention: int = ATTENTION) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin number and offset of each piece, and the final capacity of each bin.

    Pieces are taken longest first, equal ones in the order given, and of plans that cost the same that of the
    largest size is taken, so the result depends on nothing else.
    """
    caps = sorted(capacities)
    order = np.argsort(-lengths, kind="stable")
    ranked = lengths[order].tolist()
    best = None
    for preferred in reversed(caps):
        bins, offsets, used = _filled(ranked, caps, preferred)
        final = np.asarray(caps, np.int64)[np.searchsorted(caps, np.asarray(used, np.int64))] if used else np.zeros(0, np.int64)
        cost = float(np.sum(bin_cost(final, overhead, attention)))
        if best is None or cost < best[0]:
            best = cost, bins, offsets, final
    _, bins, offsets, final = best
    out = np.zeros((2, len(lengths)), np.int64)
    out[:, order] = bins, offsets
    return out[0], out[1], final


def best_fit(lengths: DataFrame, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, attention: int = ATTENTION, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Pack (doc_id, n_tokens): one row per piece with its bin, its place in it and the bin's final capacity.

    Returns doc_id, piece, n_tokens, bin_id (shard and number), bin_offset, bin_capacity, bin_used. Null or
    non-positive lengths make no piece. A null doc_id is carried along. Rows that repeat are packed as often as they
    occur, ties by doc_id and piece. Very long documents make as many pieces as they need. Other columns of lengths,
    whatever their names, are ignored; an empty table gives an empty result.
    """
    longest = max(capacities)
    pieces = lengths.where(F.col("n_tokens") > 0).select("doc_id", F.posexplode(F.sequence(F.lit(0), F.floor((F.col("n_tokens") - 1) / longest).cast("int"))).alias("piece", "at"), F.col("n_tokens").alias("whole"))
    pieces = pieces.select("doc_id", "piece", F.least(F.lit(longest), F.col("whole") - F.col("at").cast("long") * longest).cast("long").alias("n_tokens"))
    pieces = staged(pieces, "pieces")
    shards = max(1, -(-pieces.count() // shard_pieces))
    sharded = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "n_tokens"), F.lit(shards)))

    def packed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable", na_position="first")
        bins, offsets, final = pack(pdf["n_tokens"].to_numpy(), capacities, overhead, attention)
        used = np.bincount(bins, weights=pdf["n_tokens"].to_numpy(), minlength=len(final)).astype(np.int64)
        return pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "piece": pdf["piece"], "n_tokens": pdf["n_tokens"], "bin_id": f"{key[0]}-" + pd.Series(bins, index=pdf.index).astype(str), "bin_offset": offsets, "bin_capacity": final[bins], "bin_used": used[bins]})

    return sharded.groupBy("shard").applyInPandas(packed, "doc_id long, piece int, n_tokens long, bin_id string, bin_offset long, bin_capacity long, bin_used long")


def best_fit_documents(docs: DataFrame, tokenizer: str, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> DataFrame:
    """best_fit over the token lengths of whole texts (null text: the end id alone)."""
    return best_fit(token_lengths(docs, tokenizer), capacities, overhead)
