"""Token-id output in seekable zstandard files, and random access to single documents in them.

A file is a run of independent zstandard frames, each holding the ids (little-endian uint32) of whole
documents, then a skippable frame with the document table, then the trailing skippable seek table of the
public "zstd seekable" layout: per frame its compressed size, its raw size and the low 32 bits of XXH64 of its
raw bytes. A reader needs the two tables and only the frames of the documents it asks for.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ._common import shared_dir, slices
from .bpe import encoder

#: Ids in a frame; a longer document has a frame of its own.
FRAME_IDS = 1 << 18
#: Text that goes into one file, and that is encoded in one go, in bytes.
FILE_BYTES, TEXT_BYTES = 32 << 20, 4 << 20
DOC_TABLE_MAGIC, SEEK_TABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_DOC = np.dtype([("doc_id", "<i8"), ("present", "u1"), ("frame", "<u4"), ("first", "<u4"), ("count", "<u8")])


class FrameWriter:
    """Writes documents in the order given."""

    def __init__(self, out, level: int = 1, frame_ids: int = FRAME_IDS):
        import zstandard

        self.out, self.frame_ids = out, frame_ids
        self.compress = zstandard.ZstdCompressor(level=level, write_checksum=True).compress
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, int, int, int, int]] = []
        self.pending: list[np.ndarray] = []
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if self.held and self.held + len(ids) > self.frame_ids:
            self._flush()
        self.docs.append((doc_id or 0, doc_id is not None, len(self.frames), self.held, len(ids)))
        self.pending.append(ids)
        self.held += len(ids)

    def _flush(self) -> None:
        import xxhash

        raw = np.concatenate(self.pending).astype("<u4").tobytes() if self.pending else b""
        packed = self.compress(raw)
        self.out.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.pending, self.held = [], 0

    def close(self) -> None:
        if self.pending:
            self._flush()
        table = self.compress(np.array(self.docs, _DOC).tobytes())
        self.out.write(struct.pack("<II", DOC_TABLE_MAGIC, len(table)) + table)
        entries = b"".join(struct.pack("<III", *f) for f in self.frames)
        self.out.write(struct.pack("<II", SEEK_TABLE_MAGIC, len(entries) + 13) + entries)
        self.out.write(struct.pack("<IIBI", len(table), len(self.frames), 0x80, SEEKABLE_MAGIC))


class FrameReader:
    """Random access: __getitem__ by document number, find() by doc_id."""

    def __init__(self, source):
        import zstandard

        self.source, self.unpack = source, zstandard.ZstdDecompressor().decompress
        source.seek(0, 2)
        size = source.tell()
        source.seek(size - 13)
        table_size, n, _, magic = struct.unpack("<IIBI", source.read(13))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("not a seekable file")
        source.seek(size - 13 - 12 * n)
        self.frames = np.frombuffer(source.read(12 * n), "<u4").reshape(n, 3)
        self.at = np.concatenate([[0], np.cumsum(self.frames[:, 0].astype(np.int64))])
        source.seek(size - 13 - 12 * n - 8 - table_size)
        self.docs = np.frombuffer(self.unpack(source.read(table_size)), _DOC)
        self.start = np.concatenate([[0], np.cumsum(self.docs["count"].astype(np.int64))])
        self._held: tuple[int, np.ndarray] = (-1, np.zeros(0, "<u4"))

    def __len__(self) -> int:
        return len(self.docs)

    def frame(self, k: int) -> np.ndarray:
        import xxhash

        if self._held[0] != k:
            self.source.seek(int(self.at[k]))
            raw = self.unpack(self.source.read(int(self.frames[k, 0])))
            if len(raw) != self.frames[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.frames[k, 2]:
                raise ValueError(f"frame {k} is damaged")
            self._held = (k, np.frombuffer(raw, "<u4"))
        return self._held[1]

    def __getitem__(self, i: int) -> np.ndarray:
        d = self.docs[i]
        return self.frame(int(d["frame"]))[int(d["first"]) : int(d["first"]) + int(d["count"])]

    def find(self, doc_id: int) -> np.ndarray:
        hit = np.flatnonzero((self.docs["doc_id"] == doc_id) & (self.docs["present"] == 1))
        if not len(hit):
            raise KeyError(doc_id)
        return self[int(hit[0])]


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, files: int | None = None) -> DataFrame:
    """Encode text and write one file per range of doc_id below folder (a URI that all executors reach).

    Returns the manifest: part, path, n_docs, n_ids. There is a file for about FILE_BYTES of text where files is not
    given. Null text is empty; null doc_id comes first; rows of one doc_id stand in order of text. A very long text
    makes a frame by itself. A task that is run again writes the same bytes under the same name. Other columns,
    whatever their names, are ignored.
    """
    if files is None:
        size = docs.agg(F.sum(F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))) + 64)).first()[0]
        files = max(1, -(-(size or 0) // FILE_BYTES))

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc = TaskContext.get().partitionId(), encoder(tokenizer)
        attempt = TaskContext.get().taskAttemptId()
        fs, root = _filesystem(folder)
        fs.create_dir(root, recursive=True)
        final, temp, n_docs, n_ids, out = f"{root}/part-{part:06d}.zst", f"{root}/.part-{part:06d}.{attempt}", 0, 0, None
        for batch in batches:
            if out is None:
                out = fs.open_output_stream(temp)
                writer = FrameWriter(out)
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            lengths = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
            for a, b in slices(lengths, TEXT_BYTES):
                ids, at = enc.encode(texts.slice(a, b - a))
                ids = np.insert(ids, at[1:], np.uint32(end_id))
                at = (at + np.arange(len(at))).tolist()
                for i in range(b - a):
                    writer.add(doc_ids[a + i], ids[at[i] : at[i + 1]])
                n_ids += len(ids)
            n_docs += batch.num_rows
        if out is not None:
            writer.close()
            out.close()
            fs.move(temp, final)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([f"{folder}/part-{part:06d}.zst"]), pa.array([n_docs], pa.int64()), pa.array([n_ids], pa.int64())], ["part", "path", "n_docs", "n_ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranged = rows.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")
    return ranged.mapInArrow(write, "part long, path string, n_docs long, n_ids long")


def read_token_files(spark: SparkSession, manifest: list[Row], wanted: DataFrame | None = None) -> DataFrame:
    """Rows doc_id, start, n_tokens, ids of the manifest's files, one task per file, frame by frame.

    start counts the ids of all documents before it, over all files in order of part. wanted (path, doc_id)
    restricts the read to those documents, of which only the frames are read and decompressed.
    """
    before, rows = 0, []
    for m in sorted(manifest, key=lambda m: m["part"]):
        rows.append((m["path"], before))
        before += m["n_ids"]
    files = spark.createDataFrame(rows, "path string, before long").repartition(max(1, len(rows)), "path")
    if wanted is not None:
        asked = wanted.groupBy("path").agg(F.collect_set("doc_id").alias("asked"))
        files = files.join(asked, "path")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = _filesystem(row["path"])
                with fs.open_input_file(path) as source:
                    reader = FrameReader(source)
                    chosen = range(len(reader))
                    if row.get("asked") is not None:
                        chosen = np.flatnonzero(np.isin(reader.docs["doc_id"], row["asked"]) & (reader.docs["present"] == 1))
                    held: list[tuple] = []
                    size = 0
                    for i in chosen:
                        ids = reader[int(i)]
                        held.append((int(reader.docs["doc_id"][i]) if reader.docs["present"][i] else None, row["before"] + int(reader.start[i]), len(ids), ids))
                        size += len(ids)
                        if size > FRAME_IDS:
                            yield pack(held)
                            held, size = [], 0
                    if held:
                        yield pack(held)

    def pack(held: list[tuple]) -> pa.RecordBatch:
        doc_ids, start, n, ids = zip(*held, strict=True)
        flat = pa.array(np.concatenate(ids).astype(np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), flat)
        return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), lists], schema=schema)

    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids array<long>")


def token_digest(spark: SparkSession, manifest: list[Row]) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read back from the files.

    As read_token_files, but the task that decompresses a frame also takes the checksum of each document's bytes.
    """
    before, rows = 0, []
    for m in sorted(manifest, key=lambda m: m["part"]):
        rows.append((m["path"], before))
        before += m["n_ids"]

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = _filesystem(row["path"])
                with fs.open_input_file(path) as source:
                    reader = FrameReader(source)
                    crc = [zlib.crc32(reader[i].tobytes()) for i in range(len(reader))]
                    doc_ids = pa.array(reader.docs["doc_id"].astype(np.int64), mask=reader.docs["present"] == 0)
                    yield pa.RecordBatch.from_arrays([doc_ids, pa.array(row["before"] + reader.start[:-1]), pa.array(reader.docs["count"].astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.createDataFrame(rows, "path string, before long").repartition(max(1, len(rows)), "path")
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Write every document's ids and return the digest read back from the files.

    The manifest that passes through the driver has one row per file, so its size follows the number of
    partitions and not the documents. An empty table gives no file and no row.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/heddle-tokens-{uuid.uuid4().hex}"
    if "://" not in folder:
        folder = folder.replace("file:", "") if folder.startswith("file:") else folder
        folder = "file://" + folder
    return token_digest(spark, write_token_files(docs, folder, tokenizer, end_id).collect())
