"""WARC archives: writing, normalising monolithic gzip, and reading records by offset.

A crawl's archive may come as one gzip stream over all its records, which has to be inflated from the start to reach
any of them. The normaliser inflates such a stream once, writes every record again as a gzip member of its own and, beside the
archive, an index with each record's offset and compressed length; readers then seek to the records they want.
Archives, members and indices are streamed: no task holds more than one record and a window of the stream.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import shared_dir, slices, staged
from .skew import spread_join
from .token_output import _filesystem

#: Payload bytes after which a task begins another archive; a longer record still goes into one.
ARCHIVE_BYTES = 64 << 20
#: Bytes of an archive read in one go, and of a record inflated in one go.
WINDOW, HEAD = 1 << 20, 1 << 16
#: Payloads of fewer bytes are never written as revisits.
REVISIT_BYTES = 100
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMES = ("WARC-Type", "WARC-Record-ID", "X-Page-ID", "WARC-Payload-Digest", "WARC-Refers-To", "WARC-Target-URI")


def record_id(page_id: int | None, digest: str) -> str:
    """A record's identifier, from its page and its payload."""
    return f"urn:uuid:{uuid.UUID(hashlib.md5(f'{page_id}:{digest}'.encode()).hexdigest())}"


def _uri(url: str) -> str:
    """url without bytes that would break a header line."""
    return "".join(c if " " < c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(kind: str, identifier: str, date: str, block: bytes, **headers: str | None) -> list[bytes]:
    """The pieces of one WARC record; headers without a value are left out."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{identifier}>", f"WARC-Date: {date}"]
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in headers.items() if v is not None]
    return ["\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode(), block, b"\r\n\r\n"]


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, is_revisit: bool, date: str) -> list[bytes]:
    """The record of one page: an HTTP response with the payload as body, or a revisit of the record that has it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    common = {"WARC_Target_URI": None if url is None else _uri(url), "X_Page_ID": None if page_id is None else str(page_id), "WARC_Payload_Digest": f"sha256:{digest}", "Content_Type": "application/http;msgtype=response"}
    if is_revisit:
        return record("revisit", record_id(page_id, digest), date, http, WARC_Profile=IDENTICAL, WARC_Refers_To=f"<{record_id(refers_to, digest)}>", **common)
    return record("response", record_id(page_id, digest), date, http + payload, **common)


def records_of(read: Callable[[int], bytes]) -> Iterator[tuple[dict[str, str], bytes, Iterator[bytes]]]:
    """Records of an uncompressed WARC stream: headers by lower-case name, the raw header bytes, and the pieces of the block,
    which must be used up before the next record is asked for."""
    held = b""
    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            more = read(HEAD)
            if not more:
                if held.strip():
                    raise ValueError("an archive ends within a record's headers")
                return
            held = (held + more).lstrip(b"\r\n") if not held.strip() else held + more
        raw, held = held[: end + 4], held[end + 4 :]
        first, *lines = raw[:-4].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("a record of an archive does not start with a WARC version")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        left = int(headers["content-length"])

        def block() -> Iterator[bytes]:
            nonlocal held, left
            while left:
                piece = held[:left] if held else read(min(left, HEAD))
                if not piece:
                    raise ValueError("an archive ends within a record")
                held = held[len(piece) :]
                left -= len(piece)
                yield piece

        yield headers, raw, block()
        if left:
            raise RuntimeError("a record's block was left unread")
        held = held.lstrip(b"\r\n")


class Inflater:
    """read(n) over the raw bytes of a gzip stream, whether it is one member or many."""

    def __init__(self, source):
        self.source, self.member, self.rest, self.ended, self.started = source, zlib.decompressobj(31), b"", False, False

    def read(self, n: int) -> bytes:
        while not self.ended:
            if self.member.eof:
                self.rest = self.member.unused_data
                self.member = zlib.decompressobj(31)
            data = self.member.unconsumed_tail or self.rest or self.source.read(WINDOW)
            self.rest = b""
            if not data and not self.started:
                self.ended = True
                break
            out = self.member.decompress(data, n)
            if not (data or out or self.member.eof):
                raise ValueError("a gzip stream is cut short")
            self.started = not self.member.eof
            if out:
                return out
        return b""


def normalise(source, out, index) -> int:
    """Write every record of the gzip stream source as its own member to out, and a line of JSON per record (offset and length of
    the member, and the headers that find a record) to index. Returns the number of records."""
    offset = n = 0
    for headers, raw, block in records_of(Inflater(source).read):
        pack = zlib.compressobj(1, zlib.DEFLATED, 31)
        length = 0
        for piece in chain((raw,), block, (b"\r\n\r\n",)):
            if data := pack.compress(piece):
                length += out.write(data)
        length += out.write(pack.flush())
        line = {"offset": offset, "length": length} | {k: headers[k.lower()] for k in _NAMES if k.lower() in headers}
        index.write(json.dumps(line).encode() + b"\n")
        offset += length
        n += 1
    return n


def read_record(source, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Headers and payload (the body of the HTTP message, or the block where there is none) of the member at offset."""
    source.seek(offset)
    raw = zlib.decompress(source.read(length), 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    block = rest[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").startswith("application/http") else block


def _digest(html: Column) -> Column:
    return F.sha2(html.cast("binary"), 256)


def revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, digest, first) of the pages whose payload of least bytes or more stands under a smaller page_id (first) too."""
    html = F.coalesce(F.col("html"), F.lit(""))
    narrow = staged(pages.select("page_id", _digest(html).alias("digest"), F.octet_length(html).alias("n")).where(F.col("n") >= least).drop("n"), "digests")
    groups = narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1 and first is not null")
    return spread_join(narrow, groups, "digest", "copies", narrow.count()).where("page_id is null or page_id > first").select("page_id", "digest", "first").distinct()


def write_archives(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES, least: int = REVISIT_BYTES) -> DataFrame:
    """Write a record per row of pages (page_id, url, html) to archives below folder, each one gzip stream over all its records.

    Returns a table with the path of every archive. Each task writes its own rows, in archives of about archive_bytes of payload,
    under names of its own attempt, so a task that runs again never touches a file that another has reported. date
    stands in every record, as pages have none.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    # Written first, so that Spark knows its size and shuffles payloads only where there are too many revisits to send round.
    again = staged(revisits(rows, least).select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "first"), "revisits")
    html = F.coalesce(F.col("html"), F.lit(""))
    told = rows.select("page_id", "url", html.cast("binary").alias("html"), _digest(html).alias("digest"))
    told = told.join(again, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left")
    told = told.select("page_id", "url", "html", "digest", F.col("first").alias("refers_to"), F.col("d").isNotNull().alias("is_revisit"))

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, root = _filesystem(folder)
        fs.create_dir(root, recursive=True)
        paths: list[str] = []
        out = pack = None
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                if out is None:
                    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(paths):04d}.warc.gz"
                    out, pack, size = fs.open_output_stream(f"{root}/{name}", compression=None), zlib.compressobj(1, zlib.DEFLATED, 31), 0
                    paths.append(f"{folder}/{name}")
                    _put(out, pack, record("warcinfo", f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}", date, b"format: WARC File Format 1.1\r\n", WARC_Filename=name, Content_Type="application/warc-fields"))
                page_id, url, payload, digest, refers_to, is_revisit = row
                _put(out, pack, page_record(page_id, url, payload, digest, refers_to, is_revisit, date))
                size += len(payload)
                if size >= archive_bytes:
                    out.write(pack.flush())
                    out.close()
                    out = None
        if out is not None:
            out.write(pack.flush())
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["path"])

    return told.mapInArrow(write, "path string")


def _put(out, pack, pieces: list[bytes]) -> None:
    for piece in pieces:
        if data := pack.compress(piece):
            out.write(data)


def _dealt(paths: DataFrame, n: int) -> DataFrame:
    """paths in as many tasks as there are archives, or three for each that runs at a time where there are more."""
    return paths.repartition(max(1, min(n, 3 * paths.sparkSession.sparkContext.defaultParallelism)), "path")


def normalise_archives(paths: DataFrame, folder: str) -> DataFrame:
    """Normalise the archives in column path into folder, one task per archive (a gzip stream has no second entry).

    Returns path (of the archive with a member per record), index (of its sidecar) and records. Names carry the attempt.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, root = _filesystem(folder)
                fs.create_dir(root, recursive=True)
                stem = path.rsplit("/", 1)[-1].removesuffix(".gz").removesuffix(".warc") + f".{attempt}"
                source_fs, source_path = _filesystem(path)
                with source_fs.open_input_stream(source_path, compression=None) as source, fs.open_output_stream(f"{root}/{stem}.warc.gz", compression=None) as out, fs.open_output_stream(f"{root}/{stem}.index.jsonl", compression=None) as index:
                    n = normalise(source, out, index)
                yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{stem}.warc.gz"]), pa.array([f"{folder}/{stem}.index.jsonl"]), pa.array([n], pa.int64())], ["path", "index", "records"])

    return _dealt(paths.select("path"), paths.count()).mapInArrow(work, "path string, index string, records long")


def read_archives(archives: DataFrame, payload: bool = False) -> DataFrame:
    """record_id, record_type, page_id, payload_bytes, payload_digest (of the payload that the record itself holds), refers_digest and
    refers_record (what a revisit says of the record it refers to) of the response and revisit records of archives (path, index),
    read member by member at the places that the index gives; with payload, that too."""
    schema = "record_id string, record_type string, page_id long, payload_bytes long, payload_digest string, refers_digest string, refers_record string, payload binary"
    types = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_digest", pa.string()), ("refers_record", pa.string()), ("payload", pa.binary())])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, place = _filesystem(index)
                with fs.open_input_stream(place, compression=None) as lines:
                    entries = [e for e in map(json.loads, lines.read().splitlines()) if e["WARC-Type"] in ("response", "revisit")]
                fs, place = _filesystem(path)
                with fs.open_input_file(place) as source:
                    for a, b in slices(np.array([e["length"] for e in entries], np.int64), 4 * WINDOW):
                        yield pa.RecordBatch.from_pylist([row(*read_record(source, e["offset"], e["length"])) for e in entries[a:b]], schema=types)

    def row(headers: dict[str, str], body: bytes) -> dict:
        again = headers["warc-type"] == "revisit"
        page_id = headers.get("x-page-id")
        return {
            "record_id": headers["warc-record-id"].strip("<>"), "record_type": headers["warc-type"], "page_id": None if page_id is None else int(page_id),
            "payload_bytes": len(body), "payload_digest": hashlib.sha256(body).hexdigest(), "refers_digest": headers["warc-payload-digest"].removeprefix("sha256:") if again else None,
            "refers_record": headers["warc-refers-to"].strip("<>") if again else None, "payload": body if payload else None,
        }

    out = _dealt(archives.select("path", "index"), archives.count()).mapInArrow(read, schema)
    return out if payload else out.drop("payload")


def resolve(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: revisits get the length and digest of the payload of the record they
    refer to, and its page. A revisit whose record is not there, or has another digest than the revisit says, raises."""
    again = records.where("record_type = 'revisit'").select("page_id", "record_type", F.col("refers_record").alias("target"), "refers_digest")
    plain = records.where("record_type = 'response'")
    asked = again.groupBy("target").agg(F.count("*").alias("asked"))
    # Rows that repeat a page with its payload have one record id between them.
    targets = plain.groupBy(F.col("record_id").alias("target")).agg(F.min("page_id").alias("refers_to"), F.min("payload_bytes").alias("payload_bytes"), F.min("payload_digest").alias("payload_digest")).join(asked, "target")
    found = spread_join(again, targets, "target", "asked", again.count(), "left")
    broken = F.raise_error(F.concat(F.lit("a revisit refers to no record with its payload: "), "target")).cast("string")
    digest = F.when(F.coalesce(F.col("payload_digest") == F.col("refers_digest"), F.lit(False)), F.col("payload_digest")).otherwise(broken)
    found = found.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")
    return plain.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")).unionByName(found)


def warc_round_trip(pages: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) to monolithic archives, normalise them, and read every record back by its offset.

    Returns page_id, payload_bytes, payload_digest, record_type and refers_to of every row. Null html is an empty payload, null url a
    record without target. Of rows with an equal payload of 100 bytes or more those of the smallest page_id are responses (all, where
    rows repeat it), others revisits; a null page_id counts as greater than any, and rows that have no other are all responses. An
    empty table gives archives without pages, and no row. Very long pages are single records. Other columns, whatever
    their names, are ignored.
    """
    base = folder or f"{shared_dir(pages.sparkSession)}/heddle-warc-{uuid.uuid4().hex}"
    if "://" not in base:
        base = "file://" + base.removeprefix("file:")
    written = staged(write_archives(pages, f"{base}/whole", archive_bytes=archive_bytes), "archives")
    normal = staged(normalise_archives(written, f"{base}/members"), "members")
    return resolve(staged(read_archives(normal), "records"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, sha256(html) AS digest FROM p),
g AS (SELECT *, min(page_id) OVER (PARTITION BY digest, n) AS first FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM g"""
