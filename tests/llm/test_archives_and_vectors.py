"""WARC archives, hard negatives and centroid clusters against plain Python and numpy."""

import gzip
import hashlib
import io
import json
import zlib
from math import floor

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.llm import centroids, hard_negatives, skew, warc

LONG = "long page " * 60_000
PAGES = [
    (7, "http://a/1", "x" * 100), (3, "http://a/2", "x" * 100), (9, None, "x" * 100), (3, "http://a/again", "x" * 100), (None, "http://a/none", "x" * 100),
    (1, "http://a/line\r\nWARC-Type: revisit", "short"), (2, "", "short"), (4, "http://ä/ü", None), (5, "u", ""), (6, "u", "é🙂\r\n\r\nWARC/1.1\r\n" * 30), (8, "u", "é🙂\r\n\r\nWARC/1.1\r\n" * 30),
    (None, "u", "y" * 200), (10, "u", LONG), (12, "u", LONG + "."), (11, "u", LONG),
]


def pages_of(spark, rows):
    """A table whose other columns bear the names that the operator uses inside."""
    return spark.createDataFrame([(*r, 1, "z") for r in rows], "page_id long, url string, html string, first int, digest string")


def expected(rows):
    out = []
    for page_id, _, html in rows:
        payload = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == payload and p is not None]
        again = len(payload) >= 100 and bool(same) and page_id != min(same)
        out.append((page_id, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if again else "response", min(same) if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("archive_bytes", [1, 64 << 20])
def test_pages_survive_archives(spark, archive_bytes):
    got = warc.warc_round_trip(pages_of(spark, PAGES), archive_bytes=archive_bytes)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.collect()), key=str) == expected(PAGES)
    assert warc.warc_round_trip(pages_of(spark, []).limit(0)).count() == 0


def test_payloads_are_read_by_offset(spark, tmp_path):
    written = warc.write_archives(pages_of(spark, PAGES).coalesce(1), f"file://{tmp_path}/whole")
    whole = [r["path"].removeprefix("file://") for r in written.collect()]
    raw = open(whole[0], "rb").read()
    one = zlib.decompressobj(31)
    text = one.decompress(raw)
    assert len(whole) == 1 and one.eof and not one.unused_data and text.count(b"WARC-Type: response") + text.count(b"WARC-Type: revisit") >= len(PAGES)
    normal = warc.normalise_archives(spark.createDataFrame([(f"file://{whole[0]}",)], "path string"), f"file://{tmp_path}/members").collect()
    assert normal[0]["records"] == len(PAGES) + 1
    index = [json.loads(x) for x in open(normal[0]["index"].removeprefix("file://"))]
    members = open(normal[0]["path"].removeprefix("file://"), "rb").read()
    assert sum(e["length"] for e in index) == len(members)
    parts = [gzip.decompress(members[e["offset"] : e["offset"] + e["length"]]) for e in reversed(index)]
    assert b"".join(reversed(parts)) == text
    assert all(p.startswith(b"WARC/1.1\r\n") and p.endswith(b"\r\n\r\n") for p in parts)
    back = warc.read_archives(spark.createDataFrame(normal), payload=True).where("record_type = 'response'").collect()
    assert {r["page_id"]: bytes(r["payload"]).decode() for r in back if r["page_id"] in (1, 6, 10)} == {1: "short", 6: PAGES[9][2], 10: LONG}


@pytest.mark.parametrize("chunk", [1, 7, 5000])
def test_normaliser_reads_any_gzip(chunk, monkeypatch):
    monkeypatch.setattr(warc, "WINDOW", chunk)
    monkeypatch.setattr(warc, "HEAD", chunk)
    bodies = [b"", b"a", b"\r\n\r\n" * 9, bytes(range(256)) * 40]
    records = [b"".join(warc.record("resource", f"urn:x:{i}", "1970-01-01T00:00:00Z", b, X_Page_ID=str(i))) for i, b in enumerate(bodies)]
    for packed in (gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records)), gzip.compress(b"".join(records[:2])) + gzip.compress(b"".join(records[2:]))):
        out, index = io.BytesIO(), io.BytesIO()
        assert warc.normalise(io.BytesIO(packed), out, index) == len(bodies)
        entries = [json.loads(x) for x in index.getvalue().splitlines()]
        assert [warc.read_record(out, e["offset"], e["length"])[1] for e in entries] == bodies
        with pytest.raises(ValueError):
            warc.normalise(io.BytesIO(packed[:-12]), io.BytesIO(), io.BytesIO())
    with pytest.raises(ValueError):
        warc.normalise(io.BytesIO(gzip.compress(b"".join(records)[:-400])), io.BytesIO(), io.BytesIO())
    assert warc.normalise(io.BytesIO(b""), io.BytesIO(), io.BytesIO()) == 0


def test_a_revisit_without_its_record_raises(spark):
    rows = warc.read_archives(warc.normalise_archives(warc.write_archives(pages_of(spark, PAGES), (base := f"{spark.conf.get('spark.checkpoint.dir')}/lost") + "/a"), base + "/b"))
    with pytest.raises(Exception, match="refers to no record"):
        warc.resolve(rows.where("not (record_type = 'response' and page_id = 3)")).collect()


def test_joins_of_hot_keys_keep_all_rows(spark):
    rows = spark.createDataFrame([("hot" if i % 3 else f"k{i % 40}", i) for i in range(3000)] + [(None, -1), ("unknown", -2)], "key string, v long")
    table = rows.where("key is not null and key <> 'unknown'").groupBy("key").agg(F.count("*").alias("n"), F.min("v").alias("least"))
    plain = lambda how: sorted(map(tuple, rows.join(table.drop("n"), "key", how).collect()), key=str)
    for how in ("inner", "left"):
        for total in (3002, 30_000_000, 10):
            assert sorted(map(tuple, skew.spread_join(rows, table, "key", "n", total, how).collect()), key=str) == plain(how)


def vectors_of(spark, rows):
    return spark.createDataFrame([(*r, 5, "z") for r in rows], "vec_id long, embedding array<float>, label int, rid int, q string")


def random_vectors(n, width, seed, labels=4):
    rnd = np.random.default_rng(seed)
    base = rnd.standard_normal((5, width))
    rows = [(i, [float(np.float32(x)) for x in base[i % 5] * 0.2 + rnd.standard_normal(width) * 0.15], int(rnd.integers(labels))) for i in range(n)]
    for i in range(3, n, 11):  # exact copies: ties
        rows[i] = (i, rows[i - 2][1], int(rnd.integers(labels)))
    return rows


@pytest.mark.parametrize("width,size,kind", [(64, 100, np.int32), (13, 3, np.int32), (8, 1 << 22, np.int64), (1, 1, np.int32), (0, 1, np.int32)])
def test_lookups_give_inner_products(width, size, kind):
    rnd = np.random.default_rng(3)
    a, c = rnd.integers(-size, size + 1, (9, width)), rnd.integers(-size, size + 1, (70, width))
    got = hard_negatives.scores(a, hard_negatives.bit_planes(c))
    assert got.dtype == kind and (got == c @ a.T).all()
    with pytest.raises(OverflowError):
        hard_negatives.scores(np.full((1, 4), 1 << 40), hard_negatives.bit_planes(np.full((1, 4), 1 << 20)))


def mined(rows, anchor, relabel):
    kept = []
    for i, e, label in rows:
        if i is not None and label is not None and e is not None and all(x is not None and np.isfinite(x) for x in e):
            kept.append((i, tuple(floor(256 * x) for x in e), relabel(i, label)))
    out = []
    for k, (i, q, label) in enumerate(kept):
        if not anchor(i):
            continue
        rated = sorted(((-sum(x * y for x, y in zip(q, r, strict=True)), j, m) for n, (j, r, m) in enumerate(kept) if n != k and len(r) == len(q)), key=lambda t: t[:2])
        for p, pid, _ in [t for t in rated if t[2] == label][:5]:
            fit = [(j, -s) for s, j, m in rated if m != label and 50 * -p <= 100 * -s <= 95 * -p][:3]
            out += [(i, pid, n, j, -p, s) for n, (j, s) in enumerate(fit, 1)]
    return sorted(out)


ODD = [(1000, None, 1), (1001, [1.0, None] * 32, 1), (1002, [float("nan")] * 64, 2), (1003, [float("inf")] * 64, 2), (1004, [0.5] * 64, None), (None, [0.5] * 64, 1), (1050, [0.1] * 3, 1), (1051, [0.1, 0.2, 0.1], 1), (1052, [0.1, 0.0, 0.1], 2), (1100, [], 1), (1101, [], 1), (1102, [], 3), (1150, [0.0] * 64, 1)]


@pytest.mark.parametrize("blocks", [(4096, 8192, 256), (3, 17, 2)])
def test_hard_negatives(spark, monkeypatch, blocks):
    for name, size in zip(("ANCHOR_BLOCK", "ROW_BLOCK", "TABLES"), blocks, strict=True):
        monkeypatch.setattr(hard_negatives, name, size)
    rows = random_vectors(300, 64, 1) + ODD
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 4).otherwise(F.col("label"))
    got = hard_negatives.hard_negatives(vectors_of(spark, rows), F.col("vec_id") % 25 == 0, label)
    want = mined(rows, lambda i: i % 25 == 0, lambda i, m: (m + 1) % 4 if i % 7 == 0 else m)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 30


def test_hard_negatives_of_repeated_rows_and_small_tables(spark):
    rows = random_vectors(40, 64, 2, labels=2)
    rows += rows[:12]
    got = hard_negatives.hard_negatives(vectors_of(spark, rows), F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == mined(rows, lambda i: i % 10 == 0, lambda i, m: m)
    one = vectors_of(spark, rows[:1])
    assert hard_negatives.hard_negatives(one, F.col("vec_id") % 10 == 0).count() == 0
    assert hard_negatives.hard_negatives(one, F.col("vec_id") < 0).count() == 0
    assert hard_negatives.hard_negatives(one.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def clustered(rows, k=16, rounds=3):
    kept = [(i, [floor(64 * x) for x in e]) for i, e, _ in rows if e is not None and len(e) == 64 and all(x is not None and np.isfinite(x) for x in e)]
    starts = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), np.array(q, "<i8").tobytes(), q) for i, q in kept if i is not None)[:k]
    cents = [s[2] for s in starts]
    near = lambda q: min((sum((x - y) ** 2 for x, y in zip(q, c, strict=True)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        of = [near(q)[1] for _, q in kept]
        for j in range(len(cents)):
            mine = [q for (_, q), c in zip(kept, of, strict=True) if c == j]
            if mine:
                cents[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    last = [near(q) for _, q in kept]
    total = sum(d for d, _ in last)
    sums = {j: sum(d for d, c in last if c == j) for j in range(len(cents))}
    return sorted(((i, j, d, sums[j], total, hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, last, strict=True)), key=str)


@pytest.mark.parametrize("pivots", [1, 2, 12, 40])
def test_clusters(spark, pivots):
    rows = random_vectors(200, 64, 4) + ODD
    rows += rows[:20]
    got = centroids.centroid_clusters(vectors_of(spark, rows), pivots=pivots)
    assert sorted(map(tuple, got.collect()), key=str) == clustered(rows)


def test_clusters_of_few_equal_and_no_vectors(spark):
    same = [(i, [0.25] * 64, 1) for i in range(30)]
    assert sorted(map(tuple, centroids.centroid_clusters(vectors_of(spark, same)).collect()), key=str) == clustered(same)
    few = random_vectors(5, 64, 6)
    assert sorted(map(tuple, centroids.centroid_clusters(vectors_of(spark, few)).collect()), key=str) == clustered(few)
    for none in (vectors_of(spark, few).limit(0), vectors_of(spark, ODD[:4]), vectors_of(spark, [(None, [0.5] * 64, 1)])):
        assert centroids.centroid_clusters(none).count() == 0
    with pytest.raises(Exception, match="too large"):
        centroids.centroid_clusters(vectors_of(spark, [(1, [1e30] * 64, 1)])).count()


def test_bounds_hold_and_leave_centroids_out():
    rnd = np.random.default_rng(8)
    middles = rnd.integers(-60, 60, (16, 64))
    rows = middles[rnd.integers(0, 16, 500)] + rnd.integers(-9, 10, (500, 64))
    rows[:16] = middles
    for pivots in (1, 3, 12, 16):
        simplex = centroids.Simplex(middles, pivots)
        assert len(simplex.pivots) == pivots
        low, high = centroids.bounds(simplex.apices(rows), simplex.apices(middles))
        exact = np.sqrt(centroids.squared_distances(rows, middles))
        assert (low <= exact).all() and (exact <= high).all()
        best, least, computed = centroids.nearest(rows, simplex.apices(rows), middles, simplex)
        assert (best == exact.argmin(1)).all() and (least == (exact.min(1) ** 2).round()).all()
        assert pivots < 12 or computed < 16 * len(rows) / 4
