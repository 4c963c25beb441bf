"""Removal of repeated byte strings against brute force."""

import hashlib
import random
from collections import Counter

import pytest

from heddle.llm import suffix_dedup


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(r, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def cases():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, base = prose(70), prose(150)
    texts = [None, "", "short", passage, passage, prose(10) + passage[:250] + prose(10), prose(30) + passage + prose(30) + passage]
    texts += ["a" * 199, "a" * 200, "a" * 201, "ab" * 300, "x" + "ab" * 150, "z" * 1000, "a" * 450]
    texts += ["q" + passage[3:202], passage[3:203] + "q", passage[10:211]]
    for _ in range(25):
        words = base.split(" ")
        for _ in range(rnd.randint(0, 4)):
            words[rnd.randrange(len(words))] = word()
        texts.append(" ".join(words))
    texts += [prose(200) for _ in range(5)]
    return texts


@pytest.mark.parametrize("hot", [5000, 2])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_SPANS", hot)
    texts = cases()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, n_bytes string, lo int")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(docs).collect()}
    want = brute(texts, 200)
    assert [got[i] for i in range(len(texts))] == want


def test_repeated_rows_and_empty_table(spark):
    text = "".join(random.Random(1).choice("abcdefgh") for _ in range(300))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text + "!")], "doc_id long, text string")
    got = suffix_dedup.remove_repeats(docs).collect()
    assert sorted(r["n_removed"] for r in got) == [300, 300, 300]
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0
