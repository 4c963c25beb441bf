"""SetSketch near-duplicates and components against brute force."""

import random

import numpy as np

from heddle.llm import setsketch
from heddle.llm._common import shingle_sets
from heddle.llm.components import components


def sets_of(text, k):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    if len(words) < k:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(texts, k, percent):
    sets = [sets_of(t, k) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return [(len(s), c) for s, c in zip(sets, label, strict=True)]


def cases():
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgÉÄ") for _ in range(rnd.randint(2, 7)))
    texts = [None, "", "  \n\t", "one", "One", "one two", "ONE\ttwo", "one two three", "one two three one two three"]
    for size in (8, 60, 300):
        base = [word() for _ in range(size)]
        for _ in range(30):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, size // 12))):
                w[rnd.randrange(size)] = word()
            texts.append(" ".join(w))
        texts += [" ".join(base)] * 5
    texts += [" ".join(word() for _ in range(50)) for _ in range(20)]
    rnd.shuffle(texts)
    return texts


def test_against_brute_force(spark):
    texts = cases()
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, u int")
    got = {r["doc_id"]: r for r in setsketch.near_duplicates(docs, k=3, percent=85).collect()}
    want = brute(texts, 3, 85)
    assert [(got[i]["n_shingles"], got[i]["component_id"]) for i in range(len(texts))] == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.values())


def test_empty_table_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (3, "a b c d")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in setsketch.near_duplicates(docs, k=3).collect())
    assert got == [("3", 3, True), ("3", 3, True), ("None", None, True)]
    assert setsketch.near_duplicates(docs.limit(0)).count() == 0


def test_repeated_ids_lose_no_link(spark):
    words = [f"w{i}" for i in range(100)]
    a, b = " ".join(words), " ".join(x[::-1] for x in words)
    rows = [(1, a), (2, b), (2, a + " x"), (3, b + " y"), (4, "z " * 200_000)]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame([(*r, 1, "t") for r in order], "doc_id long, text string, th int, rep string")
        got = sorted((r["doc_id"], r["component_id"]) for r in setsketch.near_duplicates(docs, k=3, percent=85).collect())
        assert got == [(1, 1), (2, 1), (2, 2), (3, 2), (4, 4)]
        kept = setsketch.drop_near_duplicates(docs, k=3, percent=85)
        assert kept.columns == docs.columns and sorted((r["doc_id"], r["text"] == b) for r in kept.collect()) == [(1, False), (2, True), (4, False)]
    twice = spark.createDataFrame([(1, a), (1, a), (5, None), (5, None), (None, a)], "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in setsketch.drop_near_duplicates(twice).collect()) == ["1", "5", "5", "None"]
    assert setsketch.drop_near_duplicates(twice.limit(0)).count() == 0


def test_likelihood_follows_similarity():
    rnd = np.random.default_rng(1)
    for overlap in (0, 300, 500, 850):
        both = np.unique(rnd.integers(0, 2**63, overlap).astype(np.uint64))
        a, b = (np.unique(np.concatenate([both, rnd.integers(0, 2**63, 1000 - overlap).astype(np.uint64)])) for _ in range(2))
        regs = setsketch.registers(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        j = setsketch.likely_similarity(regs[:1], regs[1:], np.array([float(len(a))]), np.array([float(len(b))]))[0]
        assert abs(j - overlap / (2000 - overlap)) < 0.15


def test_registers_of_a_union_are_the_larger_ones():
    rnd = np.random.default_rng(2)
    a, b = (np.unique(rnd.integers(0, 2**63, 50).astype(np.uint64)) for _ in range(2))
    whole = np.unique(np.concatenate([a, b]))
    one = setsketch.registers(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
    assert (one.max(0) == setsketch.registers(whole, np.array([0, len(whole)]))[0]).all()


def test_shingles_of_short_texts():
    data = np.frombuffer(b"a bone\ttwo  three", np.uint8)
    _, at = shingle_sets(data, np.array([0, 3, 17, 17]), 3)
    assert np.diff(at).tolist() == [1, 1, 0]


def test_components_of_a_path(spark):
    n = 60
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (101, 100), (7, 7)], "u long, v long")
    got = {r["id"]: r["component_id"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 100: 100, 101: 100}
