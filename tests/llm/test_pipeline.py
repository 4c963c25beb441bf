"""The corpus pipeline against a brute-force version of its stages."""

import random

from test_near_duplicates import brute as near_brute
from test_text_operators import WORD_BPE, base_of

import corpus_pipeline
from heddle.llm import packing, surrogates


def corpus():
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghijkl") for _ in range(rnd.randint(3, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, base = prose(60), prose(200).split(" ")
    texts = [None, "", "too short", "again and again " * 40]
    texts += [prose(100) for _ in range(6)] + [prose(60) + " " + passage + " " + prose(60) for _ in range(3)]
    for k in range(5):
        w = list(base)
        w[10 * k] = "changed"
        texts.append(" ".join(w))
    texts += [prose(80) + " mail a.b7@mail3.example.com and 97.51.17.173", prose(80) + " a.b7@mail3.example.com", "\n".join(prose(30) for _ in range(4))]
    return texts


def cut_repeats(texts, length=200):
    raws = [t.encode() for t in texts]
    seen = {}
    for r in raws:
        for i in range(len(r) - length + 1):
            seen[r[i : i + length]] = seen.get(r[i : i + length], 0) + 1
    out = []
    for r in raws:
        gone = set()
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone.update(range(i, i + length))
        out.append(bytes(c for i, c in enumerate(r) if i not in gone).decode(errors="ignore"))
    return out


def test_pipeline_against_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    texts = corpus()
    rows = [(i, t, "en", "s0", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs, columns = spark.read.parquet(f"{tmp_path}/documents.parquet"), ["doc_id", "text", "lang", "source", "n_chars"]
    for _, stage in corpus_pipeline.STAGES[:2]:
        assert stage(spark, docs, str(tmp_path)).columns == columns
    got: dict[int, int] = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["n_tokens"]

    left = {i: t for i, t in enumerate(texts) if base_of(t)[0] >= 50 and 100 * base_of(t)[4] <= 50 * base_of(t)[0]}
    ids = sorted(left)
    keep = [i for k, (i, (_, c)) in enumerate(zip(ids, near_brute([left[i] for i in ids], 5, 80), strict=True)) if c == k]
    assert len(keep) == len(ids) - 4
    cut = dict(zip(keep, cut_repeats([left[i] for i in keep]), strict=True))
    tokenizer, want = Tokenizer.from_file(WORD_BPE), {}
    for i, t in cut.items():
        for start, stop, kind, entity in reversed(surrogates.found(t)):
            t = t[:start] + surrogates.dressed(kind, t[start:stop], surrogates.surrogate(kind, entity, surrogates.DEFAULT_KEY)) + t[stop:]
        want[i] = len(tokenizer.encode(t, add_special_tokens=False).ids) + 1
    assert got == want
    assert max(packing.CAPACITIES) == 8192


def test_pipeline_of_no_and_repeated_rows_and_clashing_columns(spark, tmp_path):
    """An empty table gives no row; rows that repeat an id and a text are one document after near-duplicates; columns named like the stages' own
    stay with their rows."""
    rnd = random.Random(9)
    prose = lambda n: " ".join("".join(rnd.choice("abcdefghijkl") for _ in range(rnd.randint(3, 8))) for _ in range(n))
    long = prose(12_000)
    rows = [(1, prose(90), "en", "s0", 1, "a", 5, True), (2, long, "en", None, 2, "b", 6, None), (None, prose(70), None, "s1", 3, "c", 7, False)]
    rows += rows[:2]
    schema = "doc_id long, text string, lang string, source string, n_chars long, spans string, component_id int, kept boolean"
    for name, part in (("some", rows), ("none", [])):
        spark.createDataFrame(part, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    docs = spark.read.parquet(f"{tmp_path}/some/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, f"{tmp_path}/some")
        assert docs.columns == [c.split(" ")[0] for c in schema.split(", ")]
    got = {r["doc_id"]: r for r in docs.collect()}
    assert sorted(got, key=str) == [1, 2, None] and docs.count() == 3
    assert [got[i]["spans"] for i in (1, 2, None)] == ["a", "b", "c"] and got[2]["text"] == long and got[2]["n_chars"] == len(long) and got[1]["kept"] is True
