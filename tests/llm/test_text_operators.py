"""License scans, surrogates, SentencePiece codec, token files, packing, quality rules, HTML and vectors."""

import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.llm import bpe, embedding_dedup, license_scan, packing, quality, sentencepieces, surrogates, token_output, wrappers

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD_BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "Hello  world", "\n\nA\n b", "tab\tand\x1codd\x85spaces", "été naïve ﬁ ①", "日本語のテキスト", "🙂 x", "don't we'll <|endoftext|> it", "a" * 300, "▁ under", " " * 40 + "x", "é combining", "0123 4567", "The quick brown fox. " * 30]


def docs_of(spark, texts, extra="x int"):
    return spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], f"doc_id long, text string, {extra}")


def test_word_encoder_equals_the_library():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(WORD_BPE)
    enc = bpe.WordEncoder(WORD_BPE, max_words=5)
    rnd = random.Random(5)
    odd = list("abcXYZéÉİßΣςσ'’.,;<|>#% \t\n\x1c\x85\xa0ǅ१٣Ⅷ²é≠한글中") + ["'s", "<|endoftext|>", "'re", "’s", "ЖЩж", "\u0338", "\u0301"]
    fuzz = ["".join(rnd.choice(odd[:34] + odd[-4:]) for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    fuzz += ["".join(rnd.choice(odd) for _ in range(rnd.randint(0, 40))) for _ in range(1000)]
    for texts in (TEXTS[:8], TEXTS[8:], TEXTS, fuzz, ["x" * 100_000 + ". Y", None]):
        ids, at = enc.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert enc.counts(texts).tolist() == np.diff(at).tolist()


def test_pieces_equal_the_library():
    from sentencepiece import SentencePieceProcessor

    sp, codec, rnd = SentencePieceProcessor(model_file=PIECES), sentencepieces.Codec(PIECES), random.Random(2)
    texts = TEXTS + [" " * k + "word" for k in range(70)] + ["-" * k for k in range(50)]
    texts += ["".join(rnd.choice("abcdefghij XYZé,.\n ") for _ in range(rnd.randint(1, 80))) for _ in range(300)]
    ids, at = codec.encode(texts)
    got = [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
    assert got == [sp.encode(t or "") for t in texts]
    assert codec.decode(ids, at) == [sp.decode(x) for x in got]


def test_codec_frames(spark):
    docs = docs_of(spark, TEXTS)
    coded = sentencepieces.encode(docs, PIECES)
    assert coded.columns == ["doc_id", "text", "x", "ids"]
    back = {r["doc_id"]: r["text"] for r in sentencepieces.decode(coded, PIECES).collect()}
    trip = {r["doc_id"]: r for r in sentencepieces.round_trip(docs, PIECES).collect()}
    assert all(trip[i]["exact"] == (back[i] == (t or "")) for i, t in enumerate(TEXTS))
    assert sum(not r["exact"] for r in trip.values()) == 1  # a literal U+2581 reads back as a space
    assert sentencepieces.round_trip(docs.limit(0), PIECES).count() == 0


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(WORD_BPE)
    docs = docs_of(spark, TEXTS).repartition(3)
    manifest = token_output.write_token_files(docs, f"file://{tmp_path}/out", WORD_BPE, 2, files=3).collect()
    got = {r["doc_id"]: r for r in token_output.read_token_files(spark, manifest).collect()}
    before = 0
    for i, t in enumerate(TEXTS):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids"]) == (before, len(ids), ids)
        before += len(ids)
    digest = {r["doc_id"]: r["ids_crc32"] for r in token_output.token_digest(spark, manifest).collect()}
    assert all(digest[i] == zlib.crc32(struct.pack(f"<{len(got[i]['ids'])}I", *got[i]["ids"])) for i in got)
    wanted = spark.createDataFrame([(m["path"], 3) for m in manifest], "path string, doc_id long")
    assert [r["doc_id"] for r in token_output.read_token_files(spark, manifest, wanted).collect()] == [3]
    path = manifest[0]["path"].removeprefix("file://")
    raw = bytearray(open(path, "rb").read())
    raw[20] ^= 255
    open(path, "wb").write(raw)
    with open(path, "rb") as f, pytest.raises(Exception):
        reader = token_output.FrameReader(f)
        [reader[i] for i in range(len(reader))]
    assert token_output.token_output(docs.limit(0), WORD_BPE, folder=f"file://{tmp_path}/none").count() == 0


def test_frames_are_independent(tmp_path):
    rnd = np.random.default_rng(0)
    rows = [rnd.integers(0, 50000, rnd.integers(0, 900)).astype(np.uint32) for _ in range(60)]
    with open(tmp_path / "f.zst", "wb") as f:
        w = token_output.FrameWriter(f, frame_ids=1000)
        for i, r in enumerate(rows):
            w.add(None if i == 5 else i, r)
        w.close()
    with open(tmp_path / "f.zst", "rb") as f:
        r = token_output.FrameReader(f)
        assert len(r.frames) > 10 and all((r[i] == rows[i]).all() for i in (59, 0, 30))
        assert (r.find(7) == rows[7]).all()
        with pytest.raises(KeyError):
            r.find(5)


def test_packing_is_a_partition_without_overflow():
    rnd = np.random.default_rng(1)
    lengths = np.concatenate([rnd.integers(1, 8192, 300), np.full(200, 700), [8192, 1]])
    bins, offsets, caps = packing.pack(lengths)
    for b in range(len(caps)):
        inside = np.flatnonzero(bins == b)
        order = inside[np.argsort(offsets[inside])]
        assert (np.cumsum(lengths[order]) - lengths[order] == offsets[order]).all()
        used = lengths[inside].sum()
        assert used <= caps[b] and not any(used <= c < caps[b] for c in packing.CAPACITIES)
    assert lengths.sum() / caps.sum() > 0.9
    assert all(len(x) == 0 for x in packing.pack(np.zeros(0, np.int64)))


def cheapest(lengths, caps):
    """Least cost of any packing, by trying every partition."""

    def rest(k, bins):
        if k == len(lengths):
            return sum(packing.bin_cost(next(c for c in caps if c >= b)) for b in bins)
        out = rest(k + 1, [*bins, lengths[k]])
        for i, b in enumerate(bins):
            if b + lengths[k] <= caps[-1] and b not in bins[:i]:
                out = min(out, rest(k + 1, [*bins[:i], b + lengths[k], *bins[i + 1 :]]))
        return out

    return rest(0, [])


def test_packing_against_the_cheapest():
    rnd, ratios = random.Random(6), []
    for k in range(60):
        lengths = [rnd.choice([rnd.randint(1, 900), rnd.randint(1, 4000), rnd.randint(1, 8192), 1024, 2048]) for _ in range(rnd.randint(1, 7))]
        _, _, caps = packing.pack(np.array(lengths))
        ratios.append(packing.bin_cost(caps).sum() / cheapest(lengths, packing.CAPACITIES))
    assert min(ratios) >= 1 and np.mean(ratios) < 1.08 and max(ratios) < 1.6


def test_packing_weighs_all_sizes():
    # Pieces that fill bins of 1024 exactly need no larger ones where attention costs much; with none, fewer bins win.
    lengths = np.full(64, 1000)
    assert set(packing.pack(lengths, attention=1024)[2]) == {1024}
    assert set(packing.pack(lengths, attention=1 << 40)[2]) == {8192}
    # Pieces of 2,700 waste less in bins of 8,192 cut down than in bins of 4,096.
    assert set(packing.pack(np.full(39, 2700))[2]) == {8192}


def test_packing_frames(spark):
    rows = spark.createDataFrame([(1, 20000), (2, 5), (2, 5), (None, 9), (3, 0), (4, None)], "doc_id long, n_tokens long")
    got = packing.best_fit(rows).collect()
    assert sorted((str(r["doc_id"]), r["piece"], r["n_tokens"]) for r in got) == [("1", 0, 8192), ("1", 1, 8192), ("1", 2, 3616), ("2", 0, 5), ("2", 0, 5), ("None", 0, 9)]
    assert packing.best_fit(rows.limit(0)).count() == 0


def test_licenses(spark):
    gpl = license_scan.TEMPLATES[5][1]
    texts = [None, "", "two words", "x " * 40 + "Released under the MIT License.", gpl.upper() + " tail", "released the under mit license", "Licensed under CC BY-NC 4.0. " * 2]
    got = sorted((r["doc_id"], r["license"]) for r in license_scan.license_scan(docs_of(spark, texts, "license int")).collect())
    assert got == [(3, "MIT"), (4, "GPL-3.0"), (6, "CC-BY-NC-4.0")]


def test_surrogates_keep_format_and_coreference(spark):
    texts = [None, "", "Call +1 (017) 555-7713 or mail Und.34@mail7.example.com, und.34@mail7.example.com", "ip 97.51.17.173, card 4111 1111 1111 1111 and 4111111111111112", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "Frau Anna Weber met Mr. JOHN SMITH and Г. Анна Иванова", "no data here", "again 97.51.17.173"]
    got = {r["doc_id"]: r for r in surrogates.replace_entities(docs_of(spark, texts, "spans int"), with_spans=True).collect()}
    assert got[0]["text"] == "" and got[6]["text"] == texts[6] and not got[6]["spans"]
    mails = re.findall(r"[\w.]+@\w{5}\.example\.com", got[2]["text"].lower())
    assert len(mails) == 2 and mails[0] == mails[1] != "und.34@mail7.example.com"
    phone = re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", got[2]["text"])
    assert phone and phone[0] not in texts[2]
    cards = re.findall(r"\d{4} \d{4} \d{4} \d{4}|\d{16}", got[3]["text"])
    valid = [surrogates._luhn([int(c) for c in re.sub(r"\D", "", x)]) == 0 for x in cards]
    assert valid == [True, False]
    assert [s["surrogate"] for s in got[7]["spans"]] == [got[3]["spans"][0]["surrogate"]] != ["97.51.17.173"]
    assert re.search(r'token = "[0-9a-f]{40}"', got[4]["text"]) and "04dbeb" not in got[4]["text"]
    assert "Weber" not in got[5]["text"] and "JOHN" not in got[5]["text"] and "Анна" not in got[5]["text"]
    first = got[5]["spans"][0]["surrogate"]
    assert first.split("-")[0] in surrogates.GIVEN["latin", "f"]
    for r in got.values():
        for s in r["spans"]:
            assert r["text"][s["start"] : s["stop"]] == s["surrogate"]


def test_surrogates_stay_distinct(spark):
    many = spark.createDataFrame([("ssn", f"{i:03d}-00-0000") for i in range(40)] + [("family", f"name{i}") for i in range(200)], "kind string, entity string")
    got = surrogates.assign(many).collect()
    assert len({(r["kind"], r["surrogate"]) for r in got}) == 240
    assert not {r["surrogate"] for r in got} & {r["entity"] for r in got}


def test_surrogates_are_never_entities(spark):
    given = [n.lower() for names in surrogates.GIVEN.values() for n in names]
    rows = [("given", x) for x in given] + [("family", n.lower()) for names in surrogates.FAMILY.values() for n in names]
    # A class whose every address occurs, and a secret that has no letter or digit to draw.
    rows += [("ipv4", f"192.168.{a}.{b}") for a in range(10) for b in range(10)] + [("secret", "========"), ("email", "a@b.example.com")]
    got = surrogates.assign(spark.createDataFrame(rows, "kind string, entity string")).collect()
    plain = str.lower
    made = {(r["kind"], plain(r["surrogate"])) for r in got}
    assert len(got) == len(made) == len(rows)
    assert not made & {(k, plain(e)) for k, e in rows}
    assert all(r["surrogate"].startswith("192.168.") for r in got if r["kind"] == "ipv4")


def test_every_mention_of_a_person_is_replaced(spark):
    texts = [
        "Anna Weber met us. Then Weber spoke; ANNA WEBER signed, and Anna's friend saw Weber-Stiftung and webern.", "Yesterday Mr O'Neil came with Mrs. de la Cruz. O'Neil left, Cruz stayed, DE LA CRUZ too.",
        "Anna Smith-Jones wrote. Later Jones and SMITH-JONES answered; anna smith did not.", "Dr. Andrea Costa and Mr. Andrea Costa", "Prof. Andrea Costa again", "No Weber here, but Costa Rica.", "Weber said: Frau Weber is in.",
    ]
    got = [r["text"] for r in surrogates.replace_entities(docs_of(spark, texts)).orderBy("doc_id").collect()]
    for text, names in zip(got, (["anna", "weber"], ["neil", "cruz"], ["anna", "smith", "jones"], ["andrea", "costa"], ["andrea", "costa"], [], ["weber"]), strict=True):
        assert not [n for n in names if re.search(rf"(?i)\b{n}\b", text)], text
    words = lambda i: re.findall(r"[^\W\d_]+", got[i])
    one = words(0)
    first, last = one[0], one[1]
    assert got[0] == f"{first} {last} met us. Then {last} spoke; {first.upper()} {last.upper()} signed, and {first}'s friend saw {last}-Stiftung and webern."
    neil, cruz = words(1)[3], words(1)[9]
    assert got[1] == f"Yesterday Mr O'{neil} came with Mrs. de la {cruz}. O'{neil} left, {cruz} stayed, DE LA {cruz.upper()} too."
    smith, jones = words(2)[1:3]
    assert got[2] == f"{first} {smith}-{jones} wrote. Later {jones} and {smith.upper()}-{jones.upper()} answered; {first.lower()} {smith.lower()} did not."
    andrea, costa = words(3)[1:3]
    assert got[3] == f"Dr. {andrea} {costa} and Mr. {andrea} {costa}" and got[4] == f"Prof. {andrea} {costa} again" and andrea in surrogates.GIVEN["latin", "m"]
    assert got[5] == texts[5] and got[6] == f"{last} said: Frau {last} is in."


def test_names_of_one_part_suffice_for_many(spark):
    many = spark.range(5000).select(F.lit("family").alias("kind"), F.concat(F.lit("realname"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("entity"))
    got = [r["surrogate"] for r in surrogates.assign(many).collect()]
    assert len(set(got)) == 5000 and all(x.isalpha() and x.istitle() for x in got)


def test_surrogates_of_no_and_repeated_rows(spark):
    docs = docs_of(spark, ["Frau Weber, Weber", None, "Frau Weber, Weber"] + ["pad " * 60_000 + "Herr Berg. " + "BERG " * 3])
    assert surrogates.replace_entities(docs.limit(0)).count() == 0
    got = [r["text"] for r in surrogates.surrogate_digest(docs.unionByName(docs)).orderBy("doc_id").collect()]
    assert got[0] == got[1] == got[4] and "Weber" not in got[0] and got[2] == "" and not re.search("(?i)berg", got[6])


def test_surrogates_raise_where_a_class_is_exhausted(spark, monkeypatch):
    monkeypatch.setattr(surrogates, "PATIENCE", 1)
    monkeypatch.setattr(surrogates, "surrogate", lambda kind, entity, key, attempt=0, gender="": entity)
    with pytest.raises(ValueError):
        surrogates.assign(spark.createDataFrame([("ssn", "123-45-6789")], "kind string, entity string"), rounds=2)


def test_prefilter_keeps_every_text_with_an_entity(spark):
    rnd = random.Random(12)
    bits = ["phone ٠١٢-٣٤٥-٦٧٨٩", "token =\u00a0abcdefghij", "ſecret: abcdefgh12", "PASSWD='xxxxxxxx1'", "Frau Weber", "Dr. Who", "Señora Ruiz", "Анна Иванова", "Γιώργος Παπαδόπουλος", "xAnna Berg", "a@b.org", "10.1.2.3", "Don ", "abc", "Mary had", "api_Key: 12345678"]
    texts = bits + [" ".join(rnd.choice(bits) for _ in range(rnd.randint(1, 3))) for _ in range(100)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t").withColumn("seen", F.col("t").rlike(surrogates._PREFILTER)).collect()
    assert all(r["seen"] for r in rows if surrogates.found(r["t"]))
    assert not any(r["seen"] for r in rows if r["t"] == "abc")


def test_surrogates_against_brute_force(spark):
    given = sorted(n for names in surrogates.GIVEN.values() for n in names)
    rnd = random.Random(13)
    texts = [f"{rnd.choice(given)} {rnd.choice(['Weber', 'Berg', 'Иванов', 'Иванова', 'Γεωργίου'])} wrote to u{i % 7}.x@mail.org from 192.168.0.{i % 10} on 555-0{i:03d}" for i in range(60)] + [None, "", "nothing"] + ["x " * 50_000 + "Frau Weber"]
    key = b"k"
    names = {(e[2], e[3]) for t in texts for e in surrogates.found(t or "")}
    taken, chosen, attempts = {(k, surrogates._form(k, e)) for k, e in names}, {}, {e: 0 for e in names}
    while True:
        made = {e: surrogates.surrogate(*e, key, attempts[e]) for e in names}
        by_form = {}
        for e in sorted(names):
            by_form.setdefault((e[0], surrogates._form(e[0], made[e])), []).append(e)
        again = [e for form, es in by_form.items() for e in es if form in taken or e != min(es, key=lambda x: (attempts[x], x[1]))]
        if not again:
            chosen = made
            break
        for e in again:
            attempts[e] += 1
    want = []
    for t in texts:
        t = t or ""
        for start, stop, kind, entity in reversed(surrogates.found(t)):
            t = t[:start] + surrogates.dressed(kind, t[start:stop], chosen[kind, entity]) + t[stop:]
        want.append(t)
    got = {r["doc_id"]: r for r in surrogates.replace_entities(docs_of(spark, texts, "spans int"), key).collect()}
    assert [got[i]["text"] for i in range(len(texts))] == want and got[0]["spans"] == 1
    assert not any(f"{a} " in got[i]["text"][:12] for i, t in enumerate(texts[:60]) for a in [t.split(" ")[0]])
    assert any("Weber" not in x for x in want) and surrogates.surrogate("family", "иванова", key).endswith("а")
    digest = {r["doc_id"]: r["text"] for r in surrogates.surrogate_digest(docs_of(spark, texts), key).collect()}
    assert digest == {i: w for i, w in enumerate(want)}


def base_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = {}
    for i, g in enumerate(grams):
        seen.setdefault(g, []).append(i)
    hit = {i + o for at in seen.values() if len(at) > 1 for i in at for o in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit))


def test_quality_base_and_lines(spark):
    rnd = random.Random(4)
    prose = lambda n: " ".join("".join(rnd.choice("abcdeé") for _ in range(5)) for _ in range(n))
    banner = prose(20)
    texts = [None, "", "\n \n", "a b a b a b a b", "x\nx\ny\n \nx", "## | <b>\x0bé é é"] + [banner + "\n" + prose(60) for _ in range(8)] + [banner + "\n" + banner + "\n" + banner + "\n" + prose(8 + i) for i in range(8)]
    copy = "\n".join(prose(30) for _ in range(3))
    texts += [copy] * 9
    docs = docs_of(spark, texts).withColumnRenamed("x", "source")
    got = {r["doc_id"]: r for r in quality.quality_rules(docs, max_documents=6, fold_copies=True).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base_of(t), t
    assert [got[i]["kept"] for i in range(6, 14)] == [True] * 8 and got[6]["n_left_words"] == 60
    assert not any(got[i]["kept"] for i in range(14, 22))
    assert all(got[i]["kept"] for i in range(22, 31))
    kept = {r["doc_id"]: r["text"] for r in quality.apply_quality(docs, max_documents=6, fold_copies=True).collect()}
    assert sorted(kept) == [*range(6, 14), *range(22, 31)] and banner not in kept[6] and kept[22] == copy
    assert quality.quality_rules(docs.limit(0)).count() == 0


def test_quality_leaves_columns_of_the_same_name(spark):
    long = "\n".join(" ".join(f"w{i}x{j}" for j in range(50)) for i in range(2000))
    docs = spark.createDataFrame([(1, long, "s", 80, "keep", True), (1, long, "s", 80, "keep", True), (None, None, None, 1, None, None)], "doc_id long, text string, source string, n_words int, base_failed string, kept boolean")
    got = quality.apply_quality(docs).collect()
    assert [(r["doc_id"], r["text"], r["n_words"], r["base_failed"], r["kept"]) for r in got] == [(1, long, 80, "keep", True)] * 2
    assert sorted((str(r["doc_id"]), r["n_words"]) for r in quality.quality_rules(docs).collect()) == [("1", 100000), ("1", 100000), ("None", 0)]
    assert quality.apply_quality(docs.limit(0)).count() == 0


def test_quality_counts_documents_that_share_most_lines(spark):
    rnd = random.Random(11)
    prose = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    common = [prose(12) for _ in range(12)]
    texts = ["\n".join([*common, prose(15), prose(15)]) for _ in range(40)]
    # Copies of one document, in any order of lines, count once.
    copy = [prose(30) for _ in range(3)]
    texts += ["\n".join(rnd.sample(copy, 3)) for _ in range(45)]
    docs = docs_of(spark, texts, "source int")
    got = {r["doc_id"]: r for r in quality.quality_rules(docs, max_documents=30, fold_copies=True).collect()}
    assert [(got[i]["n_left_words"], got[i]["kept"]) for i in range(40)] == [(30, False)] * 40
    assert [(got[i]["n_left_words"], got[i]["kept"]) for i in range(40, 85)] == [(90, True)] * 45
    assert sorted(r["doc_id"] for r in quality.apply_quality(docs, max_documents=30, fold_copies=True).collect()) == list(range(40, 85))
    # Counted plainly, copies are documents like others, and their lines go too.
    plain = {r["doc_id"]: r for r in quality.quality_rules(docs, max_documents=30).collect()}
    assert [(plain[i]["n_left_words"], plain[i]["kept"]) for i in range(85)] == [(30, False)] * 40 + [(0, False)] * 45
    assert quality.apply_quality(docs, max_documents=30).count() == 0
    # The limit is on distinct documents: 40 are not more than 40.
    assert all(r["kept"] for r in quality.quality_rules(docs, max_documents=40, fold_copies=True).collect())


PAGE = "<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><a href='/x'>menu {0}</a></nav><div class='ad'>buy {0}</div><article><h1>Head {0}</h1><p><b>Bold {0}.<br><p>Fish &amp;   chips\n{0} &eacute;</p><ul><li>one<li>two</ul></article><div id='comments'><p>nice {0}</p></div><footer>&copy; host</footer></body></html>"
PLAIN = "<html><body><div class='top'>Welcome to the host</div><div class='text'><p>Story {0}</p><p>More {0}</p></div><div class='end'>All of this is ours</div></body></html>"


def test_html(spark):
    rows = [(i, "http://a.org/%d" % i, PAGE.format(i)) for i in range(6)] + [(10 + i, "https://u@B.org:80/%d" % i, PLAIN.format(i)) for i in range(8)]
    rows += [(50, None, None), (51, "x", ""), (52, "x", "bare < text &lt; <p>and <i>it</i>alic"), (53, "http://a.org/0", rows[0][2])]
    got = {r["page_id"]: r for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3]["text"] == "Head 3\n\nBold 3.\n\nFish & chips 3 é\n\none\n\ntwo" == got[3]["text"].strip()
    assert got[53]["text"] == got[0]["text"] and got[3]["n_chars"] == len(got[3]["text"])
    assert got[12]["text"] == "Story 2\n\nMore 2"
    assert got[50]["text"] == got[51]["text"] == "" and got[52]["text"] == "bare < text <\n\nand italic"


def test_html_counts_decide_before_tags(spark):
    page = "<html><body class='page has-sidebar'><div class='lead'><p>Lead {0}</p></div><article><div class='article-header'><h1>Head {0}</h1></div><p>Story {0}</p>{1}<p>Share this text with a friend</p></article><div class='rest'><p>Rest {0}</p><p>All rights are ours</p></div></body></html>"
    rows = [(i, f"http://c.org/{i}", page.format(i, f"<ul><li>point {i}</li></ul>" * (i % 2))) for i in range(24)]
    # A section with few pages: its constant text is on all of the pages that hold the node, not on most of the host.
    side = "<html><body><section><p>Side {0}</p><h6>Part of our series</h6></section></body></html>"
    rows += [(100 + i, f"http://c.org/s{i}", side.format(i)) for i in range(6)]
    # A host with one page: counts say nothing there, so its article is what counts.
    rows.append((200, "http://d.org/", page.format(1, "")))
    got = {r["page_id"]: r["text"] for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[4] == "Lead 4\n\nHead 4\n\nStory 4\n\nRest 4"
    assert got[5] == "Lead 5\n\nHead 5\n\nStory 5\n\npoint 5\n\nRest 5"
    assert got[103] == "Side 3"
    assert got[200] == "Head 1\n\nStory 1\n\nShare this text with a friend"


def test_html_reference_trees_share_names():
    a, b = "<body><div class='x'><p>1</p></div></body>", "<body><div class='y'><p>1</p></div><div class='x'><p>2</p></div></body>"
    aligner, both, parsed = wrappers.Aligner(), [], [wrappers.parse(page) for page in (a, b)]
    outlines = tuple(wrappers.outline(order) for order, _ in parsed)
    for text, (_, blocks) in zip(outlines, parsed, strict=True):
        both.append(aligner.names("h", text, outlines)[blocks[-1][0].number])
    assert both[0] == both[1] != aligner.names("other", outlines[0], outlines)[parsed[0][1][-1][0].number]


def largest_match(a, b, x=0, y=0):
    """Simple tree matching by its textbook recursion."""
    if a.label[x] != b.label[y]:
        return 0
    p, q = list(a.children[x].values()), list(b.children[y].values())
    best = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
    for i in range(len(p)):
        for j in range(len(q)):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + largest_match(a, b, p[i], q[j]))
    return best[-1][-1] + 1


def test_tree_matching_against_the_recursion():
    rnd = random.Random(9)

    def page(depth):
        return "".join(f"<{t}>x{page(depth - 1) if depth else ''}</{t}>" for t in rnd.sample(["div", "ul", "h1", "pre", "table"], rnd.randint(0, 4)))

    for _ in range(60):
        a, b = (wrappers.Tree(wrappers.outline(wrappers.parse(page(3))[0])) for _ in range(2))
        pairs = wrappers.match(a, b)
        assert len(pairs) == largest_match(a, b)
        inner = dict(pairs)
        assert all(a.label[x] == b.label[y] and (x == 0 or inner[a.parent[x]] == b.parent[y]) for x, y in pairs)


def brute_html(rows, min_pages=5, share=0.5):
    """Extraction with plain loops: all outlines of a host aligned with the same references."""
    hosts, parsed = {}, {}
    for page_id, url, page in rows:
        order, blocks = wrappers.parse(page)
        parsed[page_id] = (url.split("/")[2], wrappers.outline(order), [(n.number, t, a) for n, t, a in blocks], page)
    for host, text, _, _ in parsed.values():
        hosts.setdefault(host, {}).setdefault(text, 0)
        hosts[host][text] += 1
    aligner, named = wrappers.Aligner(), {}
    for host, texts in hosts.items():
        classes = {}
        for t, n in texts.items():
            h = wrappers._hash(t)
            classes[h % 3] = max(classes.get(h % 3, (0, 0, "")), (n, h, t))
        refs = tuple(classes[k][2] for k in sorted(classes))
        named |= {(host, t): aligner.names(host, t, refs) for t in texts}
    pages_at, pages_with = {}, {}
    for host, text, blocks, page in parsed.values():
        for n, t, _ in blocks:
            pages_at.setdefault(named[host, text][n], set()).add(page)
            pages_with.setdefault((named[host, text][n], t), set()).add(page)
    out = {}
    for page_id, (host, text, blocks, _) in parsed.items():
        good = []
        for n, t, a in blocks:
            slot = named[host, text][n]
            some, all_ = len(pages_with[slot, t]), len(pages_at[slot])
            if not (some >= min_pages * (2 if a else 1) and all_ >= min_pages and some > share * all_):
                good.append((t, a, all_ >= min_pages))
        if any(a for _, a, _ in good):
            good = [x for x in good if x[1] or x[2]]
        out[page_id] = "\n\n".join(x[0] for x in good)
    return out


def test_html_against_brute_force(spark):
    rnd = random.Random(10)
    rows = []
    for i in range(150):
        host, own = rnd.choice("abc"), f"w{i} {rnd.random()}"
        parts = [f"<div class='lead'>Welcome to {host}</div>" if rnd.random() < 0.8 else "", f"<p>Teaser {own}</p>" if rnd.random() < 0.5 else ""]
        body = "".join(f"<p>Par {k} {own}</p>" for k in range(rnd.randint(1, 4))) + ("<p class='share'>Share</p><h6>Series</h6>" if rnd.random() < 0.7 else "")
        parts.append(f"<article><h1>H {own}</h1>{body}</article>" if rnd.random() < 0.7 else f"<section>{body}</section>")
        parts.append("<pre>All rights</pre>" if rnd.random() < 0.6 else "")
        rows.append((i, f"http://{host}.org/{i}", f"<html><body>{''.join(parts)}</body></html>"))
    rows += [(200 + i, *rows[i][1:]) for i in range(20)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, host int")
    got = {r["page_id"]: r["text"] for r in wrappers.extract(frame).collect()}
    assert got == brute_html(rows)
    # Counts matter: without them, constants stay.
    off = {r["page_id"]: r["text"] for r in wrappers.extract(frame, min_pages=10**9).collect()}
    assert sum(off[i] != got[i] for i in got) > 50


def test_html_deep_long_and_empty(spark):
    deep = "<div>" * 3000 + "core" + "</div>" * 3000
    long = "<body>" + "".join(f"<p>line {i}" for i in range(20000)) + "</body>"
    frame = spark.createDataFrame([(1, "http://x/1", deep), (2, "http://x/2", long), (3, "http://x/3", "<b>" * 3000 + "t" + "<a '")], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in wrappers.extract(frame).collect()}
    assert got[1] == "core" and got[2].count("line") == 20000 and got[3].startswith("t")
    assert wrappers.extract(frame.limit(0)).count() == 0


def test_vectors_against_brute_force(spark):
    rnd = np.random.default_rng(3)
    base = rnd.standard_normal((12, 16))
    rows = [base[i % 12] + rnd.standard_normal(16) * (0.02 if i < 150 else 2.0) for i in range(240)]
    rows += [rows[0]] * 4 + [rows[0] * 3, np.zeros(16), np.full(16, np.nan), rows[1][:8]]
    data = [(i, [float(x) for x in r], 0) for i, r in enumerate(rows)] + [(900, None, 0), (901, [], 0), (902, [1.0, None], 0)]
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<double>, weight int")
    got = {r["vec_id"]: r for r in embedding_dedup.embedding_duplicates(vectors).collect()}
    x = np.stack([np.nan_to_num(r) if len(r) == 16 else np.zeros(16) for r in rows])
    norm = np.linalg.norm(x, axis=1)
    unit = x / np.where(norm > 0, norm, 1)[:, None]
    link = (unit @ unit.T >= 0.9) & (norm > 0)[:, None] & (norm > 0)[None]
    np.fill_diagonal(link, False)
    label = np.arange(len(rows))
    for _ in range(len(rows)):
        label = np.array([min(label[i], *label[link[i]]) if link[i].any() else label[i] for i in range(len(rows))])
    assert [got[i]["n_links"] for i in range(len(rows))] == link.sum(1).tolist()
    assert [got[i]["component_id"] for i in range(len(rows))] == label.tolist()
    assert all((got[i]["n_links"], got[i]["kept"]) == (0, True) for i in (900, 901, 902))
    assert embedding_dedup.embedding_duplicates(vectors.limit(0)).count() == 0


def test_vectors_scale_and_repeated_ids(spark):
    data = [(1, [1e200, 1e200]), (2, [2e200, 2e200]), (3, [1e-200, 1.1e-200]), (3, [0.0, 5.0]), (4, [0.0, 7.0]), (None, [0.0, 5.1]), (5, [float("inf"), 1.0])]
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_dedup.embedding_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()), key=str)
    assert got == [(1, 2, 1), (2, 2, 1), (3, 2, 1), (3, 2, 3), (4, 2, 3), (5, 0, 5), (None, 2, 3)]


def test_passes_grow_with_the_table():
    few, many = embedding_dedup.passes_for(50_000, 64, 0.9, 12), embedding_dedup.passes_for(10**8, 64, 0.9, 12)
    assert 20 <= few[0] < 30 and 2 * few[0] < many[0] < 150 and many[1] > few[1]
    assert 0.4 < embedding_dedup.agreement(0.9, 64) < 0.55 and embedding_dedup.agreement(1.0, 64) == 1.0


@pytest.mark.parametrize("n", [400, 4000])
def test_recall_of_planted_links(spark, n):
    rnd = np.random.default_rng(n)
    x = rnd.standard_normal((n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = rnd.standard_normal((n // 4, 64))
    near -= (near * x[: n // 4]).sum(1, keepdims=True) * x[: n // 4]
    x = np.concatenate([x, 0.91 * x[: n // 4] + np.sqrt(1 - 0.91**2) * near / np.linalg.norm(near, axis=1, keepdims=True)])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = sum(r["n_links"] for r in embedding_dedup.embedding_duplicates(frame).collect())
    link = x @ x.T >= 0.9
    assert found / (link.sum() - len(x)) >= 0.95


@pytest.mark.parametrize("n", [1500, 6000])
def test_recall_of_all_links_in_dense_topics(spark, n):
    rnd = np.random.default_rng(n)

    def unit(x):
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    topics = unit(rnd.standard_normal((4, 64)))[rnd.integers(4, size=n)]
    x = unit(np.sqrt(0.8) * topics + np.sqrt(0.2) * unit(rnd.standard_normal((n, 64))))
    near = rnd.standard_normal((n // 10, 64))
    near -= (near * x[: n // 10]).sum(1, keepdims=True) * x[: n // 10]
    x = np.concatenate([x, 0.91 * x[: n // 10] + np.sqrt(1 - 0.91**2) * unit(near)])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = sum(r["n_links"] for r in embedding_dedup.embedding_duplicates(frame, reach=4).collect())
    link = x @ x.T >= 0.9
    assert 0.9 <= found / (link.sum() - len(x)) <= 1
