"""Quality rules on whole texts, with column expressions, joins and aggregations only.

Base rules look at a document by itself. The cross-document rule hashes each document's normalised lines,
counts per host (the source column) in how many distinct documents a line stands, removes the lines above the
limit, and rejects documents of which too little is left.

With fold_copies, documents with the same set of lines, told by a digest of all its line hashes, count once in that
count: where near-duplicate removal follows and keeps one of them, copies don't make each other boilerplate. Documents
that differ in a line are counted each, however many they share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import let, once, staged

#: Distinct documents of a host in which a line may stand, and the share of words that must be left.
MAX_DOCUMENTS = 100
MIN_LEFT_PERCENT = 40
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

_SPACE = r"[ \t-\r]"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, f"{_SPACE}+"), lambda w: w != "")


def _repeat_words(grams: Column) -> Column:
    """Words in the windows whose hash occurs more than once, from the array of window hashes."""
    ranked = F.sort_array(F.transform(grams, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

    def repeated(r: Column) -> Column:
        same = lambda k, j: F.get(r, k)["x"].eqNullSafe(F.get(r, j)["x"])
        near = F.filter(F.sequence(F.lit(0), F.size(r) - 1), lambda k: same(k, k + 1) | ((k > 0) & same(k, F.greatest(k - 1, F.lit(0)))))
        return F.sort_array(F.transform(near, lambda k: F.get(r, k)["i"]))

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda p, k: F.when(k == 0, F.lit(3)).otherwise(F.least(F.lit(3), p - F.get(at, F.greatest(k - 1, F.lit(0))))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x)

    return let(let(ranked, repeated), covered)


def _key(text: Column) -> Column:
    """128 bits that stand for a document's id and text."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit("\n"), text).cast("binary")))


#: The measures of the base rules; frames hold them behind two underscores, so that no column of docs is lost.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_rules(docs: DataFrame) -> DataFrame:
    """docs with __text, __key, the MEASURES behind two underscores, and __failed."""
    out = once(docs, __text=F.coalesce(F.col("text").cast("string"), F.lit("")))
    out = once(out, __key=_key(F.col("__text")), __words=_words(F.col("__text")))
    word = lambda i: F.get("__words", i)
    starts = F.when(F.size("__words") >= 3, F.sequence(F.lit(0), F.size("__words") - 3)).otherwise(F.array().cast("array<int>"))
    lines = F.filter(F.split(F.col("__text"), "\n"), lambda x: F.length(F.trim(F.translate(x, "\t\n\x0b\f\r", "     "))) > 0)
    out = once(out, __n_words=F.size("__words").cast("long"), __grams=F.transform(starts, lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2))), __lines=lines).drop("__words")
    some = F.size(F.array_distinct("__grams")) < F.size("__grams")
    out = once(
        out,
        __word_chars=(F.length("__text") - F.regexp_count("__text", F.lit(_SPACE))).cast("long"),
        __n_symbols=F.regexp_count("__text", F.lit(r"[#*$%&|<>]")).cast("long"),
        __n_dup_lines=(F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        __n_repeat_words=F.when(some, _repeat_words(F.col("__grams"))).otherwise(F.lit(0).cast("long")),
    ).drop("__grams", "__lines")
    failed = (F.col("__n_words") < MIN_WORDS) | (100 * F.col("__n_repeat_words") > MAX_REPEAT_PERCENT * F.col("__n_words"))
    return out.withColumn("__failed", failed)


def _normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), f"{_SPACE}+", " "))


def frequent_lines(docs: DataFrame, host: str = "source", max_documents: int = MAX_DOCUMENTS, fold_copies: bool = False) -> DataFrame:
    """__key, line (hash of the normalised line) and words (of the line in that document, all occurrences) of
    the lines that stand in more than max_documents distinct documents of their host; with fold_copies, documents with
    the same set of lines count as one."""
    rows = docs.select("doc_id", F.col(host).cast("string").alias("host"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text")).withColumn("__key", _key(F.col("__text")))
    split = F.filter(F.transform(F.split("__text", "\n"), _normal), lambda x: x != "")
    rows = once(rows.select("__key", "host", "__text"), lines=F.transform(split, lambda x: F.struct(F.unhex(F.md5(x.cast("binary"))).alias("line"), F.size(F.split(x, " ")).alias("words"))))
    if fold_copies:
        sets = F.array_sort(F.array_distinct(F.transform("lines", lambda x: F.hex(x["line"]))))
        rows = once(rows.select("__key", "host", "lines"), whole=F.unhex(F.md5(F.array_join(sets, "").cast("binary"))))
    else:
        rows = rows.withColumn("whole", F.col("__key"))
    each = rows.select("__key", "host", "whole", F.explode("lines").alias("x")).select("__key", "host", "whole", "x.line", "x.words")
    each = staged(each.groupBy("__key", "host", "line").agg(F.sum("words").alias("words"), F.min("whole").alias("whole")), "lines")
    # A document's line is one row of each, so only copies need folding before the count.
    distinct = each.groupBy("host", "line", "whole").agg(F.lit(1).alias("one")) if fold_copies else each
    distinct = distinct.groupBy("host", "line").agg(F.count("*").alias("documents"))
    over = distinct.where(F.col("documents") > max_documents).select(F.col("host").alias("h"), F.col("line").alias("l"))
    return each.join(over, F.col("host").eqNullSafe(F.col("h")) & (F.col("line") == F.col("l"))).select("__key", "line", "words")


def quality_rules(docs: DataFrame, host: str = "source", max_documents: int = MAX_DOCUMENTS, min_left_percent: int = MIN_LEFT_PERCENT, fold_copies: bool = False) -> DataFrame:
    """doc_id, the base measures, n_left_words, base_failed and kept for every row of docs (doc_id, text, host).

    kept is false where base_failed, or where lines above the limit are removed and the words left are fewer
    than min_left_percent of all. Null text has no words and fails; a null host is a host of its own. Rows of
    the same doc_id and text count as one document. Very long texts are measured whole. An empty table stays empty.
    Other columns, whatever their names, are ignored.
    """
    measured = base_rules(docs.select("doc_id", "text")).select("doc_id", "__key", *[F.col(f"__{m}").alias(m) for m in MEASURES], F.col("__failed").alias("base_failed"))
    removed = frequent_lines(docs, host, max_documents, fold_copies).groupBy("__key").agg(F.sum("words").alias("gone"))
    out = measured.join(removed, "__key", "left").withColumn("n_left_words", F.greatest(F.lit(0), F.col("n_words") - F.coalesce("gone", F.lit(0))))
    depleted = F.col("gone").isNotNull() & (100 * F.col("n_left_words") < min_left_percent * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_left_words", "base_failed", (~F.col("base_failed") & ~depleted).alias("kept"))


def apply_quality(docs: DataFrame, host: str = "source", max_documents: int = MAX_DOCUMENTS, min_left_percent: int = MIN_LEFT_PERCENT, fold_copies: bool = False) -> DataFrame:
    """docs without the rejected documents, and without the lines above the limit in those that stay.

    Columns are those of docs, also where a name is that of a measure; n_chars, where there is one, is counted again.
    Nulls, short texts, repeated rows and an empty table are treated as in quality_rules.
    """
    lines = frequent_lines(docs, host, max_documents, fold_copies).groupBy("__key").agg(F.sum("words").alias("__gone"), F.collect_set("line").alias("__over"))
    out = base_rules(docs).where("not __failed").join(lines, "__key", "left")
    left = F.col("__n_words") - F.coalesce("__gone", F.lit(0))
    out = out.where(F.col("__gone").isNull() | (100 * left >= min_left_percent * F.col("__n_words")))
    keep = F.filter(F.split("__text", "\n"), lambda x: ~F.array_contains("__over", F.unhex(F.md5(_normal(x).cast("binary")))))
    text = F.when(F.col("__over").isNull(), F.col("__text")).otherwise(F.array_join(keep, "\n"))
    out = out.withColumn("__new", text)
    cols = {"text": F.col("__new"), "n_chars": F.length("__new").cast("long")}
    return out.select(*[cols[c].alias(c) if c in cols else F.col(c) for c in docs.columns])


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, source, list_filter(regexp_split_to_array(t, '[ \t-\r]+'), lambda x: x <> '') AS ws FROM d),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
g2 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS c FROM g),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM g2, (VALUES (0), (1), (2)) v(o) WHERE c > 1 GROUP BY doc_id),
ln AS (SELECT doc_id, source, unnest(string_split(t, chr(10))) AS raw FROM d),
l2 AS (SELECT doc_id, source, raw, trim(regexp_replace(lower(raw), '[ \t-\r]+', ' ', 'g')) AS line FROM ln WHERE regexp_matches(raw, '[^ \t-\r]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT raw) AS n FROM l2 GROUP BY doc_id),
l3 AS (SELECT doc_id, source, md5(line) AS line, sum(len(string_split(line, ' '))) AS words FROM l2 GROUP BY ALL),
over_limit AS (SELECT source, line FROM l3 GROUP BY source, line HAVING count(DISTINCT doc_id) > 100),
gone AS (SELECT doc_id, sum(words) AS n FROM l3 JOIN over_limit USING (source, line) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[ \t-\r]', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words, gone.n AS gone, (len(ws) - coalesce(gone.n, 0))::BIGINT AS n_left_words
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_left_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (gone IS NOT NULL AND 100 * n_left_words < 40 * n_words) AS kept
FROM m
"""
