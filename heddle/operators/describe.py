"""Aggregations, windows, ordering and set operations that describe tables of people and links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle import functions as H

from ._loop import counted, once, staged


def positions(rows: DataFrame, place: str, *order: Column) -> DataFrame:
    """rows with their place (from 1) in a total order, without a task that sorts all of them: rows are dealt into
    ordered ranges, which are written once, and a row's place is its range's offset plus its place in it."""
    ranged = staged(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    counts = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    # One row per range: as many as there are shuffle partitions.
    offsets = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return ranged.join(offsets, "__part").withColumn(place, (F.col("__before") + inside).cast("int")).drop("__part", "__before")


def numbered_within(rows: DataFrame, keys: list[str], order: list[str], place: str) -> DataFrame:
    """rows with their place (from 1) within their key, by order and then all other columns, without a task that holds all rows of a key: ranges of
    (key, order) are written once, and a row's place is what earlier ranges have of its key and its place in its own."""
    by = [F.col(c) for c in [*keys, *order]]
    ranged = staged(rows.repartitionByRange(*by).withColumn("__part", F.spark_partition_id()))
    # A key has a row here for each range it reaches into.
    counts = ranged.groupBy(*keys, "__part").agg(F.count("*").alias("__n"))
    before = counts.select(*keys, "__part", (F.sum("__n").over(Window.partitionBy(*keys).orderBy("__part")) - F.col("__n")).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__part", *keys).orderBy(*by[len(keys):]))
    same = reduce(lambda a, b: a & b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "__part"]])
    joined = ranged.withColumn("__inside", inside).alias("a").join(before.alias("b"), same)
    return joined.select(*[F.col(f"a.{c}") for c in rows.columns], (F.col("b.__before") + F.col("a.__inside")).alias(place))


def exact_medians(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and median (as a double, the mean of the middle two) of the values that are not null, without a group in one task.

    Equal values are counted first; ranges of (key, value) are written once, and sums over ranges tell in which of them
    a key's middle ranks lie, so that only those are looked at value by value.
    """
    counts = values.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    ranged = staged(counts.repartitionByRange(*keys, value).withColumn("__part", F.spark_partition_id()))
    parts = ranged.groupBy(*keys, "__part").agg(F.sum("__n").alias("__in"))
    every = Window.partitionBy(*keys)
    parts = parts.withColumn("__before", F.sum("__in").over(every.orderBy("__part")) - F.col("__in")).withColumn("__all", F.sum("__in").over(every))
    ranks = F.array_distinct(F.array(F.expr("(__all - 1) div 2"), F.expr("__all div 2")))
    parts = parts.withColumn("__rank", F.explode(ranks)).where("__rank >= __before and __rank < __before + __in")
    named = parts.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__part").alias("__p"), "__before", "__rank")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys], F.col("__part") == F.col("__p"))
    upto = F.sum("__n").over(Window.partitionBy(*keys, "__part", "__rank").orderBy(value)) + F.col("__before")
    found = ranged.join(named, same).withColumn("__upto", upto).where("__rank < __upto and __rank >= __upto - __n")
    return found.groupBy(*keys).agg(F.avg(F.col(value).cast("double")).alias("median"))


def coauthors(works: DataFrame, selves: DataFrame) -> DataFrame:
    """(id, author_key, display) from works (id, at, authors: text) without the names of selves (id, name).

    Names are parted by "and", semicolons and ampersands; "Last, First" is turned round. The key is first::last token;
    of its spellings that with the most tokens, then the longest, then the earliest, then the greatest is shown; names of one token go, and so do
    names whose tokens begin those of another of the same id.
    """
    parts = F.split(F.regexp_replace(F.replace(F.col("authors"), F.lit(" and "), F.lit("&")), ";", "&"), "&")
    # Texts are taken apart, and names normalised, once for all rows that have them.
    rows = works.select("authors").distinct().select("authors", F.posexplode(parts).alias("nth", "raw"))
    rows = once(rows, pieces=F.filter(F.transform(F.split(F.regexp_replace("raw", r"^[ ,.]+|[ ,.]+$", ""), ","), lambda x: H.squeeze(x)), lambda x: x != ""))
    turned = F.concat_ws(" ", F.concat(F.slice("pieces", F.lit(2), F.size("pieces")), F.slice("pieces", 1, 1)))
    named = once(once(rows.where(F.size("pieces") > 0), display=turned), norm=H.norm_person("display")).select("authors", "nth", "display", "norm")
    words = F.split("norm", " ")
    starts = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))
    named = named.where(F.size(H.tokens(F.col("norm"))) >= 2).select("*", F.concat_ws("::", *H.ends(F.col("norm"))).alias("author_key"), F.size(words).alias("tokens"))
    named = works.select("id", "at", "authors").join(staged(named), "authors").drop("authors")
    norms = staged(once(selves.select("name").distinct(), norm=H.norm_person("name")))
    named = named.join(selves.select("id", "name").join(norms, "name").select("id", "norm").distinct(), ["id", "norm"], "left_anti")
    rank = F.struct("tokens", F.length("display"), -F.col("at"), -F.col("nth"), F.col("display"))
    best = named.groupBy("id", "author_key").agg(F.max_by(F.struct("display", "norm"), rank).alias("x")).select("id", "author_key", "x.*")
    begun = best.select("id", F.explode(starts).alias("norm")).distinct()
    return best.join(begun, ["id", "norm"], "left_anti").select("id", "author_key", "display")


def most_common(rows: DataFrame, column: str, ordinal: str) -> DataFrame:
    """(value, count, rank) by count, then by where the value stands first; blanks are left out."""
    counts = rows.where(F.trim(column) != "").groupBy(F.col(column).alias("value")).agg(F.count("*").alias("count"), F.min(ordinal).alias("first"))
    return positions(counts, "rank", F.desc("count"), F.col("first")).select("value", "count", "rank")


def top_variants(rows: DataFrame, canon: str, raw: str, k: int = 20, m: int = 5) -> DataFrame:
    """(canon, raw, n, total): the k most frequent canonical values with their m most frequent spellings each."""
    pairs = rows.groupBy(canon, raw).agg(F.count("*").alias("n"))
    totals = pairs.groupBy(canon).agg(F.sum("n").alias("total")).orderBy(F.desc("total"), canon).limit(k)
    ranked = pairs.join(totals, canon).withColumn("k", F.row_number().over(Window.partitionBy(canon).orderBy(F.desc("n"), raw)))
    return ranked.where(F.col("k") <= m).select(F.col(canon).alias("canon"), F.col(raw).alias("raw"), "n", "total")


def headlines(rows: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """(statistic, universe, count): named conditional counts in one pass, long form."""
    one = rows.agg(F.count("*").alias("__all"), *[F.count_if(c).alias(k) for k, c in tests.items()])
    return one.select(F.col("__all"), F.explode(F.array(*[F.struct(F.lit(k).alias("statistic"), F.col(k).alias("count")) for k in tests])).alias("x")).select("x.statistic", F.col("__all").alias("universe"), "x.count")


def profile(rows: DataFrame, year: str, categories: list[str], flag: str) -> DataFrame:
    """(section, label, value): least, greatest, median (whole) and mean (one decimal) year, decades, values of
    each category with blanks as "(blank)", and the rate of a flag in percent."""
    y = F.col(year)
    years = rows.agg(F.min(y).alias("least"), F.max(y).alias("greatest"), F.round(F.avg(y), 1).alias("mean"))
    median = exact_medians(rows.select(F.lit("year").alias("section"), y.alias("y")), ["section"], "y")
    out = years.select(F.explode(F.array(*[F.struct(F.lit("year").alias("section"), F.lit(k).alias("label"), F.col(k).cast("double").alias("value")) for k in ("least", "greatest", "mean")])).alias("x")).select("x.*")
    middle = F.broadcast(rows.agg(F.lit("year").alias("section"))).join(median, "section", "left")
    out = out.unionByName(middle.select("section", F.lit("median").alias("label"), F.floor("median").cast("double").alias("value")))
    decade = rows.where(y.isNotNull()).groupBy(F.concat((F.floor(y / 10) * 10).cast("string"), F.lit("s")).alias("label")).agg(F.count("*").cast("double").alias("value"))
    out = out.unionByName(decade.select(F.lit("decade").alias("section"), "label", "value"))
    if categories:
        long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("section"), F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit("(blank)")).alias("label")) for c in categories])).alias("x")).select("x.*")
        out = out.unionByName(long.groupBy("section", "label").agg(F.count("*").cast("double").alias("value")))
    return out.unionByName(rows.agg(F.round(100.0 * F.count_if(F.col(flag)) / F.count("*"), 1).alias("value")).select(F.lit(flag).alias("section"), F.lit("percent").alias("label"), "value"))


def cohorts(rows: DataFrame, year: str, flag: str, bins: list[tuple[str, int, int]]) -> DataFrame:
    """(label, people, flagged, rate): rate of a flag by labelled year ranges; empty ranges have 0. The list of
    bins is a parameter of a few rows, so it is a map in an expression and not a join."""
    label = F.when(F.lit(False), "")
    for name, low, high in bins:
        label = label.when(F.col(year).between(low, high), name)
    counts = rows.groupBy(label.alias("label")).agg(F.count("*").alias("people"), F.count_if(F.col(flag)).alias("flagged"))
    every = rows.sparkSession.createDataFrame([(b[0],) for b in bins], "label string")
    out = every.join(counts, "label", "left").select("label", F.coalesce("people", F.lit(0)).alias("people"), F.coalesce("flagged", F.lit(0)).alias("flagged"))
    return out.withColumn("rate", F.coalesce(F.col("flagged") / F.nullif(F.col("people"), F.lit(0)), F.lit(0.0)))


def coverage(rows: DataFrame, fields: list[str], group: str) -> DataFrame:
    """(field, part, filled, total): non-blank values per field over all and by group."""
    long = rows.select(F.col(group).cast("string").alias("part"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), (F.coalesce(F.trim(F.col(f).cast("string")), F.lit("")) != "").alias("has")) for f in fields])).alias("x")).select("part", "x.*")
    return long.groupBy("field", "part").agg(F.count_if("has").alias("filled"), F.count("*").alias("total")).unionByName(long.groupBy("field").agg(F.lit("all").alias("part"), F.count_if("has").alias("filled"), F.count("*").alias("total")))


def string_lists(rows: DataFrame, key: str, value: str, order: str, kind: str, primary: str) -> DataFrame:
    """(key, list): ordered distinct values joined by "; ", of the primary kind where there are any, else of all."""
    firsts = rows.groupBy(key, value).agg(F.min(F.when(F.col(kind) == primary, F.col(order))).alias("p"), F.min(order).alias("o"))
    listed = lambda o: F.array_join(F.transform(F.array_sort(F.filter(F.collect_list(F.struct(F.col(o).alias("o"), F.col(value).alias("v"))), lambda x: x["o"].isNotNull())), lambda x: x["v"]), "; ")
    return firsts.groupBy(key).agg(F.coalesce(F.nullif(listed("p"), F.lit("")), listed("o")).alias("list"))


def group_roster(rows: DataFrame, group: str, name: str, size: int = 10_000) -> DataFrame:
    """(group, chunk, n, names): people per group, and their sorted names; a blank group is named "(blank)". A group of more than size names has several
    rows, chunks from 0 with so many names each; no list is longer."""
    g = F.coalesce(F.nullif(F.trim(F.col(group).cast("string")), F.lit("")), F.lit("(blank)"))
    named = rows.select(g.alias("group"), F.col(name).alias("name"))
    totals = named.groupBy("group").agg(F.count("*").alias("n"))
    placed = numbered_within(named.where("name is not null"), ["group"], ["name"], "__at")
    lists = placed.groupBy("group", F.floor((F.col("__at") - 1) / size).alias("chunk")).agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("names"))
    return totals.join(lists, "group", "left").select("group", F.coalesce("chunk", F.lit(0)).cast("long").alias("chunk"), "n", F.coalesce("names", F.lit("")).alias("names"))


def types_by_pair(edges: DataFrame, order: list[str]) -> DataFrame:
    """(src, dst, types): the pair's edge types in a fixed order, joined by +."""
    rank = F.create_map(*[F.lit(x) for i, t in enumerate(order) for x in (t, i)])
    ranked = edges.groupBy("src", "dst").agg(F.array_sort(F.collect_set(F.struct(F.coalesce(F.try_element_at(rank, F.col("type")), F.lit(len(order))).alias("r"), "type"))).alias("t"))
    return ranked.select("src", "dst", F.array_join(F.transform("t", lambda x: x["type"]), "+").alias("types"))


def impact_panel(rows: DataFrame, group: str, matched: Column, h: str, cites: str, recent: str, recent_h: str) -> DataFrame:
    """Per group and overall (group null): people, matched, coverage, median h, median citations, recent share in
    percent, still cited and productive people."""
    m = rows.withColumn("__m", matched)
    one = lambda c: F.when(F.col("__m"), F.col(c))
    panel = m.rollup(group).agg(
        F.grouping(group).alias("__level"),
        F.count("*").alias("people"),
        F.count_if("__m").alias("matched"),
        (100.0 * F.sum(one(recent)) / F.sum(one(cites))).alias("recent_percent"),
        F.count_if(F.col("__m") & (F.col(recent) > 0)).alias("still_cited"),
        F.count_if(F.col("__m") & (F.col(recent_h) >= 10)).alias("productive"),
    )
    # Every value counts in its group and in the whole.
    levels = F.explode(F.array(F.struct(F.col(group).alias(group), F.lit(0).alias("__level")), F.struct(F.lit(None).cast(rows.schema[group].dataType).alias(group), F.lit(1).alias("__level"))))
    measures = F.explode(F.array(F.struct(F.lit("h").alias("kind"), F.col(h).cast("double").alias("v")), F.struct(F.lit("cites").alias("kind"), F.col(cites).cast("double").alias("v"))))
    long = m.where("__m").select(levels.alias("l"), h, cites).select("l.*", measures.alias("x")).select(group, "__level", "x.*")
    medians = exact_medians(long, [group, "__level", "kind"], "v")
    wide = medians.groupBy(F.col(group).alias("__g"), F.col("__level").alias("__l")).agg(F.max(F.when(F.col("kind") == "h", F.col("median"))).alias("median_h"), F.max(F.when(F.col("kind") == "cites", F.col("median"))).alias("median_citations"))
    out = panel.join(wide, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__level") == F.col("__l")), "left")
    return out.select(group, "people", "matched", "median_h", "median_citations", "recent_percent", "still_cited", "productive")


def share_top(rows: DataFrame, group: str, category: str) -> DataFrame:
    """(group, category, n, share, kinds): the largest category of each group, ties to the smaller value."""
    counts = rows.groupBy(group, category).agg(F.count("*").alias("n"))
    return counts.groupBy(F.col(group).alias("group")).agg(F.min_by(category, F.struct(-F.col("n"), F.col(category))).alias("category"), F.max("n").alias("n"), (F.max("n") / F.sum("n")).alias("share"), F.count("*").alias("kinds"))


def status_rollup(issues: DataFrame) -> DataFrame:
    """One row: FAIL with a high issue, WARN with any, else PASS, and the counts."""
    return issues.agg(F.count_if(F.col("severity") == "high").alias("high"), F.count("*").alias("issues")).select(F.when(F.col("high") > 0, "FAIL").when(F.col("issues") > 0, "WARN").otherwise("PASS").alias("status"), "high", "issues")


def dedup_complete(rows: DataFrame, key: list[str], weights: dict[str, int], fields: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): of rows with one key the most complete stays: weights (in tenths) of the columns that are
    filled, and one tenth per filled field; ties go to the first in order, which must be total."""
    has = lambda c: (F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "").cast("int")
    score = sum((has(c) * w for c, w in weights.items()), F.lit(0)) + sum((has(c) for c in fields), F.lit(0))
    ranked = rows.withColumn("score", score).withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), *order)))
    return ranked.where("k = 1").drop("k"), ranked.where("k > 1").drop("k")


def best_record(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The least row of each key in order (ranks, then source and row index), and how many there were."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("x"), F.count("*").alias("records")).select(key, "x.*", "records")


def last_record(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x"), F.count("*").alias("records")).select(key, "x.*", "records")


def rank_candidates(rows: DataFrame, key: str, order: list[Column], k: int = 5) -> DataFrame:
    """First k candidates per key with rank, and gap of the best score to the next."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).withColumn("gap", F.col("score") - F.coalesce(F.lead("score").over(w), F.lit(0.0))).where(F.col("rank") <= k)


def child_sequence(rows: DataFrame, parent: str, order: list[str], prefix: str = "S") -> DataFrame:
    """rows with child_id: prefix, parent and a four-digit counter per parent."""
    n = F.row_number().over(Window.partitionBy(parent).orderBy(*order))
    return rows.withColumn("child_id", F.concat(F.lit(f"{prefix}-"), F.col(parent).cast("string"), F.lit("-"), F.lpad(n.cast("string"), 4, "0")))


def first_nonblank(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    return rows.where(F.trim(value) != "").groupBy(key).agg(F.min_by(value, order).alias(value))


def wave_pools(pool: DataFrame, excluded: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """pool with reason: the first exclusion list that holds its key, or null for those who stay."""
    out = pool
    for i, (_, t) in enumerate(excluded):
        out = out.join(t.select(key).distinct().withColumn(f"__{i}", F.lit(1)), key, "left")
    reason = F.coalesce(*[F.when(F.col(f"__{i}").isNotNull(), F.lit(name)) for i, (name, _) in enumerate(excluded)])
    return out.withColumn("reason", reason).drop(*[f"__{i}" for i in range(len(excluded))])


def greedy_distinct(rows: DataFrame, place: str, keys: str, name: str) -> DataFrame:
    """(place, key): the rows that a walk in order of place keeps, and the key that each is kept under. A row is kept if its name (null: none) was not seen and one of its
    keys (an array, in order) was not; it is kept under the first such key, and then its name and all its keys count as seen.

    place is unique. The walk goes in rounds instead of row by row: rows that no earlier undecided row shares a key or name with
    are decided at once, and then rows that what they brought rules out. Rounds follow the longest chain of rows that wait for each
    other, not the number of rows; a key that many rows share is settled in one.
    """
    clean = F.array_distinct(F.filter(F.col(keys), lambda k: k.isNotNull()))
    left, n = counted(rows.select(F.col(place).alias("place"), clean.alias("keys"), F.col(name).alias("name")).where(F.size("keys") > 0))
    kept: list[DataFrame] = []
    while n["rows"]:
        marks = F.concat(F.transform("keys", lambda k: F.struct(F.lit("k").alias("kind"), k.cast("string").alias("v"))), F.filter(F.array(F.struct(F.lit("n").alias("kind"), F.col("name").cast("string").alias("v"))), lambda x: x["v"].isNotNull()))
        long = left.select("place", F.explode(marks).alias("mark")).select("place", "mark.*")
        first = long.groupBy("kind", "v").agg(F.min("place").alias("place")).groupBy("place").agg(F.count("*").alias("leads"))
        size = F.size("keys") + F.when(F.col("name").isNotNull(), 1).otherwise(0)
        ready = staged(left.join(first, "place").where(F.col("leads") == size).drop("leads"))
        kept.append(ready.select("place", F.col("keys")[0].alias("key")))
        # Each mark has one row here: ready rows share none.
        seen = ready.select(F.explode(marks).alias("mark")).select("mark.*", F.lit(True).alias("seen"))
        hit = long.join(ready.select("place"), "place", "left_anti").join(seen, ["kind", "v"]).groupBy("place").agg(F.collect_set(F.when(F.col("kind") == "k", F.col("v"))).alias("gone"), F.bool_or(F.col("kind") == "n").alias("named"))
        rest = left.join(ready.select("place"), "place", "left_anti").join(hit, "place", "left").where("named is null or not named")
        remaining = F.filter("keys", lambda k: ~F.array_contains(F.coalesce("gone", F.array().cast("array<string>")), k.cast("string")))
        left, n = counted(rest.select("place", remaining.alias("keys"), "name").where(F.size("keys") > 0))
    none = rows.select(F.col(place).alias("place"), F.col(keys)[0].alias("key")).limit(0)
    return reduce(DataFrame.unionByName, kept, none)


def wave_contacts(pool: DataFrame, place: str, emails: str, name: str, answered: DataFrame, contacted: DataFrame, aliases: DataFrame) -> DataFrame:
    """pool (a unique place, an array of e-mail addresses and a name, null for none) with reason and email: why a person is not written to (no_email,
    responded, contacted, duplicate), or the address to use.

    answered and contacted hold email and name of people (either may be null); a person is one of answered by any address, by name, or by an alias (name, alias); one of contacted by any
    address or by name. Of those that are left each e-mail address and name is used once, in order of place.
    """
    some = pool.select(F.col(place).alias("place"), F.array_distinct(F.filter(F.col(emails), lambda e: e.contains("@"))).alias("emails"), F.col(name).alias("name"))
    marks = some.select("place", F.explode("emails").alias("email"))

    def held(by: DataFrame, names: DataFrame) -> DataFrame:
        one = marks.join(by.select("email").where("email is not null").distinct(), "email", "left_semi").select("place")
        return one.union(names.join(by.select("name").where("name is not null").distinct(), "name", "left_semi").select("place")).distinct()

    called = some.select("place", "name").where("name is not null")
    also = called.join(aliases.select("name", "alias").distinct(), "name").select("place", F.col("alias").alias("name"))
    responded, before = held(answered, called.unionByName(also)), held(contacted, called)
    tagged = some.join(responded.withColumn("__r", F.lit(True)), "place", "left").join(before.withColumn("__c", F.lit(True)), "place", "left")
    out = F.when(F.size(F.coalesce("emails", F.array().cast("array<string>"))) < 1, "no_email").when(F.col("__r"), "responded").when(F.col("__c"), "contacted")
    tagged = staged(tagged.select("place", "emails", "name", out.alias("reason")))
    kept = greedy_distinct(tagged.where("reason is null"), "place", "emails", "name").select("place", F.col("key").alias("email"))
    both = tagged.select("place", "reason").join(kept, "place", "left")
    return both.select(F.col("place").alias(place), F.coalesce("reason", F.when(F.col("email").isNull(), "duplicate")).alias("reason"), "email")


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, member): a_only, b_only or both."""
    tagged = a.select(key, F.lit("a").alias("t")).unionByName(b.select(key, F.lit("b").alias("t")))
    return tagged.groupBy(key).agg(F.when(F.min("t") != F.max("t"), "both").otherwise(F.concat(F.min("t"), F.lit("_only"))).alias("member"))


def blank_last(generation: Column, *rest: Column) -> list[Column]:
    """Sort keys: a number with blank or invalid as 999, then the rest with nulls last."""
    return [F.coalesce(generation.try_cast("int"), F.lit(999)).asc(), *[c.asc_nulls_last() for c in rest]]


def by_category(column: str, order: list[str]) -> Column:
    """Sort key by a list of categories; others come last."""
    rank = F.create_map(*[F.lit(x) for i, t in enumerate(order) for x in (t, i)])
    return F.coalesce(F.try_element_at(rank, F.col(column)), F.lit(len(order)))
