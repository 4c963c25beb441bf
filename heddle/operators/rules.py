"""Data-quality rules; each gives issue rows (id, issue[, detail]) rather than raising."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle import functions as H


def union(*issues: DataFrame) -> DataFrame:
    out = issues[0]
    for i in issues[1:]:
        out = out.unionByName(i)
    return out


def when_issues(rows: DataFrame, key: str, tests: dict[str, Column]) -> DataFrame:
    """(key, issue) of every test that holds, in one pass over rows; null tests don't hold."""
    found = F.filter(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]), lambda x: x.isNotNull())
    return rows.select(key, F.explode(found).alias("issue"))


def duplicates(rows: DataFrame, key: str, issue: str = "duplicate") -> DataFrame:
    return rows.groupBy(key).count().where("count > 1").select(key, F.lit(issue).alias("issue"))


def missing(rows: DataFrame, other: DataFrame, key: str, issue: str) -> DataFrame:
    return rows.select(key).distinct().join(other.select(key), key, "left_anti").select(key, F.lit(issue).alias("issue"))


def record_errors(required: list[str], enums: dict[str, list[str]], integers: list[str], cross: dict[str, Column]) -> Column:
    """Array of the messages that a record's fields earn."""
    tests = [F.when(H.coalesce_blank(c).isNull(), F.lit(f"{c}: required")) for c in required]
    tests += [F.when(F.col(c).isNotNull() & ~F.col(c).isin(*v), F.lit(f"{c}: not allowed")) for c, v in enums.items()]
    tests += [F.when(H.coalesce_blank(c).isNotNull() & H.parse_int(c).isNull(), F.lit(f"{c}: not a whole number")) for c in integers]
    tests += [F.when(t, F.lit(m)) for m, t in cross.items()]
    return F.filter(F.array(*tests), lambda x: x.isNotNull())


def cross_source(name_ok: Column, overlap: Column, h: Column, cites: Column, year: Column, now: int, url: Column, cites_per_year: int = 50, h_per_year: int = 5) -> Column:
    """Struct of checks (pass, warn, fail, skip) and overall: fail with a failed name or URL, warn with any warning."""
    years = F.greatest(F.lit(1), F.lit(now) - year)
    checks = {
        "name": F.when(name_ok.isNull(), "skip").when(name_ok, "pass").otherwise("fail"),
        "affiliation": F.when(overlap.isNull(), "skip").when(overlap >= 0.5, "pass").otherwise("warn"),
        "temporal": F.when(year.isNull() | h.isNull() | cites.isNull(), "skip").when((h > h_per_year * years) | (cites > cites_per_year * years), "warn").otherwise("pass"),
        "url": F.when(url.isNull(), "skip").when(H.url_class(url)["http"], "pass").otherwise("fail"),
    }
    values = F.array(*checks.values())
    overall = F.when(F.array_contains(values, "fail"), "fail").when(F.array_contains(values, "warn"), "warn").otherwise("pass")
    return F.struct(*[c.alias(k) for k, c in checks.items()], overall.alias("overall"))


def first_mismatch(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, issue): rows only in a or only in b, and the first field in which rows differ (nulls are equal)."""
    x = a.select(key, F.struct(*fields).alias("__a"))
    y = b.select(key, F.struct(*fields).alias("__b"))
    both = x.join(y, key, "full_outer")
    issue = F.when(F.col("__b").isNull(), "only_left").when(F.col("__a").isNull(), "only_right")
    for f in fields:
        issue = issue.when(~F.col(f"__a.{f}").eqNullSafe(F.col(f"__b.{f}")), f"differs: {f}")
    return both.select(key, issue.alias("issue")).where("issue is not null")


def placeholders(rows: DataFrame, key: str, columns: list[str], literals: list[str]) -> DataFrame:
    """(key, column): text columns that hold a placeholder literal."""
    long = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lower(F.trim(F.col(c).cast("string"))).alias("v")) for c in columns]))
    return rows.select(key, long.alias("x")).where(F.col("x.v").isin(*literals)).select(key, F.col("x.column").alias("column"))


def pii_scan(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, sample): texts with e-mail addresses, how many, and the first."""
    found = F.regexp_extract_all(F.col(text), F.lit(H.EMAIL), 0)
    return rows.select(key, found.alias("f")).where("size(f) > 0").select(key, F.size("f").alias("n"), F.element_at("f", 1).alias("sample"))


def reused(rows: DataFrame, value: str, owner: str) -> DataFrame:
    """(value, owners): values that different owners use."""
    return rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.countDistinct(owner).alias("owners")).where("owners > 1")


def reconcile(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, expected, actual) where printed counts differ from those of the data."""
    e, a = expected.select(key, F.col("n").alias("expected")), actual.select(key, F.col("n").alias("actual"))
    return e.join(a, key, "full_outer").where(~F.col("expected").eqNullSafe(F.col("actual")))


def orphans(edges: DataFrame, people: DataFrame) -> DataFrame:
    """(id, issue): advisors that are nobody's record."""
    return edges.select(F.col("src").alias("id")).distinct().join(people.select("id"), "id", "left_anti").withColumn("issue", F.lit("orphan_advisor"))


def capture_audit(advisors: DataFrame, audit: DataFrame, listed: DataFrame) -> DataFrame:
    """(advisor, origin, rows, captured, dropped): an audit of advisors (advisor) made fit for the graph.

    Rows of audit (advisor, child, status, at) count where the advisor is known and, if captured, the child is among
    those listed (advisor, child); of the rows of a pair that with the status captured counts, then the latest. An
    advisor without a row left gets made rows, one per listed child, or one where none is. dropped tells how many
    rows of the advisor didn't count."""
    known = audit.join(advisors, "advisor", "left_semi").join(listed.select("advisor", "child", F.lit(True).alias("__listed")), ["advisor", "child"], "left")
    fit = (F.col("status") != "captured") | F.col("__listed")
    rank = F.struct((F.col("status") == "captured").alias("c"), "at")
    best = known.where(F.coalesce(fit, F.lit(False))).groupBy("advisor", "child").agg(F.max_by("status", rank).alias("status"))
    hand = best.groupBy("advisor").agg(F.count("*").alias("rows"), F.count_if(F.col("status") == "captured").alias("captured")).withColumn("origin", F.lit("audited"))
    bare = advisors.join(hand, "advisor", "left_anti").join(listed, "advisor", "left")
    made = bare.groupBy("advisor").agg(F.greatest(F.count("child"), F.lit(1)).alias("rows"), F.count("child").alias("captured")).withColumn("origin", F.lit("synthesised"))
    total = known.groupBy("advisor").agg(F.count("*").alias("n"))
    return hand.unionByName(made).join(total, "advisor", "left").select("advisor", "origin", "rows", "captured", (F.coalesce("n", F.lit(0)) - F.when(F.col("origin") == "audited", F.col("rows")).otherwise(0)).alias("dropped"))
