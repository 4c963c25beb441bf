"""Candidate scoring, gates, decisions and enrichment of entity tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle import functions as H

#: Thresholds of the gate, and the slack for sums of decimal fractions.
AUTO, SECOND, AMBIGUOUS, GAP, SECOND_GAP, EPS = 0.78, 0.68, 0.50, 0.10, 0.15, 1e-9


def name_score(first: Column, last: Column, names: Column, groups: list[list[str]]) -> Column:
    """Struct score and kind over a candidate's normalised names: .65 exact, .55 same or nickname first with the
    last name, .45 initial and last name, .30 both contained, else 0."""
    full = F.concat(first, F.lit(" "), last)
    ends = lambda n: n.endswith(last) & (last != "")
    given = lambda n: F.substring_index(n, " ", 1)
    out = [
        (F.exists(names, lambda n: n == full), 0.65, "exact"),
        (F.exists(names, lambda n: ends(n) & H.nickname_equal(given(n), first, groups)), 0.55, "first_last"),
        (F.exists(names, lambda n: ends(n) & given(n).startswith(F.substring(first, 1, 1)) & (first != "")), 0.45, "initial_last"),
        (F.exists(names, lambda n: n.contains(first) & n.contains(last) & (first != "") & (last != "")), 0.30, "contains"),
    ]
    made = F.when(F.lit(False), F.struct(F.lit(0.0).alias("score"), F.lit("").alias("kind")))
    for test, score, kind in out:
        made = made.when(test, F.struct(F.lit(score).alias("score"), F.lit(kind).alias("kind")))
    return made.otherwise(F.struct(F.lit(0.0).alias("score"), F.lit("none").alias("kind")))


def institution_forms(names: Column) -> Column:
    """What institution_score compares, of an array of names: compute it on either side before the join."""
    return F.transform(names, lambda n: H.affil_form(n))


def institution_score(known: Column, candidate: Column) -> Column:
    """From the best similarity of each known institution (both sides as institution_forms): exact ones .20 and .10
    for each further up to .30; else .18 for .75 or more, .12 for .40 or more, 0 below."""
    best = F.transform(known, lambda k: F.coalesce(F.array_max(F.transform(candidate, lambda c: H.affil_similarity(k, c))), F.lit(0.0)))

    def score(b: Column) -> Column:
        exact, top = F.size(F.filter(b, lambda x: x >= 1.0)), F.coalesce(F.array_max(b), F.lit(0.0))
        return F.when(exact > 0, F.least(F.lit(0.30), 0.20 + 0.10 * (exact - 1))).when(top >= 0.75, 0.18).when(top >= 0.40, 0.12).otherwise(0.0)

    return H.let(best, score)


def primary_topic(topics: Column) -> Column:
    """Struct topic, subfield, field, domain of the first of an array of topics (display_name, and subfield, field and
    domain with a display_name each); blanks where there is none."""
    first = F.get(topics, F.lit(0))
    blank = lambda c: F.coalesce(c, F.lit(""))
    return F.struct(blank(first["display_name"]).alias("topic"), *[blank(first[k]["display_name"]).alias(k) for k in ("subfield", "field", "domain")])


def institution_names(known: Column, affiliations: Column) -> Column:
    """Display names of last known institutions, then of affiliations, the first of those that normalise alike."""
    every = F.concat(F.coalesce(F.transform(known, lambda k: k["display_name"]), F.array().cast("array<string>")), F.coalesce(F.transform(affiliations, lambda a: a["institution"]["display_name"]), F.array().cast("array<string>")))
    return H.ordered_distinct(F.filter(every, lambda n: F.coalesce(n, F.lit("")) != ""), lambda n: H.norm_affil(n))


def current_institution(known: Column, affiliations: Column) -> Column:
    """Name of the first last known institution, else the first of institution_names; blank where there is none."""
    return F.when(F.size(known) > 0, F.coalesce(F.get(known, F.lit(0))["display_name"], F.lit(""))).otherwise(F.coalesce(F.get(institution_names(known, affiliations), F.lit(0)), F.lit("")))


def timing_score(degree: Column, earliest: Column) -> Column:
    """-.50 where the first work is over 30 years before the degree, .10 from 12 before to 8 after, -.20 over 15
    after or 25 before, else 0; 0 where either year is missing."""
    return F.coalesce(F.when(earliest < degree - 30, -0.50).when(earliest.between(degree - 12, degree + 8), 0.10).when((earliest > degree + 15) | (earliest < degree - 25), -0.20), F.lit(0.0))


def earliest_year(counts: Column) -> Column:
    """Least year with works of an array of (year, works)."""
    return F.array_min(F.transform(F.filter(counts, lambda c: c["works"] > 0), lambda c: c["year"]))


def total_score(*parts: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), sum(parts[1:], parts[0]))), 4)


def gate(best: Column, second: Column, name: Column, institution: Column, compatible: Column) -> Column:
    """matched, ambiguous or no_match for the best score (null: no candidates) and the second (null: none)."""
    gap = best - F.coalesce(second, F.lit(0.0))
    alone = second.isNull()
    sure = (best >= AUTO) & (alone | (gap >= GAP - EPS))
    backed = (best >= SECOND) & (name >= 0.55) & (institution >= 0.12) & (alone | (gap >= SECOND_GAP - EPS))
    return F.when(best.isNull(), "no_match").when(sure | backed, F.when(compatible, "matched").otherwise("ambiguous")).when(best >= AMBIGUOUS, "ambiguous").otherwise("no_match")


def flags(count: Column, degree: Column, earliest: Column, field: Column, compatible: Column, foreign: list[str], limit: int = 25) -> Column:
    """Array of the warnings that a chosen candidate gets; high_candidate_count at exactly the search's page size."""
    tests = [(count == limit, "high_candidate_count"), (earliest < degree - 30, "temporal_implausibility"), (field.isin(*foreign), "field_mismatch"), (~compatible, "name_mismatch_warning")]
    return F.filter(F.array(*[F.when(t, n) for t, n in tests]), lambda x: x.isNotNull())


def is_public(status: Column, found: Column, automatic: Column) -> Column:
    """Matched, no blocking flag, and not both automatic and of a crowded search."""
    blocking = F.arrays_overlap(found, F.array(F.lit("temporal_implausibility"), F.lit("field_mismatch"), F.lit("name_mismatch_warning")))
    return (status == "matched") & ~blocking & ~(automatic & F.array_contains(found, "high_candidate_count"))


def apply_decisions(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """rows (node, status, chosen) with decisions (node, decision, proposed) on top: approve and replace take the
    proposed id, keep matches the chosen one, reject clears it, review makes the row ambiguous."""
    d = F.col("decision")
    status = F.when(d.isin("approve_match", "replace_match", "keep_match"), "matched").when(d == "reject_match", "rejected").when(d == "needs_more_review", "ambiguous").otherwise(F.col("status"))
    chosen = F.when(d.isin("approve_match", "replace_match"), F.coalesce("proposed", "chosen")).when(d != "reject_match", F.col("chosen")).when(d.isNull(), F.col("chosen"))
    return rows.join(decisions, "node", "left").select("node", status.alias("status"), chosen.alias("chosen"), d.isNotNull().alias("manual"))


def review_table(rows: DataFrame, ranked: DataFrame, k: int = 5) -> DataFrame:
    """Up to k ranked candidates of each unmatched node, or one row without a candidate."""
    open_ = rows.where("status <> 'matched'").select("node", "status")
    return open_.join(ranked.where(F.col("rank") <= k), "node", "left")


def triage(c: dict[str, Column]) -> Column:
    """Struct decision and rule, the first of an ordered list of rules that applies. c has score, second, works,
    second_works, inst (confirmed), inst_score, second_inst, timing, n (candidates), year, name_ok, foreign,
    second_foreign; second values are 0, false or null where there is no second candidate."""
    s, gap, w, w2, n = c["score"], c["score"] - c["second"], c["works"], c["second_works"], c["n"]
    ok, review, no = "approve_match", "needs_more_review", "reject_match"
    fragment = (w2 > 0) & (w >= 5 * w2) & (w >= 10)
    backed = c["inst"] | (c["inst_score"] > 0)
    rules = [
        ("name", ~c["name_ok"], review),
        ("high_confirmed", (s >= 0.95) & c["inst"] & (gap >= 0.05), ok),
        ("tied_fragment", (s >= 0.95) & (gap < 0.05) & fragment & backed, ok),
        ("tied_dominant", (s >= 0.95) & (gap < 0.05) & fragment & ~backed & (w >= 10 * w2), ok),
        ("tied_other_field", (s >= 0.95) & (gap < 0.05) & ~fragment & (n > 1) & c["second_foreign"] & ~c["foreign"] & c["inst"], ok),
        ("confirmed_gap", (s >= 0.85) & c["inst"] & (gap >= 0.10), ok),
        ("confirmed_works", (s >= 0.85) & c["inst"] & (gap >= 0.05) & (w >= 3 * F.greatest(w2, F.lit(1))), ok),
        ("confirmed_close", (s >= 0.85) & c["inst"] & (gap >= 0.05), review),
        ("single_institution", (s >= 0.75) & (n == 1) & backed, ok),
        ("single_timing", (s >= 0.75) & (n == 1) & (c["timing"] > 0) & (w >= 3), ok),
        ("single_bare", (s >= 0.75) & (n == 1), review),
        ("gap_institution", (s >= 0.75) & (gap >= 0.15) & c["inst"], ok),
        ("gap_timing", (s >= 0.75) & (gap >= 0.15) & (c["timing"] > 0), ok),
        ("crowded_tie", (n >= 25) & (gap < 0.05), review),
        ("high_gap", (s >= 0.95) & (gap >= 0.08) & (w >= 5), ok),
        ("perfect", (s >= 1.0) & ((gap >= 0.05) | ((w2 > 0) & (w >= 3 * w2))), ok),
        ("early_career", (c["year"] >= 2025) & (n <= 3) & (w <= 5) & (s >= 0.70), review),
        ("works_dominance", (s >= 0.85) & c["inst"] & (w >= 10) & ((w2 == 0) | (w >= 3 * w2)), ok),
        ("tied_confirmed", (s >= 0.85) & (gap < 0.05) & c["inst"] & ~c["second_inst"], ok),
        ("single_low", (n == 1) & (s >= 0.65), review),
        ("low_crowded", (s < 0.65) & ~c["inst"] & (n >= 25), review),
        ("low", (s < 0.65) & ~c["inst"], no),
    ]
    made = F.when(F.lit(False), F.struct(F.lit("").alias("decision"), F.lit("").alias("rule")))
    for rule, test, decision in rules:
        made = made.when(test, F.struct(F.lit(decision).alias("decision"), F.lit(rule).alias("rule")))
    return made.otherwise(F.struct(F.lit(review).alias("decision"), F.lit("default").alias("rule")))


def recommend(score: Column, gap: Column, current: Column) -> Column:
    """approve, reject or defer; deferred rows need a follow-up."""
    return F.when((score >= 0.95) | ((score >= 0.9) & (gap >= 0.08)), "approve").when(score <= 0.35, "reject").when(current & (score >= 0.85), "approve").otherwise("defer")


def audit(decision: Column, found: Column, works: Column, top: Column) -> Column:
    """flag for approvals with a warning or over 300 works, and for rejections that had a candidate of .95 or more
    with institution support among the first two (top: array of score and institution structs); else pass."""
    risky = (decision == "approve_match") & ((F.size(found) > 0) | (works > 300))
    missed = (decision == "reject_match") & F.exists(F.slice(top, 1, 2), lambda t: (t["score"] >= 0.95) & (t["institution"] > 0))
    return F.when(risky | missed, "flag").otherwise("pass")


def evidence(rows: DataFrame, top: DataFrame, named: DataFrame, k: int = 3) -> DataFrame:
    """node, decision, chosen candidate (by id, else the current one, else rank 1) and the first k candidates.

    rows has node, decision, proposed and current; top (node, candidate, rank, score) the first k candidates of each at least, named (node, candidate)
    those candidates at least that rows name. No list is longer than k.
    """
    first = top.where(F.col("rank") <= k).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("rank", "candidate", "score"))).alias("top"))
    known = named.select("node", "candidate").distinct()
    asked = lambda c: known.select("node", F.col("candidate").alias(c), F.col("candidate").alias(f"__{c}"))
    out = rows.join(first, "node", "left").join(asked("proposed"), ["node", "proposed"], "left").join(asked("current"), ["node", "current"], "left")
    return out.select("node", "decision", F.coalesce("__proposed", "__current", F.get("top", F.lit(0))["candidate"]).alias("selected"), "top")


def decision_code(action: Column, current: Column, selected: Column) -> Column:
    """Code of a reviewer's action: reject, defer, or accept, which keeps, replaces or approves."""
    accept = F.when(selected.isNull(), "needs_more_review").when(current.isNull(), "approve_match").when(current == selected, "keep_match").otherwise("replace_match")
    return F.when(action == "reject", "reject_match").when(action == "accept", accept).otherwise("needs_more_review")


def upsert(existing: DataFrame, updates: DataFrame, key: str, skip: Column | None = None) -> DataFrame:
    """existing with rows of updates (same columns) in place of theirs by key, new ones added; skip leaves updates out."""
    new = updates if skip is None else updates.where(~skip)
    rest = [c for c in existing.columns if c != key]
    return existing.join(new.select(key, F.struct(*rest).alias("__new")), key, "full_outer").select(key, *[F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) for c in rest])


def profile_level(name_ok: Column, overridden: Column, overlap: Column, first_ratio: Column) -> Column:
    """Struct level (high, medium, none) and review score .65 first + .35 min(1, overlap / .6) + .1 up to 1."""
    score = F.least(F.lit(1.0), 0.65 * first_ratio + 0.35 * F.least(F.lit(1.0), overlap / 0.6) + 0.1)
    return F.struct(F.when(~name_ok, "none").when(overridden | (overlap >= 0.6), "high").otherwise("medium").alias("level"), F.round(score, 4).alias("review_score"))


def profile_status(levels: DataFrame, by: list[str] | None = None, n: Column | None = None) -> DataFrame:
    """Per node (or by): found with one high, or one medium and no high; ambiguous with more; else not_found. A row of levels stands for n profiles."""
    of = lambda level: F.sum(F.when(F.col("level") == level, F.lit(1) if n is None else n).otherwise(0))
    high, medium = of("high"), of("medium")
    return levels.groupBy(*by or ["node"]).agg(F.when((high > 1) | ((high == 0) & (medium > 1)), "ambiguous").when(high + medium > 0, "found").otherwise("not_found").alias("status"))


def suspicious(text: Column, cites: Column, h: Column, surname: Column, vague: Column, terms: list[str], common: list[str]) -> Column:
    """A profile whose text has a listed term, or which is very strong while its surname is common or its affiliation vague."""
    return text.rlike("(?i)" + "|".join(terms)) | (((cites >= 10000) | (h >= 40)) & (surname.isin(*common) | vague))


def first_acceptable(candidates: DataFrame, ok: Column, by: list[str] | None = None) -> DataFrame:
    return candidates.where(ok).groupBy(*by or ["node"]).agg(F.min_by("candidate", "position").alias("candidate"))


def backfill(base: DataFrame, patch: DataFrame, key: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(patched, log): non-blank patch values set, blank ones keep, columns in clear_fields are blanked. log has
    key, column and action (backfill, overwrite, clear) of what changed."""
    new = patch.select(key, F.col("clear_fields").alias("__clear"), *[H.coalesce_blank(c).alias(f"__{c}") for c in columns])
    both = base.join(new, key, "left")
    cleared = lambda c: F.coalesce(F.array_contains("__clear", F.lit(c)), F.lit(False))
    value = lambda c: F.when(cleared(c), F.lit(None)).otherwise(F.coalesce(F.col(f"__{c}"), F.col(c)))
    action = lambda c: F.when(cleared(c) & F.col(c).isNotNull(), "clear").when(~cleared(c) & F.col(f"__{c}").isNotNull() & F.col(c).isNull(), "backfill").when(~cleared(c) & F.col(f"__{c}").isNotNull() & (F.col(f"__{c}") != F.col(c)), "overwrite")
    log = both.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), action(c).alias("action")) for c in columns])).alias("x")).select(key, "x.*").where("action is not null")
    return both.select(*[value(c).alias(c) if c in columns else F.col(c) for c in base.columns]), log


def patch_guards(base: DataFrame, patch: DataFrame, key: str, columns: list[str], sources: dict[str, list[str]] | None = None, states: tuple[str, str] | None = None, aliases: dict[str, str] | None = None) -> DataFrame:
    """(key, issue): keys patched twice, unknown keys, unknown columns to clear, columns set and cleared at once; values that need a source and have none (sources: a
    column and the patch's columns of which one must be filled); and states of rows whose country is not the US (states: the patch's columns of state and
    country; aliases of countries are resolved)."""
    twice = patch.groupBy(key).count().where("count > 1").select(key, F.lit("duplicate").alias("issue"))
    lost = patch.select(key).join(base.select(key), key, "left_anti").select(key, F.lit("unknown_key").alias("issue"))
    known = F.array(*[F.lit(c) for c in columns])
    filled = F.filter(F.array(*[F.when(H.coalesce_blank(c).isNotNull(), F.lit(c)) for c in columns]), lambda x: x.isNotNull())
    rules = {"unknown_column": F.size(F.array_except("clear_fields", known)) > 0, "set_and_clear": F.arrays_overlap("clear_fields", filled)}
    for column, proofs in (sources or {}).items():
        rules[f"{column}_without_source"] = H.coalesce_blank(column).isNotNull() & F.coalesce(*[H.coalesce_blank(p) for p in proofs]).isNull()
    if states:
        rules["state_outside_us"] = H.coalesce_blank(states[0]).isNotNull() & ~F.coalesce(H.is_us(states[1], aliases or {}), F.lit(False))
    broken = patch.select(key, F.explode(F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]), lambda x: x.isNotNull())).alias("issue"))
    return twice.unionByName(lost).unionByName(broken)


def merge_panel(panel: DataFrame, enrichment: DataFrame, key: str, fields: list[str], prefix: str, skip_failed: bool = True) -> DataFrame:
    """panel with a prefixed block of fields, filled only where validation (a column of enrichment) is pass or warn,
    or fail when those are not skipped; status says merged, skipped or missing."""
    panel = panel.drop(*[c for c in panel.columns if c.startswith(prefix)])
    e = enrichment.select(key, F.col("validation").alias("__v"), *[F.col(f).alias(f"__{f}") for f in fields])
    good = F.col("__v").isin("pass", "warn") | ((F.col("__v") == "fail") & F.lit(not skip_failed))
    both = panel.join(e, key, "left")
    return both.select(*panel.columns, *[F.when(good, F.col(f"__{f}")).alias(prefix + f) for f in fields], F.when(F.col("__v").isNull(), "missing").when(good, "merged").otherwise("skipped").alias(prefix + "status"))
