"""Column functions on text, names, e-mail addresses and numbers; all native unless a docstring says otherwise.

Blank and null are one state here: functions read null as the empty string and give the empty string or null
where nothing is found, as each docstring says.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import blocks


def _fold_table() -> tuple[str, str, list[tuple[str, str]]]:
    """Latin letters by what they fold to: one-to-one as two strings, the rest as pairs. From Unicode's own
    decompositions, plus letters that have none."""
    single, pairs = {"ø": "o", "Ø": "O", "ı": "i", "İ": "I", "ð": "d", "Ð": "D", "ł": "l", "Ł": "L", "’": "'", "ʼ": "'"}, []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        letter = chr(code)
        plain = "".join(c for c in unicodedata.normalize("NFKD", letter) if not unicodedata.combining(c))
        if plain != letter and letter not in single:
            (single.__setitem__(letter, plain) if len(plain) == 1 else pairs.append((letter, plain)))
    pairs += [("ß", "ss"), ("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE"), ("þ", "th"), ("Þ", "Th")]
    return "".join(single), "".join(single.values()), pairs


_FROM, _TO, _PAIRS = _fold_table()
#: Common one-to-many folds that text really holds; the rest of _PAIRS are ligatures and digraphs.
_MARKS = r"[̀-ͯ]"

EMAIL = r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\.[A-Za-z0-9_]+"
YEAR = r"\b(19[5-9][0-9]|20[0-3][0-9])\b"


def _s(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def squeeze(c: Column) -> Column:
    """White space to single spaces, trimmed."""
    return F.trim(F.regexp_replace(c, r"[ \t-\r]+", " "))


def strip_accents(c: Column | str) -> Column:
    """Accents and strokes folded to plain Latin letters; decomposed marks dropped."""
    out = F.translate(_s(c), _FROM, _TO)
    for letter, plain in _PAIRS:
        if letter in "ßæÆœŒþÞǆǅǄǉǈǇǌǋǊĲĳŉ":
            out = F.replace(out, F.lit(letter), F.lit(plain))
    return F.regexp_replace(out, _MARKS, "")


def strip_accents_exact() -> object:
    """Arrow UDF: compatibility decomposition without combining marks, for scripts beyond Latin."""

    @F.pandas_udf("string")
    def fold(s: pd.Series) -> pd.Series:
        return s.fillna("").map(lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))

    return fold


def norm_person(c: Column | str, parentheticals: bool = True, honorifics: bool = True) -> Column:
    """Person name in lower case letters, digits and single spaces: accents folded, (…) and dr, prof, professor
    dropped on demand, all else to spaces."""
    out = F.lower(strip_accents(c))
    if parentheticals:
        out = F.regexp_replace(out, r"\s*\([^)]*\)", " ")
    if honorifics:
        out = F.regexp_replace(out, r"\b(?:dr|prof|professor)\.?\s*", " ")
    return F.trim(F.regexp_replace(out, "[^a-z0-9]+", " "))


def name_key(first: Column | str, last: Column | str) -> Column:
    """Pair of normalised names."""
    return F.struct(norm_person(first).alias("first"), norm_person(last).alias("last"))


def norm_text(c: Column | str, mode: str = "fold") -> Column:
    """Weaker normal forms. fold: accents folded, lower case alphanumerics; keep: lower case, alphanumerics of any
    script kept; ascii: characters beyond ASCII dropped after folding; letters: letters a-z only, others removed;
    space: white space collapsed and lower case; trim: trimmed and lower case."""
    t = _s(c)
    if mode == "fold":
        return F.trim(F.regexp_replace(F.lower(strip_accents(t)), "[^a-z0-9]+", " "))
    if mode == "keep":
        return F.trim(F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}]+", " "))
    if mode == "ascii":
        return squeeze(F.lower(F.regexp_replace(strip_accents(t), r"[^\x00-\x7F]", "")))
    if mode == "letters":
        return squeeze(F.regexp_replace(F.lower(strip_accents(t)), "[^a-z ]", ""))
    if mode == "space":
        return F.lower(squeeze(t))
    if mode == "trim":
        return F.lower(F.trim(t))
    raise ValueError(mode)


def strip_html(c: Column | str) -> Column:
    return F.regexp_replace(_s(c), "<[^>]+>", "")


def norm_email(c: Column | str) -> Column:
    """Lower case, trimmed, without trailing semicolons."""
    return F.regexp_replace(F.lower(F.trim(_s(c))), "[; ]+$", "")


def split_emails(c: Column | str, commas: bool = False) -> Column:
    """Parts with an @ of a list parted by semicolons or white space (and commas), in order."""
    return F.filter(F.split(F.lower(_s(c)), "[;,\\s]+" if commas else "[;\\s]+"), lambda x: x.contains("@"))


def extract_emails(c: Column | str) -> Column:
    """Addresses in the text, lower case, ordered and distinct."""
    return F.array_distinct(F.transform(F.regexp_extract_all(_s(c), F.lit(EMAIL), 0), lambda x: F.lower(x)))


def without_emails(c: Column | str) -> Column:
    """The text around the addresses."""
    t = _s(c)
    return F.when(t.rlike(EMAIL), F.replace(F.regexp_replace(t, EMAIL, ""), F.lit(";"), F.lit(" "))).otherwise(t)


def fix_email(c: Column | str) -> Column:
    """Where no address is found, the first "user domain.tld" becomes "user@domain.tld" unless user is digits."""
    t, loose = _s(c), r"([A-Za-z0-9_.+-]+)\s+([A-Za-z0-9-]+\.[A-Za-z][A-Za-z0-9.-]*)"
    user = F.regexp_extract(t, loose, 1)
    at = F.instr(t, F.regexp_extract(t, loose, 0))
    fixed = F.concat(F.substring(t, F.lit(1), at - 1), user, F.lit("@"), F.regexp_extract(t, loose, 2), F.substring(t, at + F.length(F.regexp_extract(t, loose, 0)), F.length(t)))
    return F.when(~t.rlike(EMAIL) & (user != "") & ~user.rlike("^[0-9]+$"), fixed).otherwise(t)


def extract_year(c: Column | str) -> Column:
    """First year 1950-2039, or null."""
    return F.regexp_extract(_s(c), YEAR, 1).try_cast("int")


def without_year(c: Column | str) -> Column:
    """The text without that first year."""
    t = _s(c)
    year = F.regexp_extract(t, YEAR, 1)
    # What stands before the year as a word of its own: the same digits may be part of another word before it.
    before = F.length(F.regexp_extract(t, rf"(?s)^(.*?){YEAR}", 1))
    return F.when(year != "", F.concat(F.substring(t, F.lit(1), before), F.substring(t, before + 5, F.length(t)))).otherwise(t)


#: Labels of status that stand in name fields.
STATUS_LABELS = ("in progress", "current", "ongoing", "deceased", "on hold", "expected", "AP at")


def clean_name(c: Column | str) -> Column:
    """Without (…), status labels and punctuation at the edges."""
    out = F.regexp_replace(_s(c), r"\([^)]*\)", "")
    out = F.regexp_replace(out, "(?i)" + "|".join(STATUS_LABELS), "")
    return squeeze(F.regexp_replace(F.regexp_replace(out, r"[,.\s]+$", ""), r"^[,.\s]+", ""))


def looks_like_name(c: Column | str) -> Column:
    """Two words or more and three letters or more."""
    t = squeeze(_s(c))
    return (F.size(F.split(t, " ")) >= 2) & (F.length(F.regexp_replace(t, r"[^\p{L}]", "")) >= 3)


def name_from_email(c: Column | str) -> Column:
    """Name told by the local part: two or more alphabetic parts of two letters or more, capitalised; else ''."""
    parts = F.filter(F.split(F.substring_index(F.lower(_s(c)), "@", 1), "[._-]+"), lambda p: p.rlike(r"^\p{L}{2,}$"))
    return F.when(_s(c).contains("@") & (F.size(parts) >= 2), F.array_join(F.transform(parts, lambda p: F.initcap(p)), " ")).otherwise(F.lit(""))


def email_parts(c: Column | str) -> Column:
    """local and domain; both '' without an @."""
    e = norm_email(c)
    return F.struct(F.when(e.contains("@"), F.substring_index(e, "@", 1)).otherwise("").alias("local"), F.when(e.contains("@"), F.substring_index(e, "@", -1)).otherwise("").alias("domain"))


def split_name(c: Column | str, mode: str = "last") -> Column:
    """first and last by policy: last (what is before the last space, and the last token), first (first token,
    and the rest), ends (first token and last token). One token is a first name under first, a last name else."""
    t = squeeze(_s(c))
    one = ~t.contains(" ")
    if mode == "first":
        first, last = F.substring_index(t, " ", 1), F.when(one, "").otherwise(F.regexp_replace(t, r"^\S+ ", ""))
    elif mode == "ends":
        first, last = F.when(one, "").otherwise(F.substring_index(t, " ", 1)), F.substring_index(t, " ", -1)
    else:
        first, last = F.when(one, "").otherwise(F.regexp_replace(t, r" \S+$", "")), F.substring_index(t, " ", -1)
    return F.struct(first.alias("first"), last.alias("last"))


def name_splits(c: Column | str) -> Column:
    """Candidate (first, last) splits of a name at its first, second and last gap, ordered and distinct."""
    words = F.split(norm_person(c), " ")
    n = F.size(words)
    at = F.filter(F.array_distinct(F.array(F.lit(1), F.lit(2), n - 1)), lambda i: (i >= 1) & (i < n))
    return F.transform(at, lambda i: F.struct(F.array_join(F.slice(words, F.lit(1), i), " ").alias("first"), F.array_join(F.slice(words, i + 1, n - i), " ").alias("last")))


def tokenize_names(c: Column | str) -> Column:
    """Names in free text: parted by line breaks, semicolons, "and" and commas; two single words around a comma
    are one "Last, First" and come out as "First Last"."""
    parts = F.flatten(F.transform(F.split(_s(c), "[\n;]|(?i)\\s+and\\s+"), lambda p: F.array(F.filter(F.transform(F.split(p, ","), lambda x: F.trim(x)), lambda x: x != ""))))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("held"))

    def step(acc: Column, x: Column) -> Column:
        single = ~x.contains(" ")
        joined = F.concat(x, F.lit(" "), acc["held"])
        flushed = F.when(acc["held"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], acc["held"]))
        return (
            F.when(acc["held"].isNotNull() & single, F.struct(F.array_append(acc["done"], joined).alias("done"), F.lit(None).cast("string").alias("held")))
            .when(single, F.struct(flushed.alias("done"), x.alias("held")))
            .otherwise(F.struct(F.array_append(flushed, x).alias("done"), F.lit(None).cast("string").alias("held")))
        )

    def fold(part: Column) -> Column:
        return F.aggregate(part, start, step, lambda acc: F.when(acc["held"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], acc["held"])))

    return F.flatten(F.transform(parts, fold))


def ordered_distinct(values: Column, key=lambda x: x) -> Column:
    """First of the elements that share a derived key, in order; elements whose key is '' are dropped."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("seen"))

    def step(acc: Column, x: Column) -> Column:
        skip = F.array_contains(acc["seen"], key(x)) | (key(x) == "")
        return F.when(skip, acc).otherwise(F.struct(F.array_append(acc["out"], x).alias("out"), F.array_append(acc["seen"], key(x)).alias("seen")))

    return F.aggregate(values, start, step, lambda acc: acc["out"])


def name_variants(c: Column | str) -> Column:
    """The full name, the name without (…), and each parenthetical before the rest; distinct by normal form."""
    t = squeeze(_s(c))
    bare = squeeze(F.regexp_replace(t, r"\([^)]*\)", " "))
    inner = F.transform(F.regexp_extract_all(t, F.lit(r"\(([^)]*)\)"), 1), lambda x: squeeze(F.concat(x, F.lit(" "), F.substring_index(bare, " ", -1))))
    plain = lambda x: norm_person(x, parentheticals=False)
    return ordered_distinct(F.concat(F.array(t, bare), inner), plain)


#: Particles that belong to family names.
PARTICLES = ("de", "da", "del", "della", "van", "von", "di", "la")


def name_queries(c: Column | str) -> Column:
    """Search forms: the variants, each without accents, a quoted nickname with the family name, the name without
    particles, and first with last of names of four words or more."""
    t = squeeze(_s(c))
    base = name_variants(t)
    folded = F.transform(base, lambda x: strip_accents(x))
    nick = F.transform(F.regexp_extract_all(t, F.lit('"([^"]+)"'), 1), lambda x: F.concat(x, F.lit(" "), F.substring_index(t, " ", -1)))
    words = F.split(t, " ")
    lean = F.array_join(F.filter(words, lambda w: ~F.lower(w).isin(*PARTICLES)), " ")
    ends = F.when(F.size(words) >= 4, F.array(F.concat(F.element_at(words, 1), F.lit(" "), F.element_at(words, -1)))).otherwise(F.array().cast("array<string>"))
    return ordered_distinct(F.concat(base, folded, nick, F.array(lean), ends), lambda x: F.lower(x))


#: What announces another name in parentheses, in order of precedence; what ends such a name; and words
#: that show that a short parenthetical is none.
NAME_MARKERS = ("but was ", "formerly ", "previously ", "nee ", "née ", "was ")
NAME_ENDS = ("while", "when", "at", "during", "from", "in")
NAME_STOPWORDS = ("and", "at", "but", "during", "for", "from", "formerly", "i", "in", "my", "nee", "née", "of", "the", "to", "was", "while", "with")


def alt_names(c: Column | str, nicknames: list[tuple[str, str]], limit: int = 4) -> Column:
    """Other names: what a marker in parentheses announces, up to a word that ends it; parentheticals of two words or
    fewer without a stop word; and nicknames of the first name both ways, crossed with up to limit family names."""
    t = squeeze(_s(c))
    bare = squeeze(F.regexp_replace(t, r"\([^)]*\)", " "))

    def announced(chunk: Column) -> Column:
        low = F.lower(chunk)
        after = F.when(F.lit(False), F.lit(""))
        for marker in NAME_MARKERS:
            after = after.when(low.contains(marker), F.substring(chunk, F.instr(low, marker) + len(marker), F.length(chunk)))
        named = F.regexp_replace(after, rf"(?is)\b(?:{'|'.join(NAME_ENDS)})\b.*", "")
        words = F.split(squeeze(chunk), " ")
        short = (F.size(words) <= 2) & ~F.exists(words, lambda w: F.lower(w).isin(*NAME_STOPWORDS))
        return F.trim(F.translate(squeeze(F.coalesce(named, F.when(short, chunk), F.lit(""))), ",;.", ""))

    found = F.filter(F.transform(F.regexp_extract_all(t, F.lit(r"\(([^)]*)\)"), 1), announced), lambda x: x != "")
    first, last = F.lower(F.substring_index(bare, " ", 1)), F.substring_index(bare, " ", -1)
    table = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in nicknames or [("", "")]])
    other = F.transform(F.filter(table, lambda p: (p["a"] == first) | (p["b"] == first)), lambda p: F.initcap(F.when(p["a"] == first, p["b"]).otherwise(p["a"])))
    lasts = F.slice(F.array_distinct(F.concat(F.array(last), F.transform(found, lambda x: F.substring_index(x, " ", -1)))), 1, limit)
    firsts = F.slice(F.array_distinct(F.concat(F.array(F.substring_index(bare, " ", 1)), other)), 1, limit)
    return F.flatten(F.transform(firsts, lambda f: F.transform(lasts, lambda x: F.concat(f, F.lit(" "), x))))


def query_list(name: Column | str, institution: Column | str, limit: int = 14) -> Column:
    """Variants, full name, full name with institution, and folded name; distinct whatever the case, limit long."""
    t = squeeze(_s(name))
    return F.slice(ordered_distinct(F.concat(name_variants(t), F.array(t, squeeze(F.concat(t, F.lit(" "), _s(institution))), strip_accents(t))), lambda x: F.lower(x)), 1, limit)


def norm_affil(c: Column | str) -> Column:
    """norm_text without department, school or college of."""
    return F.trim(F.regexp_replace(norm_text(c), r"\b(?:department|school|college) of\b ?", ""))


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda w: w != "")


def token_overlap(a: Column, b: Column) -> Column:
    """Shared distinct tokens over the smaller set; 0 where one is empty."""
    x, y = F.array_distinct(tokens(_s(a))), F.array_distinct(tokens(_s(b)))
    return F.coalesce(F.size(F.array_intersect(x, y)) / F.nullif(F.least(F.size(x), F.size(y)), F.lit(0)), F.lit(0.0))


def token_containment(a: Column, b: Column, share: float = 0.5) -> Column:
    """Whether that share of a's tokens of over three characters stand in b as substrings."""
    long = F.filter(tokens(_s(a)), lambda w: F.length(w) > 3)
    return F.coalesce(F.size(F.filter(long, lambda w: _s(b).contains(w))) / F.nullif(F.size(long), F.lit(0)) >= share, F.lit(False))


def affil_form(c: Column | str) -> Column:
    """Struct of a normalised institution and its distinct tokens: what affil_similarity compares. Worth computing
    once per institution, before institutions are paired."""
    return let(norm_affil(c), lambda t: F.struct(t.alias("text"), F.array_distinct(tokens(t)).alias("words")))


def affil_similarity(x: Column, y: Column) -> Column:
    """Similarity of two affil_form structs: 1 equal, .75 one holds the other (eight characters or more), .60 overlap
    of .8, .40 overlap of .6, else 0."""
    a, b = x["text"], y["text"]
    holds = (F.length(a) >= 8) & (F.length(b) >= 8) & (a.contains(b) | b.contains(a))
    over = F.coalesce(F.size(F.array_intersect(x["words"], y["words"])) / F.nullif(F.least(F.size(x["words"]), F.size(y["words"])), F.lit(0)), F.lit(0.0))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).when(holds, 0.75).when(over >= 0.8, 0.6).when(over >= 0.6, 0.4).otherwise(0.0)


def inst_similarity(a: Column, b: Column) -> Column:
    """affil_similarity of two names as they are."""
    return let(F.struct(affil_form(a).alias("a"), affil_form(b).alias("b")), lambda p: affil_similarity(p["a"], p["b"]))


def lookup(c: Column, table: dict[str, str]) -> Column:
    """Value of a small fixed table, or null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def country(c: Column | str, aliases: dict[str, str]) -> Column:
    """Country with white space collapsed and aliases (lower case) resolved."""
    t = squeeze(_s(c))
    return F.coalesce(lookup(F.lower(t), aliases), t)


def is_us(c: Column | str, aliases: dict[str, str], values: tuple[str, ...] = ("United States",)) -> Column:
    """Whether a country, white space collapsed and aliases resolved, is one of the given names of the US."""
    return country(c, aliases).isin(*values)


def us_state(state: Column | str, nation: Column, names: dict[str, str], us: str = "United States") -> Column:
    """Two-letter state of rows of the US: an abbreviation as it is, a full name by table; null where unknown or
    where the row is of another country (quality rules report these)."""
    t = squeeze(_s(state))
    return F.when(nation == us, F.when(F.upper(t).isin(*names.values()), F.upper(t)).otherwise(lookup(F.lower(t), names)))


def canon_key(c: Column | str) -> Column:
    """Key of a canonical spelling: lower case, apostrophes straight, without trailing spaces, dots and commas."""
    return F.regexp_replace(F.lower(F.translate(squeeze(_s(c)), "’ʼ", "''")), "[ .,]+$", "")


def nickname_group(c: Column, groups: list[list[str]]) -> Column:
    """Number of the group of given names that go for each other, or null."""
    return lookup(c, {n: str(i) for i, g in enumerate(groups) for n in g}).cast("int")


def nickname_equal(a: Column, b: Column, groups: list[list[str]]) -> Column:
    return F.coalesce((a == b) | (nickname_group(a, groups) == nickname_group(b, groups)), F.lit(False))


def ends(c: Column) -> tuple[Column, Column]:
    """First and last token of a normalised name."""
    return F.substring_index(c, " ", 1), F.substring_index(c, " ", -1)


def same_person(a: Column, b: Column, groups: list[list[str]], first_ratio: Column, last_ratio: Column) -> Column:
    """First reason of a ladder why two normalised full names are one person's, or null. The ratios are ro_ratio of
    their first and of their last tokens; names with fuzzy last tokens need a ratio of .90."""
    (f1, l1), (f2, l2) = ends(a), ends(b)
    one_letter = ((F.length(f1) == 1) | (F.length(f2) == 1)) & (F.substring(f1, 1, 1) == F.substring(f2, 1, 1))
    prefix = (F.least(F.length(f1), F.length(f2)) >= 4) & (f1.startswith(f2) | f2.startswith(f1))
    near = last_ratio >= 0.9
    return F.when((a != "") & (b != ""), (
        F.when(a == b, "exact")
        .when((l1 == l2) & (f1 == f2), "first_last")
        .when((l1 == l2) & nickname_equal(f1, f2, groups), "nickname")
        .when((l1 == l2) & one_letter, "initial")
        .when((l1 == l2) & prefix, "prefix")
        .when(near & (f1 == f2), "fuzzy_last")
        .when(near & (first_ratio >= 0.85), "fuzzy_full")
        .when(near & one_letter, "initial_fuzzy_last")
    ))


def names_compatible(a: Column, b: Column) -> Column:
    """Whether normalised full names can be one person's: same last token, or one's tokens are among the other's
    (an extra initial, a compound surname, another order)."""
    x, y = tokens(a), tokens(b)
    subset = (F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0)
    same_ends = (F.element_at(x, -1) == F.element_at(y, -1)) & (F.substring(F.element_at(x, 1), 1, 1) == F.substring(F.element_at(y, 1), 1, 1))
    return F.coalesce((F.size(x) > 0) & (F.size(y) > 0) & (subset | same_ends), F.lit(False))


def surname_gate(surname: Column, candidate: Column) -> Column:
    """Whether a surname token of three characters or more is among the candidate's tokens."""
    return F.arrays_overlap(F.filter(tokens(surname), lambda w: F.length(w) >= 3), tokens(candidate))


def ro_ratio(a: Column | str, b: Column | str) -> Column:
    """Ratcliff-Obershelp similarity of blocked pairs; the order of arguments matters, and null is empty. A UDF over Arrow batches, in which all
    pairs of a batch advance together (blocks.matched); equal pairs are rated once."""

    # Sent to the workers with the UDF, which need not have this package.
    cloudpickle.register_pickle_by_value(blocks)
    rate = blocks.ratios

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        pairs = pd.DataFrame({"x": x.fillna(""), "y": y.fillna("")})
        which = pairs.groupby(["x", "y"], sort=False).ngroup().to_numpy()
        once = pairs.drop_duplicates()
        return pd.Series(rate(once["x"].tolist(), once["y"].tolist())[which])

    return ratio(a, b)


#: Phrases of a multiple-choice answer on how two people are related, most specific first.
RELATIONS = (("advisor's advisor", 3, "indirect"), ("of my phd advisor", 2, "indirect"), ("advisor of my advisor", 2, "indirect"), ("multiple of my advisors", 2, "indirect"), ("member of my dissertation committee", 1, "committee"), ("my phd advisor", 1, "direct"), ("is my advisor", 1, "direct"))


def relation_class(c: Column | str) -> Column:
    """Struct of a multiple-choice answer: generation (least of direct and indirect, null under review),
    raw_generation (committees too), non_adjacent, direct, committee, indirect, manual_review."""
    choices = F.split(F.translate(F.lower(_s(c)), "’ʼ", "''"), ",")

    def kind(x: Column) -> Column:
        out = F.when(F.lit(False), F.struct(F.lit(0).alias("g"), F.lit("").alias("k")))
        for phrase, g, k in RELATIONS:
            out = out.when(x.contains(phrase), F.struct(F.lit(g).alias("g"), F.lit(k).alias("k")))
        return out

    kinds = F.filter(F.transform(choices, kind), lambda k: k.isNotNull())
    has = lambda k: F.exists(kinds, lambda x: x["k"] == k)
    raw = F.transform(kinds, lambda x: x["g"])
    solid = F.transform(F.filter(kinds, lambda x: x["k"] != "committee"), lambda x: x["g"])
    review = has("committee") & has("indirect") & ~has("direct")
    return F.struct(
        F.when(~review, F.array_min(solid)).alias("generation"),
        F.array_min(raw).alias("raw_generation"),
        F.coalesce(F.array_max(raw) - F.array_min(raw) > 1, F.lit(False)).alias("non_adjacent"),
        has("direct").alias("direct"),
        has("committee").alias("committee"),
        has("indirect").alias("indirect"),
        review.alias("manual_review"),
    )


#: Patterns of lines in listings that name nobody, and of people who don't count.
SKIP_LINES = (r"^\s*$", r"^\s*[*#-]", r"(?i)^\s*n/?a\s*$", r"(?i)^\s*none", r"(?i)^\s*see ", r"(?i)^\s*same as", r"(?i)^\s*note:", r"(?i)^\s*and\s*$", r"^\s*[0-9]+\s*$")
DISQUALIFIED = (r"(?i)did not (?:finish|graduate)", r"(?i)dropped out", r"(?i)left the program", r"(?i)not a (?:student|phd)")
GIBBERISH = ("asdf", "qwerty", "test", "xxx", "aaa", "abc", "foo", "bar")


def text_flags(c: Column | str) -> Column:
    """Struct of flags: skip, disqualified, gibberish, committee_only, unsure."""
    t = _s(c)
    low = F.lower(F.trim(t))
    return F.struct(
        t.rlike("|".join(f"(?:{p})" for p in SKIP_LINES)).alias("skip"),
        t.rlike("|".join(f"(?:{p})" for p in DISQUALIFIED)).alias("disqualified"),
        low.isin(*GIBBERISH).alias("gibberish"),
        (low.contains("committee") & ~low.contains("advisor")).alias("committee_only"),
        (low.startswith("other") | low.contains("not sure")).alias("unsure"),
    )


def parse_bool(c: Column | str) -> Column:
    return F.lower(F.trim(_s(c))).isin("true", "1", "yes")


def parse_int(c: Column | str, missing: int | None = None) -> Column:
    """Integer of a text, or missing where it is none."""
    out = F.trim(_s(c)).try_cast("int")
    return out if missing is None else F.coalesce(out, F.lit(missing))


def decorated_int(c: Column | str) -> Column:
    """Integer of the digits in a text such as 1,234; 0 without digits."""
    return F.coalesce(F.regexp_replace(_s(c), "[^0-9]", "").try_cast("bigint"), F.lit(0).cast("bigint"))


def norm_id(c: Column | str) -> Column:
    """Short identifier at the end of a URL, or the trimmed text: what is behind the last slash or equals sign."""
    return F.regexp_extract(F.trim(_s(c)), r"([^/=?#&]*?)(?:\.html?)?/?(?:[#&].*)?$", 1)


#: Kinds of source that do not settle a case by themselves.
WEAK_SOURCES = ("search", "social", "aggregator", "unknown")


def url_class(url: Column | str, kind: Column | None = None) -> Column:
    """Struct: http, search (a search engine's result page), strong (a URL whose kind is not weak)."""
    u = F.trim(_s(url))
    search = u.rlike(r"(?i)[?&](?:q|query|search)=") | F.lower(u).contains("/search")
    weak = _s(kind).isin(*WEAK_SOURCES) if kind is not None else F.lit(False)
    return F.struct(u.rlike("^https?://").alias("http"), search.alias("search"), ((u != "") & ~weak & ~search).alias("strong"))


def html_ids(c: Column | str, inline: str = r"Short-[Ii][Dd]:\s*([A-Za-z0-9]+)") -> Column:
    """Link targets and inline identifiers of a page, in the order of each kind, distinct."""
    return F.array_distinct(F.concat(F.regexp_extract_all(_s(c), F.lit('href="([^"]+)"'), 1), F.regexp_extract_all(_s(c), F.lit(inline), 1)))


def codes(c: Column | str) -> Column:
    """Distinct subject codes such as N13, the number before "H index" and the number before "Citations"."""
    t = _s(c)
    return F.struct(F.array_distinct(F.regexp_extract_all(t, F.lit(r"\b([A-Z][0-9]{2})\b"), 1)).alias("subjects"), F.regexp_extract(t, r"([0-9]+)\s+H index", 1).try_cast("int").alias("h_index"), decorated_int(F.regexp_extract(t, r"([0-9,]+)\s+Citations", 1)).alias("citations"))


def preview(papers: Column, limit: int = 3) -> Column:
    """"title (year), cites=n" of the first papers, joined by semicolons; papers are structs title, year, citations."""
    one = lambda p: F.concat(_s(p["title"]), F.lit(" ("), F.coalesce(p["year"].cast("string"), F.lit("?")), F.lit("), cites="), F.coalesce(p["citations"].cast("string"), F.lit("0")))
    return F.array_join(F.transform(F.slice(papers, 1, limit), one), "; ")


def coalesce_blank(*cols: Column | str) -> Column:
    """First that is not blank, or null."""
    return F.coalesce(*[F.nullif(F.trim(_s(c)), F.lit("")) for c in cols])


def format_rate(n: Column, total: Column) -> Column:
    """n/N (p%), n/a where N is 0; one decimal, halves away from zero."""
    return F.when(total == 0, "n/a").otherwise(F.concat(n.cast("string"), F.lit("/"), total.cast("string"), F.lit(" ("), F.format_string("%.1f", F.round(100.0 * n / F.nullif(total, F.lit(0)), 1)), F.lit("%)")))


def slug(c: Column | str) -> Column:
    return F.regexp_replace(norm_text(c), " ", "-")
