"""Surrogates for personal data: detected entities get keyed replacements of the same type and format.

The surrogate of an entity is a function of a secret key, its type and its normalised form, so the same entity
has the same surrogate in every document (coreference), with no table to look up. Format is kept character class
by character class: digits become digits, letters become letters of the same case and script, separators stay,
and parts that carry meaning do too (a phone's country code, the reserved range of an address, a check digit that
was valid). Names are replaced by names of the same script, and given names of the same gender, in the same case.
A person's name is known by its parts: the given name, and each part of the family name (of Smith-Jones both, of
O'Neil the second, of de la Cruz the last), so forms and coreference stay part by part. Once a name is found in a
document, all its mentions there are replaced: alone, in capitals, within hyphenated names, earlier or later. Gender is
no part of who somebody is; what titles tell of a given name is summed up over the corpus.

Distinctness: distinct entities whose surrogates collide with each other's, or with an entity that occurs in the
corpus (names compared without case), are found by an aggregation over the distinct entities, and get
a further attempt under another tweak, until none collide. From attempt WIDER on the format gives way where it
leaves too few values. Only entities that needed more than one attempt are joined to the documents.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import staged

#: Key under which surrogates are drawn when none is given; production runs pass their own.
DEFAULT_KEY = b"heddle surrogate key"
ROUNDS = 12
#: The attempt from which small classes are widened, and how many times ROUNDS may pass before assign() raises.
WIDER, PATIENCE = 4, 8

#: Common given names by script and gender, and family names by script.
GIVEN = {
    ("latin", "f"): "Anna Maria Emma Laura Julia Sofia Clara Elena Alice Lucia Marta Nina Paula Rosa Sara Eva Irene Carmen Louise Camille Jane Emily Mary Susan Karen Linda Nancy Helen Claire Sophie".split(),
    ("latin", "m"): "John James Peter Paul David Thomas Michael Robert Daniel Martin Carlos Pedro Luis Jorge Antonio Hans Karl Otto Fritz Jean Pierre Louis Henri Marc Luc Alan Brian Kevin Eric George".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Юлия Екатерина".split(),
    ("cyrillic", "m"): "Иван Пётр Алексей Сергей Дмитрий Николай Андрей Михаил Владимир Павел".split(),
    ("greek", "f"): "Μαρία Ελένη Άννα Σοφία Κατερίνα Γεωργία".split(),
    ("greek", "m"): "Γιώργος Νίκος Κώστας Δημήτρης Παύλος Ανδρέας".split(),
}
FAMILY = {
    "latin": "Smith Miller Brown Taylor Wilson Martin Bernard Dubois Moreau Laurent Schmidt Schneider Fischer Weber Wagner Becker Garcia Lopez Martinez Sanchez Romero Torres Navarro Dominguez Rossi Ferrari Novak Jensen Larsen Berg".split(),
    "cyrillic": "Иванов Смирнов Кузнецов Попов Соколов Лебедев Козлов Новиков Морозов Волков".split(),
    "greek": "Παπαδόπουλος Γεωργίου Νικολάου Δημητρίου Ιωάννου Οικονόμου".split(),
}
#: Titles that go before a name, by the gender that they tell.
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f", "Don": "m", "Doña": "f", "Dr": "", "Prof": ""}

#: Small words that belong to family names and stay as they are.
PARTICLES = "de da do dos das del della der den di du la le los las van von zu zum zur ter ten af av bin ibn al el y e".split()

_UPPER, _LETTER = r"[^\W\d_a-zà-öø-ÿа-яё]", r"[^\W\d_]"
_CAP = rf"{_UPPER}{_LETTER}+"
#: A word of a name with its apostrophes and hyphens; the s of a possessive is none of it.
_WORD = rf"{_UPPER}(?:['’](?!s\b){_LETTER}|{_LETTER})+(?:-{_LETTER}(?:['’](?!s\b){_LETTER}|{_LETTER})*)*"
_LAST = rf"(?:(?:{'|'.join(sorted(PARTICLES, key=len, reverse=True))}) )*{_WORD}"
_PART = re.compile(rf"{_LETTER}{{2,}}")
_GENDER = {n.lower(): g for (_, g), names in GIVEN.items() for n in names}
_NAMES = [n for names in GIVEN.values() for n in names]
_TITLE = "|".join(sorted(TITLES, key=len, reverse=True))
_FIRST = "|".join(sorted(_NAMES, key=len, reverse=True))

#: What is found, in order of precedence at one position.
PATTERN = re.compile(
    "|".join(
        (
            r"(?P<email>(?<![\w.+%-])[\w.+%-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,})",
            r"(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b)",
            r"(?P<secret>(?i:\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\b\s*[=:]\s*[\"']?)(?P<secret_value>[A-Za-z0-9_\-+/=]{8,}))",
            r"(?P<ipv4>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d))",
            r"(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))",
            r"(?P<card>(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-]))",
            r"(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])(?:\d{2,4}[ .-])?\d{3,4}(?![\w]))",
            r"(?P<hex>(?<![\w])(?=[0-9a-f]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{32,}(?![\w]))",
            rf"(?P<name>\b(?:(?P<title>{_TITLE})\.? (?:(?P<t_first>{_CAP}) (?P<t_last>{_LAST})|(?P<t_only>{_LAST}))|(?P<first>{_FIRST}) (?P<last>{_LAST})))",
        )
    )
)
#: A native test that every text with an entity passes: a digit of any script or @, a word that announces a secret, or
#: a title or given name with the space that follows it. Word borders are left out, which Java and Python see in
#: different places; the look-ahead rejects most positions before the names are tried.
_PREFILTER = r"[\p{Nd}@]|(?iu:token|secret|passw|api[_-]?key|access[_-]?key)|(?=[A-Z\u0370-\u04FF])(?:(?:" + _TITLE + r")\.? |(?:" + _FIRST + ") )"

_COUNTRY_CODE = re.compile(r"\+\d{1,3}")


class _Stream:
    """Keyed random numbers for one entity and attempt."""

    def __init__(self, key: bytes, kind: str, entity: str, attempt: int):
        self.seed = hashlib.blake2b(f"{kind}\x00{attempt}\x00{entity}".encode(), key=key[:64], digest_size=32).digest()
        self.block, self.pool = 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool = hashlib.blake2b(self.seed, salt=self.block.to_bytes(8, "big")).digest()
            self.block += 1
        value, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return value * n >> 32


_ALPHABETS = [("abcdefghijklmnopqrstuvwxyz", "a", "z"), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "A", "Z"), ("абвгдежзиклмнопрстуфхцчшщэюя", "а", "я"), ("АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ", "А", "Я"), ("αβγδεζηθικλμνξοπρστυφχψω", "α", "ω"), ("ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", "Α", "Ω")]


def _like(c: str, draw: _Stream) -> str:
    """A random character of the same class: digit, or letter of the same script and case; others stay."""
    if c.isdigit():
        return str(draw.below(10))
    for letters, low, high in _ALPHABETS:
        if low <= c <= high:
            return letters[draw.below(len(letters))]
    if c.isalpha():
        return "ABCDEFGHIJKLMNOPQRSTUVWXYZ"[draw.below(26)] if c.isupper() else "abcdefghijklmnopqrstuvwxyz"[draw.below(26)]
    return c


def _luhn(digits: list[int]) -> int:
    """Luhn sum of digits modulo 10; 0 for a valid number."""
    return sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(reversed(digits))) % 10


def _script(name: str) -> str:
    c = next((c for c in name if c.isalpha()), "a")
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" else "latin"


def _cased(model: str, text: str) -> str:
    return text.upper() if model.isupper() and len(model) > 1 else text


def surrogate(kind: str, entity: str, key: bytes, attempt: int = 0, gender: str = "") -> str:
    """The replacement of one normalised entity, in its canonical form. gender is for given names that are not listed."""
    draw = _Stream(key, kind, entity, attempt)
    if kind == "email":
        local, _, domain = entity.partition("@")
        labels = domain.split(".")
        # Reserved domains stay as they are below the top two labels, others go to a reserved one.
        tail = labels[-2:] if labels[-2] == "example" else ["example", labels[-1] if labels[-1] in ("com", "net", "org") else "com"]
        head = ["".join(_like(c, draw) for c in x) for x in labels[:-2]] or (["".join(_like(c, draw) for c in labels[0])] if labels[-2] != "example" else [])
        more = "".join(_like("a", draw) for _ in range(max(0, attempt - WIDER + 1)))
        return "".join(_like(c, draw) for c in local) + more + "@" + ".".join([*head, *tail])
    if kind == "ipv4":
        parts = [int(x) for x in entity.split(".")]
        # Private and reserved first bytes stay, so that the address stays of its kind and has as many digits.
        keep = 2 if parts[:2] in ([192, 168],) else 1 if parts[0] in (0, 10, 127) or parts[0] >= 224 else 0
        out = []
        if attempt >= 2 * WIDER and keep == 2:
            parts, keep = [10, *parts[1:]], 1
        for i, p in enumerate(parts):
            if attempt >= WIDER and i >= keep:
                out.append(draw.below(256) if i else 11 + draw.below(116))
                continue
            low, high = (0, 9) if p < 10 else (10, 99) if p < 100 else (100, 255 if i else 223)
            out.append(p if i < keep else low + draw.below(high - low + 1))
        return ".".join(map(str, out))
    if kind == "card":
        digits = [int(c) for c in entity]
        fresh = [digits[0], *(draw.below(10) for _ in digits[1:])]
        valid = _luhn(digits) == 0
        if (_luhn(fresh) == 0) != valid:
            # Exactly one last digit makes a valid number: take it, or step off it.
            fresh[-1] = next(d for d in range(10) if (_luhn([*fresh[:-1], d]) == 0) == valid)
        return "".join(map(str, fresh))
    if kind == "iban":
        body = "".join(_like(c, draw) for c in entity[4:])
        number = int("".join(str(int(c, 36)) for c in body + entity[:2] + "00"))
        return entity[:2] + f"{98 - number % 97:02d}" + body
    if kind == "phone":
        return "".join(c if i < _phone_prefix(entity) else _like(c, draw) for i, c in enumerate(entity))
    if kind == "ssn":
        return "9" + "".join(_like(c, draw) for c in entity[1:])
    if kind == "given":
        return _given(entity, _GENDER.get(entity, gender), attempt, draw)
    if kind == "family":
        return _family(entity, attempt, draw)
    if kind == "hex":
        return "".join("0123456789abcdef"[draw.below(16)] for _ in entity)
    if attempt >= WIDER and kind == "secret":
        return "".join(_like("a" if c in "_-+/=" else c, draw) for c in entity)
    hexadecimal = re.fullmatch(r"[0-9a-f]+", entity)
    return "".join("0123456789abcdef"[draw.below(16)] if hexadecimal else _like(c, draw) for c in entity)


#: Endings of women's family names in Russian, and of names in Greek that only men have.
WOMEN, MEN = ("ова", "ева", "ёва", "ина", "ына", "ая"), "ς"


#: Sounds that names are built of by script: beginnings, vowels, and what closes a syllable; endings of family names (for any gender, for women, for
#: men) and of given names (for women, for men).
SOUNDS = {
    "latin": ("B Br C Cl D Dr F Fl G Gr H J K Kr L M N P R S St T Tr V W".split(), "a e i o u".split(), "l n r s t m nd rt ll ck v z".split()),
    "cyrillic": ("Б В Г Д З К Л М Н П Р С Т Ф Х".split(), "а е и о у".split(), "л н р с т м в к".split()),
    "greek": ("Β Γ Δ Κ Λ Μ Ν Π Ρ Σ Τ Φ Χ".split(), "α ε ι ο".split(), "λ ν ρ σ τ μ δ κ".split()),
}
FAMILY_ENDS = {"latin": "er mann son sen ini elli etti ez ano ard ier ow ski ak berg feld dal by ton ley wood worth ham stein holm lund quist ner".split(), "cyrillic": "ов ев ин".split(), "greek": "ίου άκη έα".split()}
GREEK_MEN = "όπουλος ίδης άκης".split()
GIVEN_ENDS = {("latin", "f"): "a ia ina elle ette ita anne".split(), ("latin", "m"): "o us an ert ik as en ardo".split(), ("cyrillic", "f"): "а ия ина".split(), ("cyrillic", "m"): "ей ан ир ислав".split(), ("greek", "f"): "α ία η".split(), ("greek", "m"): "ος ης ας".split()}


def _built(script: str, ends: list[str], attempt: int, draw: _Stream) -> str:
    """A name of one part: a syllable and an ending (tens of thousands in Latin script), from the third attempt on with syllables between, so
    that there are enough at any size."""
    starts, vowels, closes = SOUNDS[script]
    pick = lambda values: values[draw.below(len(values))]
    out = pick(starts) + pick(vowels) + pick(closes)
    for _ in range((attempt - 1) // 2):
        out += pick(vowels) + pick(closes)
    return out + pick(ends)


def _given(entity: str, gender: str, attempt: int, draw: _Stream) -> str:
    """A given name of the gender, or of either where none is known: a common one first, then built ones."""
    script = _script(entity)
    genders = [gender] if gender else ["f", "m"]
    if not attempt:
        pool = [n for g in genders for n in GIVEN[script, g] if n.lower() != entity]
        return pool[draw.below(len(pool))]
    return _built(script, [e for g in genders for e in GIVEN_ENDS[script, g]], attempt, draw)


def _family(entity: str, attempt: int, draw: _Stream) -> str:
    """A family name, in the form for the entity's gender where the script tells one: a common one first, then built ones."""
    script = _script(entity)
    woman = script == "cyrillic" and entity.endswith(WOMEN)
    man = script == "greek" and entity.endswith(MEN)
    pool = [n for n in FAMILY[script] if n.lower() != entity and (script != "greek" or n.endswith(MEN) == man)]
    if pool and not attempt:
        return pool[draw.below(len(pool))] + ("а" if woman else "")
    return _built(script, GREEK_MEN if man else FAMILY_ENDS[script], attempt, draw) + ("а" if woman else "")


def _phone_prefix(entity: str) -> int:
    m = _COUNTRY_CODE.match(entity)
    return m.end() if m else 0


def _parts(text: str, start: int, stop: int) -> list[tuple[int, int, str, str]]:
    """The parts of a family name at a place; particles and single letters are none."""
    return [(p.start(), p.end(), "family", p[0].lower()) for p in _PART.finditer(text, start, stop) if p[0] not in PARTICLES]


def _mentions(text: str, spans: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Further mentions of the names among spans: words that are a name's part as it was written, with a capital or in capitals; in small letters a given
    name before a family name."""
    names = {e: k for k in ("given", "family") for _, _, kind, e in spans if kind == k}
    taken = [(a, b) for a, b, _, _ in spans]
    inside = lambda i: (at := bisect(taken, (i, len(text) + 1))) and taken[at - 1][1] > i
    wordlike = lambda i: 0 <= i < len(text) and (text[i].isalnum() or text[i] == "_")
    out = []

    def places(form: str) -> Iterator[int]:
        i = text.find(form)
        while i >= 0:
            if not (wordlike(i - 1) or wordlike(i + len(form)) or inside(i)):
                yield i
            i = text.find(form, i + len(form))

    for entity, kind in names.items():
        for form in {entity.capitalize(), entity.upper(), *(text[a:b] for a, b, _, e in spans if e == entity)}:
            out += [(i, i + len(form), kind, entity) for i in places(form)]
    small = [(i, i + len(e), k, e) for e, k in names.items() for i in places(e)]
    after = {a: x for x in small if x[2] == "family" for a in [x[0]]}
    for x in small:
        if x[2] == "given" and text[x[1] : x[1] + 1] == " " and x[1] + 1 in after:
            out += [x, after[x[1] + 1]]
    return sorted(set(out))


def found(text: str, genders: dict[str, str] | None = None) -> list[tuple[int, int, str, str]]:
    """start, stop, kind and canonical form of the entities of a text, in order and without overlaps. What titles tell of given names is put into genders."""
    out = []
    named = False
    for m in PATTERN.finditer(text):
        kind = m.lastgroup
        if m["email"]:
            out.append((m.start(), m.end(), "email", m["email"].lower()))
        elif m["secret"]:
            out.append((m.start("secret_value"), m.end("secret_value"), "secret", m["secret_value"]))
        elif m["name"]:
            named = True
            if m["t_only"]:
                out += _parts(text, m.start("t_only"), m.end("t_only"))
                continue
            first, last = ("t_first", "t_last") if m["title"] else ("first", "last")
            entity = m[first].lower()
            out.append((m.start(first), m.end(first), "given", entity))
            out += _parts(text, m.start(last), m.end(last))
            if genders is not None and m["title"] and TITLES[m["title"]]:
                genders[entity] = TITLES[m["title"]]
        elif m["card"]:
            out.append((m.start(), m.end(), "card", re.sub(r"\D", "", m[0])))
        elif m["iban"]:
            out.append((m.start(), m.end(), "iban", m[0].replace(" ", "")))
        elif m["phone"]:
            if sum(c.isdigit() for c in m[0]) >= 7:
                # Country code and digits identify a number; how it is grouped doesn't.
                out.append((m.start(), m.end(), "phone", ("+" + re.sub(r"\D", "", m["phone"].split("(")[0].split(" ")[0].split("-")[0].split(".")[0]) + " " if m[0][0] == "+" else "") + re.sub(r"\D", "", m[0][_phone_prefix(m[0]) :])))
        else:
            kind = next(k for k in ("ipv4", "ssn", "hex") if m[k])
            out.append((m.start(), m.end(), kind, m[0]))
    return sorted(out + _mentions(text, out)) if named else out


def dressed(kind: str, original: str, canonical: str) -> str:
    """A surrogate in canonical form, in the format of the original."""
    if kind in ("given", "family"):
        return canonical.lower() if original.islower() else _cased(original, canonical)
    if kind == "phone":
        start = _phone_prefix(original)
        digits = iter(canonical.partition(" ")[2] if start else canonical)
        return original[:start] + "".join(next(digits) if c.isdigit() else c for c in original[start:])
    if kind in ("card", "iban"):
        chars = iter(canonical)
        return "".join(next(chars) if c.isalnum() else c for c in original)
    if kind == "email" and original.isupper():
        return canonical.upper()
    return canonical


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def occurrences(texts: DataFrame) -> DataFrame:
    """__key, kind, entity (canonical form) and gender (what titles in the text tell of a given name) of the distinct entities of each text, from rows
    (__text, __key)."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = []
            for text, k in zip(texts, keys, strict=True):
                genders: dict[str, str] = {}
                rows += [(k, kind, e, genders.get(e, "") if kind == "given" else "") for kind, e in sorted({y[2:] for y in found(text, genders)})]
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.string()) for c in cols[1:])], ["__key", "kind", "entity", "gender"])

    return texts.select("__text", "__key").where(F.col("__text").rlike(_PREFILTER)).mapInArrow(scan, "__key long, kind string, entity string, gender string")


def _form(kind: str, canonical: str) -> str:
    """What a reader can tell of an entity or a surrogate: names without case."""
    return canonical.lower() if kind in ("given", "family") else canonical


def _drawn(rows: DataFrame, key: bytes) -> DataFrame:
    """kind, entity, gender, attempt, the surrogate that the attempt gives, and the forms of both."""

    def draw(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [surrogate(k, e, key, a, g) for k, e, g, a in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            kinds, own = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            forms = [pa.array([_form(k, x) for k, x in zip(kinds, col, strict=True)], pa.string()) for col in (own, made)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string()), *forms], ["kind", "entity", "gender", "attempt", "surrogate", "own", "form"])

    return rows.select("kind", "entity", "gender", "attempt").mapInArrow(draw, "kind string, entity string, gender string, attempt int, surrogate string, own string, form string")


def assign(distinct: DataFrame, key: bytes = DEFAULT_KEY, rounds: int = ROUNDS) -> DataFrame:
    """kind, entity, gender, attempt, surrogate for distinct (kind, entity), with gender or without: no two entities of a kind share a surrogate,
    and none is itself an entity of the corpus. Who came first keeps a contested surrogate (smaller attempt, then
    smaller entity); the others draw again until no clash is left. Where a class has no values left in PATIENCE
    times so many rounds, this raises instead of sharing surrogates or leaving entities as they are."""
    told = distinct if "gender" in distinct.columns else distinct.withColumn("gender", F.lit(""))
    now = staged(_drawn(told.withColumn("attempt", F.lit(0)), key), "drawn")
    taken = now.select(F.col("kind").alias("k"), F.col("own").alias("e")).distinct()
    columns = ["kind", "entity", "gender", "attempt", "surrogate", "own", "form"]
    for _ in range(PATIENCE * rounds):
        first = now.groupBy("kind", "form").agg(F.min(F.struct("attempt", "entity")).alias("x"), F.count("*").alias("n")).where("n > 1").select(F.col("kind").alias("fk"), F.col("form").alias("fs"), F.col("x.entity").alias("winner"))
        marked = now.join(first, (F.col("kind") == F.col("fk")) & (F.col("form") == F.col("fs")), "left")
        marked = marked.join(taken, (F.col("kind") == F.col("k")) & (F.col("form") == F.col("e")), "left")
        clash = (F.col("winner").isNotNull() & (F.col("winner") != F.col("entity"))) | F.col("e").isNotNull()
        marked = staged(marked.select(*columns, F.coalesce(clash, F.lit(False)).alias("clash")), "marked")
        if not marked.where("clash").limit(1).count():
            return marked.select("kind", "entity", "gender", "attempt", "surrogate")
        again = _drawn(marked.where("clash").select("kind", "entity", "gender", (F.col("attempt") + 1).alias("attempt")), key)
        now = staged(marked.where("not clash").drop("clash").unionByName(again), "drawn")
    raise ValueError(f"surrogates still collide after {PATIENCE * rounds} rounds: {[tuple(r) for r in marked.where('clash').groupBy('kind').count().collect()]}")


def replace_entities(docs: DataFrame, key: bytes = DEFAULT_KEY, with_spans: bool = False) -> DataFrame:
    """docs with text in which every entity is replaced; with_spans adds spans (kind, start, stop, surrogate,
    positions in code points of the new text), in place of a column of that name. Other columns stay, but n_chars is
    counted again.

    Null text becomes empty, empty text and text without entities stay as they are, very long texts are read whole,
    and rows that repeat are replaced alike. An empty table stays empty.
    """
    rest = [c for c in docs.columns if c != "text"]
    plain = docs.select(*rest, _text().alias("__text")).withColumn("__key", F.xxhash64("__text"))
    # Texts are read for entities once; what is found serves the draws and the documents' late attempts.
    known = staged(occurrences(plain), "entities")
    of = lambda g: F.count_if(F.col("gender") == g)
    told = known.groupBy("kind", "entity").agg(F.when(of("f") + of("m") == 0, "").when(of("m") > of("f"), "m").otherwise("f").alias("gender"))
    mapping = assign(told, key)
    late = mapping.where("attempt > 0 or gender <> ''").select("kind", "entity", "attempt", "gender")
    known = known.select("__key", "kind", "entity")
    # Attempts beyond the first and genders that titles tell, gathered by text: documents without such entities meet an empty side.
    tweaks = staged(known.join(late, ["kind", "entity"]).distinct().groupBy("__key").agg(F.collect_list(F.struct("kind", "entity", "attempt", "gender")).alias("__late")), "tweaks")
    if tweaks.limit(1).count():
        plain = plain.join(tweaks, "__key", "left")
    else:
        plain = plain.withColumn("__late", F.lit(None).cast("array<struct<kind:string,entity:string,attempt:int,gender:string>>"))
    span = "array<struct<kind:string,start:int,stop:int,surrogate:string>>"
    schema = plain.select(*rest).schema.add("text", "string").add("__spans", T.DataType.fromDDL(span))
    width = len(rest)

    def swap(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[str, str, int, str], str] = {}
        for batch in batches:
            texts, spans = [], []
            for text, tweak in zip(batch.column(width).to_pylist(), batch.column(width + 1).to_pylist(), strict=True):
                told = {(x["kind"], x["entity"]): (x["attempt"], x["gender"]) for x in tweak or ()}
                out, mine, pos, size = [], [], 0, 0
                for start, stop, kind, entity in found(text):
                    at = (kind, entity, *told.get((kind, entity), (0, "")))
                    if at not in kept:
                        if len(kept) > 100_000:
                            kept.clear()
                        kept[at] = surrogate(kind, entity, key, *at[2:])
                    new = dressed(kind, text[start:stop], kept[at])
                    out += [text[pos:start], new]
                    size += start - pos + len(new)
                    mine.append({"kind": kind, "start": size - len(new), "stop": size, "surrogate": new})
                    pos = stop
                texts.append("".join([*out, text[pos:]]))
                spans.append(mine)
            kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("surrogate", pa.string())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(texts, pa.string()), pa.array(spans, kinds)], [*rest, "text", "__spans"])

    # Texts without an entity skip Python.
    some = F.col("__text").rlike(_PREFILTER)
    swapped = plain.where(some).select(*rest, "__text", "__late").mapInArrow(swap, schema)
    same = plain.where(~some).select(*rest, F.col("__text").alias("text"), F.array().cast(span).alias("__spans"))
    out = swapped.unionByName(same)
    cols = [*docs.columns] if "text" in docs.columns else [*docs.columns, "text"]
    fresh = {"n_chars": F.length("text").cast("long").alias("n_chars")}
    spans = [F.col("__spans").alias("spans")] if with_spans else []
    return out.select(*[fresh.get(c, F.col(c)) for c in cols if not (with_spans and c == "spans")], *spans)


def surrogate_digest(docs: DataFrame, key: bytes = DEFAULT_KEY) -> DataFrame:
    """doc_id, n_entities, kinds (sorted, distinct), surrogates (in order) and the new text, per row."""
    out = replace_entities(docs.select("doc_id", "text"), key, with_spans=True)
    return out.select("doc_id", F.size("spans").cast("long").alias("n_entities"), F.array_join(F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["kind"]))), ",").alias("kinds"), F.transform("spans", lambda s: s["surrogate"]).alias("surrogates"), "text")
