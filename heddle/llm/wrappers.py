"""Main text of web pages by wrapper induction.

The pages of a host are made by few templates. The commonest outlines of each host (the reference trees) stand for
these; every other outline is aligned with the nearest of them by simple tree matching, in which runs of like siblings
count as one node, and matching nodes have one name. For each aligned node Spark counts on how many of the pages that
hold it each text stands there: a text that most of them share is template, in an article too, and a node whose text
varies is a slot for content, wherever it stands. Names of elements and classes decide only what counts leave open:
slots within menus, footers, adverts, forms and the like are not content, and at nodes of too few pages for a count,
text outside an article gives way to the article's.

What is shuffled are outlines (once per host and shape), hashes of texts, and at the end the texts of slots with the
places in each page that are template. Trees are walked without recursion, so pages may be nested as deep as they like.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ._common import staged

#: Reference trees per host; a text at a node of so many pages, and of such a share of them, is template.
REFERENCES, MIN_PAGES, TEMPLATE_SHARE = 3, 5, 0.5
#: Within an article or main element, so many times the pages are needed.
ARTICLE_EVIDENCE = 2
#: Stands for the hash of a text where a node is counted by itself.
ANY = 0

#: Element names of HTML by their part in a page.
RAW = frozenset("script style noscript template svg math textarea iframe object canvas title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CHROME = frozenset("nav header footer aside form button select input menu dialog head fieldset".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar toolbar".split())
CHROME_WORDS = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice popup promo promoted related reply replies responses share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
#: Elements and class names that hold content, whatever other words stand in their class.
CONTENT = frozenset("html body main article".split())
STATES = frozenset("has with without no is".split())
HEADED = frozenset("article post entry story content".split())
CLOSES = {"p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
LISTS = frozenset("ul ol dl table body article section div main".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")


class Node:
    """An element of the tree whose like children are one node; all chrome of a page is one node without children."""

    __slots__ = ("label", "children", "chrome", "parent", "number")

    def __init__(self, label: str, chrome: bool, parent: Node | None):
        self.label, self.chrome, self.parent = label, chrome, parent
        self.children: dict[str, Node] = {}
        self.number = -1


def _chrome(tag: str, attrs: dict[str, str], inside_article: bool) -> bool:
    if tag in CHROME and not (tag == "header" and inside_article):
        return True
    if attrs.get("role", "").lower() in CHROME_ROLES:
        return True
    return tag not in CONTENT and any(_chrome_word(x, inside_article) for k in ("class", "id") if k in attrs for x in attrs[k].lower().split())


def _chrome_word(token: str, inside_article: bool) -> bool:
    """Whether a class or id names chrome: has-sidebar tells a state, and article-header is an article's own header."""
    words = _SPLIT.split(token)
    if words[0] in STATES:
        return False
    own = inside_article or words[0] in HEADED
    return any(w in CHROME_WORDS and not (own and w == "header") for w in words)


def parse(page: str) -> tuple[list[Node], list[tuple[Node, str, bool]]]:
    """Nodes of a page level by level, and its blocks of text in order: node, text, whether it stands within an article
    or main element. Chrome makes no blocks."""
    root, chrome_node = Node("#", False, None), Node("#chrome", True, None)
    # Tag, node, whether within an article, and the node of the nearest block element.
    stack: list[tuple[str, Node, bool, Node]] = [("#", root, False, root)]
    opened: Counter[str] = Counter()
    blocks: list[tuple[Node, str, bool]] = []
    held: list[str] = []
    pos, n = 0, len(page)

    def flush() -> None:
        if held:
            top = stack[-1]
            text = "" if top[1].chrome else " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                blocks.append((top[3], text, top[2]))

    def push(tag: str, node: Node, inside: bool, block: Node) -> None:
        stack.append((tag, node, inside, block))
        opened[tag] += 1

    def close(i: int) -> None:
        """Closes the elements from place i on."""
        for x in stack[i:]:
            opened[x[0]] -= 1
        del stack[i:]

    while pos < n:
        m = _TOKEN.search(page, pos)
        if not m:
            held.append(page[pos:])
            break
        if m.start() > pos:
            held.append(page[pos : m.start()])
        pos = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if tag in RAW:
            if not m[1] and not m[0].endswith("/>"):
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, pos)
                pos = end.end() if end else n
            continue
        if m[1]:
            inline = tag in INLINE
            if not inline:
                flush()
            if opened[tag]:
                i = len(stack) - 1
                while stack[i][0] != tag:
                    i -= 1
                    if inline and stack[i][0] not in INLINE and stack[i][0] != tag:
                        i = 0
                        break
                if i:
                    if inline and any(x[1] is not stack[i - 1][1] for x in stack[i:]):
                        flush()
                    if inline and all(x[0] in INLINE for x in stack[i:]) and i < len(stack) - 1:
                        # Only the named one of misnested inline elements ends.
                        opened[tag] -= 1
                        del stack[i]
                    else:
                        close(i)
            continue
        if tag == "br":
            held.append(" ")
        attrs = {a[0].lower(): a[1] or a[2] or a[3] for a in _ATTR.findall(m[3])} if m[3] else {}
        _, parent, inside, block = stack[-1]
        if tag in INLINE:
            if tag in VOID:
                continue
            if parent.chrome or not (attrs and _chrome(tag, attrs, inside)):
                push(tag, parent, inside, block)
                continue
        flush()
        if tag in VOID:
            continue
        if tag in CLOSES:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in CLOSES[tag]:
                    close(i)
                    break
                if stack[i][0] in LISTS:
                    break
        elif tag not in INLINE and opened["p"]:
            # A block ends an open paragraph.
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] not in INLINE:
                    break
        _, parent, inside, block = stack[-1]
        if parent.chrome or _chrome(tag, attrs, inside):
            node = chrome_node
        else:
            label = tag + "".join("." + w for w in sorted(set(attrs.get("class", "").lower().split())))
            node = parent.children.get(label)
            if node is None:
                node = parent.children[label] = Node(label, False, parent)
        if not m[0].endswith("/>"):
            push(tag, node, inside or tag in ("article", "main") or attrs.get("role") == "main", block if tag in INLINE else node)
    flush()
    order = [root]
    for node in order:
        order.extend(node.children.values())
    for i, node in enumerate(order):
        node.number = i
    return order, blocks


def outline(order: list[Node]) -> str:
    """A line for each node: its parent's number and its label. Neither holds white space."""
    return "\n".join(f"{node.parent.number if node.parent else -1} {node.label}" for node in order)


class Tree:
    """A tree read from an outline."""

    def __init__(self, text: str):
        rows = [line.split(" ", 1) for line in text.split("\n")]
        self.parent = [int(r[0]) for r in rows]
        self.label = [r[1] for r in rows]
        self.children: list[dict[str, int]] = [{} for _ in rows]
        for i, p in enumerate(self.parent):
            if p >= 0:
                self.children[p][self.label[i]] = i


def _heaviest_rising(places: list[int], weights: list[int]) -> list[int]:
    """Indices of a subsequence of rising places with the greatest sum of weights (a tree of prefix maxima)."""
    rank = {p: i + 1 for i, p in enumerate(sorted(places))}
    best: list[tuple[int, int]] = [(0, -1)] * (len(places) + 1)
    before = [-1] * len(places)
    for k, (p, w) in enumerate(zip(places, weights, strict=True)):
        top, i = (0, -1), rank[p] - 1
        while i > 0:
            top = max(top, best[i])
            i -= i & -i
        before[k], mine, i = top[1], (top[0] + w, k), rank[p]
        while i <= len(places):
            best[i] = max(best[i], mine)
            i += i & -i
    k = max(best)[1]
    out = []
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def match(a: Tree, b: Tree) -> list[tuple[int, int]]:
    """Simple tree matching: the largest set of node pairs that keeps labels, ancestry and order.

    Siblings differ in their labels, so a node has one possible partner below each pair of parents.
    """
    pairs, below = [(0, 0)], []
    for x, y in pairs:
        mine = [(c, b.children[y][label]) for label, c in a.children[x].items() if label in b.children[y]]
        below.append(range(len(pairs), len(pairs) + len(mine)))
        pairs.extend(mine)
    size, chosen = [1] * len(pairs), [[] for _ in pairs]
    for k in range(len(pairs) - 1, -1, -1):
        if below[k]:
            places = list(below[k])
            chosen[k] = [places[i] for i in _heaviest_rising([pairs[j][1] for j in places], [size[j] for j in places])]
            size[k] += sum(size[j] for j in chosen[k])
    out = [0]
    for k in out:
        out.extend(chosen[k])
    return [pairs[k] for k in out]


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


class Aligner:
    """Names (hashes) of the nodes of outlines by alignment with a host's reference trees."""

    def __init__(self):
        self.trees: dict[tuple[str, tuple[str, ...]], list[tuple[Tree, list[int]]]] = {}

    @staticmethod
    def _complete(tree: Tree, names: dict[int, int], host: str) -> list[int]:
        """Nodes without a name get one made of their parent's and their own label."""
        out: list[int] = []
        for i, p in enumerate(tree.parent):
            out.append(names[i] if i in names else _hash(f"{out[p] if p >= 0 else host}/{tree.label[i]}"))
        return out

    def _shared(self, host: str, references: tuple[str, ...]) -> list[tuple[Tree, list[int]]]:
        """Reference trees and the names of their nodes: a node that matches one of an earlier tree has its name."""
        out: list[tuple[Tree, list[int]]] = []
        for text in references:
            tree, names = Tree(text), {}
            for earlier, theirs in out:
                used = set(names.values())
                for a, b in match(tree, earlier):
                    if a not in names and theirs[b] not in used:
                        names[a] = theirs[b]
            out.append((tree, self._complete(tree, names, host)))
        return out

    def names(self, host: str, text: str, references: tuple[str, ...]) -> list[int]:
        """Name of each node: that of its partner, or one made of the last node's above it that has one."""
        if (host, references) not in self.trees:
            if len(self.trees) > 200:
                self.trees.clear()
            self.trees[host, references] = self._shared(host, references)
        tree = Tree(text)
        scored = [(match(tree, ref), names) for ref, names in self.trees[host, references]]
        pairs, theirs = max(scored, key=lambda s: len(s[0]), default=([], []))
        return self._complete(tree, {a: theirs[b] for a, b in pairs}, host)


def _host(url):
    """Host name of a URL, lower case; pages without one share a host of their own."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))


def _parsed(rows: DataFrame, columns: list[str], schema: str, made) -> DataFrame:
    """rows(..., host, html) with each page parsed: the given columns, and what made(page, order, blocks) returns."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = batch.column(len(columns)).to_pylist()
            for a in range(0, len(pages), 200):
                out = list(zip(*(made(page, *parse(page)) for page in pages[a : a + 200]), strict=True))
                if out:
                    cols = [pa.array(c, t) for c, t in zip(out, kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, 200) for i in range(len(columns))), *cols], names)

    fields = T.StructType.fromDDL(schema)
    kinds, names = [to_arrow_type(f.dataType) for f in fields], [*columns, *fields.names]
    whole = T.StructType([*rows.select(*columns).schema.fields, *fields.fields])
    return rows.select(*columns, "html").mapInArrow(run, whole)


def _whole(page: str) -> bytes:
    return xxhash.xxh3_128_digest(page.encode("utf-8", "surrogatepass"))


def extract(pages: DataFrame, references: int = REFERENCES, min_pages: int = MIN_PAGES, share: float = TEMPLATE_SHARE) -> DataFrame:
    """page_id, url, text and n_chars for every row of pages (page_id, url, html).

    Null and empty html give the empty text. Blocks are joined by a blank line in page order, with character
    references decoded and white space inside a block made one space. The text is that of every slot
    outside menus and the like; text at nodes that fewer than min_pages pages hold is left out where it stands
    outside an article or main element and the page has text in one. Pages without a host share one. Very long and
    deep pages are taken whole. Copies of a page of a host count once and rows that repeat give their rows each. An
    empty table stays empty; other columns, whatever their names, are ignored.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("host", _host(F.col("url")))

    def described(page: str, order: list[Node], blocks: list[tuple[Node, str, bool]]) -> tuple:
        text = outline(order)
        return _whole(page), _hash(text), text, [b[0].number for b in blocks], [_hash(b[1]) for b in blocks], [b[2] for b in blocks]

    keys = staged(_parsed(rows, ["host"], "whole binary, shape long, outline string, nodes array<int>, texts array<long>, inside array<boolean>", described), "outlines")
    shapes = staged(keys.groupBy("host", "shape").agg(F.min("outline").alias("outline"), F.count("*").alias("n")), "shapes")
    # A bounded number of outlines per host, the commonest of each class of a hash: aggregated before the shuffle.
    refs = shapes.groupBy("host", F.pmod("shape", F.lit(references)).alias("k")).agg(F.max_by("outline", F.struct("n", "shape")).alias("outline"))
    refs = refs.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "outline"))), lambda x: x["outline"]).alias("refs"))

    def align(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner()
        for batch in batches:
            hosts, texts, known = (batch.column(i).to_pylist() for i in (0, 2, 3))
            names = [aligner.names(h, t, tuple(r)) for h, t, r in zip(hosts, texts, known, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.list_(pa.int64()))], ["host", "shape", "names"])

    aligned = staged(shapes.join(refs, "host").select("host", "shape", "outline", "refs").mapInArrow(align, "host string, shape long, names array<long>"), "aligned")

    # Pages count once per content: the copies of one page would else turn its text into template.
    once = keys.select("host", "whole", "shape", "nodes", "texts", "inside").dropDuplicates(["host", "whole"]).join(aligned, ["host", "shape"])
    blocks = F.transform("nodes", lambda n, i: F.struct(F.get("names", n).alias("slot"), F.get("texts", i).alias("text"), F.get("inside", i).alias("inside"), i.alias("at")))
    named = staged(once.select("host", "whole", blocks.alias("blocks")), "named")
    # A row for each node by itself too, which counts the pages that hold it.
    pairs = F.array_distinct(F.flatten(F.transform("blocks", lambda b: F.array(F.struct(b["slot"].alias("slot"), b["text"].alias("text")), F.struct(b["slot"].alias("slot"), F.lit(ANY).cast("long").alias("text"))))))
    counts = staged(named.select(F.explode(pairs).alias("x")).groupBy("x.slot", "x.text").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages), "counts")
    totals = staged(counts.where(F.col("text") == ANY).select("slot", F.col("n").alias("pages")), "totals")
    firm = (F.col("n") >= ARTICLE_EVIDENCE * min_pages).alias("firm")
    fixed = staged(counts.where(F.col("text") != ANY).join(totals, "slot").where(F.col("n") > share * F.col("pages")).select("slot", "text", firm), "fixed")

    # Places of a page that are template (in an article only where there are pages enough for that), and places
    # outside its article at nodes with enough pages.
    each = named.select("host", "whole", F.explode("blocks").alias("b")).select("host", "whole", "b.*")
    gone = each.join(fixed, ["slot", "text"]).where("not inside or firm").select("host", "whole", "at", F.lit(True).alias("gone"))
    firm_places = named.where(F.exists("blocks", lambda b: b["inside"])).select("host", "whole", F.explode(F.filter("blocks", lambda b: ~b["inside"])).alias("b"))
    known = firm_places.select("host", "whole", "b.slot", "b.at").join(totals.select("slot"), "slot").select("host", "whole", "at", F.lit(False).alias("gone"))
    marks = gone.unionByName(known).groupBy("host", "whole").agg(F.collect_set(F.when(F.col("gone"), F.col("at"))).alias("gone"), F.collect_set(F.when(~F.col("gone"), F.col("at"))).alias("known"))
    marks = staged(marks, "marks")

    def shown(page: str, order: list[Node], blocks: list[tuple[Node, str, bool]]) -> tuple:
        return _whole(page), [b[1] for b in blocks], [b[2] for b in blocks]

    texts = _parsed(rows, ["page_id", "url", "host"], "whole binary, texts array<string>, inside array<boolean>", shown)
    none = F.array().cast("array<int>")
    final = texts.join(marks, ["host", "whole"], "left").withColumn("gone", F.coalesce("gone", none)).withColumn("known", F.coalesce("known", none))
    left = F.filter(F.transform("texts", lambda t, i: F.struct(t.alias("text"), F.get("inside", i).alias("inside"), i.alias("at"))), lambda x: ~F.array_contains("gone", x["at"]))
    final = final.withColumn("left", left)
    kept = F.filter("left", lambda x: x["inside"] | F.array_contains("known", x["at"]) | ~F.exists("left", lambda y: y["inside"]))
    return final.select("page_id", "url", F.array_join(F.transform(kept, lambda x: x["text"]), "\n\n").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
