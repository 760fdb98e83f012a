"""HTML extraction by wrapper induction.

Every host has a reference page. A page's tree of blocks (inline elements folded into their block) is aligned with the
reference's by simple tree matching: the matching of children in order, from the top down, that keeps most nodes, where
nodes of equal text count double. A matched node has the reference node's name; a node that the reference lacks (another
layout, an optional part) is named by its path of labels. All pages of a host then vote on each name: where the text is the
same on all pages that have it, which are four different pages and a tenth of the host's at least, the node is template;
all other nodes are slots, at every level. A page's text is all its slots in page order; a page that is all template, and a
host of three pages or fewer, keep all their text. Menus, headers, footers, sidebars, notices, adverts, forms, scripts and
comments of readers are left out by element, role and class.

Pages are parsed once, beside their reference; hosts with many pages get it by broadcast, so no task holds a host. Votes
are aggregated by host and name with partial sums.

Defined cases: null and empty html give the empty text; a null or malformed url is a host of its own; unclosed
and stray tags are repaired as browsers do for paragraphs and list items; pages of any length and depth are read
whole; repeated rows are extracted each and vote as one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import common

#: Fixed names: elements without text of their own, and parts of pages that are not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset(
    "script style noscript template head title nav footer aside form button select textarea iframe object svg canvas dialog menu".split())
INLINE = frozenset(
    "a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
PARTS = frozenset(
    "ad ads adbox advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disqus disclaimer footer header menu modal nav navbar navigation newsletter notice notices popup promo promoted "
    "related reply replies respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
#: Parts whose names stand for content too: such a block is the article where it holds three quarters of the page's text or more.
SOFT = frozenset("banner disclaimer header notice notices share sharing social widget".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
#: Elements that stand inside a paragraph without ending it, besides the inline ones.
INSIDE = INLINE | frozenset("script style noscript template button select textarea iframe object svg canvas".split())
#: Read references that a task keeps.
KEPT_REFERENCES = 256
#: Nodes nested deeper are named by their path, not aligned.
DEEPEST = 150
#: A template node is on so many of 64 classes of different pages, by three classings, and on this share of the host's rows.
MIN_PAGES, MIN_SHARE = 4, 0.1
SAME_CLOSES = frozenset("li dt dd tr td th option".split())


class Node:
    __slots__ = ("label", "tag", "children", "parent", "skip", "depth", "soft", "size")

    def __init__(self, tag: str, label: str, parent: Node | None, skip: bool, soft: bool = False):
        self.tag, self.label, self.parent, self.skip, self.soft, self.size = tag, label, parent, skip, soft, 0
        self.children: list[Node | str] = []
        self.depth: int = parent.depth + 1 if parent else 0


def _part(tag: str, attrs: list[tuple[str, str | None]]) -> tuple[bool, bool]:
    """Whether an element is named as a part that is not the article, and whether by names only that content has too."""
    named = dict(attrs)
    if (named.get("role") or "").lower() in ROLES or "hidden" in named:
        return True, False
    if tag in ("body", "html", "article", "main"):
        return False, False
    names = PARTS.intersection(re.split(r"[^a-z0-9]+", f"{named.get('class') or ''} {named.get('id') or ''}".lower()))
    return bool(names), bool(names) and names <= SOFT


def _decide(root: Node, nodes: list[Node]) -> None:
    """Skips the nodes that are parts by soft names, but those that hold three quarters of the page's text. nodes are in page order."""
    for x in reversed(nodes):
        x.size = 0 if x.skip else sum(c.size if isinstance(c, Node) else len("".join(c.split())) for c in x.children)
    for x in nodes:
        if x.soft and 4 * x.size < 3 * root.size:
            x.skip = True


class Tree(HTMLParser):
    """A page as nodes with texts; character references are decoded."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#", "#", None, False)
        self.nodes = [self.root]
        self.feed(html)
        self.close()
        if any(x.soft for x in self.nodes):
            _decide(self.root, self.nodes)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.at.children.append(" ")
        if tag in VOID:
            return
        if tag not in INSIDE:
            self._end("p", {"article", "main", "section", "div", "body", "td", "li", "blockquote"})
        if tag in SAME_CLOSES:
            self._end(tag, {"ul", "ol", "dl", "table", "select"})
        kind = (dict(attrs).get("class") or "").split()
        part, soft = _part(tag, attrs)
        inside = self.at.skip or tag in SKIPPED or part and not soft
        if tag == "header" and not inside:
            inside = not self._within({"article", "main"})
        node = Node(tag, ".".join([tag, *kind[:1]]), self.at, inside, soft and not inside)
        self.nodes.append(node)
        self.at.children.append(node)
        self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("script", "style", "svg", "path", "use"):
            self._end(tag, set())

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.at.children.append(" ")
        self._end(tag, {"article", "main", "body", "table"} if tag in INLINE or tag == "p" else {"article", "main", "body"} - {tag})

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)

    def _within(self, tags: set[str]) -> bool:
        x: Node | None = self.at
        while x and x.tag not in tags:
            x = x.parent
        return x is not None

    def _end(self, tag: str, walls: set[str]) -> None:
        """Closes the nearest open element of this name, unless a wall stands before it."""
        x: Node | None = self.at
        while x and x.tag != tag:
            if x.tag in walls:
                return
            x = x.parent
        if x and x.parent:
            self.at = x.parent


class Block:
    """A block and the text that stands in it outside the blocks below."""

    __slots__ = ("label", "path", "depth", "children", "words", "order", "shape", "name", "deep", "near", "size")

    def __init__(self, label: str, path: int, depth: int):
        self.label, self.path, self.depth, self.name, self.deep, self.near = label, path, depth, 0, 0, 1
        self.children: list[Block] = []
        self.words: list[str] = []


def _hash(*parts: object) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "little", signed=True)


def read(html: str) -> tuple[Block, list[Block], list[tuple[Block, int, str]]]:
    """The page's blocks from the top, in page order, and its runs of text: (block, number of the output block, text)."""
    top = Block("#", 0, 0)
    blocks, runs, nth = [top], [], 0
    stack: list[tuple[Node | str | None, Block]] = [(Tree(html).root, top)]
    while stack:
        x, block = stack.pop()
        if x is None:
            nth += 1
        elif isinstance(x, str):
            runs.append((block, nth, x))
            block.words += x.split()
        elif not x.skip:
            if x.tag not in INLINE:
                nth += 1
                stack.append((None, block))
                if x.parent:
                    new = Block(x.label, _hash(block.path, x.label), block.depth + 1)
                    block.children.append(new)
                    blocks.append(new)
                    block = new
            stack.extend((c, block) for c in reversed(x.children))
    for k in range(len(blocks) - 1, -1, -1):
        x = blocks[k]
        x.order, near = k, x.children if x.depth < DEEPEST else []
        x.near, x.deep = 1 + sum(c.near for c in near), hash((x.label, *x.words, len(x.words), *(c.deep for c in near)))  # compared in this process only
        x.shape = _hash(x.label, *(c.shape for c in x.children))
    return top, blocks, runs


def _weight(a: Block, b: Block) -> int:
    """How many nodes of two trees, down to DEEPEST, simple tree matching pairs, nodes of equal text counted twice."""
    if a.label != b.label:
        return 0
    if a.deep and a.deep == b.deep:
        return 2 * a.near
    own = 2 if a.words == b.words else 1
    return own + _most(a.children, b.children) if a.children and b.children and a.depth < DEEPEST else own


def _most(xs: list[Block], ys: list[Block]) -> int:
    """The best matching's weight of two lists; equal trees at both ends are part of a best one."""
    i, m, n, out = 0, len(xs), len(ys), 0
    while i < m and i < n and xs[i].deep and xs[i].deep == ys[i].deep:
        out += 2 * xs[i].near
        i += 1
    while m > i and n > i and xs[m - 1].deep and xs[m - 1].deep == ys[n - 1].deep:
        m, n = m - 1, n - 1
        out += 2 * xs[m].near
    return out + _table(xs[i:m], ys[i:n], None)


def _table(xs: list[Block], ys: list[Block], steps: list[bytearray] | None) -> int:
    """The best matching's weight, by a row of weights at a time; steps gets how each two beginnings' best came about, a byte each: without x, without y, with both."""
    above = [0] * (len(ys) + 1)
    for x in xs:
        row, step = [0], bytearray(len(ys))
        for j, y in enumerate(ys):
            best = above[j + 1] if above[j + 1] > row[j] else row[j]
            w = _weight(x, y)
            if w and above[j] + w > best:
                best = above[j] + w
            step[j] = 0 if best == above[j + 1] else 1 if best == row[j] else 2
            row.append(best)
        if steps is not None:
            steps.append(step)
        above = row
    return above[-1]


def _pairs(xs: list[Block], ys: list[Block]) -> list[tuple[Block, Block]]:
    """Children matched in order; equal ones at both ends at once."""
    out, same = [], lambda x, y: x.shape == y.shape and x.words == y.words
    i, m, n = 0, len(xs), len(ys)
    while i < m and i < n and same(xs[i], ys[i]):
        out.append((xs[i], ys[i]))
        i += 1
    while m > i and n > i and same(xs[m - 1], ys[n - 1]):
        m, n = m - 1, n - 1
        out.append((xs[m], ys[n]))
    xs, ys = xs[i:m], ys[i:n]
    steps: list[bytearray] = []
    _table(xs, ys, steps)
    i, j = len(xs), len(ys)
    while i and j:
        step = steps[i - 1][j - 1]
        if step == 0:
            i -= 1
        elif step == 1:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((xs[i], ys[j]))
    return out


def align(page: Block, reference: Block) -> None:
    """Names the page's blocks: by the matched block of the reference, or by their path."""
    stack: list[tuple[Block, Block | None]] = [(page, reference)]
    while stack:
        x, y = stack.pop()
        x.name = x.path if y is None else _hash("reference", y.order)
        matched = {} if y is None or x.depth >= DEEPEST else {id(a): b for a, b in _pairs(x.children, y.children)}
        stack.extend((c, matched.get(id(c))) for c in x.children)


def joined(blocks: Iterable[int], texts: Iterable[str]) -> str:
    """Texts of one block put together, white space folded; blocks joined by empty lines."""
    out: dict[int, list[str]] = {}
    for k, t in zip(blocks, texts, strict=True):
        out.setdefault(k, []).append(t)
    folded = (re.sub(r"[ \t\n\r\f\v]+", " ", "".join(t)).strip(" ") for t in out.values())
    return "\n\n".join(t for t in folded if t)


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1)), F.lit(""))


def references(pages: DataFrame) -> DataFrame:
    """host, n (its rows) and reference (the html of least hash)."""
    named = pages.filter("html <> ''").select(host_of(F.col("url")).alias("host"), F.xxhash64("html").alias("page"), "html")
    least = common.written(named.groupBy("host").agg(F.min("page").alias("page"), F.count("*").alias("n")), "least-pages")
    found = named.join(least, ["host", "page"]).select("host", "n", F.col("html").alias("reference"))
    return common.written(found.dropDuplicates(["host"]), "references")


def slots(rows: DataFrame) -> DataFrame:
    """page_id, url, host, page, n, the runs of text (block, name, text) in page order, and each name's text as a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Block] = {}
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("block", "name", "text", "voted", "words")}
            for html, reference in zip(batch.column("html").to_pylist(), batch.column("reference").to_pylist(), strict=True):
                runs, votes = [], {}
                if html:
                    top, blocks, runs = read(html)
                    if reference not in known:
                        if len(known) >= KEPT_REFERENCES:
                            known.clear()
                        known[reference] = read(reference)[0]
                    align(top, known[reference])
                    for x in blocks:
                        if x.words:
                            votes[x.name] = _hash(votes.get(x.name), x.words)
                out["block"].append([k for _, k, _ in runs])
                out["name"].append([x.name for x, _, _ in runs])
                out["text"].append([t for _, _, t in runs])
                out["voted"].append(list(votes))
                out["words"].append(list(votes.values()))
            kinds = (pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("page_id", "url", "host", "page", "n")), *(pa.array(v, pa.list_(t)) for v, t in zip(out.values(), kinds, strict=True))],
                names=["page_id", "url", "host", "page", "n", *out])

    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, host string, page bigint, n bigint, block array<int>, name array<bigint>, text array<string>, voted array<bigint>, words array<bigint>")


def wrappers(found: DataFrame) -> DataFrame:
    """host and wrapper (the names of template nodes) of each host that has any."""
    votes = found.select("host", "n", "page", F.explode(F.arrays_zip("voted", "words")).alias("v"))
    votes = votes.groupBy("host", F.col("v.voted").alias("name")).agg(
        F.min("v.words").alias("lo"), F.max("v.words").alias("hi"), F.max("n").alias("n"), F.count("*").alias("have"),
        F.greatest(*[F.bit_count(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(shiftright(page, {k}), 64) as int))"))) for k in (0, 6, 12)]).alias("pages"))
    fixed = votes.filter((F.col("lo") == F.col("hi")) & (F.col("pages") >= MIN_PAGES) & (F.col("have") >= MIN_SHARE * F.col("n")))
    return fixed.groupBy("host").agg(F.collect_list("name").alias("wrapper"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row."""
    common.python_ready(pages.sparkSession)
    known = references(pages)
    named = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"), F.xxhash64("html").alias("page"))
    full = named.filter("html <> ''")
    total = known.agg(F.sum("n")).first()[0] or 0
    found = common.written(slots(common.lookup(full, known, ["host"], "n", total)), "slots", codec="zstd")
    wrapped = common.written(wrappers(found), "wrappers")
    columns = ["page_id", "url", "block", "name", "text", "wrapper"]
    rest = found.join(wrapped, "host", "left").select(*columns)  # names of template nodes only: mostly small enough to be sent to the pages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for block, name, text, wrapper in zip(*(batch.column(c).to_pylist() for c in columns[2:]), strict=True):
                template = set(wrapper or ())
                kept = [(k, t) for k, x, t in zip(block, name, text, strict=True) if x not in template]
                texts.append(joined(*zip(*kept, strict=True)) if kept else "")
                texts[-1] = texts[-1] or joined(block, text)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    got = rest.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
    empty = named.filter("coalesce(html, '') = ''").select("page_id", "url", F.lit("").alias("text"), F.lit(0).cast("bigint").alias("n_chars"))
    return got.unionByName(empty)
