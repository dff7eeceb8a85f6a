"""HTML extraction: template deduction from equivalence classes of tokens, host by host.

Tokens are the elements of a page, each named by its place in the page tree (tags and class names from the root down), and its text
blocks, each named by its element and its text. A token's occurrence vector says how often it occurs on each page of the host; tokens
with the same vector form a class, and a class nests in the class of the token around it. Classes on at least half of the pages are
the host's template. Where every one of its pages has a token once, the stretch below it is one slot.

The article's slot is such a token: an ``article``, else a ``main``, else the deepest one below which nine tenths of the text lie. It
is read block by block. A block that is in the class of an element (it stands wherever the element stands: a notice, a licence, a
prompt), where the class has the support of one page in ``SHARE`` of the host and of ``SUPPORT`` pages, is part of the template and left
out; menus, footers, forms and the like, whose text may differ from page to page, are left out by the name of their element. Text elements
(paragraphs, headings, cells) are never parts by their names alone.

A host has at most ``SHARE`` times as many template blocks as its pages have blocks on average, so its row is as large as a few pages.

Vectors are compared by the sum over pages of hash(page, count), which adds up in parts: a host with a third of all pages never
meets in one task, and no task holds a host's tokens.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specgraph.llm.common import checkpointed, lookup

#: A class of template text stands on one page in ``SHARE`` of its host, and on ``SUPPORT`` pages; and such blocks hold at most this share of a slot's text (else the pages are copies).
SHARE, SUPPORT, MOST_FIXED = 8, 3, 0.5
#: Share of a host's text below the slot of the article, where no element is named as one; and below a named part that is not one.
GATHERED, WRAPS = 0.9, 0.5

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img math mi mn mo ms mtext mrow msup msub mfrac msqrt annotation".split())
#: Elements that hold text of the page: their names do not make them parts.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre td th dd dt figcaption caption".split())
LEFT_OUT = frozenset("script style noscript template nav footer aside form button select option textarea iframe canvas dialog head title menu input audio video".split())
#: Class, id or role names of page parts that are not the article ...
PARTS = frozenset(
    "nav navbar navigation menu footer contentinfo sidebar aside complementary ad ads advert adverts advertisement advertising sponsor sponsored banner promo cookie cookies consent notice notices alert popup modal overlay"
    " newsletter subscribe signup login search dialog dfp outbrain taboola stories share sharing social related recommended breadcrumb breadcrumbs pagination pager toolbar widget widgets skip masthead disclaimer".split()
)
#: ... of reader comments, however long ...
COMMENTS = frozenset("comment comments respond replies disqus discussion".split())
#: ... and words that may stand beside them in a name ("site-footer", "comment-list").
BESIDE = frozenset("site page main global user users reader more our left right top bottom box list item items area block section wrapper wrap inner container content bar links link form thread form slot unit post entry article primary secondary header message text".split())
#: Elements that a new block ends: a paragraph is closed by any of them, an item or a cell by the next one.
ENDS = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe")}
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


WHOLE, HEADER = frozenset(("html", "body", "article", "main")), frozenset(("header",))


@dataclass(slots=True, eq=False)
class Node:
    """An open element: its token, whether its text is left out (``hard``: by its tag; ``soft``: by its name), in a link, in the slot; and text signs below it."""

    tag: str
    token: int
    parent: Node | None
    depth: int
    hard: bool
    soft: int
    link: bool
    inside: bool
    block: int = 0
    text: int = 0
    held_back: int = 0


def named_part(names: list[str], words: frozenset[str]) -> bool:
    """Whether one of the names consists of ``words`` and the words that may stand beside them."""
    for name in names:
        parts = [p.lower() for p in _WORDS.findall(name)]
        if any(p in words for p in parts) and all(p in words or p in BESIDE or p in PARTS or p.isdigit() for p in parts):
            return True
    return False


def open_node(tag: str, attributes: str, parent: Node | None, article: int | None, keep: frozenset[int]) -> Node:
    names: list[str] = []
    own = tag
    if attributes and "=" in attributes:
        for m in _NAMES.finditer(attributes):
            value = html.unescape(m[2] or m[3] or m[4] or "").split()
            names += value
            if m[1].lower() == "class":
                own = f"{tag}.{'.'.join(sorted(value))}"
    token = ((parent.token if parent else 17) * 0x9E3779B97F4A7C15 + zlib.crc32(own.encode("utf-8", "replace")) + 1) & (1 << 62) - 1
    in_article = parent is not None and (parent.inside or parent.tag in ("article", "main"))
    hard = bool(parent and parent.hard) or tag in LEFT_OUT or (tag not in WHOLE and named_part(names, COMMENTS))
    soft = parent.soft if parent else 0
    if not soft and tag not in WHOLE and tag not in TEXTUAL and token not in keep and ((names and (named_part(names, PARTS) or (named_part(names, HEADER) and not in_article))) or (tag == "header" and not in_article)):
        soft = token
    block = token if tag not in INLINE else parent.block if parent else 0
    return Node(tag, token, parent, parent.depth + 1 if parent else 0, hard, soft, tag == "a" or bool(parent and parent.link), bool(parent and parent.inside) or token == article, block)


class Open:
    """Open elements of a page. The places of each tag, and those of elements that are not inline, are kept, so closing costs what it closes, however many are open."""

    def __init__(self) -> None:
        self.nodes: list[Node] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def top(self) -> Node | None:
        return self.nodes[-1] if self.nodes else None

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag not in INLINE:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, place: int) -> None:
        while len(self.nodes) > place:
            tag = self.nodes.pop().tag
            self.places[tag].pop()
            if tag not in INLINE:
                self.blocks.pop()

    def close(self, tag: str) -> None:
        """Ends the last open element of a tag and all in it; an inline one only within its block."""
        places = self.places.get(tag)
        if places and not (tag in INLINE and self.blocks and self.blocks[-1] > places[-1]):
            self.cut(places[-1])

    def make_way(self, tag: str) -> None:
        """Ends what a new block of a tag ends: an open paragraph, or the item or cell before it."""
        if self.blocks and ((last := self.nodes[self.blocks[-1]].tag) == "p" or last in ENDS.get(tag, ())):
            self.cut(self.blocks[-1])


def pieces(page: str, article: int | None = None, keep: frozenset[int] = frozenset()) -> Iterator[tuple[Node | None, str | None, bool]]:
    """(element, raw text or None, whether a block begins or ends here) in page order; an element comes once without text when it opens, no element where one ends."""
    stack = Open()
    end, size = 0, len(page)
    while end < size:
        m = _TAG.search(page, end)
        if m is None:
            yield stack.top(), page[end:], False
            return
        if m.start() > end:
            yield stack.top(), page[end : m.start()], False
        end = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                yield stack.top(), html.escape(m[0][9:-3]), False
            continue
        tag = tag.lower()
        if m[1]:
            stack.close(tag)
            if tag not in INLINE:
                yield None, None, True
            continue
        if tag not in INLINE and tag not in VOID:
            stack.make_way(tag)
        node = open_node(tag, m[3], stack.top(), article, keep)
        yield node, None, tag not in INLINE
        if tag in VOID or m[3].endswith("/"):
            continue
        if tag in _RAW:
            close = _RAW[tag].search(page, end)
            end = close.start() if close else size
        stack.push(node)


@dataclass(slots=True)
class Block:
    """A block of text: its words with one space between, the element it stands in, and whether it is in the slot."""

    text: str
    element: int
    inside: bool


def parsed(page: str, article: int | None = None, keep: frozenset[int] = frozenset()) -> tuple[list[Node], list[Block]]:
    """Elements in page order, with the signs of text below each, and the blocks that are not left out. ``keep`` has tokens whose names do not count."""
    nodes: list[Node] = []
    blocks: list[Block] = []
    parts: list[str] = []
    element, inside = 0, article is None

    def end() -> None:
        text = " ".join("".join(parts).split())
        if text:
            blocks.append(Block(text, element, inside))
        parts.clear()

    for node, text, breaks in pieces(page, article, keep):
        if text is None:
            if parts and (breaks or (node is not None and node.tag in ("br", "hr"))):
                end()
            if node is not None:
                nodes.append(node)
            continue
        size = 0 if node is not None and node.link else len(text.strip())
        if node is None or not (node.hard or node.soft):
            now = article is None or (node is not None and node.inside)
            if parts and now != inside:
                end()
            if not parts:
                element, inside = (node.block if node is not None else 0), now
            parts.append(html.unescape(text))
            if node is not None:
                node.text += size
        elif not node.hard:
            node.held_back += size
    end()
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.text += node.text
            node.parent.held_back += node.held_back
    return nodes, blocks


def rank_of(tag: str) -> int:
    """Which elements are taken for the article: 2 article, 1 main, 0 others, -1 never."""
    return 2 if tag == "article" else 1 if tag == "main" else -1 if tag in INLINE or tag in ("p", "li", "head", "h1", "h2", "h3") else 0


def tokens(page: str) -> list[tuple[int, int, int, int, int, int, int, int]]:
    """(token, block, parent, times, text, held back, rank, depth) of each element (block 0) and each text block of a page."""
    nodes, blocks = parsed(page)
    out: dict[tuple[int, int], list[int]] = {}
    for node in nodes:
        row = out.setdefault((node.token, 0), [node.parent.token if node.parent else 0, 0, 0, 0, rank_of(node.tag), node.depth])
        row[1] += 1
        row[2] += node.text
        row[3] += node.held_back
    for block in blocks:
        row = out.setdefault((block.element, block_hash(block.text)), [block.element, 0, 0, 0, -1, 0])
        row[1] += 1
        row[2] += len(block.text)
    return [(*key, *row) for key, row in out.items()]


def block_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) >> 1 | 1


def own_slot(page: str) -> tuple[int | None, frozenset[int]]:
    """The article's slot of a page alone, by the same rules: each of its tokens that occurs once is a slot."""
    rows = [r for r in tokens(page) if r[1] == 0]
    whole = max((r[4] + r[5] for r in rows), default=0)
    keep = frozenset(r[0] for r in rows if r[5] > WRAPS * whole)
    if keep:
        again, _ = parsed(page, None, keep)
        held = {n.token: n.text for n in again}
        rows = [(*r[:4], held.get(r[0], 0), *r[5:]) for r in rows]
    total = max((r[4] for r in rows), default=0)
    able = [(r[6], r[4] if r[6] > 0 else r[7], -r[7], r[0]) for r in rows if r[4] > 0 and r[6] >= 0 and (r[3] == 1 or r[6] > 0) and (r[6] > 0 or r[4] >= GATHERED * total)]
    return (max(able)[3] if able else None), keep


def extract(page: str | None, article: int | None, keep: list[int] | None = None, fixed: list[int] | None = None) -> str:
    """The blocks of the article's slot, one a line, without those of the template. A page that lacks its host's slot has its own deduced."""
    if not page:
        return ""
    kept, left = frozenset(keep or ()), frozenset(fixed or ())
    nodes, blocks = parsed(page, article, kept) if article is not None else ([], [])
    if not any(n.token == article for n in nodes):
        article, kept = own_slot(page)
        left = frozenset()
        _, blocks = parsed(page, article, kept)
    return "\n".join(b.text for b in blocks if b.inside and (not left or block_hash(b.text) not in left))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


COUNTED = "host string, page long, token long, block long, parent long, times long, text long, held_back long, rank long, depth long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tokens of every page, in batches of a few thousand rows."""
    names = [x.split()[0] for x in COUNTED.split(", ")]
    for batch in batches:
        rows: list[tuple] = []
        for i in range(batch.num_rows):
            host, page, raw = (batch.column(k)[i].as_py() for k in range(3))
            rows += [(host, page, *x) for x in tokens(raw or "")]
            if rows and (len(rows) > 20_000 or i + 1 == batch.num_rows):
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64() if k else pa.string()) for k, c in enumerate(zip(*rows, strict=True))], names=names)
                rows = []


def occurrence_vectors(pages: DataFrame, key: str = "page_id", url: str = "url", text: str = "html") -> DataFrame:
    """(host, token, block, parent, rank, depth, vector, pages, times, text, held_back) of every element, and of every text block that ``SUPPORT`` pages have."""
    rows = pages.select(host_of(F.col(url)).alias("host"), F.xxhash64(text).alias("page"), F.col(text).alias("html"))
    sums = rows.mapInArrow(_counted, COUNTED).groupBy("host", "token", "block").agg(
        F.min("parent").alias("parent"), F.min("rank").alias("rank"), F.min("depth").alias("depth"), F.sum(F.pmod(F.xxhash64("page", "times"), F.lit(1 << 40))).alias("vector"),
        F.count("*").alias("pages"), F.sum("times").alias("times"), F.sum("text").alias("text"), F.sum("held_back").alias("held_back"),
    )
    return sums.where((F.col("block") == 0) | (F.col("pages") >= SUPPORT))


def host_classes(vectors: DataFrame) -> DataFrame:
    """(host, vector, tokens, pages, outer): the classes of elements, and the vector of the class that each nests in (null for the outermost)."""
    elements = vectors.where("block = 0")
    classes = elements.groupBy("host", "vector").agg(F.count("*").alias("tokens"), F.max("pages").alias("pages"), F.min_by("parent", F.struct("depth", "token")).alias("parent"))
    around = elements.select("host", F.col("token").alias("parent"), F.col("vector").alias("outer"))
    return classes.join(around, ["host", "parent"], "left").select("host", "vector", "tokens", "pages", "outer")


def host_templates(vectors: DataFrame) -> DataFrame:
    """(host, article, keep, fixed) of every host: the token of the article's slot, named parts that hold most of the text, and blocks of the template in that slot."""
    elements = vectors.where("block = 0")
    whole = elements.groupBy("host").agg(F.max("pages").alias("of"), F.max(F.col("text") + F.col("held_back")).alias("whole"), F.max("text").alias("total"))
    classes = host_classes(vectors).select("host", "vector", F.col("pages").alias("class_pages"))
    tokens = elements.join(classes, ["host", "vector"]).join(whole, "host")
    wraps = tokens.where(F.col("held_back") > F.lit(WRAPS) * F.col("whole")).groupBy("host").agg(F.collect_set("token").alias("keep"))
    # where a named part holds most of the text, its text counts again
    tokens = tokens.join(wraps, "host", "left").withColumn("text", F.when(F.col("keep").isNull(), F.col("text")).otherwise(F.col("text") + F.col("held_back")))
    tokens = tokens.withColumn("total", F.when(F.col("keep").isNull(), F.col("total")).otherwise(F.col("whole")))
    once = tokens.where((F.col("times") == F.col("pages")) & (2 * F.col("class_pages") >= F.col("of")) & (F.col("text") > 0) & (F.col("rank") >= 0))
    able = once.where((F.col("rank") > 0) | (F.col("text") >= F.lit(GATHERED) * F.col("total")))
    order = F.struct("rank", F.when(F.col("rank") > 0, F.col("text")).otherwise(F.col("depth")).alias("x"), (-F.col("depth")).alias("y"), "token")
    slots = able.groupBy("host").agg(F.max(F.struct(order.alias("o"), "text")).alias("best")).select("host", F.col("best.o.token").alias("article"), F.col("best.text").alias("slot"))
    # a block with the vector of an element stands wherever that element stands
    wide = vectors.where("block <> 0").join(whole.select("host", "of"), "host").where(F.lit(SHARE) * F.col("pages") >= F.col("of"))
    same = wide.join(elements.select("host", "vector").distinct(), ["host", "vector"], "left_semi")
    fixed = same.groupBy("host").agg(F.collect_set("block").alias("fixed"), F.sum("text").alias("size"))
    found = slots.join(wraps, "host", "full").join(fixed, "host", "left")
    return found.select("host", "article", "keep", F.when(F.col("size") <= F.lit(MOST_FIXED) * F.col("slot"), F.col("fixed")).alias("fixed"))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(*(batch.column(k)[i].as_py() for k in range(2, 6))) for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["key", "url", "text", "n_chars"])


def extract_articles(pages: DataFrame, key: str = "page_id", url: str = "url", text: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row.

    Null and empty pages have an empty text. A null or odd url belongs to the host "". Repeated rows keep a row each (in a vector they
    count as often as they occur). A page that lacks its host's slot has its own deduced. Other columns are not read.
    """
    templates = checkpointed(host_templates(checkpointed(occurrence_vectors(pages, key, url, text))))
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(text).alias("html"), host_of(F.col(url)).alias("host"))
    joined = lookup(rows, templates, "host").select("key", "url", "html", "article", "keep", "fixed")
    kind = pages.schema[key].dataType.simpleString()
    return joined.mapInArrow(_extracted, f"key {kind}, url string, text string, n_chars long").withColumnRenamed("key", key)
