"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree of style nodes: elements are the same
node if their chain of tags, classes and ids is the same (digits counting alike). For
each node with text of its own, over the host's distinct pages that have it, two
entropies are taken to the base of their number: of the presentations (sequences of
child elements) and of the contents (texts). Their weighted mean is the node's
importance: near 0 where all pages show the same, near 1 where each shows its own.
Below it hang the texts themselves: as paragraphs, headings and list items of one
chain stand together, one that nearly all pages repeat may stand among others that
vary. A text's importance is the entropy of having it or something of one's own.

A branch is as important as the most important node or text in it, so importance is
carried up from the leaves: a branch goes, with all that is in it, if everything in it
is below ``IMPORTANCE`` on ``MIN_PAGES`` pages or more. (So where a parent's own text
goes and a child varies, the child stays.) That holds inside a marked article as well.
A page that importance would leave empty keeps what was there.

Before that, what its element names as no part of an article goes (menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles, reader comments); if a
page marks its article (article, main), only that is kept. A class or id counts as a
name of such a part only if all its words do ("site-footer", not "has-sidebar" or
"social-science"), and never on what also names itself content or marks the article.

Statistics are a row for each page and node, counted in Spark; so are the removed nodes,
however many a host has, and a page is handed only those it has itself. Pages are parsed
twice, in time linear in their length; no html is shuffled unless the lists of removed
nodes are too large to broadcast, and then by page, not by host.

Defined results: a null or empty html gives an empty text; a null url is a page of the
host ''; repeated pages count once in the statistics; broken markup is read like a
browser would in simple cases: a block closes an open paragraph, an end tag without a
start is ignored, text in an unknown element counts, what looks like a tag but never
ends is text.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.llm.linkgraph import host_of
from emberlake.llm.shared import cut, drop, sliced

IMPORTANCE = 0.1
MIN_PAGES = 5
#: Weight of the content entropy against that of the presentation.
CONTENT = 0.9
#: Parts that a node's pages are dealt to when they meet the removed nodes.
SALTS = 32

# Element names of HTML, and words that name what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noscript template svg math object select".split())
HEAD = frozenset("head title meta link style script base noscript template".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody tfoot thead tr ul caption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
DROPPED = frozenset("head nav footer aside form menu dialog button input search label fieldset".split())
NAMED = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer sidebar aside widget"
    " notice cookie cookies consent gdpr alert popup modal overlay newsletter subscribe signup login search social share sharing related recommended comment comments reply replies respond disqus discussion pagination pager toolbar skip form hidden".split()
)
#: Words that say where or whose a part is, beside what it is.
BESIDE = frozenset("main site page global top bottom left right primary secondary block box container wrapper wrap list section area bar link links item items inner outer user reader blog mobile desktop sticky fixed floating the in on text post article entry".split())
CONTENT_NAMES = frozenset("content article story post entry".split())
COMMENTS = frozenset("comment comments reply replies".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("table ul ol dl article section div main body html td th li".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRS = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_ATTR = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/\"']|$)", re.I)
_WORDS = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"[0-9]+")


def node(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _under(parent: int, name: str) -> int:
    """The style node below ``parent``; a number, so deep trees cost no more than flat ones."""
    return node(f"{parent}/{name}")


class _Frame:
    """An open element. skip: the tag of the outermost element that drops it, or nothing; p_at: where the paragraph is that a block would close, or -1."""

    __slots__ = ("tag", "node", "skip", "main", "head", "header", "owner", "p_at", "shape")

    def __init__(self, tag: str, of: int, up: _Frame | None, at: int, skip: str = "", main: bool = False):
        self.tag, self.node, self.skip, self.main, self.shape = tag, of, skip, main, 0
        self.head = up is not None and up.head or tag == "head"
        self.header = up is not None and up.header or tag == "header"
        self.owner = self if up is None or tag in BLOCK else up.owner
        self.p_at = at if tag == "p" else -1 if up is None or tag in SCOPE else up.p_at


class Block:
    """A text of a block element: its style node, and what its element shows before it."""

    __slots__ = ("node", "text", "main", "shape")

    def __init__(self, frame: _Frame, text: str):
        self.node, self.text, self.main, self.shape = frame.node, text, frame.main, frame.shape


def _names_no_article(token: str) -> bool:
    words = set(_WORDS.findall(token))
    return bool(words & NAMED) and words <= NAMED | BESIDE and not ("header" in words and words & CONTENT_NAMES)


def _style(tag: str, attrs: str) -> tuple[str, bool, bool]:
    """Style of an element; whether its names say it is no article; whether they say it is."""
    main, skip = tag in ("article", "main"), tag in DROPPED
    if not attrs or "=" not in attrs and "hidden" not in attrs.lower():
        return tag, skip, main
    names, tokens = [], []
    for key, a, b, c in _ATTR.findall(attrs):
        key, value = key.lower(), (a or b or c).lower()
        if key == "hidden":
            skip = True
        elif key == "role":
            main |= value in ("main", "article")
            skip |= value in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog")
        elif key == "itemprop":
            main |= value == "articlebody"
            skip |= value == "comment"
        else:
            names += [key[0] + _DIGITS.sub("0", x) for x in value.split()]
            tokens += value.split()
    if tag not in ("html", "body"):
        says = [t for t in tokens if _names_no_article(t)]
        skip |= any(COMMENTS & set(_WORDS.findall(t)) for t in says) if main else bool(says) and not CONTENT_NAMES & set(tokens)
    return f"{tag}.{'.'.join(sorted(names))}" if names else tag, skip, main


def parse(page: str) -> list[Block]:
    """The blocks of text of a page that no name drops, in order, with their style nodes."""
    root = _Frame("", 0, None, 0)
    stack = [root]
    opened: dict[str, int] = {}
    blocks: list[Block] = []
    pieces: list[str] = []

    def flush() -> None:
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            pieces.clear()
            f = stack[-1].owner
            if text and not (f.header and f.tag not in HEADINGS):
                blocks.append(Block(f, text))

    def pop_to(k: int) -> None:
        if any(f.tag in BLOCK for f in stack[k:]):
            flush()
        for f in stack[k:]:
            opened[f.tag] -= 1
        del stack[k:]

    at, end, last, quoted = 0, len(page), page.rfind(">"), True
    while at < end:
        top = stack[-1]
        lt = page.find("<", at, last) if at <= last else -1
        if lt < 0:
            if not top.skip:
                pieces.append(page[at:])
            break
        if lt > at and not top.skip:
            pieces.append(page[at:lt])
        mark = page[lt + 1]
        if mark in "!?":
            k = page.find("-->", lt + 4) if page.startswith("<!--", lt) else page.find(">", lt)
            at = end if k < 0 else k + (3 if page.startswith("<!--", lt) else 1)
            continue
        name = _NAME.match(page, lt + 1 + (mark == "/"))
        if not name:
            if not top.skip:
                pieces.append("<")
            at = lt + 1
            continue
        tag = name.group().lower()
        if mark == "/":
            at = page.find(">", name.end()) + 1
            if opened.get(tag):
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                pop_to(k)
            continue
        m = _ATTRS.match(page, name.end()) if quoted else None
        if m:
            attrs, at = m.group(1), m.end()
        else:  # a quote that never ends: from here on quotes do not hide the end of a tag
            quoted, k = False, page.find(">", name.end())
            attrs, at = page[name.end() : k], k + 1
        if tag in RAW:
            found = re.compile(f"</{tag}", re.I).search(page, at)
            stop = page.find(">", found.end()) if found else -1
            at = end if stop < 0 else stop + 1
            if tag in BLOCK:
                flush()
            continue
        if top.head and tag not in HEAD:
            k = len(stack)
            while stack[k - 1].head:
                k -= 1
            pop_to(k)
        if tag in ("br", "td", "th") and not stack[-1].skip:
            pieces.append(" ")
        if tag in BLOCK:
            flush()
            if stack[-1].p_at >= 0:
                pop_to(stack[-1].p_at)
        if tag in CLOSED_BY and any(opened.get(t) for t in CLOSED_BY[tag]):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in CLOSED_BY[tag]:
                    pop_to(k)
                    break
                if stack[k].tag in ("ul", "ol", "dl", "table"):
                    break
        up = stack[-1]
        style, skip, main = _style(tag, attrs)
        up.owner.shape = zlib.crc32(tag.encode(), up.owner.shape)
        if tag in VOID or attrs.endswith("/") and tag not in BLOCK:
            continue
        if tag == "header":
            skip = skip or not up.main
        why = "" if up.skip == "form" and main and not skip else up.skip or (tag if skip else "")  # a form around the whole page is no form
        stack.append(_Frame(tag, _under(up.node, style), up, len(stack), why, (main or up.main) and not why))
        opened[tag] = opened.get(tag, 0) + 1
    flush()
    return blocks


def kept(blocks: list[Block], removed: frozenset[int] = frozenset()) -> list[str]:
    """The texts of the article's blocks, without the removed nodes and texts."""
    left = [b for b in blocks if b.main] or blocks
    pruned = [b for b in left if b.node not in removed and own_node(b) not in removed] if removed else left
    return [b.text for b in pruned or left]


def own_node(block: Block) -> int:
    """The leaf that the text itself is."""
    return node(f"{block.node}\n{block.text}")


_NODE = "host long, page long, node long, shape long, content long"


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page hash, html) to a row for each node with text of its own, and one for each text, which has no shape and its node as content."""
    for batch in sliced(batches):
        rows: list[tuple] = []
        for host, page, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            own: dict[int, tuple[list[int], list[str]]] = {}
            single: dict[int, int] = {}
            blocks = parse(text.as_py() or "")
            for b in [b for b in blocks if b.main] or blocks:
                shapes, texts = own.setdefault(b.node, ([], []))
                shapes.append(b.shape)
                texts.append(b.text)
                single[own_node(b)] = b.node
            rows += [(host, page, of, node(str(s)), node("\n".join(t))) for of, (s, t) in own.items()]
            rows += [(host, page, of, None, up) for of, up in single.items()]
        yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 5, names=["host", "page", "node", "shape", "content"])


def style_nodes(pages: DataFrame) -> DataFrame:
    """(host, page, node, shape, content) of each host's distinct pages."""
    rows = pages.select(F.xxhash64(host_of(F.col("url"))).alias("host"), F.xxhash64("html").alias("page"), "html").mapInArrow(_nodes, _NODE)
    return cut(rows.dropDuplicates(["host", "page", "node"]), "style-nodes")


def node_importance(every: DataFrame) -> DataFrame:
    """(host, node, pages, importance) from the style nodes."""
    seen = every.where("shape is not null")

    def entropy(value: str) -> DataFrame:
        """Entropy to the base of the page count, from how many pages share each value."""
        counts = seen.groupBy("host", "node", value).agg(F.count("*").alias("_k"))
        return counts.groupBy("host", "node").agg(F.sum("_k").alias("pages"), F.sum(F.col("_k") * F.ln("_k")).alias("_s")).select(
            "host", "node", "pages", F.when(F.col("pages") > 1, 1 - F.col("_s") / (F.col("pages") * F.ln("pages"))).otherwise(1.0).alias(f"_{value}"))

    contents = entropy("content")
    both = contents.join(entropy("shape").drop("pages"), ["host", "node"])
    shared = every.where("shape is null").groupBy("host", "node", F.col("content").alias("up")).agg(F.count("*").alias("_k")).where("_k > 1")
    single = shared.join(contents.select("host", F.col("node").alias("up"), "pages"), ["host", "up"])
    judged = single.select("host", "node", F.col("_k").alias("pages"), (1 - F.col("_k") * F.ln("_k") / (F.col("pages") * F.ln("pages"))).alias("importance"))
    return both.select("host", "node", "pages", (CONTENT * F.col("_content") + (1 - CONTENT) * F.col("_shape")).alias("importance")).union(judged)


def removed_nodes(pages: DataFrame, importance: float = IMPORTANCE, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, page, removed): the node ids that go, by page; never more than the page has."""
    every = style_nodes(pages)
    low = cut(node_importance(every).where(F.col("importance") < importance).where(F.col("pages") >= min_pages).select("host", "node"), "removed")
    dealt = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = every.select("host", "page", "node", F.pmod("page", F.lit(SALTS)).cast("int").alias("salt"))
    gone = cut(salted.join(dealt, ["host", "node", "salt"]).groupBy("host", "page").agg(F.collect_list("node").alias("removed")), "removed-by-page")
    drop(every, low)
    return gone


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    gone = removed_nodes(pages).select(F.col("host").alias("_host"), F.col("page").alias("_page"), "removed")
    rows = pages.select("page_id", "url", "html").join(gone, (F.xxhash64(host_of(F.col("url"))) == F.col("_host")) & (F.xxhash64("html") == F.col("_page")), "left").select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "removed")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = []
            for page, gone_ in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
                texts.append("\n".join(kept(parse(page.as_py() or ""), frozenset(gone_ or ()))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(extract, "page_id long, url string, text string, n_chars long")


def op7_html(pages: DataFrame) -> DataFrame:
    return main_text(pages)
