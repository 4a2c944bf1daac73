"""Main-text extraction by tree scoring.

A page becomes a tree of block elements. Every paragraph gives points for its length and its commas to its parent, and
half of them to the element above; an element's points are discounted by its link density. The element with the most
points is the container; siblings that score alike, or are long paragraphs with few links, are kept with it. Elements
that are furniture by tag, role, class or id never score and are never part of the text.
"""

from __future__ import annotations

import html as charrefs
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# HTML's elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea svg math object select".split())
GONE = frozenset("nav header footer aside form button dialog menu head title figure canvas audio video map label fieldset".split()) | RAW
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
ENDS_P = BLOCK - {"html", "head", "body", "td", "th", "tr", "tbody", "thead", "tfoot"}
SCOPE = {"li": {"ul", "ol", "menu", "dir"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tbody": {"table"}, "thead": {"table"}, "tfoot": {"table"}}
CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "tbody", "thead", "tfoot"}, "thead": {"tr", "td", "th", "tbody", "thead", "tfoot"}, "tfoot": {"tr", "td", "th", "tbody", "thead", "tfoot"}}
HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words of class, id, role and aria-label that name page furniture.
FURNITURE = frozenset(
    "ad ads adv advert alert adverts advertisement advertising adsense banner banners billboard breadcrumb breadcrumbs byline captcha comment comments commentlist cookie cookies consent complementary contentinfo copyright disqus dialog dropdown footer gdpr hidden login masthead menu menus modal nav navbar navigation newsletter notice notices overlay pager pagination paywall popup privacy promo promos promoted promotion recommend recommended recommendations related replies reply respond search share sharing sharebar shoutbox sidebar sidebars signup sitemap skip social sponsor sponsored sponsors subscribe subscription tags teaser toast toc toolbar tracking trending widget widgets".split()
)
# Words beside which a header is that of the text itself.
OWN_HEADER = frozenset("article content entry post section story text".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTR = re.compile(r"(?:^|\s)(class|id|role|aria-label|hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?(?=\s|/|$)", re.I)
FRAMES = frozenset("table tbody thead tfoot tr ul ol dl menu dir hgroup".split())
SPACE = re.compile(r"\s+")
EXTRACTED = "page_id long, url string, text string, n_chars long"


class Node:
    __slots__ = ("tag", "up", "inside", "gone", "points", "size", "linked")

    def __init__(self, tag: str, up: Node | None, gone: bool):
        self.tag, self.up, self.inside, self.gone = tag, up, [], gone
        self.points, self.size, self.linked = 0.0, 0, 0


def furniture(tag: str, attrs: str) -> bool:
    """Whether an element can't be part of the main text."""
    if tag in GONE:
        return True
    for m in ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name == "hidden" and tag not in ("html", "body"):
            return True
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return True
        elif name == "aria-label" or tag not in ("html", "body", "article", "main"):
            words = re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", (m[2] or "").strip("\"'")).lower())
            if any(w in FURNITURE for w in words) or "header" in words and not OWN_HEADER.intersection(words):
                return True
    return False


def parse(page: str) -> Node:
    """The tree of block elements; text and links are strings and (text,) tuples inside. Inline elements are dropped."""
    root = Node("body", None, False)
    at, pos, link = root, 0, 0
    opened: Counter[str] = Counter()  # open elements by tag, so that a tag without one isn't looked for

    def leave(to: Node) -> Node:
        n = at
        while n is not to:
            opened[n.tag] -= 1
            n = n.up
        return to

    for m in iter(lambda: TOKEN.search(page, pos), None):
        if m.start() > pos:
            at.inside.append((page[pos : m.start()], link > 0))
        pos = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag == "a":
                link = 0
            elif opened[tag]:
                n, stop = at, SCOPE.get(tag, ())
                while n.up and n.tag != tag and n.tag not in stop:
                    n = n.up
                if n.up and n.tag == tag:
                    at = leave(n.up)
                    link = 0
            continue
        attrs = m[3] or m[6] or ""
        if tag in RAW and not attrs.endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|\Z", re.I).search(page, pos)
            pos = end.end()
            continue
        if tag == "a":
            link = 1
        elif tag == "br" or tag == "hr":
            at.inside.append((" ", False))
        if tag in ("html", "body") or tag in VOID:
            continue
        gone = furniture(tag, attrs)
        if tag in BLOCK or tag in GONE or (gone and not attrs.endswith("/")):
            if tag in ENDS_P:
                n = at
                while n.up and n.tag not in BLOCK:
                    n = n.up
                if n.tag == "p" or (tag in HEADS and n.tag in HEADS):
                    at = leave(n.up)
            if tag in CLOSES and any(opened[x] for x in CLOSES[tag]):
                n, stop = at, SCOPE[tag]
                last = None
                while n.up and n.tag not in stop and n.tag != "article":
                    if n.tag in CLOSES[tag]:
                        last = n
                    n = n.up
                if last is not None:
                    at = leave(last.up)
            if tag not in BLOCK and tag not in GONE:
                # Furniture made of an inline element: skip to its own end tag.
                after = _end_of(page, tag, pos)
                link = 0 if tag == "a" and after > pos else link
                pos = after
                continue
            node = Node(tag, at, gone)
            at.inside.append(node)
            at = node
            opened[tag] += 1
    if pos < len(page):
        at.inside.append((page[pos:], link > 0))
    return root


def _end_of(page: str, tag: str, pos: int) -> int:
    level = 1
    for m in re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>])[^>]*>", re.I).finditer(page, pos):
        level += -1 if m[1] else 1
        if not level:
            return m.end()
    return pos


def _clean(raw: str) -> str:
    return SPACE.sub(" ", charrefs.unescape(raw)).strip()


def _own(node: Node) -> list:
    """Children in page order, runs of text joined."""
    out, run, linked = [], [], 0
    for x in [*node.inside, None]:
        if isinstance(x, tuple):
            run.append(x[0])
            linked += len(x[0]) if x[1] else 0
        else:
            if run:
                text = _clean("".join(run))
                if text:
                    out.append((text, min(linked, len(text))))
                run, linked = [], 0
            if x is not None:
                out.append(x)
    return out


def measure(node: Node, into: list[Node]) -> None:
    """Sizes and points of every element that isn't furniture, without recursion over the page's depth."""
    order, todo = [], [node]
    while todo:
        n = todo.pop()
        n.inside = _own(n)
        order.append(n)
        todo += [x for x in n.inside if isinstance(x, Node) and not x.gone]
    for n in reversed(order):
        for x in n.inside:
            if isinstance(x, tuple):
                n.size += len(x[0])
                n.linked += x[1]
            elif not x.gone:
                n.size += x.size
                n.linked += x.linked
    for n in order:
        for x in n.inside:
            if isinstance(x, tuple):
                points = (1 + x[0].count(",") + x[0].count("，") + min(len(x[0]) // 100, 3)) * (1 - x[1] / len(x[0]))
                paragraph = n.tag in ("p", "pre", "blockquote", "li", "dd", "td", "figcaption") or n.tag in HEADS
                above = n.up if paragraph and n.up else n
                while above.up and above.tag in FRAMES:
                    above = above.up
                above.points += points
                if above.up:
                    above.up.points += points / 2
    into += order


def density(n: Node) -> float:
    return n.linked / n.size if n.size else 0.0


def texts(node: Node) -> list[str]:
    out, todo = [], [node]
    while todo:
        n = todo.pop()
        if isinstance(n, tuple):
            out.append(n[0])
        elif not n.gone:
            todo += reversed(n.inside)
    return out


def extract(page: str) -> str:
    """The main text of one whole page; blocks are joined by a line feed. Without text it is empty."""
    nodes: list[Node] = []
    root = parse(page)
    measure(root, nodes)
    best = max(nodes, key=lambda n: (n.points * (1 - density(n)), n.tag in ("article", "main")))
    if not best.size:
        return ""
    marked = [n for n in nodes if n.tag in ("article", "main") and n.size >= best.size / 2]
    inside = best
    while inside.up is not None:  # a container within an article is widened to it
        if inside in marked:
            best = inside
        inside = inside.up
    top = best.points * (1 - density(best))
    if best.up is None or best.tag in ("article", "main"):
        kept = [best] if best.tag != "article" or best.up is None else [x for x in best.up.inside if x is best or isinstance(x, Node) and x.tag == "article" and not x.gone]
    else:
        kept = [x for x in best.up.inside if x is best or _joins(x, top)]
    return "\n".join(t for n in kept for t in texts(n))


def _joins(x, top: float) -> bool:
    """Whether a sibling of the best container belongs to the text."""
    if isinstance(x, tuple):
        return len(x[0]) > 80 and x[1] < len(x[0]) / 4
    if x.gone or not x.size:
        return False
    if x.points * (1 - density(x)) >= max(10.0, 0.2 * top) or x.tag in HEADS:
        return True
    text = " ".join(texts(x)) if x.tag in ("p", "pre", "blockquote") else ""
    return bool(text) and (len(text) > 80 and density(x) < 0.25 or not x.linked and text[-1:] in ".!?")


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row's whole html. Null html is empty and gives an empty text; null ids and
    urls and repeated rows stay; an empty table gives an empty table; other columns are ignored."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.in_slices(batches):
            got = [extract(h) for h in common.texts_of(b.column("html"))]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(got, pa.string()), pa.array([len(t) for t in got], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(rows, EXTRACTED)
