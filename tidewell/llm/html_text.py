"""Main text of web pages by composite text density.

For every node of the page's tree the composite density is its characters per tag, adjusted by a logarithm that falls where links hold much of the text. A
node's density sum adds the densities of its children that are blocks; inline elements are part of their block's text. The node of the largest sum under body
is in the article; the smallest density on the path from it up to body is the threshold of content. Every block that reaches it is content wherever it stands, so
the text is that of the smallest node that holds all of them; the threshold also separates leftovers with links.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9:-]*")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+")
TELLING = re.compile("class|id|role|hidden|style", re.I)
HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
SPACES = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {x: re.compile(rf"</{x}\s*>", re.I) for x in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp")}
BLOCK = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: An opening tag of the key ends open elements of the values, up to the nearest element that holds such ones.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = frozenset("ul ol menu dl table body html article section div main aside nav select".split())
#: Elements that are never part of an article; elements, roles and words of class and id that mark what is none unless it holds most of a page (fixed values).
UNSEEN = frozenset("script style noscript template iframe svg button select textarea input head title object dialog".split())
DROPPED = frozenset("nav header footer aside form".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices gdpr alert popup modal overlay nav navbar navigation menu menus breadcrumb breadcrumbs"
    " sidebar side aside widget footer header masthead comment comments disqus reply replies respond related recommended share sharing social subscribe newsletter signup login search pagination pager toolbar legal copyright".split()
)
#: Words beside which a mark keeps its meaning inside one class or id ("site-footer", "share-buttons").
BESIDE = frozenset("a all area articles banner bar bottom box block button buttons container content dialog form global icons item items left links list main message page panel posts primary reader right row section secondary site slot text thread top unit user wrap wrapper".split())
#: Tags that may be left open inside a cell: their closing tags end nothing outside it.
INLINE = frozenset("b i em strong a span p".split())
KEEPS_PARAGRAPH = HOLDS | {"li", "td", "th", "dd", "form", "header", "footer", "blockquote", "figure"}
LINKED = 0.6


class Node:
    __slots__ = ("tag", "parent", "parts", "chars", "tags", "link_chars", "link_tags", "density", "total", "dropped", "unseen", "block", "open", "scopes")

    def __init__(self, tag: str, parent, dropped: bool = False, unseen: bool = False):
        self.tag, self.parent, self.dropped, self.unseen, self.parts = tag, parent, dropped, unseen, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.block = tag in BLOCK


def _marked(value: str) -> bool:
    """Whether a class or id has a mark: as a whole, or with words beside which it keeps its meaning."""
    for token in value.lower().split():
        parts = [x for x in re.split(r"[^a-z0-9]+", token) if x]
        if any(x in MARKS for x in parts) and all(x in MARKS or x in BESIDE or x.isdigit() for x in parts):
            return True
    return False


def _dropped(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether a node is marked as no part of an article, and whether it is so for certain, as readers don't see it."""
    if tag in UNSEEN:
        return True, True
    dropped = tag in DROPPED
    if TELLING.search(attributes):
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), next((v for v in m.groups()[1:] if v), "")
            if name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and HIDING.search(html.unescape(value)):
                return True, True
            if name == "role" and not ROLES.isdisjoint(value.lower().split()) or name in ("class", "id") and tag not in ("body", "html", "article", "main") and _marked(value):
                dropped = True
    return dropped, False


def _tags(page: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, name with a slash for closing tags, attributes) of the tags of a page; comments and declarations have no name. One pass: what has no end is seen
    once. In a page with a quote that is never closed, quotes count no longer."""
    at, last, quotes = 0, page.rfind(">"), True
    while True:
        start = page.find("<", at)
        if start < 0:
            return
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = len(page) if end < 0 else end + 3
            yield start, at, "", ""
            continue
        at = start + 1
        if at > last:
            return
        name = NAME.match(page, at)
        if name is None:
            if page[at] in "!?":
                at = page.find(">", at) + 1
                yield start, at, "", ""
            continue
        end = -1
        stop = STOP.search(page, name.end()) if quotes else None
        while stop is not None:
            if stop[0] == ">":
                end = stop.start()
                break
            close = page.find(stop[0], stop.end())
            if close < 0:
                break
            stop = STOP.search(page, close + 1)
        if end < 0:
            quotes, end = False, page.find(">", name.end())
        at = end + 1
        yield start, at, name[0].lower(), page[name.end() : end]


def parse(page: str) -> Node:
    """The page's tree, by the common rules for tags that are not closed. Text stands in `parts` among child nodes. Every node counts the open tags below the nearest
    node where a search for one of them ends, so nothing is searched for in vain: the time is in proportion to the page."""
    root = node = Node("html", None)
    root.open, root.scopes = defaultdict(int), (defaultdict(int), defaultdict(int), defaultdict(int))  # open elements of the page; of the list or box; around the paragraph; of the cell
    at, body = 0, False

    def leave(up: Node) -> Node:
        """Closes everything up to and with `up`."""
        x = node
        while x is not up.parent:
            root.open[x.tag] -= 1
            for scope in x.parent.scopes:
                scope[x.tag] -= 1
            x = x.parent
        return up.parent

    for start, end, tag, attributes in _tags(page):
        if start < at:
            continue
        if start > at:
            node.parts.append(page[at:start])
        at = end
        if not tag:
            continue
        if tag[0] == "/":
            tag = tag[1:]
            if tag in ("html", "body") or not (node.scopes[2] if tag in INLINE else root.open)[tag]:
                continue
            up = node
            while up.tag != tag:
                up = up.parent
            node = leave(up)
            continue
        if tag in BLOCK and node.scopes[1]["p"]:  # ends an open paragraph
            up = node
            while up.tag != "p":
                up = up.parent
            node = leave(up)
        if tag in ENDS:
            while node.tag not in HOLDS and any(node.scopes[0][x] for x in ENDS[tag]):
                up = node
                while up.tag not in ENDS[tag]:
                    up = up.parent
                node = leave(up)
        if tag == "html" or tag == "body" and body:
            continue
        if tag == "body":
            body = True
            if node is not root:
                up = node
                while up.parent is not root:
                    up = up.parent
                node = leave(up)
        child = Node(tag, node, *_dropped(tag, attributes))
        node.parts.append(child)
        if tag in RAW:
            close = RAW[tag].search(page, at)
            at = close.end() if close else len(page)
        elif tag not in VOID and not attributes.rstrip().endswith("/"):
            root.open[tag] += 1
            for scope in node.scopes:
                scope[tag] += 1
            child.scopes = tuple(defaultdict(int) if tag in ends else scope for scope, ends in zip(node.scopes, (HOLDS, KEEPS_PARAGRAPH, ("td", "th")), strict=True))
            node = child
    if at < len(page):
        node.parts.append(page[at:])
    return root


def _restore(body: Node) -> None:
    """Takes back marks of nodes that hold most of the page's plain text and a first heading or article, or without which hardly any text and no such element is left: wrappers
    of the whole page. Elements for menus, footers and asides stay marked. The header of an article with its heading is part of the article."""
    order, stack = [], [body]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [x for x in node.parts if isinstance(x, Node) and not x.unseen]
    plain, heads, left, kept = {}, {}, {}, {}
    for node in reversed(order):
        size = keep = 0
        head = node.tag in ("h1", "article", "main")
        for x in node.parts:
            if isinstance(x, str):
                n = len(x) - x.count(" ") - x.count("\n")
                size, keep = size + n, keep + n
            elif not x.unseen:
                size, keep, head = size + plain[x], keep + left[x], head or heads[x]
        plain[node] = 0 if node.tag == "a" else size
        left[node] = 0 if node.dropped or node.tag == "a" else keep
        heads[node] = head
        kept[node] = not node.dropped and (node.tag in ("h1", "article", "main") or any(kept[x] for x in node.parts if isinstance(x, Node) and not x.unseen))
    for node in order:  # parents first
        if node.dropped and node.tag not in ("nav", "footer", "aside") and 2 * plain[node] > plain[body] and (heads[node] or not kept[body] and 10 * left[body] < plain[body]):
            node.dropped = False
        if node.dropped and node.tag == "header" and heads[node]:
            up = node.parent
            while up is not body and up.tag not in ("article", "main") and not up.dropped:
                up = up.parent
            node.dropped = up.dropped or up.tag != "article"


def _measure(root: Node) -> list[Node]:
    """Counts of characters and tags, all and in links, for every node that is not dropped; whether it is or holds a block; the nodes, parents first."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [x for x in node.parts if isinstance(x, Node) and not x.dropped]
    for node in reversed(order):
        for x in node.parts:
            if isinstance(x, str):
                node.chars += len(x) - x.count(" ") - x.count("\n")
            elif not x.dropped:
                node.chars, node.tags = node.chars + x.chars, node.tags + x.tags + 1
                node.link_chars, node.link_tags = node.link_chars + x.link_chars, node.link_tags + x.link_tags + (x.tag == "a")
                node.block = node.block or x.block
        if node.tag == "a":
            node.link_chars = node.chars
    return order


def _densities(order: list[Node], body: Node) -> None:
    share = body.link_chars / max(body.chars, 1)
    for node in order:
        if node.chars:
            plain, linked = max(node.chars - node.link_chars, 1), node.link_chars
            base = math.log(node.chars / plain * linked + share * node.chars + math.e)
            node.density = node.chars / max(node.tags, 1) * math.log(node.chars / max(linked, 1) * max(node.tags, 1) / max(node.link_tags, 1) + 1e-12) / max(math.log(base + 1e-12), 1.0) if base > 0 else 0.0
    for node in order:
        node.total = sum(x.density for x in node.parts if isinstance(x, Node) and not x.dropped and x.block)


def _leftover(x: Node, threshold: float) -> bool:
    """Whether a block is mostly links and below the threshold."""
    return x.tag in BLOCK and x.density < threshold and x.link_tags > 0 and x.link_chars > LINKED * x.chars


def _adds(up: Node, below: Node, threshold: float) -> bool:
    """Whether a node holds content outside one of its children: a block or text of its own that reaches the threshold, or, under body, a first heading."""
    own, stack = 0, []
    for x in up.parts:
        if isinstance(x, str):
            own += len(x) - x.count(" ") - x.count("\n")
        elif x is not below and not x.dropped:
            if x.tag == "h1" and up.parent is not None and up.tag != "body":
                return True
            stack.append(x)
            own += 0 if x.block else x.chars - x.link_chars
    if own and own * math.log(own) >= threshold:
        return True
    while stack:
        x = stack.pop()
        if x.block and x.chars and x.link_chars <= LINKED * x.chars and x.density >= threshold:
            return True
        stack += [y for y in x.parts if isinstance(y, Node) and not y.dropped]
    return False


def _content(best: Node, body: Node, threshold: float) -> Node:
    """The smallest node that holds the best one, the article or main element around it, and all content by the threshold."""
    root = up = best
    while up is not body:
        below, up = up, up.parent
        if up.tag in ("article", "main") and root.tag not in ("article", "main") or _adds(up, below, threshold):
            root = up
    return root


def extract(page) -> str:
    """The main text of a page: its blocks, white space inside them made one space, joined by line ends. None and pages without text give an empty text."""
    if not isinstance(page, str) or not page:
        return ""
    root = parse(page)
    body = next((x for x in root.parts if isinstance(x, Node) and x.tag == "body"), root)
    _restore(body)
    order = _measure(body)
    _densities(order, body)
    best = max(order, key=lambda n: n.total)  # the first of equal ones, which holds the others
    if best.total <= 0:
        best = body
    threshold, up = best.density, best
    while up is not body:
        up = up.parent
        threshold = min(threshold, up.density)
    root = _content(best, body, threshold)
    blocks, run = [], []

    def end() -> None:
        if run:
            text = SPACES.sub(" ", html.unescape("".join(run))).strip(" ")
            if text:
                blocks.append(text)
            run.clear()

    stack: list = [root]
    while stack:
        x = stack.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            run.append(x)
        elif x.tag == "br":
            run.append(" ")
        elif not x.dropped and (x is root or root.tag == "article" or not _leftover(x, threshold)):  # an article's own links are part of it
            block = x.tag in BLOCK
            if block:
                end()
                stack.append(None)
            stack += reversed(x.parts)
    end()
    return "\n".join(blocks)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html). Null or empty html: empty text. Whole pages are read, however long; repeated rows
    give a row each; other columns are ignored."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [extract(x) for x in batch.html]
            yield pd.DataFrame({"page_id": pd.array(batch.page_id, "Int64"), "url": batch.url, "text": texts, "n_chars": [len(t) for t in texts]})

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInPandas(run, "page_id long, url string, text string, n_chars long")
