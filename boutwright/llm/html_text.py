"""Main text of web pages by composite text density.

The page becomes a tree. Each node has characters C, link characters LC, tags T and link tags LT;
its composite density is C/T times a logarithm that falls with links:
log_base(C/T * T/LT), base ln(C * LC / (C - LC) + lc * C / c + e), over the page's own lc / c.
A node's density sum adds its children's densities. The path from the body to the node of the
highest sum (or the article element around it) gives the threshold, the least density on that
path. That node is kept whole. From the body down, so is every other subtree, or run of text
between blocks, at or above the threshold, and every heading that leads a kept one of its siblings.
Text of scripts, styles, forms, navigation, headers, footers and asides never counts. A block whose
class or id names an advert, a notice, a menu or comments counts only where its figures speak
against the name: less than half of its text is links and its density sum is above that of all
that has no such name.

Defined cases: null and empty pages, and pages without text, have empty text; unclosed and stray
tags are repaired; very long pages take time and memory in proportion to their length, broken
markup included (a < without its > is text); repeated rows stay repeated; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
SPECIAL = re.compile(r"[>\"']")
OPAQUE = re.compile(r"<!--|<!\[CDATA\[")
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "xmp", "noembed"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body br canvas center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
DROP = RAW | set("head nav header footer aside form button select option input menu dialog object canvas audio video map".split())
#: What a class or id says of a block that is no main text.
NAMED = re.compile(r"(?i)(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|promo\w*|sponsor\w*|cookies?|consent|gdpr|notices?|notification\w*|popup|modal|overlay|newsletter|subscribe|sidebar|side|related|recommend\w*|share|sharing|social|breadcrumbs?|menu|nav|navbar|navigation|footer|header|masthead|toolbar|widgets?|comments?|disqus|respond|replies|reply|pagination|pager|login|signup|search|copyright|legal|disclaimer)(?:$|[\s_-])")
ATTR = re.compile(r"""(?i)(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar", "form"}
#: An open element that a start tag closes, up to the nearest element that ends its reach.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
CLOSE_P = BLOCK - {"br", "body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "dialog", "canvas"}
SPACES = re.compile(r"\s+")
#: Leading zeros and numbers beyond all characters, which need not be read as numbers.
ZEROS, HUGE = re.compile(r"&#0+(?=[0-9])"), re.compile(r"&#[0-9]{8,};?")


class Node:
    __slots__ = ("tag", "up", "items", "drop", "chars", "links", "tags", "link_tags", "density", "sums", "named", "block", "list_block", "option_block")

    def __init__(self, tag: str, up: Node | None, drop: bool):
        self.tag, self.up, self.items, self.drop, self.named = tag, up, [], drop or (up is not None and up.drop), False
        # the nearest element from here up that can end or be closed by an implied end: of any, a list's and an option's
        holds = tag in BLOCK or up is None
        self.block = self if holds else up.block
        self.list_block = self if holds or tag == "menu" else up.list_block
        self.option_block = self if holds or tag in ("option", "select") else up.option_block


def _marks(tag: str, attrs: str) -> tuple[bool, bool]:
    """Whether an element never counts, and whether its name says that it is no main text."""
    if tag in DROP:
        return True, False
    if tag in ("body", "html", "article", "main") or not attrs.strip():
        return False, False
    named = False
    for name, value in ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"(?i)display\s*:\s*none", value):
            return True, False
        named = named or name in ("class", "id") and NAMED.search(value) is not None
    return False, named


class Tokens:
    """Tags of a page, left to right, in time proportional to the page however broken it is.

    A tag reaches to the first > outside quotes; where there is none, or a quote is not closed, its <
    is text. What was found out on the way to a failure is remembered, so no stretch is read again
    from each of the < in it.
    """

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in ">\"'"}
        self.failed: set[int] = set()  # quotes that open, outside of others, on the way to no >
        self.seen = (0, -1)  # no special character stands between these two but the second

    def _close(self, at: int) -> int:
        """Where the > of a tag stands whose attributes start at ``at``; -1 where there is none."""
        low, high = self.seen
        if not low <= at <= high:
            m = SPECIAL.search(self.page, at)
            low, high = self.seen = at, m.start() if m else len(self.page)
        way, at = [], high
        while at < len(self.page) and (c := self.page[at]) != ">":
            if at in self.failed or self.last[c] <= at:
                break
            way.append(at)
            m = SPECIAL.search(self.page, self.page.index(c, at + 1) + 1)
            at = m.start() if m else len(self.page)
        else:
            if at < len(self.page):
                return at
        self.failed.update(way)
        self.failed.add(at)
        return -1

    def next(self, at: int) -> tuple[int, int, bool, str | None, str] | None:
        """From ``at``: start, stop, whether it is an end tag, name (None: a comment or declaration) and attributes of the next tag."""
        page = self.page
        while True:
            if at > self.last[">"]:  # only what may run to the end of the page is left
                m = OPAQUE.search(page, at)
                return (m.start(), len(page), False, None, "") if m else None
            start = page.find("<", at)
            if start < 0:
                return None
            for mark, end in (("<!--", "-->"), ("<![CDATA[", "]]>")):
                if page.startswith(mark, start):
                    stop = page.find(end, start + len(mark))
                    return start, stop + len(end) if stop >= 0 else len(page), False, None, ""
            at = start + 1
            if page.startswith(("!", "?"), at):
                if start < self.last[">"]:
                    return start, page.index(">", start) + 1, False, None, ""
                continue
            ends = page.startswith("/", at)
            if name := NAME.match(page, at + ends):
                stop = self._close(name.end())
                if stop >= 0:
                    return start, stop + 1, ends, name[0].lower(), page[name.end() : stop]


def parse(page: str) -> Node:
    """A tree of the page; text items are strings, still encoded."""
    root = Node("html", None, False)
    node, at = root, 0
    tokens, open_ = Tokens(page), Counter()

    def leave(to: Node) -> Node:
        """Close all elements from the current one up to below ``to``."""
        x = node
        while x is not to:
            open_[x.tag] -= 1
            x = x.up
        return to

    while (token := tokens.next(at)) is not None:
        start, stop, ends, tag, attrs = token
        if start > at:
            node.items.append(page[at:start])
        at = stop
        if tag is None:
            continue
        if ends:  # closes the nearest such element, if one is open
            if open_[tag]:
                x = node
                while x.tag != tag:
                    x = x.up
                node = leave(x.up)
            continue
        if tag == "html" or tag == "body" and open_["body"]:
            continue
        if tag in CLOSES or tag in CLOSE_P:
            node = leave(_implied(node, tag))
        drop, named = _marks(tag, attrs)
        child = Node(tag, node, drop)
        child.named = named
        node.items.append(child)
        if tag in RAW:
            end = re.compile(rf"(?i)</{tag}").search(page, at)
            close = page.find(">", end.end()) if end else -1
            at = close + 1 if close >= 0 else len(page)
        elif tag not in VOID and not attrs.endswith("/") or tag in BLOCK and tag not in VOID:
            node = child
            open_[tag] += 1
    if at < len(page):
        node.items.append(page[at:])
    return root


def _path(node: Node | None) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.up


def _implied(node: Node, tag: str) -> Node:
    """The node that a start tag goes into after the ends that it implies."""
    shut, stop = CLOSES.get(tag, (set(), set()))
    near = "list_block" if tag == "li" else "option_block" if tag == "option" else "block"
    out, x = node, getattr(node, near)
    while x.up is not None and x.tag not in stop:
        if x.tag in shut or x.tag == "p" and tag in CLOSE_P:
            out = x.up
        elif x.tag in BLOCK and x.tag != "p":
            break
        x = getattr(x.up, near)
    return out


def _ordered(root: Node) -> list[Node]:
    """All nodes, parents first (no recursion: pages may be nested deeply)."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [x for x in reversed(node.items) if isinstance(x, Node)]
    return out


def _measure(root: Node) -> list[Node]:
    nodes = _ordered(root)
    for n in nodes:
        n.chars = n.links = n.tags = n.link_tags = 0
        n.sums = 0.0
    for n in reversed(nodes):
        if n.drop:
            continue
        n.chars += sum(len(x.strip()) for x in n.items if isinstance(x, str))
        if n.tag == "a":
            n.links, n.link_tags = n.chars, n.link_tags + 1
        if n.up is not None and not n.named:
            n.up.chars += n.chars
            n.up.links += n.links
            n.up.tags += n.tags + 1
            n.up.link_tags += n.link_tags
    lc, c = root.links, max(root.chars, 1)
    for n in reversed(nodes):
        n.density = 0.0
        if n.drop or not n.chars:
            continue
        n.density = _density(n.chars, n.links, n.tags, n.link_tags, lc, c)
        if n.up is not None and not n.up.drop and not n.named:
            n.up.sums += n.density
    return nodes


def _density(chars: int, links: int, tags: int, link_tags: int, lc: int, c: int) -> float:
    plain = max(chars - links, 1)
    base = math.log(chars / plain * links + lc / c * chars + math.e)
    arg = chars / max(links, 1) * max(tags, 1) / max(link_tags, 1)
    return chars / max(tags, 1) * math.log(max(arg, 1.0)) / max(math.log(max(base, 1.0001) + 1), 1e-6)


def _regions(root: Node) -> dict[Node, Node]:
    """The node of the highest density sum (of equal sums, density) of the page and of each named block, without the named blocks inside."""
    best, home = {}, {}
    for n in _measure(root):
        home[n] = at = n if n.named or n.up is None else home[n.up]
        if not n.drop and n.chars and (at not in best or (n.sums, n.density) > (best[at].sums, best[at].density)):
            best[at] = n
    return best


def main_node(root: Node) -> Node | None:
    """The block of the highest density sum, raised to the article it stands in; names that their figures contradict are cleared."""
    best = _regions(root)
    top = best.get(root)
    wrong = [at for at, n in best.items() if at.named and 2 * at.links < at.chars and (top is None or (n.sums, n.density) > (top.sums, top.density))]
    for at in wrong:
        while at is not None and at.named is not None:  # None: this way up is cleared already
            at.named, at = None, at.up
    if wrong:
        top = _regions(root).get(root)
    if top is None:
        return None
    top = next((n for n in _path(top) if n.tag in BLOCK or n.up is None), top)
    return next((n for n in _path(top) if n.tag == "article"), top)


def _parts(node: Node, path: set[Node]) -> list[list]:
    """The items of a node that count: blocks one by one, and runs of text and inline elements between them."""
    out, run = [], None
    for x in node.items:
        if isinstance(x, Node) and (x.drop or x.named):
            run = None if x.tag in BLOCK else run
        elif isinstance(x, Node) and (x.tag in BLOCK or x in path):
            out.append([x])
            run = None
        elif run is None:
            out.append(run := [x])
        else:
            run.append(x)
    return out


def kept(root: Node, top: Node) -> dict[Node, list[list]]:
    """Of ``top``'s ancestors and of blocks less dense than its path: their parts that count, in order; a part that is a key is not whole."""
    path = list(_path(top))
    framed = any(n.tag == "body" for n in path)
    limit = min(n.density for n in path if n.up is not None or not framed)
    on, lc, c = set(path), root.links, max(root.chars, 1)
    parts, todo, sure = {}, [root] if top is not root else [], {id(top)}
    while todo:
        node = todo.pop()
        parts[node] = _parts(node, on)
        for part in parts[node]:
            x = part[0]
            if isinstance(x, Node) and len(part) == 1 and (x.tag in BLOCK or x in on):
                if x is top or x not in on and x.density >= limit:
                    sure.add(id(x))
                else:
                    todo.append(x)
            else:
                of = [y for y in part if isinstance(y, Node)]
                chars = sum(y.chars if isinstance(y, Node) else len(y.strip()) for y in part)
                figures = sum(y.links for y in of), sum(y.tags + 1 for y in of), sum(y.link_tags for y in of)
                # beside the path only: elsewhere such a run is the text of a block that was found too thin
                if node in on and chars and _density(chars, *figures, lc, c) >= limit:
                    sure.add(id(x))
    for node in reversed(parts):  # children first
        out, led = [], [False] * 7
        for part in reversed(parts[node]):
            x = part[0]
            level = int(x.tag[1]) if isinstance(x, Node) and re.fullmatch("h[1-6]", x.tag) else 0
            good = id(x) in sure or isinstance(x, Node) and bool(parts.get(x))
            if level and not good and led[level]:
                good = True
                parts[x] = [x.items]
            if good:
                out.append(part)
            if level:
                led[level:] = [False] * (7 - level)
            elif good:
                led = [True] * 7
        parts[node] = out[::-1]
    return parts


def main_text(page: str | None) -> str:
    """The main text: blocks in page order, one a line."""
    if not page:
        return ""
    root = parse(page)
    top = main_node(root)
    if top is None:
        return ""
    parts = kept(root, top)
    blocks, line = [], []

    def close() -> None:
        if text := SPACES.sub(" ", html.unescape(HUGE.sub("\ufffd", ZEROS.sub("&#", "".join(line))))).strip():
            blocks.append(text)
        line.clear()

    todo: list = [root]
    while todo:
        x = todo.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            line.append(x)
        elif not x.drop and not x.named:
            if x.tag in BLOCK:
                close()
                todo.append(None)
            if x in parts:  # what is left out ends a line
                for part in reversed(parts[x]):
                    todo += [None, *reversed(part)]
            else:
                todo += reversed(x.items)
    close()
    return "\n".join(blocks)


def _texts(keep: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [main_text(x.as_py()) for x in b.column("__html")]
            cols = {k: b.column(k) for k in keep}
            yield pa.RecordBatch.from_pydict(cols | {"text": pa.array(got, pa.string()), "n_chars": pa.array(np.array([len(x) for x in got], np.int64))})

    return run


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), source: str = "html") -> DataFrame:
    """``keep`` columns, text and n_chars of every page."""
    src = pages.select(*keep, F.col(source).cast("string").alias("__html"))
    schema = T.StructType([src.schema[k] for k in keep] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return src.mapInArrow(_texts(keep), schema)


def op5_html_text(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))
