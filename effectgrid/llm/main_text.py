"""HTML extraction by composite text density.

Each node of the page's tree gets its link-adjusted characters per tag: with C
characters, T tags, LC of the characters and LT of the tags in links, and NLC
characters outside of links,

    C / T * log_b(C / LC * T / LT),   b = ln(C / NLC * LC + C * LC(body) / C(body) + e),

zeros in denominators counting as one. A node's sum is that of its children's
densities. The least density on the path from the node with the largest sum to
the body is the threshold. From the body down, every node that reaches the
threshold gives the node with the largest sum inside it; a node of which its own
text is the half or more is given whole. Given nodes are widened to the article
or main element around them, or narrowed to the articles in them that reach the
threshold and hold most of them; where such an element is around the largest
sum, only those count. Headings are too short for a density, so those
beside a given node come with it.

Nodes that are no article by their element or role (menus, page headers and
footers, sidebars, forms, scripts, styles) are taken off before. So are those with
the name of such a part (a sidebar, a notice, an advert, reader comments) as class
or id, whatever their size, unless they hold an article or main element, or nothing
but headings, links and other named parts is beside them in the element around. Names
that speak of a wrapper (`with-sidebar`, `page-nav-wrap`) are a weak sign: such a
node stays, too, if it holds most of the characters outside of links of the element
around it, or of a page that has no such element. Of a main element with
several articles every one is given.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</(?:[^>]*)(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|$)""", re.I)
_RAW = {x: re.compile(rf"</{x}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for x in ("script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr caption ul".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag of the key ends open elements of these kinds, no further out than `_SCOPE`.
_ENDS = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "option": {"option"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "tbody": {"tr", "td", "th", "thead", "tbody"},
    "tfoot": {"tr", "td", "th", "thead", "tbody"},
}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}
_NEVER = frozenset("script style noscript template iframe textarea title head select button nav aside footer dialog svg math canvas object audio video map".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar comment comments disqus cookie cookies consent"
    " notice newsletter subscribe subscription popup modal overlay menu nav navbar navigation breadcrumb breadcrumbs footer masthead share sharing"
    " social related recommended widget toolbar pagination pager login signup respond replies gdpr".split()
)
#: Parts of a name by which it tells of what a wrapper holds: with any name, and with names of a page's layout.
_HOLDING = frozenset("has with no without".split())
_WRAPPING = frozenset("page site content main body layout wrap wrapper wrapping container".split())
_LAYOUT = frozenset("banner sidebar menu nav navbar navigation breadcrumb breadcrumbs header footer masthead toolbar widget".split())


class Node:
    __slots__ = ("tag", "parent", "children", "parts", "gone", "weak", "named", "within", "loose", "chars", "tags", "link_chars", "link_tags", "density", "sum", "own", "top")

    def __init__(self, tag: str, parent: Node | None, sign: str = ""):
        self.tag, self.parent, self.gone, self.named = tag, parent, sign == "gone", sign == "named"
        self.weak = self.named or sign == "weak"
        self.within = tag == "article" or (parent is not None and parent.within)
        self.children: list[Node] = []
        self.parts: list[str | Node] = []


def _unwanted(tag: str, attributes: str, within_article: bool) -> str:
    """Whether a node is "gone", "named" like an unwanted part, "weak" by a wrapper's name, or none of these."""
    if tag in _NEVER or (tag == "header" and not within_article):
        return "gone"
    if not attributes or tag in ("html", "body", "main"):
        return ""
    found = ""
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name in ("class", "id"):
            for token in value.split():
                parts = set(re.split(r"[^a-z0-9]+", token))
                unwanted = parts & _NAMES | (parts & {"header"} if not within_article else set())
                if unwanted:
                    wrapper = parts & _HOLDING or (parts & _WRAPPING and unwanted <= _LAYOUT)
                    found = found or "weak" if wrapper else "named"
        elif name == "role" and value in _ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return "gone"
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return "gone"
    return found


def parse(page: str) -> Node:
    """The tree of a page. Missing end tags are supplied, stray ones left out; a tag cut off by the end is none."""
    root = Node("html", None)
    body = Node("body", root)
    root.children.append(body)
    node, at = body, 0
    find = _TOKEN.search
    # how many elements of a name are open: nobody looks upwards for one that is not
    opened: dict[str, int] = {}

    def left(inner: Node, outer: Node) -> Node:
        """Closes the elements from the inner one up to below the outer one."""
        while inner is not outer:
            opened[inner.tag] -= 1
            inner = inner.parent
        return outer

    while (m := find(page, at)) is not None:
        if m.start() > at:
            node.parts.append(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                node.parts.append(html.escape(m[0][9:].removesuffix("]]>"), quote=False))
            continue
        if not page.endswith(">", m.start(), at):
            break
        tag, closing, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if closing:
            if opened.get(tag):
                up = node
                while up.tag != tag:
                    up = up.parent
                node = left(node, up.parent)
            elif tag == "br":
                node.parts.append(" ")
            continue
        if tag in ("html", "body", "head"):
            continue
        if tag in _VOID:
            node.parts.append(" " if tag in ("br", "hr") else "")
            if tag == "hr":
                node.parts.append(Node("hr", node))
            continue
        if tag in _BLOCK and node is not body:  # a block ends an open paragraph, and headings do not nest
            up = node
            while up is not body and up.tag != "p" and up.tag not in _BLOCK:
                up = up.parent
            if up is not body and (up.tag == "p" or (tag[0] == "h" and up.tag[0] == "h" and tag[1:].isdigit() and up.tag[1:].isdigit())):
                node = left(node, up.parent)
        ends = _ENDS.get(tag)
        if ends:
            up, last, scope = node, None, _SCOPE.get(tag, {"table"})
            unseen = sum(opened.get(x, 0) for x in ends)
            while unseen and up.tag not in scope:
                if up.tag in ends:
                    last, unseen = up, unseen - 1
                up = up.parent
            if last is not None:
                node = left(node, last.parent)
        child = Node(tag, node, _unwanted(tag, attributes, node.within))
        if tag in _RAW:
            end = _RAW[tag].search(page, at)
            at = end.end() if end else len(page)
            if not child.gone:
                child.parts.append(page[m.end() : end.start() if end else len(page)])
                node.children.append(child)
                node.parts.append(child)
            continue
        node.children.append(child)
        node.parts.append(child)
        if not attributes.rstrip().endswith("/") or tag in _BLOCK or tag in ("a", "b", "i", "span", "em", "strong"):
            node = child
            opened[tag] = opened.get(tag, 0) + 1
    else:
        if at < len(page):
            node.parts.append(page[at:])
    return body


def _measure(body: Node) -> list[Node]:
    """Characters and tags of every node, from the leaves up; those of unwanted nodes do not count."""
    order, stack = [], [body]
    while stack:
        node = stack.pop()
        node.children = [c for c in node.children if not c.gone]
        order.append(node)
        stack += node.children
    for node in reversed(order):
        node.own = sum(len("".join(p.split())) for p in node.parts if type(p) is str)
        node.chars = node.own + sum(c.chars for c in node.children)
        node.tags = sum(c.tags + 1 for c in node.children)
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.tags
        else:
            node.link_chars = sum(c.link_chars for c in node.children)
            node.link_tags = sum(c.link_tags + (c.tag == "a") for c in node.children)
    share = body.link_chars / body.chars if body.chars else 0.0
    for node in reversed(order):
        c, t = node.chars, max(1, node.tags)
        base = max(log(c / max(1, c - node.link_chars) * node.link_chars + share * c + e), 1.0001)
        ratio = c / max(1, node.link_chars) * t / max(1, node.link_tags)
        node.density = c / t * log(ratio) / log(base) if ratio > 1 else 0.0
        node.sum = sum(x.density for x in node.children)
        node.top = node  # the first of the largest sums in page order
        for child in node.children:
            if child.top.sum > node.top.sum:
                node.top = child.top
    return order


def _drop_named(order: list[Node], body: Node, named: bool) -> bool:
    """Drops nodes that are named so, or else the weak ones, unless what they hold speaks against it."""
    plain = {n for n in order if n.tag in ("article", "main") and not n.weak}
    holders = set()
    for node in plain:
        while node is not None and node not in holders:
            holders.add(node)
            node = node.parent
    for node in reversed(order):
        bare = node.named and node not in holders or node.tag == "a" or node.tag in _HEADINGS
        node.loose = 0 if bare else node.own + sum(c.loose for c in node.children)
    dropped, around = False, {body: None if plain else body}
    for node in order:  # parents come first
        if node is not body:
            around[node] = node.parent if node.parent in plain else around[node.parent]
        if node.weak and node.named == named and node not in holders:
            held = around[node]
            node.gone = (
                held is None
                or node.chars == node.link_chars
                or 2 * (node.chars - node.link_chars) < held.chars - held.link_chars
                or (node.named and held.loose > 0)
            )
            dropped |= node.gone
    return dropped


def _measured(body: Node) -> None:
    """Measures without nodes unwanted by their names, and without forms unless a form is what wraps the page."""
    order = _measure(body)
    for named in (True, False):
        if _drop_named(order, body, named):
            order = _measure(body)
    forms = [n for n in order if n.tag == "form"]
    for form in forms:
        form.gone = 2 * form.chars < body.chars
    if any(form.gone for form in forms):
        _measure(body)


def _around(node: Node) -> Node | None:
    """The outermost article around a node, else the nearest main."""
    found = None
    while node is not None:
        if node.tag == "article" or (node.tag == "main" and found is None):
            found = node
        node = node.parent
    return found


def _main(node: Node) -> Node | None:
    """The main element around an article."""
    while node is not None and node.tag != "main":
        node = node.parent
    return node


def _outer_articles(node: Node) -> list[Node]:
    found, stack = [], [node]
    while stack:
        x = stack.pop()
        if x.tag == "article":
            found.append(x)
        else:
            stack += x.children
    return found


def _articles(node: Node, threshold: float) -> list[Node]:
    """The articles in a node that reach the threshold, if they hold most of it, else the node."""
    found = [x for x in _outer_articles(node) if x.density >= threshold and x.chars]
    return found if 2 * sum(x.chars for x in found) >= node.chars and found else [node]


def _chosen(body: Node) -> list[Node]:
    """The nodes of the main text, in page order."""
    threshold, up = body.density, body.top
    while up is not body:
        threshold = min(threshold, up.density)
        up = up.parent
    taken, stack = set(), [body]
    while stack:
        node = stack.pop()
        if node.density < threshold or not node.chars or node in taken:
            continue
        top = node if 2 * node.own >= node.chars else node.top
        taken.add(top)
        if top is not node:
            stack += node.children
    if _around(body.top):
        taken = {x for x in map(_around, taken) if x}
        mains = {_main(x) for x in taken} - {None}
        taken |= {x for main in mains for x in _outer_articles(main)}
    else:
        taken = {x for node in taken for x in ([_around(node)] if _around(node) else _articles(node, threshold))}
        taken |= {x for node in taken if node is not body for x in node.parent.children if x.tag in _HEADINGS}
    out, stack = [], [body]
    while stack:
        node = stack.pop()
        if node in taken:
            out.append(node)
        else:
            stack += reversed(node.children)
    return out


def _blocks(node: Node, out: list[list[str]]) -> None:
    """The text of a node, cut into blocks; iterative, since pages may nest deeply."""
    stack: list[object] = [node]
    while stack:
        x = stack.pop()
        if x is None:
            if out[-1]:
                out.append([])
        elif type(x) is str:
            out[-1].append(x)
        elif not x.gone:
            if x.tag in _BLOCK:
                stack.append(None)
            stack += reversed(x.parts)
            if x.tag in _BLOCK and out[-1]:
                out.append([])


def main_text(page: str | None) -> str:
    """The main text of one page: blocks in page order, one per line; empty if there is none."""
    if not page:
        return ""
    body = parse(page)
    _measured(body)
    out: list[list[str]] = [[]]
    for node in _chosen(body):
        _blocks(node, out)
        out.append([])
    lines = (" ".join(html.unescape("".join(parts)).split()) for parts in out)
    return "\n".join(x for x in lines if x)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["id", "url", "text", "n_chars"],
        )


def extracted(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars (code points).

    A null or empty html has an empty text, as has a page of nothing but
    unwanted parts. Repeated rows are kept; other columns are not read.
    """
    rows = pages.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{url_column}`").cast("string").alias("url"), F.col(f"`{html_column}`").alias("html"))
    return rows.mapInArrow(_extracted, "id long, url string, text string, n_chars long").withColumnsRenamed({"id": id_column, "url": url_column})
