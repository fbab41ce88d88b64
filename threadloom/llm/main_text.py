"""Main text of web pages by scoring the tree of their elements.

Every paragraph passes points for its length and its commas to its ancestors, a share that falls with the distance;
a container's sum is discounted by the part of its text that lies in links. The best container and those of its siblings
that score enough of its sum, or are link-poor paragraphs or sections, make the main text. Parts that are never main text by
their element are left out beforehand, and so are those whose class, id or role says it, unless they hold the article:
an ``h1``, ``article`` or ``main`` and most of the prose, or all prose there is. The words of readers need an ``h1`` or ``main``.
The time is linear in the markup, however deep or unclosed it is.

A page is one row's work on its whole markup; pages are spread as Spark reads them and nothing is shuffled. Null, empty
and markup-free pages give their plain text or an empty one; unclosed elements end where HTML says or with their parent.
Repeated rows give equal rows, columns beside id, url and html are ignored, and an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import column, map_batches, record

BLOCKS = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
LEFT_OUT = frozenset(
    "head script style noscript template nav header footer aside form button select textarea input iframe object svg "
    "canvas dialog menu title".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe".split())
PARAGRAPHS = frozenset("p pre td blockquote li dd h1 h2 h3 h4 h5 h6 div section article main".split())
PROSE = frozenset("p pre blockquote ul ol dl table section article figure".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_MARKUP = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_UNWANTED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|complementary|cookies?|consent|disqus|footer|header|masthead|menu|modal|"
    r"nav\w*|newsletter|notices?|popup|promo\w*|related|replies|respond|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[\s_-])",
    re.I,
)
_READERS = re.compile(r"(?:^|[\s_-])(?:comments?|disqus|replies|respond|cookies?|consent|newsletter|subscribe)(?:$|[\s_-])", re.I)
# What a class says beside a word of the list where it means a part of the text: the head of a post, social history.
_OF_TEXT = re.compile(
    r"(?<![^\s])(?:(?:entry|post|article|story|chapter|section)[_-]header|social[_-](?!(?:bar|box|buttons?|feed|follow|icons?|links?|list|"
    r"media|menu|nav\w*|network\w*|share|sharing|widget|wrap\w*)(?:$|[\s_-]))\w+)(?![^\s])",
    re.I,
)
_HIDDEN = re.compile(r"""\shidden(?=[\s=/>]|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("name", "parent", "children", "out", "doubt", "inside", "block", "points", "text", "linked")

    def __init__(self, name: str, parent: Node | None, out: bool, doubt: str = "") -> None:
        self.name, self.parent, self.out = name, parent, out
        self.doubt = doubt  # class, id and role that speak against it
        self.inside = name in ("article", "main") or (parent is not None and parent.inside)
        self.block: Node = self if parent is None or name in BLOCKS else parent.block
        self.children: list[Node | str] = []
        self.points = 0.0
        self.text = self.linked = 0


def parse(html: str) -> Node:
    """Tree of the elements, with what is never main text marked."""
    root = node = Node("html", None, False)
    opened = Counter()  # by name, from the node up
    at = 0

    def close(until: Node) -> None:
        up = node
        while up is not until:
            opened[up.name] -= 1
            up = up.parent

    while at < len(html):
        found = _MARKUP.search(html, at)
        if found is None:
            node.children.append(unescape(html[at:]))
            break
        if found.start() > at:
            node.children.append(unescape(html[at : found.start()]))
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        if found[1]:
            if opened[name]:
                up = node
                while up.name != name:
                    up = up.parent
                close(up.parent)
                node = up.parent
            continue
        if name in BLOCKS:
            up = _close(node, name)
            close(up)
            node = up
        attributes = found[3]
        named = " ".join(m.strip("\"'") for m in _NAMES.findall(attributes)) if attributes else ""
        if named and (name in ("body", "html", "article", "main") or not _UNWANTED.search(_OF_TEXT.sub(" ", named))):
            named = ""
        inside = name == "header" and node.inside
        out = node.out or (name in LEFT_OUT and not inside) or bool(attributes and _HIDDEN.search(attributes))
        if name == "br":
            node.children.append(" ")
        elif name in VOID:
            if name == "hr":
                node.children.append(Node("hr", node, out))
        elif name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(html, at)
            at = end.end() if end else len(html)
        else:
            new = Node(name, node, out, named)
            node.children.append(new)
            if not attributes.endswith("/"):
                node = new
                opened[name] += 1
    judge(root)
    return root


def judge(root: Node) -> None:
    """Leave out the nodes in doubt, but those that hold the article; the outer ones are judged first."""
    order: list[Node] = []
    stack = [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
    if not any(node.doubt and not node.out for node in order):
        return
    own: dict[Node, int] = {}  # prose below that no inner node in doubt holds
    all_: dict[Node, int] = {}
    signs: dict[Node, int] = {}  # 1: an article, 2: an h1 or main
    for node in reversed(order):
        if node.out or node.name == "a":
            own[node] = all_[node] = signs[node] = 0
            continue
        below = [c for c in node.children if isinstance(c, Node)]
        plain = sum(len(c.strip()) for c in node.children if isinstance(c, str))
        own[node] = plain + sum(0 if c.doubt else own[c] for c in below)
        all_[node] = plain + sum(all_[c] for c in below)
        signs[node] = 2 if node.name in ("h1", "main") else int(node.name == "article")
        for c in below:
            signs[node] |= signs[c]
    prose = own[root]
    for node in order:
        if node.parent is not None and node.parent.out:
            node.out = True
        elif node.doubt and not node.out:
            readers = bool(_READERS.search(node.doubt))
            holds = signs[node] >= (2 if readers else 1) and all_[node] >= 4 * prose
            if all_[node] and (holds or (prose == 0 and not readers)):
                prose += own[node]
            else:
                node.out = True


def _close(node: Node, name: str) -> Node:
    """Where a block starts: outside of an open paragraph or heading, and of an open item of its own kind."""
    up = node.block
    if up.parent is not None and (up.name == "p" or up.name in HEADINGS or (up.name == name and name in ("li", "td", "th", "tr", "dt", "dd", "option"))):
        return up.parent
    return node


def measure(root: Node) -> list[Node]:
    """Text lengths below every node, and points passed up from paragraphs; the nodes that may be containers."""
    order: list[Node] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if not node.out:
            order.append(node)
            stack.extend(c for c in node.children if isinstance(c, Node))
    for node in reversed(order):
        own = [_SPACE.sub(" ", c) for c in node.children if isinstance(c, str)]
        below = [c for c in node.children if isinstance(c, Node) and not c.out]
        inline = [c for c in below if c.name not in BLOCKS]
        length = sum(len(c) for c in own if c.strip())
        node.text = length + sum(c.text for c in below)
        node.linked = node.text if node.name == "a" else sum(c.linked for c in below)
        flat = length + sum(c.text for c in inline)
        if node.name in PARAGRAPHS and flat - sum(c.linked for c in inline) >= 1 and node.name not in HEADINGS:
            commas = sum(c.count(",") + c.count("，") for c in own)
            points = 1 + commas + min(flat / 100, 20)
            up, share = node if node.name not in ("p", "pre", "li", "td", "dd") else node.parent, 1.0
            while up is not None and share > 0.1:
                up.points += points * share
                up, share = up.parent, share / 2
    return order


def density(node: Node) -> float:
    return node.linked / node.text if node.text else 0.0


def value(node: Node) -> float:
    return node.points * (1 - density(node))


def blocks(nodes: list[Node]) -> list[str]:
    """Texts of the blocks below, in page order, their white space as single spaces."""
    out: list[str] = []
    part: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", "".join(part)).strip()
        part.clear()
        if text:
            out.append(text)

    stack: list[Node | str | None] = list(reversed(nodes))
    while stack:
        item = stack.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            part.append(item)
        elif not item.out:
            if item.name in BLOCKS:
                flush()
                stack.append(None)
            stack.extend(reversed(item.children))
    flush()
    return out


def main_text(html: str | None) -> str:
    """Text of the best container and its good siblings."""
    if not html:
        return ""
    root = parse(html)
    nodes = measure(root)
    best = max(nodes, key=value, default=root)
    if value(best) <= 0:
        return "\n".join(blocks([root]))
    while best.parent is not None and best.name not in BLOCKS:
        best = best.parent
    chosen: list[Node] = [best]
    if best.parent is not None and best.name not in ("article", "main", "body"):
        enough = max(1.0, 0.2 * value(best))
        chosen = []
        for node in best.parent.children:
            if not isinstance(node, Node) or node.out:
                continue
            prose = node.text and density(node) < 0.25 and (node.name in PROSE or (node.name == "div" and best.parent.inside))
            if node is best or node.name in HEADINGS or prose or value(node) >= enough:
                chosen.append(node)
    return "\n".join(blocks(chosen))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id, url, text, n_chars`` of every page."""

    def work(batch: pa.RecordBatch):
        texts = [main_text(html) for html in column(batch, "html")]
        yield record(
            ["id", "url", "text", "n_chars"],
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
        )

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return map_batches(rows, work, "id long, url string, text string, n_chars long")
