"""Main text of web pages by tree scoring: paragraphs pass points up to their containers."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partwright.llm.common import small_batches, text_or_empty

TAG = re.compile(r"<(?:!--(?P<note>.*?)(?:--!?>|\Z)|(?P<close>/)?(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|(?P<other>[!?/][^>]*>))", re.S)
ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACE = re.compile(r"\s+")
NAME_PARTS = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")

# Kinds of HTML elements.
RAW = {"script", "style", "textarea", "title", "noscript", "noframes", "xmp", "iframe", "noembed"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre",
    "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption", "head",
}
ENDS_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "html", "head", "body"}
#: Elements closed by the start of one of these kinds, up to a container that holds them.
CLOSED_BY = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
DROPPED = {
    "head", "script", "style", "noscript", "template", "iframe", "object", "embed", "applet", "svg", "canvas", "nav", "aside", "footer", "form", "button", "select", "input",
    "textarea", "label", "fieldset", "dialog", "menu", "audio", "video", "title", "noframes", "noembed", "xmp", "annotation", "annotation-xml",
}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "form", "menu", "menubar", "toolbar"}
UNWANTED = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "adslot", "adbox", "banner", "banners", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist",
    "consent", "cookie", "cookies", "disclaimer", "disqus", "feedback", "footer", "form", "gdpr", "login", "masthead", "menu", "menus", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification",
    "outbrain", "overlay", "pager", "pagination", "popup", "privacy", "promo", "promoted", "promotion", "recommended", "related", "replies", "reply", "respond", "responses", "search", "share", "sharing", "shoutbox", "sidebar",
    "signup", "skip", "social", "sponsor", "sponsored", "sponsors", "subscribe", "subscription", "taboola", "tags", "toolbar", "topbar", "tracking", "warning", "widget", "widgets", "alert", "discussion",
}
WANTED = {"article", "articlebody", "body", "content", "entry", "main", "maincontent", "post", "story", "text", "prose"}
#: Names that stand for what is no part of an article, wherever it is, and words that only say what such a part is made of.
APART = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "adslot", "adbox", "banner", "banners", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "consent", "cookie", "cookies",
    "disqus", "gdpr", "login", "menu", "menus", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "outbrain", "overlay", "pager", "pagination", "popup", "promo", "promoted", "recommended",
    "replies", "respond", "share", "sharing", "shoutbox", "sidebar", "signup", "social", "sponsor", "sponsored", "sponsors", "subscribe", "subscription", "taboola", "toolbar", "topbar", "widget", "widgets",
}
MADE_OF = {
    "area", "articles", "bar", "block", "bottom", "box", "button", "buttons", "card", "cards", "container", "form", "footer", "header", "icons", "inline", "inner", "item", "items", "left", "link", "links", "list", "media", "mobile", "outer",
    "page", "panel", "posts", "related", "right", "section", "site", "slot", "stories", "thread", "tools", "top", "unit", "wrap", "wrapper", "zone",
}
#: Two words that together name a list of other pages.
OTHERS, PAGES = {"related", "popular", "trending"}, {"posts", "articles", "stories", "links", "news"}
NEVER = {"html", "body", "article", "main"}
HEADS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Ends of clauses and sentences.
MARKS = re.compile("[.,;!?،、，。！？]")
#: What text inside an element of unwanted names counts for.
SHADE = 0.2


class Node:
    __slots__ = ("tag", "up", "kids", "gone", "points", "chars", "linked", "hint", "doubtful", "whole", "named", "apart", "size", "links", "marks")

    def __init__(self, tag: str, up: "Node | None", gone: bool = False, hint: float = 0.0, named: bool = False, apart: bool = False):
        self.tag, self.up, self.gone, self.hint, self.named, self.apart = tag, up, gone, hint, named, apart
        #: Whether it or something around it has unwanted names only.
        self.doubtful = named or up is not None and up.doubtful
        self.kids: list[Node | str] = []
        self.size = self.links = self.marks = 0.0
        self.points = self.whole = self.chars = self.linked = 0.0


def _words(value: str) -> list[list[str]]:
    """The words of each name in a ``class`` or ``id``."""
    return [[w for w in NAME_PARTS.split(CAMEL.sub("-", name).lower()) if w] for name in html.unescape(value).split()]


def _judge(tag: str, attrs: str, inside: set[str]) -> tuple[bool, float, bool, bool]:
    """Whether an element is left out with all it holds, points for its names, whether only unwanted ones are there, and
    whether they leave no doubt (one consists of ``APART`` words and of words for what it is made of or beside)."""
    named = apart = False
    if tag in NEVER:
        gone, hint = False, 25.0 if tag in ("article", "main") else 0.0
    elif tag == "header":
        gone, hint = not inside & {"article", "main"}, 0.0
    else:
        gone, hint = tag in DROPPED, 0.0
    if attrs.strip() and tag not in ("html", "body"):
        names: list[list[str]] = []
        for name, a, b, c in ATTR.findall(attrs):
            name, value = name.lower(), a or b or c
            if name in ("class", "id"):
                names += _words(value)
            elif name == "role" and value.lower() == "alert":
                names.append(["alert"])
            elif name == "role" and value.lower() in ROLES or name in ("hidden",) or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                gone = gone or tag not in NEVER
        words = {w for name in names for w in name}
        bad, good = UNWANTED & words, WANTED & words
        if "header" in words and not inside & {"article", "main"}:
            bad = bad | {"header"}
        named = bool(bad) and not good and (tag not in NEVER or tag == "article")
        known = APART | MADE_OF | WANTED
        praised = any(WANTED & set(n) and not APART & set(n) for n in names)
        apart = not praised and tag != "main" and any(APART & set(n) and known.issuperset(n) or OTHERS & set(n) and PAGES & set(n) for n in names)
        hint += 25.0 * bool(good) - 25.0 * bool(bad)
    return gone, hint, named, apart


def parse(page: str) -> Node:
    """The page's elements as a tree: unclosed paragraphs, items and cells end where HTML says, stray ends are ignored."""
    root = Node("#", None)
    now = root
    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        if m is None:
            now.kids.append(html.unescape(page[at:]))
            break
        if m.start() > at:
            now.kids.append(html.unescape(page[at : m.start()]))
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["close"]:
            node = now
            while node is not root and node.tag != name:
                node = node.up
            if node is not root:
                now = node.up
            continue
        if name in ENDS_P:
            node = now
            while node is not root and node.tag not in ("p", "td", "th", "table", "button", "li", "div", "article", "section", "body"):
                node = node.up
            if node.tag == "p":
                now = node.up
        if name in CLOSED_BY:
            ends, holders = CLOSED_BY[name]
            node, last = now, None
            while node is not root and node.tag not in holders:
                if node.tag in ends:
                    last = node
                node = node.up
            if last is not None:
                now = last.up
        inside, up = set(), now
        if name == "header" or "eader" in m["attrs"]:
            while up is not root:
                inside.add(up.tag)
                up = up.up
        node = Node(name, now, *_judge(name, m["attrs"], inside))
        now.kids.append(node)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
        elif name not in VOID and not m["attrs"].rstrip().endswith("/"):
            now = node
    return root


def blocks(root: Node) -> list[tuple[Node, str, float]]:
    """Runs of text between block borders, in page order: the block element, the text, and its share within links."""
    out: list[tuple[Node, str, float]] = []
    parts: list[str] = []
    linked = 0
    owner = root

    def end() -> None:
        nonlocal linked
        if parts:
            text = SPACE.sub(" ", "".join(parts)).strip()
            if text:
                out.append((owner, text, min(1.0, linked / max(1, len(text)))))
            parts.clear()
        linked = 0

    # An explicit stack: pages may be nested deeper than Python's calls. Items: (element or text, its block, links around it, leaving).
    stack: list[tuple] = [(root, root, 0, False)]
    while stack:
        item, block, links, leaving = stack.pop()
        if isinstance(item, str):
            owner = block
            parts.append(item)
            if links:
                linked += len(item.strip())
            continue
        if leaving:
            end()
            continue
        if item.gone:
            if item.tag in BLOCK or item.tag in DROPPED:
                end()
            else:
                parts.append(" ")
            continue
        if item.tag in ("br", "wbr"):
            parts.append(" " if item.tag == "br" else "")
            continue
        is_block = item.tag in BLOCK
        if is_block:
            end()
            block = item
            stack.append((item, block, links, True))
        links += item.tag == "a"
        stack += [(kid, block, links, False) for kid in reversed(item.kids)]
    end()
    return out


def main_text(page: str) -> str:
    """The article of a page, one block a line; empty if there is none.

    Every block is a paragraph: it earns a point, one for each comma and one for each 100 characters, less its share
    of linked text, and passes them to its container, half of them to the next one, a third to the one above, and so
    on; ``article`` and ``main`` get them whole from any depth. Text in elements with unwanted names only
    (``doubtful``) counts a fifth; such elements are left out beside the best container and kept inside it. Containers
    are weighed by their names and discounted by their own link density, and all are ranked together. A best one inside
    an ``article`` stands for that article. Within a ``main``, an ``article`` is taken instead if it scores above the
    ``main`` without it, and so is a container of wanted names if only headings and doubtful text stand beside it. The
    best one is kept with those siblings that score at least a fifth of it or are paragraphs that read like text, and
    with the headings before it. All blocks of what is kept are returned, linked ones too, but for those of elements
    within it that are no headings and whose names leave no doubt (``apart``: comments, adverts, sharing, menus, notices,
    ...) or are unwanted while their text is linked for the most part or has hardly a sentence.
    """
    found = blocks(parse(page))
    if not found:
        return ""
    holders: dict[int, Node] = {}
    for owner, text, link in found:
        points = (1 + len(re.findall("[,،、，]", text)) + len(text) / 100) * (1 - link) * (SHADE if owner.doubtful else 1)
        node = owner.up if owner.tag in HEADS or owner.tag in ("p", "li", "blockquote", "pre", "td", "dd", "dt") and owner.up is not None else owner
        level = 1
        while node is not None and node.tag != "#":
            holders[id(node)] = node
            node.points += points if node.tag in ("article", "main") else points / level
            node.whole += points
            node.chars += len(text)
            node.linked += len(text) * link
            node, level = node.up, level + 1
        marks, node = len(MARKS.findall(text)), owner
        while node is not None:
            node.size += len(text)
            node.links += len(text) * link
            node.marks += marks
            node = node.up
    if not holders:
        return "\n".join(text for _, text, _ in found)

    def score(node: Node, less: Node | None = None) -> float:
        points, chars, linked = (node.points - less.whole, node.chars - less.chars, node.linked - less.linked) if less else (node.points, node.chars, node.linked)
        return (points + node.hint) * (1 - linked / max(1.0, chars))

    def within(node: Node, *holders: Node) -> bool:
        while node is not None and node not in holders:
            node = node.up
        return node is not None

    ranked = [x for x in holders.values() if x.tag not in ("html", "body")] or list(holders.values())
    best = max(ranked, key=lambda x: (score(x), x.tag in ("article", "main")))  # the first of equals in page order
    node = best
    while node is not None and node.tag != "article":
        node = node.up
    best = node or best
    if best.tag == "main":
        inner = [x for x in ranked if x is not best and not x.doubtful and (x.tag == "article" or x.hint > 0) and within(x, best)]
        for x in sorted(inner, key=lambda x: (x.tag == "article", score(x)), reverse=True):
            if score(x) > score(best, x) and (x.tag == "article" or all(o.doubtful or o.tag in HEADS or within(o, x) for o, _, _ in found if within(o, best))):
                best = x
                break
    floor = max(10.0, 0.2 * score(best))
    kept = {id(best)}
    beside = best.up if best.tag not in ("main", "body", "html") else None
    doubted = beside is not None and beside.doubtful  # then all beside it is
    before = True
    for kid in best.up.kids if best.up is not None else []:
        if not isinstance(kid, Node) or kid.doubtful and not doubted:
            continue
        if kid is best:
            before = False
        elif before and kid.tag in HEADS or kid.tag in ("header", "hgroup") and before:
            kept.add(id(kid))
        elif beside is not None and id(kid) in holders and score(kid) >= floor:
            kept.add(id(kid))

    def boilerplate(node: Node) -> bool:
        if node.tag in HEADS:
            return False
        return node.apart or node.named and (node.links > 0.4 * node.size or node.marks * 200 < node.size)

    def wanted(owner: Node, text: str, link: float) -> bool:
        node = owner
        while node is not None:
            if id(node) in kept:
                return True
            if boilerplate(node):
                return False
            node = node.up
        # A paragraph beside the best container.
        return (doubted or not owner.doubtful) and owner.tag in ("p", "h1") and owner.up is beside is not None and (owner.tag == "h1" or link < 0.25 and len(text) > 80)

    return "\n".join(text for owner, text, link in found if wanted(owner, text, link))


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """``page_id``, the ``keep`` columns and ``text``: the main text of every page, from its whole HTML.

    Null and empty pages, and pages without an article, give empty text. Broken mark-up is read as far as it goes;
    pages of any length and depth are read whole. Repeated rows and null ids are kept as they are, further columns
    are ignored, a table without rows gives none.
    """
    small_batches(pages.sparkSession, 500)

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(page) for page in batch["html"]]
            yield batch.drop(columns="html").assign(text=pd.Series(texts, index=batch.index, dtype=object))

    base = pages.select(F.col(id_col).alias("page_id"), *keep, text_or_empty(html_col).alias("html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema if f.name != "html")
    return base.mapInPandas(extract, schema + ", text string")
