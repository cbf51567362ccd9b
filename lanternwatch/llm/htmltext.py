"""Main text of web pages by scoring the element tree.

Text blocks give points for their length and commas to the elements above
them, discounted by how much of those elements is link text. The element with
the most points leads to the article: the ``article`` or ``main`` around it, or
else the element itself with the siblings that belong to it.

What never gives text is told by tag, role, hidden state and, with care, by
class and id. Names that only ever mark page furniture (adverts, sidebars,
comments) count everywhere; names that articles also use for their own parts
(notice, legal, discussion) count only outside an article. A name is ignored
on an element that holds the article or its title. Pages are read in one pass
of linear time, whatever is left unclosed.
"""

from __future__ import annotations

import re
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SIMPLE = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*+)>")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
#: One attribute, or the end of the tag. A quote opens a value only after "=".
_ATTR = re.compile(r"[\s/]*+(?:(>)|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"'][^\s>]*+)?))?+)")
_NEXT_LINK = re.compile(r"<(/?)a(?=[\s/>])", re.I)
#: Elements skipped with their content; of those in RAW an unclosed one runs to the end of the page.
_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+>?", re.I) for t in ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "title", "select", "object", "canvas", "video", "audio")}
RAW = {"script", "style"}

#: Elements that shape the tree; every other tag is inline and leaves no mark.
BLOCKS = set("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address details summary hr center nav header footer aside form fieldset menu dialog head button label search".split())
NOISE_TAGS = set("nav footer aside form fieldset menu dialog head button label search".split())
VOID = {"hr"}
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Where the search for an element to close implicitly ends.
BARRIER = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
NO_P_CLOSE = set("button label caption figcaption summary".split())


def _words(*stems: str) -> re.Pattern:
    return re.compile(rf"(?:^|[\s_-])(?:{'|'.join(stems)})(?=$|[\s_-])")


#: Names of page furniture, wherever they stand.
_NOISE = _words(
    r"ads?", r"adverts?", r"advert\w+", "adsense", "adbox", r"sponsor\w*", "promoted", "outbrain", "taboola", r"cookies?\w*", "consent", "gdpr", "popup", "pop-up", "modal", "newsletter", "subscribe", "signup",
    "sidebar", "navbar", "nav", "navigation", "menu", r"breadcrumbs?", "masthead", "topbar", "footer", r"comments?", "commentlist", r"comment-\w+", r"disqus\w*", r"related-(?:posts|articles|links|stories|content)", "recommendations", "share", "sharing", "social", "login", "signin", "pagination", "pager", "paginator",
)
#: Names that articles also use for their own parts: they count only outside an article.
_OUTSIDE = _words(
    "header", "head", "banner", "promo", "notice", "notification", "alert", "overlay", "subscription", "side", "rail", "widget", "foot", "bottom", "replies", "reply", "respond", "discussion", "responses", "related", r"recommend\w*", "search", "toolbar", "skip", "copyright", "legal", "disclaimer",
)
_GOOD = _words("article", "articlebody", "content", "main", "post", "entry", "story", "body", "text", "hentry", "page")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
NOISE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form", "menu", "menubar"}
HEADINGS = {"h1", "h2"}
#: As in browsers, an element nested deeper is opened beside its parent; no text is lost, and looking up the open elements stays cheap.
MAX_DEPTH = 512


class Node:
    """``noise``: gives no text. ``named``: only because of its class or id. ``inside``: below an article or main.

    ``holds``: 2 above an article or main, 1 above a title.
    """

    __slots__ = ("chars", "children", "holds", "inside", "links", "name", "named", "noise", "parent", "score", "tag")

    def __init__(self, tag: str, name: str, parent: Node | None, noise: bool, named: bool, inside: bool):
        self.tag, self.name, self.parent, self.noise, self.named, self.inside = tag, name, parent, noise, named, inside
        self.children: list[Node | tuple[str, bool]] = []
        self.score, self.chars, self.links, self.holds = 0.0, 0, 0, 0


def _is_noise(tag: str, found: dict[str, str], inside: bool) -> tuple[str, bool, bool]:
    """Class and id in lower case; whether the element gives no text; whether only its name says so."""
    if not found:
        return "", tag in NOISE_TAGS or (tag == "header" and not inside), False
    name = _CAMEL.sub("-", f"{found.get('class', '')} {found.get('id', '')}").lower().strip()
    if tag in NOISE_TAGS or (tag == "header" and not inside):
        return name, True, False
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or found.get("role", "").lower() in NOISE_ROLES or _HIDDEN.search(found.get("style", "").lower()):
        return name, True, False
    named = bool(name) and tag not in ("body", "html", "main") and bool(_NOISE.search(name) or (not inside and _OUTSIDE.search(name) and not _GOOD.search(name)))
    return name, named, named


def _tag(html: str, start: int) -> tuple[int, str, str, dict[str, str], bool] | None:
    """End, "/" of a closing tag, name, attributes and whether it closes itself; None: no tag starts here."""
    m = _SIMPLE.match(html, start)
    if m:
        return m.end(), m[1], m[2].lower(), {}, False
    m = _NAME.match(html, start)
    if not m:
        return None
    found: dict[str, str] = {}
    at = m.end()
    while True:
        a = _ATTR.match(html, at)
        if not a:  # the page ends inside the tag, or a quote is never closed: the next ">" ends it
            end = html.find(">", m.end())
            return (end + 1 if end >= 0 else len(html)), m[1], m[2].lower(), found, False
        if a[1]:
            return a.end(), m[1], m[2].lower(), found, html[a.end() - 2] == "/"
        if a.end() < len(html) and html[a.end()] in "\"'" and html[a.end() - 1] in "=\t\n\f\r ":
            end = html.find(">", a.end())
            return (end + 1 if end >= 0 else len(html)), m[1], m[2].lower(), found, False
        found.setdefault(a[2].lower(), a[3] or a[4] or a[5] or "")
        at = a.end()


def parse(html: str) -> Node:
    """Tree of block elements; children are elements or pieces of text with whether they are link text.

    A link lasts across the blocks inside it. Unclosed, it ends with the block it stands in.
    """
    root = Node("html", "", None, False, False, False)
    at, pos, n, inside, depth, unclosed = root, 0, len(html), 0, 0, set()
    link: Node | None = None  # the element in which a link was opened

    def text(upto: int) -> None:
        if upto > pos:
            piece = html[pos:upto]
            at.children.append((unescape(piece) if "&" in piece else piece, link is not None))

    def leave(node: Node) -> Node:
        nonlocal depth, inside, link
        depth -= 1
        inside -= node.tag in ("article", "main")
        link = None if link is node else link
        return node.parent or root

    while pos < n:
        start = html.find("<", pos)
        if start < 0:
            text(n)
            break
        follows = html[start + 1 : start + 2]
        if follows in ("!", "?") or (follows == "/" and not html[start + 2 : start + 3].isalpha()):  # comments and declarations
            text(start)
            comment = html.startswith("<!--", start)
            end = html.find("-->" if comment else ">", start + (4 if comment else 1))
            pos = n if end < 0 else end + (3 if comment else 1)
            continue
        token = _tag(html, start)
        if token is None:  # a bare "<" is text
            text(start + 1)
            pos = start + 1
            continue
        text(start)
        pos, closing, tag, found, closed = token
        if tag in _END and not closing:
            if closed and tag in ("svg", "math"):
                continue
            end = None if tag in unclosed else _END[tag].search(html, pos)
            if end:
                pos = end.end()
            elif tag in RAW:
                pos = n
            unclosed |= set() if end else {tag}
            at.children.append((" ", False))
            continue
        if tag == "a":
            link = None
            if not closing and "href" in found:
                after = _NEXT_LINK.search(html, pos)
                link = root if after and after[1] else at
            continue
        if tag == "br":
            at.children.append((" ", False))
            continue
        if tag not in BLOCKS:
            continue
        if closing:
            up = at
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                while at is not up:
                    at = leave(at)
                at = leave(at)
            continue
        if at.tag == "head":  # its end tag may be left out
            at = leave(at)
        if tag in ("html", "body") and at is root:
            continue
        if tag in CLOSES or tag not in NO_P_CLOSE:
            ends = CLOSES.get(tag, {"p"}) | {"p"}
            up, barrier = at, BARRIER.get(tag, set())
            while up is not root and up.tag not in ends and up.tag not in barrier and tag in BARRIER:
                up = up.parent
            if up is not root and up.tag in ends:
                while at is not up:
                    at = leave(at)
                at = leave(at)
        if depth >= MAX_DEPTH:
            at = leave(at)
        name, noise, named = _is_noise(tag, found, inside > 0)
        node = Node(tag, name, at, noise, named, inside > 0)
        at.children.append(node)
        if tag in ("article", "main", "h1") and not noise:  # a name says nothing against what holds the article or its title
            up, level = node.parent, 1 if tag == "h1" else 2
            while up is not None and up.holds < level and not (up.noise and not up.named):
                up.holds = level
                if level == 2 or "comment" not in up.name:
                    up.noise = up.named = False
                up = up.parent
        if tag not in VOID and not closed:
            at = node
            depth += 1
            inside += tag in ("article", "main")
    return root


def _measure(root: Node) -> list[Node]:
    """Fills in text and link lengths and scores; returns the elements in page order. No recursion: pages nest deeply."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node) and not c.noise)
    for node in reversed(order):
        own = [c for c in node.children if isinstance(c, tuple)]
        plain = " ".join(" ".join(t for t, _ in own).split())
        linked = sum(len(" ".join(t.split())) for t, is_link in own if is_link)
        node.chars += len(plain)
        node.links += linked
        if len(plain) - linked >= 25:
            points = (1 + plain.count(",") + min(len(plain) / 100, 10)) * (1 - min(1.0, linked / len(plain)))
            up, share = node if node.tag not in ("p", "pre", "li", "td", "dd", "blockquote") else node.parent, 1.0
            for depth in range(4):
                if up is None:
                    break
                up.score += points * share
                up, share = up.parent, 0.5 if depth == 0 else share / 1.5
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.links += node.links
    for node in order:
        weight = 1.0 + 0.5 * bool(_GOOD.search(node.name)) + 3.0 * (node.tag in ("article", "main") or "articlebody" in node.name)
        node.score *= weight * (1 - min(1.0, node.links / max(1, node.chars)))
    return order


def _is_menu(node: Node) -> bool:
    """A block that is mostly links. In an article it may be a list of sources, which stays."""
    return not node.inside and node.tag in ("ul", "ol", "dl", "table", "div", "section") and node.chars > 0 and node.links / node.chars > 0.6


def _children(node: Node) -> list[Node]:
    return [c for c in node.children if isinstance(c, Node) and not c.noise]


def _holds_title(node: Node) -> bool:
    stack = [node]
    while stack:
        x = stack.pop()
        if x.tag == "h1":
            return True
        stack.extend(_children(x))
    return False


def _article(best: Node) -> list[Node]:
    """The elements whose text is the article, in page order."""
    if best.score <= 0:
        return [best]
    up = best
    while up is not None and up.tag != "article":
        up = up.parent
    if up is None:
        up = best
        while up is not None and up.tag != "main":
            up = up.parent
    best = up or best
    if best.parent is None:
        return [best]
    least, whole = max(10.0, best.score * 0.2), best.tag in ("article", "main")
    of_page = best.parent.parent is None or best.parent.tag == "body"

    def belongs(c: Node) -> bool:
        if c is best or c.score >= least:
            return True
        prose = c.chars > 0 and c.links < 0.25 * c.chars
        if c.tag == "p":
            return prose and c.chars > 80
        return prose and not whole and not of_page and (c.tag in HEADINGS or not _is_menu(c))

    chosen = [c for c in _children(best.parent) if belongs(c)]
    if not any(_holds_title(c) for c in chosen):  # the nearest title before it
        x = best
        while x.parent is not None:
            before = x.parent.children[: x.parent.children.index(x)]
            title = [c for c in before if isinstance(c, Node) and not c.noise and c.tag == "h1"]
            if title:
                return [title[-1], *chosen]
            x = x.parent
    return chosen


def extract(html: str | None) -> str:
    """Blocks of the article, white space collapsed, joined by an empty line; empty where there is none."""
    if not html:
        return ""
    order = _measure(parse(html))
    chosen = _article(max(order, key=lambda node: node.score))
    blocks: list[str] = []
    for top in chosen:
        stack: list = [top]
        run: list[str] = []
        while stack:
            x = stack.pop()
            if isinstance(x, Node):
                flushed = " ".join("".join(run).split())
                if flushed:
                    blocks.append(flushed)
                run = []
                if not x.noise and not (x is not top and _is_menu(x)):
                    stack.append(None)
                    stack.extend(reversed(x.children))
            else:
                if x is not None:
                    run.append(x[0])
                    continue
                flushed = " ".join("".join(run).split())
                if flushed:
                    blocks.append(flushed)
                run = []
    return "\n\n".join(blocks)


@F.pandas_udf(T.StringType())
def main_text(html: pd.Series) -> pd.Series:
    return html.map(extract)


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page row.

    Null or empty html gives an empty text; rows that repeat are all returned;
    pages of any length and nesting are read whole; an empty table gives an
    empty result and columns other than these three are not looked at. Of
    elements with equal scores the first on the page leads.
    """
    return pages.select("page_id", "url", main_text("html").alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
