"""Pages of markup to titles, text blocks and links.

Markup is read by the standard library's tokenizer; a small tree builder adds void elements, implied ends of paragraphs,
list items and cells, and raw text of scripts and styles. That is exact for titles, anchors, headings, list items and
paragraphs, and close to a browser for the rest.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlsplit

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.urls import BINARY, NOT_FOLLOWED, canonical
from corpusloom.sources.structured import embedded_strings, json_ld_strings

_BLANK = re.compile(r"[\t\n\v\f\r \xa0\U00001680\U00002000-\U0000200a\U00002028\U00002029\U0000202f\U0000205f\U00003000\U0000feff]+")
_BINARY = re.compile(r"\.(" + "|".join(BINARY) + r")(\?|#|$)", re.I)

#: What is taken from a page, in order: selector and least length (fixed values).
BLOCKS = [("h1", 5), ("h2", 5), ("h3", 5), ("h4", 5), ("p", 15), ("article", 20), ("section", 20), ("main", 20), ("li", 10), ("[role=main]", 20), ("[role=article]", 20)]
#: Meta elements that describe a page, in order: attribute and value (fixed values).
META = [
    ("name", "description"), ("property", "og:description"), ("name", "twitter:description"), ("property", "og:title"), ("name", "twitter:title"), ("name", "author"), ("name", "keywords"),
    ("name", "subject"), ("name", "abstract"), ("property", "og:site_name"), ("name", "article:author"), ("name", "article:section"), ("name", "article:tag"),
    ("property", "business:contact_data:street_address"), ("property", "business:contact_data:locality"), ("name", "email"), ("name", "url"),
]
BODY_PARTS = ["body>div", "body>section", "body>article", "footer", "nav", "header"]
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An element that opens ends these open ones (fixed values).
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS |= dict.fromkeys(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split(), {"p"}
)
_SCOPE = {"li": {"ul", "ol"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}


def squeeze(text: str) -> str:
    return _BLANK.sub(" ", text).strip(" ")


def shorten(text: str, size: int) -> str:
    t = squeeze(text)
    return t if len(t) <= size else t[:size] + "..."


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                stack.extend(reversed(x.children))
        return "".join(out)

    def walk(self):
        stack = [self]
        while stack:
            x = stack.pop()
            yield x
            stack.extend(c for c in reversed(x.children) if not isinstance(c, str))


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#document", {}, None)

    def handle_starttag(self, tag, attrs):
        ended = ENDS.get(tag, ())
        node, stop = self.at, _SCOPE.get(tag, {"td", "th", "button"})
        while node is not None and node.tag not in stop:
            if node.tag in ended:
                self.at = node.parent
                break
            node = node.parent
        new = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        self.at.children.append(new)
        if tag not in VOID:
            self.at = new

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(markup: str) -> Node:
    builder = _Builder()
    builder.feed(markup)
    builder.close()
    return builder.root


def _selected(nodes: list[Node], selector: str) -> list[Node]:
    if selector.startswith("[role="):
        return [n for n in nodes if n.attrs.get("role") == selector[6:-1]]
    if ">" in selector:
        parent, tag = selector.split(">")
        return [n for n in nodes if n.tag == tag and n.parent is not None and n.parent.tag in (parent, "#document", "html") and (tag != "div" or n.children)]
    return [n for n in nodes if n.tag == selector]


def blocks(root: Node) -> list[tuple[str, str]]:
    """``(phase, text)`` of everything that is taken from a page, in order, before beginnings are compared."""
    nodes = [n for n in root.walk()]
    out: list[tuple[str, str]] = []

    def add(phase: str, text: str, least: int) -> None:
        t = squeeze(text)
        if t and len(t) >= least:
            out.append((phase, t))

    for selector, least in BLOCKS:
        for n in _selected(nodes, selector):
            add("block", shorten(n.text(), 5000), least)
    for attribute, value in META:
        for n in nodes:
            if n.tag == "meta" and n.attrs.get(attribute) == value:
                add("meta", n.attrs.get("content", ""), 5)
    scripts = [n for n in nodes if n.tag == "script"]
    for n in scripts:
        if n.attrs.get("type") == "application/ld+json":
            for text in json_ld_strings(n.text()):
                add("json-ld", text, 3)
    for text in embedded_strings([n.text() for n in scripts if n.attrs.get("id") == "__NEXT_DATA__" or n.attrs.get("type") == "application/json"]):
        add("json", text, 10)
    if len(out) < 8:
        for selector in BODY_PARTS:
            for n in _selected(nodes, selector):
                t = shorten(n.text(), 6000)
                if len(t) >= 30 and not any(t[:50] in held for _, held in out):
                    out.append(("body", t))
    if len(out) < 5:
        body = next((n for n in nodes if n.tag == "body"), root)
        t = squeeze(body.text())[:2000]
        if len(t) >= 50:
            out.append(("all", t))
    return out


def page_text(found: list[tuple[str, str]], prefix: int = 260) -> str:
    """The blocks, one a line: of those with a common beginning the longest, at the first one's place."""
    kept: dict[str, str] = {}
    for _, text in found:
        t = squeeze(text)
        key = t[:prefix].lower()
        if t and len(t) > len(kept.get(key, "")):
            kept[key] = t
    return "\n".join(kept.values())


def links(root: Node, url: str) -> list[str]:
    """Addresses of the anchors outside scripts and styles, resolved, distinct, in order."""
    found: dict[str, None] = {}
    for n in root.walk():
        href = n.attrs.get("href") if n.tag == "a" else None
        if href is None:
            continue
        up = n.parent
        while up is not None and up.tag not in ("script", "noscript", "style"):
            up = up.parent
        t = href.strip()
        if up is not None or not t or t.startswith(NOT_FOLLOWED) or _BINARY.search(t):
            continue
        try:
            absolute = canonical_keeping_query(urldefrag(t)[0], url)
        except ValueError:
            continue
        if absolute:
            found[absolute] = None
    return list(found)


def canonical_keeping_query(href: str, base: str) -> str | None:
    """A link as a browser resolves it; tracking parameters stay until the address is visited."""
    joined = urljoin(base, href)
    query = urlsplit(joined).query
    bare = canonical(joined.split("?", 1)[0].split("#", 1)[0])
    return None if bare is None else bare + (f"?{query}" if query else "")


def extract(markup: str | None, url: str | None) -> dict | None:
    """``title, blocks, text, links`` of one page; None for a NULL body."""
    if markup is None:
        return None
    root = parse(markup)
    title = next((squeeze_ends(n.text()) for n in root.walk() if n.tag == "title"), "") or None
    found = blocks(root)
    return {"title": title, "blocks": [{"phase": p, "text": t} for p, t in found], "text": page_text(found), "links": links(root, url or "")}


def squeeze_ends(text: str) -> str:
    return re.sub(rf"^{_BLANK.pattern}|{_BLANK.pattern}$", "", text)


PAGE = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("blocks", T.ArrayType(T.StructType([T.StructField("phase", T.StringType()), T.StructField("text", T.StringType())]))),
        T.StructField("text", T.StringType()),
        T.StructField("links", T.ArrayType(T.StringType())),
    ]
)


@F.pandas_udf(PAGE)
def extract_page(markup: pd.Series, url: pd.Series) -> pd.DataFrame:
    """``extract`` of columns; a NULL body gives NULL fields."""
    rows = [extract(m if isinstance(m, str) else None, u) or dict.fromkeys(PAGE.fieldNames()) for m, u in zip(markup, url)]
    return pd.DataFrame(rows, columns=PAGE.fieldNames())

