"""Text and metadata of HTML pages, by a tolerant parser in vectorised UDFs."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
# Elements, classes and roles that hold no content, and places that hold the main content.
JUNK_TAGS = {"script", "style", "noscript", "iframe", "nav", "header", "footer", "aside"}
JUNK_CLASSES = {"sidebar", "navigation", "menu", "advertisement", "ads", "ad", "social", "share", "comments", "comment"}
JUNK_ROLES = {"navigation", "banner", "contentinfo"}
MAIN = [("tag", "main"), ("tag", "article"), ("role", "main"), ("id", "content"), ("id", "main"), ("class", "content"), ("class", "main"), ("class", "post"), ("class", "article")]


class _Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, {k.lower(): v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(_Node(tag, {k.lower(): v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag == tag:
                del self.open[depth:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(html: str) -> _Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def _walk(root: _Node):
    """Elements in document order, without recursion, so depth is no limit."""
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(c for c in reversed(node.children) if isinstance(c, _Node))


def _is_junk(n: _Node) -> bool:
    return n.tag in JUNK_TAGS or bool(JUNK_CLASSES & set(n.attrs.get("class", "").split())) or n.attrs.get("role") in JUNK_ROLES or n.attrs.get("aria-hidden") == "true"


def _text(root: _Node, clean: bool = True) -> str:
    parts, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            parts.append(node)
        elif node is root or not (clean and _is_junk(node)) and (clean or node.tag not in ("script", "style")):
            stack.extend(reversed(node.children))
    return re.sub(r"\s+", " ", " ".join(parts)).strip()


def _matches(n: _Node, kind: str, name: str) -> bool:
    if kind == "tag":
        return n.tag == name
    return name in n.attrs.get("class", "").split() if kind == "class" else n.attrs.get(kind) == name


def main_text(root: _Node) -> str:
    """The text of the first main place with more than 200 characters, else of the body, without what holds no content."""
    nodes = list(_walk(root))
    for kind, name in MAIN:
        first = next((n for n in nodes if _matches(n, kind, name)), None)
        if first is not None and len(_text(first, clean=False)) > 200:
            return _text(first)
    return _text(next((n for n in nodes if n.tag == "body"), root))


def _meta(nodes: list[_Node], key: str, name: str) -> str:
    return next((n.attrs["content"] for n in nodes if n.tag == "meta" and n.attrs.get(key) == name and n.attrs.get("content")), "")


def canonical_link(html: str, base: str, social: bool = False) -> str | None:
    """The first link whose relations include canonical, resolved; with ``social`` the page's social address is the second choice."""
    nodes = list(_walk(parse(html)))
    href = next((n.attrs["href"].strip() for n in nodes if n.tag == "link" and "canonical" in n.attrs.get("rel", "").lower().split() and n.attrs.get("href")), None)
    if href:
        return urljoin(base, href)
    return (_meta(nodes, "property", "og:url") or None) if social else None


def page_content(html: str, url: str, limit: int = 10_000) -> dict:
    """{title, text, description, canonical} as a page would be captured, sites with structured metadata first."""
    nodes = list(_walk(parse(html)))
    title = next((_text(n, clean=False) for n in nodes if n.tag == "title"), "")
    text = main_text(parse(html))
    description = _meta(nodes, "property", "og:description") or _meta(nodes, "name", "twitter:description") or _meta(nodes, "name", "description")
    host = urlsplit(url).hostname or ""
    content = lambda test: next((t for n in nodes if test(n) and (t := _text(n, clean=False))), "")
    if "youtube.com" in host:
        named = _meta(nodes, "property", "og:title")
        title = named or title
        within = lambda outer, inner: next((t for o in nodes if outer(o) for n in _walk(o) if n is not o and inner(n) and (t := _text(n, clean=False))), "")
        channel = within(lambda n: n.attrs.get("id") == "channel-name", lambda n: n.tag == "a") or within(lambda n: n.attrs.get("itemprop") == "author", lambda n: n.attrs.get("itemprop") == "name") or content(lambda n: n.attrs.get("itemprop") == "name")
        about = _meta(nodes, "property", "og:description")
        longer = content(lambda n: n.attrs.get("id") == "description-inline-expander" or n.tag == "ytd-text-inline-expander") or within(lambda n: n.attrs.get("id") == "description", lambda n: "content" in n.attrs.get("class", "").split())
        about = longer[:2000] if len(longer) > len(about) else about
        text = " | ".join(x for x in (named, f"Channel: {channel}" if channel else "", about, _meta(nodes, "name", "keywords")) if x)
    else:
        parts: list[str] | None = None
        if "github.com" in host:
            topics = " ".join(_text(n, clean=False) for n in nodes if "topic-tag" in n.attrs.get("class", "").split())
            parts = [title, content(lambda n: n.attrs.get("itemprop") == "about" or {"f4", "my-3"} <= set(n.attrs.get("class", "").split())), topics]
        elif "twitter.com" in host or "x.com" in host:
            parts = [title, content(lambda n: n.attrs.get("data-testid") == "tweetText")]
        elif "reddit.com" in host:
            heading = content(lambda n: n.tag == "h1")
            parts = ([heading] if heading and heading != title else []) + [title, content(lambda n: n.attrs.get("data-click-id") == "text")]
        if parts is not None:
            text = " | ".join(p for i, p in enumerate(parts) if p or i == 0) + " " + text
        elif description:
            text = description + " " + text
    return {"title": title, "text": text[:limit], "description": description, "canonical": canonical_link(html, url, social=True)}


def _mapped(f, html: pd.Series, url: pd.Series) -> list:
    return [f(h, u or "") if h else None for h, u in zip(html, url)]


@F.pandas_udf(T.StringType())
def canonical_link_udf(html: pd.Series, url: pd.Series) -> pd.Series:
    return pd.Series(_mapped(canonical_link, html, url), dtype=object)


@F.pandas_udf(T.StringType())
def readable_text_udf(html: pd.Series) -> pd.Series:
    return pd.Series([main_text(parse(h)) if h else None for h in html], dtype=object)


@F.pandas_udf(T.StructType([T.StructField(c, T.StringType()) for c in ("title", "text", "description", "canonical")]))
def page_content_udf(html: pd.Series, url: pd.Series) -> pd.DataFrame:
    empty = {"title": None, "text": None, "description": None, "canonical": None}
    return pd.DataFrame([x or empty for x in _mapped(page_content, html, url)], columns=list(empty))
