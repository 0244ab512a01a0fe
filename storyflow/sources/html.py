"""A tolerant document tree on the standard parser, and what is read from it: Arrow UDFs."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..data.rules import NEGATIVE_KEYWORDS, POSITIVE_KEYWORDS

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: What ends an open paragraph or list item.
_CLOSES = {"p": {"p"}, "li": {"li", "p"}, "div": {"p"}, "section": {"p"}, "article": {"p"}, "ul": {"p"}, "h1": {"p"}, "h2": {"p"}, "h3": {"p"}}
_SKIPPED = frozenset("script style noscript template svg".split())
#: Parts of a page that are never its text.
_CHROME = frozenset("nav header footer aside form button".split())

class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def walk(self):
        """This node and all below, in document order, without recursion."""
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(c for c in reversed(n.children) if isinstance(c, Node))

    def text(self) -> str:
        parts, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                parts.append(n)
            elif n.tag not in _SKIPPED:
                stack.extend(reversed(n.children))
                if n.tag == "br":
                    parts.append(" ")
        return re.sub(r"\s+", " ", "".join(parts)).strip()

    def find(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n.tag in tags]


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def handle_starttag(self, tag, attrs):
        ends = _CLOSES.get(tag, ())
        n = self.at
        while n.parent is not None and n.tag in ("p", "li", "b", "i", "em", "strong", "span", "a"):
            if n.tag in ends:
                self.at = n.parent
                break
            n = n.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        n = self.at
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def score(n: Node) -> int:
    """A container's points as the place of the main text."""
    mark = f"{n.attrs.get('id', '')} {n.attrs.get('class', '')} {n.attrs.get('role', '')}".lower()
    points = 300 * (n.tag == "article") + 250 * (n.attrs.get("itemprop") == "articleBody") + 40 * sum(g in mark for g in POSITIVE_KEYWORDS) - 300 * sum(b in mark for b in NEGATIVE_KEYWORDS)
    paragraphs = n.find("p")
    points += min(len(paragraphs), 30) * 25 - 150 * (len(paragraphs) < 2)
    points += min(len(n.find("h2")), 10) * 20 + min(len(n.find("h3")), 10) * 10
    points += min(sum(len(p.text().split()) for p in paragraphs) // 20, 150)
    return points - 5000 * (n.tag in _CHROME) - 500 * (n.tag in ("#root", "html", "body"))


def main_content(root: Node) -> Node:
    """The container of most points; the first of equals; the page where there is none."""
    found = [n for n in root.walk() if n.tag in ("article", "main", "section", "div", "td", "body")]
    return max(found, key=score, default=root)


def blocks(root: Node) -> list[str]:
    """The main text's headings, paragraphs, quotes and items in order, each once."""
    out, seen = [], set()
    for n in main_content(root).find("h2", "h3", "h4", "p", "blockquote", "li"):
        up = n.parent
        while up is not None and up.tag not in _CHROME:
            up = up.parent
        if up is not None or any(c.tag in ("p", "li", "blockquote") for c in n.walk() if c is not n):
            continue
        t = n.text()
        key = re.sub(r"[^a-z0-9]+", "", t.lower())
        if t and key not in seen:
            seen.add(key)
            out.append(f"“{t}”" if n.tag == "blockquote" else f"• {t}" if n.tag == "li" else t)
    return out


_KINDS = ("article", "newsarticle", "reportagearticle", "blogposting")


def json_ld(root: Node) -> dict:
    """The first article among the page's linked data, depth first."""
    for n in root.find("script"):
        if n.attrs.get("type") == "application/ld+json":
            try:
                stack = [json.loads("".join(c for c in n.children if isinstance(c, str)))]
            except ValueError:
                continue
            while stack:
                x = stack.pop()
                if isinstance(x, list):
                    stack.extend(reversed(x))
                elif isinstance(x, dict):
                    kinds = x.get("@type")
                    if any(str(k).lower() in _KINDS for k in (kinds if isinstance(kinds, list) else [kinds])):
                        return x
                    stack.extend(reversed([v for v in x.values() if isinstance(v, dict | list)]))
    return {}


def metadata(root: Node) -> dict[str, str]:
    """Title, author, date, canonical address and image, each from the first place that has it."""
    meta = {}
    for n in root.find("meta"):
        k = (n.attrs.get("property") or n.attrs.get("name") or "").lower()
        if k and n.attrs.get("content", "").strip():
            meta.setdefault(k, n.attrs["content"].strip())
    ld = json_ld(root)
    first = lambda tag: next((t for t in (n.text() for n in root.find(tag)) if t), "")
    canonical = next((n.attrs.get("href", "") for n in root.find("link") if n.attrs.get("rel", "").lower() == "canonical"), "")
    author = ld.get("author")
    author = author[0] if isinstance(author, list) and author else author
    author = author.get("name", "") if isinstance(author, dict) else author
    when = next((n.attrs.get("datetime", "") for n in root.find("time") if n.attrs.get("datetime")), "")
    pick = lambda *xs: next((str(x) for x in xs if x), "")
    return {
        "title": pick(meta.get("og:title"), meta.get("twitter:title"), first("h1"), first("title"), ld.get("headline")),
        "author": pick(meta.get("author"), meta.get("article:author"), author),
        "published": pick(meta.get("article:published_time"), when, ld.get("datePublished")),
        "canonical": pick(canonical, meta.get("og:url"), ld.get("url")),
        "image": pick(meta.get("og:image"), meta.get("twitter:image")),
    }


_ARTICLE = T.StructType([*[T.StructField(n, T.StringType()) for n in ("title", "author", "published", "canonical", "image")], T.StructField("blocks", T.ArrayType(T.StringType()))])
_LINKS = T.ArrayType(T.StructType([T.StructField("url", T.StringType()), T.StructField("title", T.StringType())]))


@F.pandas_udf(_ARTICLE)
def article(html: pd.Series) -> pd.DataFrame:
    """A page's metadata and main text."""
    rows = []
    for h in html:
        root = parse(h)
        rows.append(metadata(root) | {"blocks": blocks(root)})
    return pd.DataFrame(rows, columns=["title", "author", "published", "canonical", "image", "blocks"])


@F.pandas_udf(_LINKS)
def links(html: pd.Series) -> pd.Series:
    """A listing's links with the text that names them, the first of each address."""
    out = []
    for h in html:
        found: dict[str, str] = {}
        for n in parse(h).find("a"):
            url = n.attrs.get("href", "")
            name = n.text() or n.attrs.get("aria-label", "") or n.attrs.get("title", "")
            if url and not url.startswith(("#", "javascript:", "mailto:")):
                found.setdefault(url, name)
        out.append([{"url": u, "title": t} for u, t in found.items()])
    return pd.Series(out)


def with_references(html: Column | str, names: tuple[str, ...]) -> Column:
    """A page of which only these references are read, where a semicolon closes them: other ampersands stand for themselves."""
    return F.regexp_replace(F.col(html) if isinstance(html, str) else html, f"&(?!(?:{'|'.join(names)});)", "&amp;")


def challenge(html: Column) -> Column:
    """Whether a page only asks for proof of a human visitor."""
    return F.coalesce(F.lower(html).rlike("just a moment|verify you are human|cf-challenge|enable javascript and cookies|access denied"), F.lit(False))
