"""Readable text, title, author and date of an HTML page, in one Arrow-batched UDF.

A small tree builder over the standard tokenizer covers what pages need of HTML5: void elements, implied ends of
p and li, raw-text script and style, entities, unclosed tags. Everything after extraction is column expressions.
"""

from __future__ import annotations

import bisect
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements and scores that decide what is read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
BOILERPLATE_TAGS = frozenset("nav header footer aside script style noscript form svg".split())
BOILERPLATE_WORDS = ("nav", "menu", "header", "footer", "sidebar", "comment", "advert", "ad-", "promo", "subscribe", "related", "social", "share")
ROOTS = (("tag", "article", 3000), ("tag", "main", 2000), ("role", "main", 1500), ("class", "post", 1000), ("class", "article", 1000), ("class", "entry-content", 900), ("class", "content", 600), ("tag", "body", 0))
BLOCKS = {"h1": "# ", "h2": "## ", "h3": "## ", "h4": "## ", "h5": "## ", "h6": "## ", "p": "", "li": "- ", "pre": "", "blockquote": ""}
TITLE_METAS = (("property", "og:title"), ("name", "twitter:title"), ("name", "title"))
TITLE_PATHS = (("article", "h1"), ("article", "h2"), ("main", "article", "h1"), ("main", "article", "h2"), ("title",), ("main", "h1"), ("h1",))
AUTHOR_METAS = (("name", "author"), ("property", "article:author"), ("name", "parsely-author"))
DATE_METAS = (("property", "article:published_time"), ("property", "og:published_time"), ("name", "pubdate"), ("name", "date"), ("name", "publish-date"))
EXTRACTED = "text string, blocks array<string>, title string, author string, dates array<string>"

#: White space as Unicode has it, which leaves \x1c-\x1f alone.
_SPACE = re.compile("[\t\n\x0b\x0c\r \x85\xa0  -     　]+")


#: Scripts, styles and comments, which hold no references, or an ampersand that begins no reference closed by a semicolon.
_UNCLOSED = re.compile(r"<(script|style)\b.*?(?:</\1|\Z)|<!--.*?(?:-->|\Z)|&(?!(?:[a-z][a-z0-9]*|#[0-9]+|#x[0-9a-f]+);)", re.IGNORECASE | re.DOTALL)


def clean(text: str) -> str:
    return _SPACE.sub(" ", text).strip(" ")


class Element:
    __slots__ = ("attrs", "below", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None) -> None:
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        #: Whether an ancestor (not the element itself) is navigation or the like.
        self.below = parent is not None and (parent.below or parent.boilerplate())

    def boilerplate(self) -> bool:
        """Whether this element is navigation or the like, by tag, class or id."""
        marks = f"{self.attrs.get('class', '')}\n{self.attrs.get('id', '')}".lower()
        return self.tag in BOILERPLATE_TAGS or any(w in marks for w in BOILERPLATE_WORDS)

    def walk(self):
        """Elements below this one in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Element)]
        while stack:
            e = stack.pop()
            yield e
            stack.extend(c for c in reversed(e.children) if isinstance(c, Element))

    def texts(self) -> list[str]:
        out, stack = [], [self]
        while stack:
            e = stack.pop()
            if isinstance(e, str):
                out.append(e)
            else:
                stack.extend(reversed(e.children))
        return out

    def text(self) -> str:
        return clean(" ".join(self.texts()))

    def ancestors(self):
        e = self.parent
        while e is not None:
            yield e
            e = e.parent

    def has_class(self, name: str) -> bool:
        return name in self.attrs.get("class", "").split()


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("#root", {}, None)

    def _close(self, tags: frozenset[str] | set[str], stop: frozenset[str]) -> None:
        e = self.at
        while e is not self.root and e.tag not in stop:
            if e.tag in tags:
                self.at = e.parent
                return
            e = e.parent

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in CLOSES_P:
            self._close({"p"}, frozenset(("button", "td", "th", "body")))
        if tag == "li":
            self._close({"li"}, frozenset(("ul", "ol", "body")))
        e = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(e)
        if tag not in VOID:
            self.at = e

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        e = self.at
        while e is not self.root:
            if e.tag == tag:
                self.at = e.parent
                return
            e = e.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str, closed: bool = False) -> Element:
    """The tree of a page; with ``closed`` only references that end in a semicolon are read, as in XML."""
    builder = _Builder()
    builder.feed(_UNCLOSED.sub(lambda m: "&amp;" if m[0] == "&" else m[0], html) if closed else html)
    builder.close()
    return builder.root


def text_sizes(tree: Element) -> dict[int, int]:
    """Bytes of the texts of each element (by id) joined by spaces and stripped, all by one walk."""
    pieces: list[str] = []
    spans: list[tuple[Element, int, int]] = []
    stack: list = [(tree, None)]
    while stack:
        e, begin = stack.pop()
        if isinstance(e, str):
            pieces.append(e)
        elif begin is None:
            stack.append((e, len(pieces)))
            stack.extend((c, None) for c in reversed(e.children))
        else:
            spans.append((e, begin, len(pieces)))
    total, full = [0], [i for i, p in enumerate(pieces) if p.strip()]
    for p in pieces:
        total.append(total[-1] + len(p.encode()) + 1)
    out = {}
    for e, a, b in spans:
        lo, hi = bisect.bisect_left(full, a), bisect.bisect_left(full, b) - 1
        if lo > hi:
            out[id(e)] = 0
            continue
        first, last = pieces[full[lo]], pieces[full[hi]]
        out[id(e)] = total[full[hi] + 1] - total[full[lo]] - 1 - len(first.encode()) + len(first.lstrip().encode()) - len(last.encode()) + len(last.rstrip().encode())
    return out


def main_root(tree: Element) -> Element | None:
    best, most = None, -1
    elements, sizes = list(tree.walk()), text_sizes(tree)
    for kind, value, bonus in ROOTS:
        for e in elements:
            if not (e.tag == value if kind == "tag" else e.has_class(value) if kind == "class" else e.attrs.get(kind) == value) or e.below:
                continue
            score = sizes[id(e)] + bonus
            if score > most:
                best, most = e, score
    return best


def blocks_of(root: Element) -> list[str]:
    out: list[str] = []
    for e in root.walk():
        if e.tag in BLOCKS and not e.below and (text := e.text()):
            block = BLOCKS[e.tag] + text
            if not out or out[-1] != block:
                out.append(block)
    return out


def _visible(root: Element) -> str:
    skip = ("script", "style", "head")
    return clean(" ".join(t for t in _texts_without(root, skip)))


def _texts_without(root: Element, skip: tuple[str, ...]) -> list[str]:
    out, stack = [], list(reversed(root.children))
    while stack:
        e = stack.pop()
        if isinstance(e, str):
            out.append(e)
        elif e.tag not in skip:
            stack.extend(reversed(e.children))
    return out


def _meta(elements: list[Element], names: tuple[tuple[str, str], ...]):
    """Contents of the first element for each name, where there are any."""
    for attr, value in names:
        for e in elements:
            if e.tag == "meta" and e.attrs.get(attr) == value:
                if content := clean(e.attrs.get("content", "")):
                    yield content
                break


def _path(e: Element, path: tuple[str, ...]) -> bool:
    if e.tag != path[-1]:
        return False
    rest = list(path[:-1])
    for a in e.ancestors():
        if rest and a.tag == rest[-1]:
            rest.pop()
    return not rest


def by_line(author: str) -> str:
    return clean(re.sub(r"^(By )*(by )*", "", author.strip()))


def title_of(elements: list[Element]) -> str | None:
    for content in _meta(elements, TITLE_METAS):
        return content
    for path in TITLE_PATHS:
        first = next((e for e in elements if _path(e, path)), None)
        if first is not None and (text := first.text()):
            return text
    return None


def author_of(elements: list[Element]) -> str | None:
    for content in _meta(elements, AUTHOR_METAS):
        return by_line(content)
    for test in (lambda e: e.attrs.get("rel") == "author", lambda e: e.has_class("author"), lambda e: e.has_class("byline"), lambda e: e.attrs.get("itemprop") == "author"):
        first = next((e for e in elements if test(e)), None)
        if first is not None and (text := first.text()):
            return by_line(text)
    return None


def dates_of(elements: list[Element]) -> list[str]:
    """Candidates in order; the first that parses is the date."""
    out = list(_meta(elements, DATE_METAS))
    for e in elements:
        if e.tag == "time":
            out += [e.attrs["datetime"]] if "datetime" in e.attrs else []
            out.append(e.text())
    return out


def extract(html: str, closed: bool = False) -> tuple[str, list[str], str | None, str | None, list[str]]:
    tree = parse(html, closed)
    elements = list(tree.walk())
    root = main_root(tree)
    blocks = blocks_of(root) if root is not None else []
    text = "\n\n".join(blocks) or (_visible(root) if root is not None else "") or _visible(tree)
    return clean(text), blocks, title_of(elements), author_of(elements), dates_of(elements)


def extract_html(html: Column, closed: bool = False) -> Column:
    """struct<text,blocks,title,author,dates> of each page; null pages stay null. ``closed``: see parse."""

    @F.pandas_udf(EXTRACTED)
    def run(pages: pd.Series) -> pd.DataFrame:
        rows = [extract(p, closed) if p is not None else (None, None, None, None, None) for p in pages]
        return pd.DataFrame(rows, columns=["text", "blocks", "title", "author", "dates"])

    return run(html)
