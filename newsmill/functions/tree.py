"""Pages as trees: CSS selectors, and the block that holds an article's text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from newsmill.functions.html import VOID
from newsmill.functions.wordlists import STRIPPED_NAMES, STRIPPED_TAGS

#: Elements whose end may be left out, and what ends them where it starts.
ENDED_BY = {
    "p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]),
    "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"]),
}
#: Elements whose own text is a paragraph.
PARAGRAPHS = frozenset("p pre blockquote li div section article main td h1 h2 h3 h4".split())
LEAST_PARAGRAPH, LEAST_TEXT = 25, 100
#: Pages whose results a task has as objects at a time.
PAGES = 200


class Node:
    """An element: ``kids`` are elements and texts in order."""

    __slots__ = ("tag", "attrs", "kids", "up")

    def __init__(self, tag: str, attrs: dict[str, str], up: Node | None):
        self.tag, self.attrs, self.kids, self.up = tag, attrs, [], up

    def walk(self) -> Iterator[Node]:
        """The elements below, in the order of the page."""
        waiting = [k for k in reversed(self.kids) if isinstance(k, Node)]
        while waiting:
            n = waiting.pop()
            yield n
            waiting += [k for k in reversed(n.kids) if isinstance(k, Node)]

    def texts(self) -> Iterator[str]:
        waiting: list = self.kids[::-1]
        while waiting:
            k = waiting.pop()
            if isinstance(k, str):
                yield k
            elif k.tag not in ("script", "style"):
                waiting += k.kids[::-1]

    def cut(self) -> None:
        """Takes the tree apart. Elements and what they stand in refer to each other, so a tree would else stay until the collector of cycles comes."""
        for n in [self, *self.walk()]:
            n.kids, n.up = [], None

    def text(self) -> str:
        """Its texts, each trimmed, end to end."""
        return "".join(t.strip() for t in self.texts())


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        while self.at.up is not None and tag in ENDED_BY.get(self.at.tag, ()):
            self.at = self.at.up
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.kids.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag:
            self.at = self.at.up

    def handle_endtag(self, tag):
        n = self.at
        while n.up is not None and n.tag != tag:
            n = n.up
        if n.up is not None:  # an end without a start is left out
            self.at = n.up

    def handle_data(self, data):
        self.at.kids.append(data)


def tree(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


# --- selectors

PART = re.compile(r"""\s*([>+~])\s*|(\s+)|(\*|[A-Za-z][\w-]*)|\#([\w-]+)|\.([\w-]+)|\[\s*([\w:-]+)\s*(?:([~^$*|]?=)\s*(?:"([^"]*)"|'([^']*)'|([\w-]+))\s*)?\]""")
TESTS = {
    "=": lambda a, v: a == v, "~=": lambda a, v: v in a.split(), "^=": lambda a, v: v != "" and a.startswith(v),
    "$=": lambda a, v: v != "" and a.endswith(v), "*=": lambda a, v: v != "" and v in a, "|=": lambda a, v: a == v or a.startswith(v + "-"),
}


@lru_cache(256)
def selector(css: str) -> tuple[tuple[tuple[str, tuple], ...], ...]:
    """Alternatives of (relation to the one before, conditions); an error where it is none of tag, id, class, attribute and the four relations."""
    found = []
    for one in css.split(","):
        steps, relation, conditions, at, one = [], " ", [], 0, one.strip()
        while at < len(one):
            m = PART.match(one, at)
            if not m:
                raise ValueError(f"not a selector: {css!r}")
            at = m.end()
            if m[1] or m[2]:
                if not conditions:
                    raise ValueError(f"not a selector: {css!r}")
                steps.append((relation, tuple(conditions)))
                relation, conditions = m[1] or " ", []
            elif m[3]:
                conditions.append(("tag", m[3].lower(), ""))
            elif m[4] or m[5]:
                conditions.append(("=", "id", m[4]) if m[4] else ("~=", "class", m[5]))
            else:
                value = next((v for v in m.group(8, 9, 10) if v is not None), "")
                conditions.append((m[7] or "has", m[6].lower(), value))
        if not conditions:
            raise ValueError(f"not a selector: {css!r}")
        found.append((*steps, (relation, tuple(conditions))))
    return tuple(found)


def _fits(n: Node, conditions: tuple) -> bool:
    for test, name, value in conditions:
        if test == "tag":
            if name not in ("*", n.tag):
                return False
        elif name not in n.attrs or test != "has" and not TESTS[test](n.attrs[name], value):
            return False
    return True


def _matches(n: Node, steps: tuple) -> bool:
    if not _fits(n, steps[-1][1]):
        return False
    if len(steps) == 1:
        return True
    relation, rest = steps[-1][0], steps[:-1]
    if relation in " >":
        up = n.up
        while up is not None and up.up is not None:
            if _matches(up, rest):
                return True
            if relation == ">":
                return False
            up = up.up
        return False
    before = [k for k in n.up.kids if isinstance(k, Node)]
    before = before[: next(i for i, k in enumerate(before) if k is n)]
    return any(_matches(k, rest) for k in (before[-1:] if relation == "+" else before))


def select(root: Node, css: str) -> Iterator[Node]:
    ways = selector(css)
    return (n for n in root.walk() if any(_matches(n, steps) for steps in ways))


def linked(html: str | None, base: str | None, css: str, most: int) -> list[dict]:
    """The first ``most`` different links of what ``css`` selects, the first of each with its text."""
    found: dict[str, str] = {}
    for n in select(tree(html), css):
        href = n.attrs.get("href", "").strip()
        if not href or href.startswith(("#", "javascript:")):
            continue
        try:
            link = urljoin(base or "", href)
        except ValueError:  # not an address
            continue
        if link not in found:
            found[link] = n.text()
            if len(found) >= most:
                break
    return [{"link": k, "title": v} for k, v in found.items()]


# --- the article of a page


def _hidden(n: Node) -> bool:
    named = (n.attrs.get("class", "") + " " + n.attrs.get("id", "")).lower()
    return n.tag in STRIPPED_TAGS or any(x in named for x in STRIPPED_NAMES)


def _own_text(n: Node) -> tuple[str, int]:
    """Text of a paragraph without the paragraphs inside it, and how many of its letters are links'."""
    out, links, waiting = [], 0, [(k, False) for k in reversed(n.kids)]
    while waiting:
        k, in_link = waiting.pop()
        if isinstance(k, str):
            out.append(k)
            links += len(k.strip()) * in_link
        elif k.tag == "br":
            out.append("\n")
        elif k.tag not in PARAGRAPHS and not _hidden(k):
            waiting += [(x, in_link or k.tag == "a") for x in reversed(k.kids)]
    return re.sub(r"[^\S\n]*\n\s*", "\n", re.sub(r"[^\S\n]+", " ", "".join(out))).strip(), links


def main_text(root: Node) -> str | None:
    """The paragraphs of the block with the most text that isn't links; none where no block has a paragraph.

    A paragraph's weight is its letters less those of its links; it counts for the block it stands in, half
    for the one around, and so on, so a block with many paragraphs wins over its only one and over the whole page.
    """
    weight: dict[int, float] = {}
    blocks: dict[int, Node] = {}
    paragraphs: list[tuple[Node, str]] = []
    waiting = [root]
    while waiting:
        n = waiting.pop()
        if n.tag in PARAGRAPHS:
            text, links = _own_text(n)
            if text:
                paragraphs.append((n, text))
            if len(text) >= LEAST_PARAGRAPH and 2 * links <= len(text):
                block, part = n.up if n.tag in ("p", "pre", "blockquote", "li") else n, len(text) - links
                while block is not None and part >= 1:
                    weight[id(block)] = weight.get(id(block), 0.0) + part
                    blocks[id(block)] = block
                    block, part = block.up, part / 2
            elif text:
                paragraphs.pop()
                if not n.tag.startswith("h") and 2 * links <= len(text):
                    paragraphs.append((n, text))
        waiting += [k for k in reversed(n.kids) if isinstance(k, Node) and not _hidden(k)]
    if not weight:
        return None
    best = max(weight, key=lambda i: weight[i])  # the first in the page's order of equal ones
    inside = {best, *(id(n) for n in blocks[best].walk())}
    return "\n\n".join(text for n, text in paragraphs if id(n) in inside) or None


def _meta(root: Node, *names: str) -> str | None:
    found = {}
    for n in root.walk():
        if n.tag == "meta":
            found.setdefault(n.attrs.get("property") or n.attrs.get("name"), n.attrs.get("content", "").strip())
    return next((found[x] for x in names if found.get(x)), None)


def extracted(html: str | None, least: int = LEAST_TEXT) -> dict:
    """title, text, published, image and how the text was found: the main block; if it is shorter than ``least``, all visible
    paragraphs; null where there are none."""
    root = tree(html)
    try:
        return _extracted(root, least)
    finally:
        root.cut()


def _extracted(root: Node, least: int) -> dict:
    text, via = main_text(root), "block"
    if text is None or len(text) < least:
        every, waiting = [], [root]
        while waiting:
            n = waiting.pop()
            if n.tag in PARAGRAPHS or n.tag == "body":
                every.append(_own_text(n)[0])
            waiting += [k for k in reversed(n.kids) if isinstance(k, Node) and not _hidden(k)]
        whole = "\n\n".join(t for t in every if t)
        text, via = (whole, "page") if len(whole) > len(text or "") else (text, via)
    heads = [n.text() for tag in ("h1", "title") for n in root.walk() if n.tag == tag]
    times = [n.attrs["datetime"] for n in root.walk() if n.tag == "time" and n.attrs.get("datetime")]
    return {
        "title": _meta(root, "og:title") or next((h for h in heads if h), ""), "text": text or None,
        "published": _meta(root, "article:published_time", "date") or next(iter(times), None), "image": _meta(root, "og:image", "twitter:image"), "via": via if text else None,
    }


# --- as columns

LINKS = pa.list_(pa.struct([("link", pa.string()), ("title", pa.string())]))
ARTICLE = pa.struct([(k, pa.string()) for k in ("title", "text", "published", "image", "via")])


def _by_page(make, kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """``make`` of each row: pages leave the batch one by one, and results are packed every ``PAGES``, so a task never has a whole batch as objects."""
    parts, found = [], []
    for row in zip(*columns):
        found.append(make(*[x.as_py() for x in row]))
        if len(found) == PAGES:
            parts.append(pa.array(found, kind))
            found.clear()
    parts.append(pa.array(found, kind))
    return pa.concat_arrays(parts)


def selected_links(html: Column, base: Column, css: str = "a[href]", most: int = 20) -> Column:
    selector(css)  # an error in the plan rather than in a task

    @F.arrow_udf("array<struct<link:string,title:string>>")
    def run(pages: pa.Array, bases: pa.Array) -> pa.Array:
        return _by_page(lambda h, b: linked(h, b, css, most), LINKS, pages, bases)

    return run(html, base)


def article_of_page(html: Column, least: int = LEAST_TEXT) -> Column:
    @F.arrow_udf("struct<title:string,text:string,published:string,image:string,via:string>")
    def run(pages: pa.Array) -> pa.Array:
        return _by_page(lambda h: extracted(h, least), ARTICLE, pages)

    return run(html)
