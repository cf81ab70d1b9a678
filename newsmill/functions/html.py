"""HTML to text, and the title ratio: the two functions that Column expressions can't state, as Arrow functions."""

from __future__ import annotations

import unicodedata
from collections import Counter
from difflib import SequenceMatcher
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from newsmill.functions.recent import common_length
from newsmill.functions.text import without_artifacts
from newsmill.functions.wordlists import STRIPPED_NAMES, STRIPPED_TAGS

#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Visible(HTMLParser):
    """Collects the text outside of elements that are stripped by tag, class or id."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.hidden_from: int | None = None
        self.parts: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        self.open.append(tag)
        named = " ".join(v or "" for k, v in attrs if k in ("class", "id")).lower()
        if self.hidden_from is None and (tag in STRIPPED_TAGS or any(n in named for n in STRIPPED_NAMES)):
            self.hidden_from = len(self.open)

    def handle_endtag(self, tag):
        if tag in self.open:  # closes what was left open inside, too
            while self.open.pop() != tag:
                pass
            if self.hidden_from is not None and len(self.open) < self.hidden_from:
                self.hidden_from = None

    def handle_data(self, data):
        if self.hidden_from is None:
            self.parts.append(data)


def visible_text(html: str | None) -> str:
    if not html:
        return ""
    parser = _Visible()
    parser.feed(html)
    parser.close()
    return "\n".join(parser.parts)


def _arrow(f, kind="string"):
    @F.arrow_udf(kind)
    def run(column: pa.Array) -> pa.Array:
        return pa.array([f(x) for x in column.to_pylist()], pa.string())

    return run


def nfc(text: Column) -> Column:
    return _arrow(lambda x: None if x is None else unicodedata.normalize("NFC", x))(text)


def clean_html(html: Column) -> Column:
    """Visible text with blanks collapsed, artifacts and repeated paragraphs removed, in normal form C; '' for null."""
    text = _arrow(lambda x: unicodedata.normalize("NFC", visible_text(x)))(html)
    text = F.regexp_replace(F.regexp_replace(text, "[ \t]+", " "), "\n{3,}", "\n\n")
    return without_artifacts(text)


def title_ratio(a: Column, b: Column, least: float = 0.5) -> Column:
    """The matching-blocks ratio; not symmetric. Pairs whose letters or common subsequence rule out ``least`` get an upper bound below it instead."""

    @F.arrow_udf("double")
    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        letters = lru_cache(4096)(Counter)  # of titles, which meet many others
        out = []
        for x, y in zip(left.to_pylist(), right.to_pylist()):
            x, y = x or "", y or ""
            of_y = letters(y)
            common = sum([min(n, of_y[c]) for c, n in letters(x).items() if c in of_y])
            bound = 2.0 * common / (len(x) + len(y)) if x or y else 1.0
            if bound >= least and (x or y):
                bound = 2.0 * common_length(x, y) / (len(x) + len(y))
            out.append(bound if bound < least else SequenceMatcher(None, x, y).ratio())
        return pa.array(out, pa.float64())

    return run(a, b)
