"""Many keywords in one pass over a text: an Aho-Corasick automaton in an Arrow function.

The automaton is made once in a worker and finds every place of every keyword, so the work grows with the text and
what is found in it, not with the number of topics or keywords.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


class _Folded(dict):
    """Code points without case: upper, then lower, where these are one character."""

    def __missing__(self, code: int) -> int:
        up = chr(code).upper()
        low = (up if len(up) == 1 else chr(code)).lower()
        self[code] = ord(low) if len(low) == 1 else ord("i") if code == 0x130 else code
        return self[code]


FOLDED = _Folded()


def folded(text: str) -> str:
    """The same length as the text."""
    return text.lower() if text.isascii() else text.translate(FOLDED)


@lru_cache(1 << 16)
def in_word(c: str) -> bool:
    """Letters, marks, digits, connectors, joiners."""
    return c.isalpha() or unicodedata.category(c) in ("Mn", "Mc", "Me", "Nd", "Nl", "Pc") or c in "‌‍" or "Ⓐ" <= c <= "ⓩ"


@lru_cache(16)
def automaton(groups: tuple[tuple[str, ...], ...], fold: bool) -> ahocorasick.Automaton:
    """Values are (length, numbers of the groups that hold the keyword, keyword)."""
    held: dict[str, list[int]] = {}
    for g, keywords in enumerate(groups):
        for k in keywords:
            found = held.setdefault(folded(k) if fold else k, [])
            if k and g not in found:
                found.append(g)
    made = ahocorasick.Automaton()
    for k, of in held.items():
        if k:
            made.add_word(k, (len(k), tuple(of), k))
    made.make_automaton()
    return made


def count_groups(text: str, groups: tuple[tuple[str, ...], ...]) -> list[int]:
    """How often each group's keywords stand in a text as whole words, in either case: from left to right, the longest at a place, without overlap."""
    found = automaton(groups, True)
    counts = [0] * len(groups)
    if not len(found):
        return counts
    hits = []
    low = folded(text)
    for end, (size, of, _) in found.iter(low):
        start = end + 1 - size
        if (start == 0 or not in_word(text[start - 1])) and (end + 1 == len(text) or not in_word(text[end + 1])):
            hits.append((start, -size, of))
    until = [0] * len(groups)
    for start, size, of in sorted(hits):
        for g in of:
            if start >= until[g]:
                counts[g] += 1
                until[g] = start - size
    return counts


def group_counts(text: Column, groups: list[list[str]]) -> Column:
    """An array with :func:`count_groups` of each text; null of null."""
    named = tuple(tuple(k) for k in groups)

    @F.arrow_udf("array<bigint>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else count_groups(t, named) for t in texts.to_pylist()], pa.list_(pa.int64()))

    return run(text)


def contained(text: Column, keywords: list[str]) -> Column:
    """The keywords that a text holds anywhere, in the order of the list; null of null."""
    listed = tuple(keywords)

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        found = automaton((listed,), False)
        every = lambda t: {k for _, (_, _, k) in found.iter(t)} if len(found) else set()
        return pa.array([None if t is None else [k for k in listed if k in here or not k] for t in texts.to_pylist() for here in [every(t or "")]], pa.list_(pa.string()))

    return run(text)
