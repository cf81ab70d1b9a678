"""The source audit against plain Python with whole numbers of any size."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from newsmill.llm import source_audit

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, term string, value string"


def terms_of(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(rows, min_docs, most):
    """The audit's rows for (text, lang, source)."""
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = terms_of(text)
        groups[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = set()
    for lang, counted in docs.items():
        kept = [t for t, n in counted.items() if n >= min_docs]
        own = {s: c for (x, s), c in groups.items() if x == lang}
        total = sum(own.values(), Counter())

        def shares(c):
            n = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 5) // n for t in kept}

        p, q = {s: shares(c) for s, c in own.items()}, shares(total)
        for s in own:
            pairs = [(-sum(abs(p[s][t] - p[x][t]) for t in kept), x.encode()) for x in own if x != s]
            excess = sorted((q[t] - p[s][t], t.encode()) for t in kept if own[s][t] and p[s][t] > q[t])
            for part, found in (("pair", sorted(pairs)), ("term", excess[:most])):
                out |= {(lang, s, part, item.decode(), -value, i + 1) for i, (value, item) in enumerate(found)}
    return out


def made(seed, n, langs, sources):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "über", "Über", "naïve", "x", "Z", "漢字", "\x7f", "[", "a1b", "tie_a tie_b", " ", "é\U0001f600", "q" * 500]
    rows = [(" ".join(rng.choices(words[: rng.randint(3, len(words))], k=rng.randint(0, 40))), rng.choice(langs), rng.choice(sources)) for _ in range(n)]
    return rows + [(None, None, None), ("", "en", "empty"), ("alpha", "lone", None), ("beta " * 20_000, "en", "long"), ("alpha", "en", "a"), ("alpha", "en", "a")]


@pytest.mark.parametrize("shard_entries,block", [(None, 256), (5, 2)])
def test_audit_equals_plain_counts(spark, monkeypatch, shard_entries, block):
    monkeypatch.setattr(source_audit, "BLOCK_SOURCES", block)
    rows = made(1, 400, ["en", "de", "", None], ["a", "b", "Ä", "z", None, "", "c"])
    docs = spark.createDataFrame([(i, t, lang, s, "x", "y") for i, (t, lang, s) in enumerate(rows)], SCHEMA).repartition(5)
    for min_docs, most in ((3, 4), (10**6, 50)):
        found = source_audit.audit(docs, min_docs, most, shard_entries).collect()
        assert len(found) == len(set(found))
        assert {tuple(r) for r in found} == plain(rows, min_docs, most)


def test_more_sources_than_a_block(spark):
    rows = [(f"word{i % 7} word{i % 3}", "en", f"s{i % 300}") for i in range(1200)]
    docs = spark.createDataFrame([(i, *r, "x", "y") for i, r in enumerate(rows)], SCHEMA)
    assert {tuple(r) for r in source_audit.audit(docs, 3, 5).collect()} == plain(rows, 3, 5)


def test_terms_stop_at_texts(spark):
    texts = pa.array(["ab", "cd", None, "", "É x", "é", "-"])
    batch = pa.record_batch([texts, pa.array(["l"] * 7), pa.array(["s"] * 7)], ["text", "lang", "source"])
    got = {(r["term"], r["n"], r["docs"]) for r in source_audit.count_terms(batch).to_pylist()}
    assert got == {("ab", 1, 1), ("cd", 1, 1), ("É", 1, 1), ("x", 1, 1), ("é", 1, 1), (None, 0, 0)}


@pytest.mark.parametrize("digest", [xxhash.xxh64_intdigest, lambda b: len(b) % 2, lambda b: 7])
def test_collisions_are_told_apart_by_bytes(digest):
    rng = random.Random(2)
    words = [rng.choice(["a", "b", "ab", "ba", "abc", "é", "longer"]) for _ in range(300)]
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, stops = source_audit.term_slices(raw, np.array([0, len(raw)]))
    group, firsts = source_audit.group_slices(raw, starts, stops, digest)
    assert len(set(group.tolist())) == len(set(words)) == len({(w, g) for w, g in zip(words, group.tolist())})
    assert all(words[firsts[g]] == w for w, g in zip(words, group.tolist()))


def test_shares_of_great_counts():
    rng = random.Random(4)
    for _ in range(200):
        whole = rng.randint(10, 10**15)
        count = rng.randint(0, whole - 5)
        got = source_audit.shares(np.array([count]), np.array([whole]))[0]
        assert got == 1 + 10**9 * (count + 5) // whole


def test_empty_table_and_query(spark, tmp_path):
    assert source_audit.audit(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = made(3, 300, ["en", "fr"], ["a", "b", None])
    spark.createDataFrame([(i, *r, "", "") for i, r in enumerate(rows)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = source_audit.query(spark, str(tmp_path))
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    assert {tuple(r) for r in got.collect()} == plain(rows, 30, 50)
