"""SimHash, components and candidate groups against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from newsmill.llm import linking, simhash


def plain_fingerprint(text, words=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in simhash.re.split(r"[\x20\x09-\x0D]+", low) if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("text", [None, "", " \t", "One", "a b c", "A b C d", "É b c d e f\x1cg h", "x " * 300, "word " * 40_000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_fingerprint_is_sparks_hash(spark):
    df = spark.createDataFrame([("éa b c d",)], "s string").select(F.xxhash64("s"))
    assert df.first()[0] & (1 << 64) - 1 == plain_fingerprint("Éa b c d".replace("É", "é"))


@pytest.mark.parametrize("count", [10, 10**6, 10**9, 10**11])
def test_every_near_pair_shares_a_table(count):
    rng = random.Random(3)
    masks = simhash.table_masks(count, 4)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
        assert any(x & m == y & m for m in masks)


def brute(rows):
    links = [(a, b) for i, (a, x) in enumerate(rows) for b, y in rows[i + 1 :] if (x ^ y).bit_count() <= 4]
    return plain_components([a for a, _ in rows], links)


def test_components_of_planted_fingerprints(spark):
    rng = random.Random(5)
    rows, base = [], [rng.getrandbits(64) for _ in range(40)]
    for x in base:
        for _ in range(8):  # chains: each a few bits from the one before
            rows.append(x)
            x ^= sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6)))
    centre = rng.getrandbits(64)
    rows += [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(500)]
    rows += [rng.getrandbits(64) for _ in range(300)]
    rng.shuffle(rows)
    rows = [(1000 - i, x) for i, x in enumerate(rows)]
    df = spark.createDataFrame([(i, simhash._signed(x)) for i, x in rows], "id long, fp long").repartition(5)
    got = {r.id: r.component for r in df.join(simhash.fingerprint_components(df), "fp").collect()}
    assert got == brute(rows)


def test_near_duplicates_of_texts_and_odd_rows(spark):
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(2000)]
    texts = [None, "", "  ", "one", "one"]
    for _ in range(30):
        w = rng.choices(words, k=300)
        texts.append(" ".join(w))
        w[rng.randrange(300)] = "changed"
        texts.append(" ".join(w))
    rows = [(i * 3, t, "x", "y") for i, t in enumerate(texts)] + [(None, "one", "x", "y"), (9, "one", "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, component string")
    out = simhash.near_duplicates(df).collect()
    assert len(out) == len(rows)
    expected = brute([(i, plain_fingerprint(t)) for i, t, *_ in rows if i is not None])
    assert {r.id: r.component for r in out if r.id is not None} == expected
    assert [r.component for r in out if r.id is None] == [expected[9]]
    assert simhash.near_duplicates(df.where("false")).count() == 0


def test_large_buckets_meet_in_blocks(spark):
    keys = spark.range(1500).select(F.lit(1).cast("long").alias("bucket"), F.col("id").alias("member"))
    groups = linking.candidate_groups(keys).groupBy("first", "second").count().collect()
    assert max(r["count"] for r in groups) < 600 and len(groups) > 20

    def check(table):
        m = table.column("member").to_numpy()
        return lambda a, b: ((hit := np.abs(m[a] - m[b]) == 700), hit)

    out = linking.link_groups(linking.candidate_groups(keys), check).groupBy("member").agg(F.sum("links").alias("n")).collect()
    assert {r.member: r.n for r in out} == {i: (i >= 700) + (i < 800) for i in range(1500)}


@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(11)
    links = {
        "path": [(i, i + 1) for i in range(200)],
        "star": [(0, i) for i in range(1, 300)] + [(i, i + 1000) for i in range(1, 300)],
        "random": [(rng.randrange(400), rng.randrange(400)) for _ in range(250)],
        "none": [],
    }[shape]
    df = spark.createDataFrame(links, "u long, v long")
    got = {r.node: r.component for r in linking.components(df).collect()}
    nodes = {x for e in links if e[0] != e[1] for x in e}
    assert got == plain_components(nodes, [e for e in links if e[0] != e[1]])
