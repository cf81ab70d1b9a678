"""Chunk dedup against a plain restatement, and embedding near-dedup against all cosines."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsmill.llm import chunk_dedup, embedding_dedup
from newsmill.llm.batches import joined_bytes


def is_unspaced(c):
    o = ord(c)
    return 0xE00 <= o < 0xF00 or 0x1000 <= o < 0x10C0 or 0x1780 <= o < 0x1800 or 0x3000 <= o < 0xA000 or o >= 0x20000


def plain_chunks(text):
    """Character by character: a chunk ends where the hash of the last bytes is low for what stands there."""
    text = text or ""
    data, out, start, end, since = text.encode(), [], 0, 0, 0
    for c in text:
        end += len(c.encode())
        space = c in " \t\n\x0b\x0c\r"
        if space:
            since = end - 1
        h = 0
        for b in data[max(0, end - chunk_dedup.WINDOW) : end]:
            h = ((h << 2) + int(chunk_dedup.GEAR[b])) & 0xFFFFFFFF
        n = [chunk_dedup.MEAN_WORDS] * space + [2 * chunk_dedup.MEAN_WORDS] * is_unspaced(c) + [6 * chunk_dedup.MEAN_WORDS] * (end - 1 - since >= chunk_dedup.STRETCH)
        if end >= chunk_dedup.WINDOW and any(h < (1 << 32) // x for x in n):
            out.append((start, end))
            start = end
    if start < len(data):
        out.append((start, len(data)))
    wide = []
    for a, b in out:
        cuts = []
        for at in range(a + chunk_dedup.MOST_BYTES, b, chunk_dedup.MOST_BYTES):
            while data[at] & 0xC0 == 0x80:
                at -= 1
            cuts.append(at)
        edges = [a, *cuts, b]
        wide += list(zip(edges, edges[1:]))
    return [data[a:b] for a, b in wide]


def halves(text):
    """Half words that begin at each byte."""
    out, before, at, since = [], True, 0, 0
    for c in text or "":
        space, n = c in " \t\n\x0b\x0c\r", len(c.encode())
        if space:
            since = at
        for k in range(at, at + n):
            over = k - since - chunk_dedup.STRETCH
            first = k == at
            dense = over >= 0 and over % 3 == 0
            out.append(1 if first and is_unspaced(c) else 1 if dense else 2 * (first and not space and before))
        before, at = space, at + n
    return out


def texts(rng, n, words=4000, length=120):
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzéü", k=rng.randint(2, 9))) for _ in range(words)]
    return [" ".join(rng.choices(vocabulary, k=length)) for _ in range(n)]


def test_borders_equal_the_plain_rule():
    import pyarrow as pa

    rng = random.Random(1)
    han = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(3000))
    some = [None, "", "x", "é" * 6000, "a " * 100, *texts(rng, 20), "no-space" * 3000, han, "ไทย" * 50 + han[:200] + " \U00020001" * 40, "".join(rng.choices("abcdef", k=5000))]
    data, ends = joined_bytes(pa.array(some))
    cut = chunk_dedup.borders(data, ends).tolist()
    raw = data.tobytes()
    for k, t in enumerate(some):
        inside = [c for c in cut if ends[k] <= c <= ends[k + 1]]
        assert [raw[a:b] for a, b in zip(inside, inside[1:])] == plain_chunks(t)


def plain_spans(docs, min_words=20):
    held = defaultdict(set)
    chunks = {i: plain_chunks(t) for i, t in docs}
    pairs = {i: list(zip(cs, cs[1:])) if len(cs) != 1 else [(cs[0], b"")] for i, cs in chunks.items()}
    for i, ps in pairs.items():
        for p in ps:
            held[p].add(i)
    out = set()
    for i, cs in chunks.items():
        h, edge = halves(dict(docs)[i]), np.cumsum([0, *map(len, cs)])
        size = [sum(h[a:b]) for a, b in zip(edge, edge[1:])]
        at = np.cumsum([0, *(len(c.decode()) for c in cs)])
        hit = [len(held[p]) > 1 for p in pairs[i]]
        k = 0
        while k < len(hit):
            if not hit[k]:
                k += 1
                continue
            end = k
            while end < len(hit) and hit[end]:
                end += 1
            stop = min(end + 1, len(cs))  # chunks k to stop
            if sum(size[k:stop]) >= 2 * min_words:
                least = [min(held[p]) for p in pairs[i]]
                first = [max(least[x] for x in (c - 1, c) if k <= x < end) for c in range(k, stop)]
                j = k
                while j < stop:
                    kind, to = first[j - k] == i, j
                    while to < stop and (first[to - k] == i) == kind:
                        to += 1
                    out.add((i, int(at[j]), int(at[to]), sum(size[j:to]) // 2, min(first[j - k : to - k]), kind))
                    j = to
            k = end
    return out


def planted():
    rng = random.Random(2)
    base = texts(rng, 40)
    shared = texts(rng, 5, length=60)
    for i in range(0, 40, 2):
        w = base[i].split(" ")
        at = rng.randrange(len(w))
        base[i] = " ".join(w[:at] + [shared[i % 5]] + w[at:])
    odd = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(400)) + "abc" * 60 + " ไทย ไทย" * 9
    return base + [base[1], base[3] + " more words here", "", None, "x" + odd, odd + "y", "x" * 200 + " " + odd]


def test_repeats_equal_the_plain_rule(spark):
    docs = list(enumerate(planted()))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, id string, digests int").repartition(4)
    got = {tuple(r[c] for c in ("id", "start", "end", "n_words", "first_id", "kept")) for r in chunk_dedup.repeats(df).collect()}
    assert got == plain_spans(docs)
    caught = {x[0] for x in got}
    assert set(range(0, 40, 2)) | {1, 3, 40, 41, 44, 45, 46} == caught
    assert chunk_dedup.repeats(df.where("false")).count() == 0


def test_repeats_of_repeated_rows(spark):
    docs = list(enumerate(planted()))
    df = spark.createDataFrame([*docs, *docs[:7], docs[40]], "doc_id long, text string").repartition(4)
    got = sorted(tuple(r[c] for c in ("id", "start", "end", "n_words", "first_id", "kept")) for r in chunk_dedup.repeats(df).collect())
    assert got == sorted(plain_spans(docs))


def test_removal_keeps_one_copy(spark):
    docs = list(enumerate(planted()))
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, words string")
    got = {r.doc_id: r.text for r in chunk_dedup.remove_repeats(df).collect()}
    assert got[1] == docs[1][1] and got[40] == "" and got[43] is None and len(got) == len(docs)
    gone = defaultdict(list)
    for i, a, b, _, _, kept in plain_spans(docs):
        if not kept:
            gone[i].append((a, b))
    for i, t in docs:
        expected = t
        for a, b in sorted(gone[i], reverse=True):
            expected = expected[:a] + expected[b:]
        assert got[i] == expected


def test_an_insertion_changes_few_chunks():
    rng = random.Random(3)
    t = texts(rng, 1, length=2000)[0]
    a, b = plain_chunks(t), plain_chunks(t[:5000] + " inserted " + t[5000:])
    assert len(set(a) - set(b)) <= 4


@pytest.mark.parametrize("letters", [(0x4E00, 0x9000), (0x3041, 0x3096), (0xE01, 0xE3A), (0x61, 0x7B)])
def test_a_shifted_passage_without_white_space_is_found(spark, letters):
    rng = random.Random(6)
    some = lambda n: "".join(chr(rng.randrange(*letters)) for _ in range(n))
    passage = some(3000)
    docs = [(1, some(701) + passage + some(90)), (2, some(44) + passage), (3, passage[:1500] + "x" + passage[1500:]), (4, some(2000))]
    cut = plain_chunks(passage[:1500] + "x" + passage[1500:])
    assert len(set(plain_chunks(passage)) - set(cut)) <= 4
    got = chunk_dedup.repeats(spark.createDataFrame(docs, "doc_id long, text string"), min_words=1).collect()
    covered = {i: sum(r.end - r.start for r in got if r.id == i) for i in (1, 2, 3, 4)}
    assert covered[4] == 0 and all(covered[i] > 2700 for i in (1, 2, 3))


# --- vectors


def clustered(rng, n, d, near):
    centres = rng.standard_normal((n, d))
    rows = [c + near * rng.standard_normal(d) / np.sqrt(d) * np.linalg.norm(c) * rng.random() for c in centres for _ in range(6)]
    return np.array(rows)


def brute(rows):
    """rows: [(id, vector or None, label)]"""
    links, parent = defaultdict(int), {i: i for i, *_ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    good = []
    for i, v, label in rows:
        if v is None or label is None or not len(v) or any(x is None for x in v):
            continue
        a = np.array(v, np.float64)
        if np.isfinite(a).all() and a.any():
            good.append((i, a / np.linalg.norm(a), label, len(a)))
    for k, (i, a, la, da) in enumerate(good):
        for j, b, lb, db in good[k + 1 :]:
            if la == lb and da == db and a @ b >= 0.98:
                links[i] += 1
                links[j] += 1
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: (links[i], root(i)) for i, *_ in rows}


SCHEMA = "vec_id long, embedding array<float>, label int, member string, links int, code string"


def found(spark, rows):
    df = spark.createDataFrame([(i, v, label, "m", 1, "c") for i, v, label in rows], SCHEMA).repartition(3)
    return {r.id: (r.links, r.component) for r in embedding_dedup.near_duplicates(df).collect()}


@pytest.mark.parametrize("d", [2, 3, 16, 64, 100])
def test_vectors_equal_brute_force(spark, d):
    rng = np.random.default_rng(d)
    x = clustered(rng, 60, d, 0.25).astype(np.float32).tolist()
    rows = [(1000 - i, v, i % 3) for i, v in enumerate(x)]
    exact, got = brute(rows), found(spark, rows)
    links = sum(n for n, _ in exact.values())
    missing = sum(exact[i][0] - got[i][0] for i in exact)
    assert links > 60 and all(got[i][0] <= exact[i][0] for i in exact)
    assert missing <= 0.02 * links
    if not missing:
        assert got == exact


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    v = [0.5, -1.0, 2.0]
    rows = [(1, v, 1), (2, v, 1), (3, [1.0, -2.0, 4.0], 1), (4, v, 2), (5, v, None), (6, None, 1), (7, [], 1), (8, [0.0] * 3, 1), (9, [nan, 1.0, 1.0], 1), (10, [inf, 1.0, 1.0], 1), (11, [None, 1.0, 1.0], 1), (12, [0.5, -1.0], 1), (13, [-x for x in v], 1), (14, v, 1)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == {}
    same = [(i, [1.0, 2.0], 7) for i in range(500)]
    assert found(spark, same) == {i: (499, 0) for i in range(500)}


def test_ragged_lengths_and_doubles(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "FITTED", 2)
    rng = np.random.default_rng(4)
    rows = []
    for d in (3, 5, 8, 8, 8, 40):
        x = clustered(rng, 10, d, 0.15)
        rows += [(len(rows) + i, v, 1) for i, v in enumerate(x.tolist())]
    exact = brute(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.id: (r.links, r.component) for r in embedding_dedup.near_duplicates(df).collect()}
    assert sum(n for n, _ in exact.values()) > 200 and sum(n for n, _ in got.values()) >= 0.98 * sum(n for n, _ in exact.values())
    assert all(got[i][0] <= exact[i][0] for i in exact)


def test_query_equals_its_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{d}/embeddings.parquet')")
    assert sorted(map(tuple, con.execute(embedding_dedup.SQL).fetchall())) == sorted(map(tuple, embedding_dedup.query(spark, d).collect()))


def test_codes_are_balanced(spark):
    x = np.random.default_rng(9).standard_normal((2000, 64)) + 3.0
    mean, projection = embedding_dedup.quantiser(x)
    bits = (x - mean) @ projection >= 0
    assert projection.shape == (64, embedding_dedup.CODE_BITS)
    assert abs(bits.mean(0) - 0.5).max() < 0.06


def test_recall_on_the_test_table(spark):
    d = "/root/testdata/sf0.001"
    t = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.query(spark, d).select("vec_id", "n_links", "component_id").collect()}
    assert got == brute(t)
    assert spark.read.parquet(f"{d}/embeddings.parquet").where(F.col("vec_id").isNull()).count() == 0
