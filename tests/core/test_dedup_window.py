"""The dedup window holds kept articles: copies don't push them out."""

import random
from datetime import datetime, timedelta
from difflib import SequenceMatcher

import pytest

from newsmill.functions.recent import Common, common_length
from newsmill.operators import dedup


def sequential(rows, most):
    """(id, duplicate, cluster) by the rule, one arrival after another; titles alone."""
    kept, out = [], {}
    for i, at, title in rows:
        recent = [k for k in kept[-most:] if k[1] >= at - timedelta(hours=48)]
        same = [k for k in recent if SequenceMatcher(None, title, k[2]).ratio() >= 0.8]
        out[i] = (bool(same), same[-1][0] if same else i)
        if not same:
            kept.append((i, at, title))
    return out


@pytest.mark.parametrize("most, copies, names", [(200, 230, 0), (5, 12, 40)])
def test_copies_take_no_places(spark, most, copies, names):
    rng = random.Random(most)
    pick = lambda c: "".join(c * 3 for c in rng.sample(c, 8))
    titles = ["aaaabbbbcccc dddd"] + ["zzzz yyyy xxxx wwww"] * copies + ["aaaabbbbcccc dddd"] * 2
    pool = [pick("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(12)]
    titles += [rng.choice(pool) for _ in range(names)]
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(minutes=3 * i), t) for i, t in enumerate(titles)]
    df = spark.createDataFrame([(i, f"https://a.example/{i}", at, t, None) for i, at, t in rows], "article_id long, url string, created_at timestamp_ntz, title_original string, embedding array<double>")
    got = {r.article_id: (r.is_duplicate, r.cluster_id) for r in dedup.deduplicate(df, most=most).collect()}
    assert got == sequential(rows, most)


def made(seed, n, names, minutes):
    """Chains of titles and vectors that drift apart, in bursts of one time."""
    rng = random.Random(seed)
    start, rows, at = datetime(2024, 1, 1), [], 0
    pool = ["".join(rng.choices("abcdefghijklm nopq", k=24)) for _ in range(names)]
    for i in range(n):
        at += rng.choice([0, 0, minutes, 3 * minutes])
        k = rng.randrange(names)
        title = list(pool[k])
        title[rng.randrange(24)] = rng.choice("xyz")
        if rng.random() < 0.3:
            pool[k] = "".join(title)  # what is similar moves on
        vec = [rng.choice([0.0, 0.6, 0.8, 1.0]) for _ in range(rng.choice([3, 3, 3, 4]))] if rng.random() < 0.6 else None
        rows.append((rng.choice([1, -1]) * (i + 1) * 7919, f"https://a.example/{rng.randrange(2 * n)}", start + timedelta(minutes=at), None if rng.random() < 0.02 else "".join(title), vec))
    return rows


def whole_fold(rows, hours, most, title=0.8, cos=0.8):
    """(duplicate, layer, cluster) of each id by the rule, over all three layers."""
    first, kept, out = {}, [], {}
    for i, url, at, text, vec in sorted(rows, key=lambda r: (r[2], r[0])):
        if url in first:
            out[i] = (True, 1, first[url])
            continue
        first[url] = i
        near = [k for k in reversed(kept[-most:]) if k[1] >= at - timedelta(hours=hours)]
        hit = next(((2, k[0]) for k in near if SequenceMatcher(None, text or "", k[2] or "").ratio() >= title), None)
        if hit is None and vec:
            scored = [(sum(x * y for x, y in zip(vec, k[3])), -n, k[0]) for n, k in enumerate(near) if k[3] and len(k[3]) == len(vec)]
            best = max(scored, default=None)
            hit = (3, best[2]) if best and best[0] >= cos else None
        out[i] = (hit is not None, *(hit or (None, i)))
        if hit is None:
            kept.append((i, at, text, vec))
    for i, (dup, layer, like) in out.items():
        if layer == 1:
            out[i] = (dup, layer, out[like][2] if out[like][0] else like)
    return out


@pytest.mark.parametrize("hours,most,segment,warm", [(48, 200, 20_000, 1000), (2, 10, 40, 15), (48, 30, 25, 0), (1, 5, 7, 7), (1000, 500, 60, 10)])
def test_segments_give_the_sequential_result(spark, hours, most, segment, warm):
    rows = made(most + segment, 400, 60, 9)
    df = spark.createDataFrame(rows, "article_id long, url string, created_at timestamp_ntz, title_original string, embedding array<double>").repartition(5)
    found = dedup.deduplicate(df, hours, most=most, segment=segment, warm=warm).collect()
    want = whole_fold(rows, hours, most)
    assert {r.article_id: (r.is_duplicate, r.layer, r.cluster_id) for r in found} == want


def test_places_in_arrival_order(spark):
    rows = [(i, datetime(2024, 1, 1)) for i in range(500)] + [(1000 - i, datetime(2023, 1, 1) + timedelta(hours=i % 7)) for i in range(300)]
    df = spark.createDataFrame(rows, "article_id long, created_at timestamp_ntz").repartition(6)
    got = [r.article_id for r in dedup.arrival_order(df).orderBy("n").collect()]
    assert got == [i for i, _ in sorted(rows, key=lambda r: (r[1], r[0]))]
    assert sorted(r.n for r in dedup.arrival_order(df).collect()) == list(range(1, 801))


def test_no_articles(spark):
    empty = spark.createDataFrame([], "article_id long, url string, created_at timestamp_ntz, title_original string, embedding array<double>")
    assert dedup.deduplicate(empty).count() == 0


def test_common_subsequences_of_all_fields():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            old = row[:]
            for j, y in enumerate(b):
                row[j + 1] = old[j] + 1 if x == y else max(row[j], old[j + 1])
        return row[-1]

    rng = random.Random(9)
    text = lambda n: "".join(rng.choices("abcé ", k=rng.randint(0, n)))
    held, all_ = [""] * 7, Common(7)
    for step in range(60):
        i = rng.randrange(7)
        held[i] = text(20 if step < 30 else 200)
        all_.put(i, held[i])
        title = text(90)
        assert all_.lengths(title).tolist() == [plain(title, t) for t in held] == [common_length(title, t) for t in held]


def test_segments_keep_their_number(spark):
    """Rounds of wrong guesses follow the number of segments, so a larger table has longer ones, not more."""
    sizes = [dedup.segment_size(n) for n in (1, 4_000 * 96, 1_000_000, 3_000_000, 10**9)]
    assert sizes == [4_000, 4_000, 10_417, 31_250, 50_000]
