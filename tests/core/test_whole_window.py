"""Without a limit of articles, dedup and pairs meet all of the window, in blocks of any size."""

import math
import random
from datetime import datetime
from difflib import SequenceMatcher

import pytest
from test_dedup_window import made as drifting
from test_dedup_window import whole_fold
from test_pairs import ARTICLES, made, plain

from newsmill.functions.alike import Alike
from newsmill.functions.recent import Grouped, Recent, Whole
from newsmill.operators import dedup, windows
from newsmill.plans import content

BY_URL = "article_id long, url string, created_at timestamp_ntz, title_original string, embedding array<double>"
EVERY = 10**9


@pytest.mark.parametrize("places, pairs, cos", [(7, 5, 0.96), (100, 64, 0.4), (4_000, 1 << 16, 1.0)])
def test_pairs_are_all_of_the_window(spark, monkeypatch, places, pairs, cos):
    monkeypatch.setattr(windows, "block_size", lambda n: places)
    monkeypatch.setattr(windows, "PAIRS", pairs)
    rows = made(260, places)
    found = dedup.similar_pairs(spark.createDataFrame(rows, ARTICLES), 24, 0.8, cos, None).collect()
    got = {(r.later, r.earlier): (r.layer, None if r.score is None or math.isnan(r.score) else r.score) for r in found}
    want = plain(rows, EVERY, 24, 0.8, cos)
    assert got == want and len(found) == len(want) > len(plain(rows, 20, 24, 0.8, cos)) and {2, 3} == {x for x, _ in want.values()}


@pytest.mark.parametrize("hours, places", [(48, 25), (2, 60), (1000, 4_000), (1, 7)])
def test_the_fold_meets_all_of_the_window(spark, monkeypatch, hours, places):
    monkeypatch.setattr(windows, "block_size", lambda n: places)
    rows = drifting(hours + places, 400, 60, 9)
    df = spark.createDataFrame(rows, BY_URL).repartition(5)
    found = dedup.deduplicate(df, hours, most=None).collect()
    want = whole_fold(rows, hours, EVERY)
    assert len(found) == 400 and {r.article_id: (r.is_duplicate, r.layer, r.cluster_id) for r in found} == want
    assert hours < 48 or want != whole_fold(rows, hours, 20)


def beyond(spark):
    """A copy after 300 other articles of the same hour."""
    rng = random.Random(5)
    names = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=24)) for _ in range(300)]
    titles = ["the same words come again", *names, "the same words come again"]
    return spark.createDataFrame([(i, t, datetime(2024, 1, 1), None, f"u{i}") for i, t in enumerate(titles)], "article_id long, title_original string, created_at timestamp_ntz, embedding array<double>, url string")


def test_title_pairs_go_beyond_the_newest_200(spark, monkeypatch):
    monkeypatch.setattr(content, "_arrivals", lambda spark, d: beyond(spark))
    assert {(r.later, r.earlier) for r in content.dedup_title_pairs(spark, "").collect()} == {(301, 0)}


def test_no_article_and_none_with_a_time(spark):
    assert dedup.deduplicate(spark.createDataFrame([], BY_URL), most=None).count() == 0 == dedup.similar_pairs(spark.createDataFrame([], ARTICLES), most=None).count()
    undated = spark.createDataFrame([(1, "a", None, "x", None), (2, "b", None, "x", None)], BY_URL)
    assert [r.is_duplicate for r in dedup.deduplicate(undated, most=None).collect()] == [False, False]
    assert dedup.similar_pairs(undated, most=None).count() == 0


@pytest.mark.parametrize("letters, size, least", [("abcé ", 90, 0.8), ("ab", 300, 0.8), ("abcdefgh 😀", 20, 0.95), ("abc", 64, 0.5)])
def test_titles_that_are_alike(letters, size, least):
    rng = random.Random(size)
    pool = ["".join(rng.choices(letters, k=rng.randint(0, size))) for _ in range(12)] + [""]

    def title():
        t = list(rng.choice(pool))
        for _ in range(rng.randrange(4) if t else 0):
            t[rng.randrange(len(t))] = rng.choice(letters + "xyz")
        return "".join(t)

    a, b = [title() for _ in range(70)], [title() for _ in range(60)]
    got = {(i, j) for i, found in Alike(b, least).links(a) for j in found.tolist()}
    assert got == {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if SequenceMatcher(None, x, y).ratio() >= least}
    assert got <= {(i, j) for i, found in Alike(b, least).links(a, judged=False) for j in found.tolist()}


def test_places_follow_what_is_met():
    whole, most = Whole(1, 0.9, 0.9), Recent(1, 500, 0.9, 0.9)
    rng = random.Random(2)
    for i in range(400):
        at, title, vec = i * 20_000_000, "".join(rng.choices("abcdefgh", k=9)), [rng.random(), rng.random()] if i % 3 else None
        assert whole.arrive(i, at, title, vec) == most.arrive(i, at, title, vec)
        assert whole.entries(at) == most.entries(at)
    assert 8 < whole.most <= 256


def test_groups_that_the_window_has_left_go():
    """Titles of different letters never meet, so each letter is a group."""
    grouped, most, rng = Grouped(1, 0.9, 0.9), Recent(1, 500, 0.9, 0.9), random.Random(4)
    for i in range(3_000):
        letter = rng.randrange(100, 3_000)
        at, title, vec = i * 20_000_000, chr(letter) * 9 + "x" * rng.randrange(3), [rng.random(), rng.random()] if i % 3 else None
        assert grouped.arrive(i, at, title, vec, letter) == most.arrive(i, at, title, vec)
    assert len(grouped.titles) <= 360 and len(grouped.vectors[2].ids) < 400


def test_three_layers_go_beyond_the_newest_200(spark, monkeypatch):
    monkeypatch.setattr(content, "_arrivals", lambda spark, d: beyond(spark))
    assert {r.article_id: r.cluster_id for r in content.dedup_three_layers(spark, "").where("is_duplicate").collect()} == {301: 0}
