"""The search index against scoring everything in Python, and what its searches read."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from newsmill.functions.stems import weak_stem, word_list
from newsmill.operators import fulltext

WORD = re.compile(r"\w+")
FIELDS = {"title": 3.0, "body": 1.0}
SCHEMA = "article_id long, title string, body string, topic string, created_at long"


def stem(w):
    if len(w) < 4 or not w.endswith("s"):
        return w
    for end, but, new in (("ies", "ea", "y"), ("es", "aeo", "e"), ("s", "us", "")):
        if w.endswith(end):
            return w if w[-len(end) - 1] in but else w[: -len(end)] + new
    return w


def words(text):
    return WORD.findall((text or "").lower())


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def made(seed, n):
    rng = random.Random(seed)
    base = ["story", "stories", "match", "matches", "glass", "bus", "über", "ünder", "politics", "government", "governments", "x", "election", "elections", "electoins", "the", "économie", "a_b"]
    pick = lambda k: " ".join(rng.choices(base[: rng.randint(3, len(base))], k=rng.randint(0, k)))
    rows = [(i * 37, pick(6), pick(30), rng.choice(["ai", "sport"]), rng.randint(0, 5)) for i in range(n)]
    return rows + [(-5, None, None, "ai", 1), (10**12, "story", "", "ai", 2), (0, "extra stories", "glass", "ai", 9), (10**12 + 1, "Story, STORY!", "the Stories", "sport", 2)]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = made(1, 700)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    return rows, fulltext.build(df, f"{tmp_path_factory.mktemp('index')}/i", FIELDS, ("title", "topic", "created_at"), block_ids=1000)


def bm25(rows, queries, k, keep=lambda r: True):
    tf, length = defaultdict(Counter), Counter()
    for i, title, body, *_ in rows:
        length[i] += 0
        for text, g in ((title, 3.0), (body, 1.0)):
            for w in words(text):
                tf[stem(w)][i] += g
                length[i] += g
    n, mean = len(length), sum(length.values()) / len(length)
    kept = {r[0] for r in rows if keep(r)}
    out = set()
    for q, text in queries:
        scores = Counter()
        for t in {stem(w) for w in words(text)}:
            idf = math.log(1 + (n - len(tf[t]) + 0.5) / (len(tf[t]) + 0.5))
            for i, x in tf[t].items():
                scores[i] += idf * x * 2.2 / (x + 1.2 * (0.25 + 0.75 * length[i] / mean))
        best = sorted(((-math.floor(s * 1e6 + 0.5) / 1e6, i) for i, s in scores.items() if i in kept))[:k]
        out |= {(q, i, -s, r + 1) for r, (s, i) in enumerate(best)}
    return out


QUERIES = [(1, "story"), (2, "Stories politics"), (3, "über glass election"), (4, "nothing here"), (5, ""), (6, None), (7, "the x a_b the matches bus"), (8, "zebra story")]


@pytest.mark.parametrize("k", [1, 5, 10_000])
def test_ranked_search_equals_scoring_everything(spark, index, k):
    rows, ix = index
    found = ix.ranked(spark.createDataFrame(QUERIES, "query_id long, query string"), k).collect()
    assert {(r.query_id, r.article_id, r.score, r["rank"]) for r in found} == bm25(rows, QUERIES, k)


def test_ranked_search_with_a_condition(spark, index):
    rows, ix = index
    one = [r for r in rows if r[0] != 0]  # the id 0 has two rows of two topics
    found = ix.ranked(spark.createDataFrame(QUERIES, "query_id long, query string"), 7, F.col("topic") == "sport").where("article_id <> 0").collect()
    want = {x[:3] for x in bm25(rows, QUERIES, 8, lambda r: r[3] == "sport" or r[0] == 0) if x[1]}
    assert {(r.query_id, r.article_id, r.score) for r in found} <= want and len(found) >= 6 * 5 and one


def test_more_terms_than_are_named(spark, index, monkeypatch):
    rows, ix = index
    monkeypatch.setattr(fulltext, "NAMED_KEYS", 2)
    monkeypatch.setattr(fulltext, "SEEDS", 1)
    found = ix.ranked(spark.createDataFrame(QUERIES, "query_id long, query string"), 3).collect()
    assert {(r.query_id, r.article_id, r.score, r["rank"]) for r in found} == bm25(rows, QUERIES, 3)


def test_a_search_reads_the_asked_terms_and_few_blocks(spark, index):
    _, ix = index
    asked = spark.createDataFrame([("story",)], "term string")
    plan = ix._asked("stems", "term", asked).select("term", "block", "best")._jdf.queryExecution().executedPlan().toString()
    assert "term,story" in plan.replace(" ", "") and "shares" not in plan.split("ReadSchema")[1]


def typos(rows, queries, k):
    held = defaultdict(lambda: defaultdict(set))
    info = {}
    for i, title, body, topic, created in rows:
        info[i] = created if i not in info else info[i]
        for f, text in enumerate((title, body)):
            for w in words(text):
                held[w][i].add(f)
    out = set()
    for q, text in queries:
        terms = set(words(text))
        best = defaultdict(dict)
        for t in terms:
            most = 2 if len(t) >= 9 else 1 if len(t) >= 5 else 0
            for w, docs in held.items():
                if (d := distance(t, w)) <= most:
                    for i, fields in docs.items():
                        best[i][t] = min(best[i].get(t, (9, 9)), (d, min(fields)))
        full = [(sum(d for d, _ in m.values()), min(f for _, f in m.values()), -info[i], i) for i, m in best.items() if len(m) == len(terms)]
        out |= {(q, i, d, f, r + 1) for r, (d, f, _, i) in enumerate(sorted(full)[:k])}
    return out


def test_search_with_typos_equals_edit_distances(spark, index):
    rows, ix = index
    asked = [(1, "electoin"), (2, "goverment story"), (3, "governmentss"), (4, "stories"), (5, "glas"), (6, "éconmie"), (7, "unknownword"), (8, ""), (9, "politic x the"), (10, "lections")]
    found = ix.with_typos(spark.createDataFrame(asked, "query_id long, query string"), 15).where("article_id <> 0").collect()
    want = typos([r for r in rows if r[0] != 0 or r[1] != "extra stories"], asked, 16)
    assert {(r.query_id, r.article_id, r.typos, r.field) for r in found} <= {x[:4] for x in want} and len(found) > 100
    every = ix.with_typos(spark.createDataFrame(asked, "query_id long, query string"), 10**6).where("article_id <> 0").collect()
    assert {(r.query_id, r.article_id, r.typos) for r in every} == {x[:3] for x in typos(rows, asked, 10**6) if x[1]}


def test_marks(spark, index):
    _, ix = index
    found = ix.with_typos(spark.createDataFrame([(1, "storyy")], "query_id long, query string"), 5000, show=("title",)).where(F.col("article_id") == 10**12 + 1).first()
    assert found.title == "<mark>Story</mark>, <mark>STORY</mark>!"


def test_removal_keys_meet_within_the_typos():
    rng = random.Random(3)
    for _ in range(4000):
        most = rng.choice([1, 2])
        a = "".join(rng.choices("abc", k=rng.randint(9 if most == 2 else 5, 16)))
        b = list(a)
        for _ in range(most):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b", "x"])
        b = "".join(b)
        if distance(a, b) <= most:
            own = 2 if len(b) >= 7 else 1 if len(b) >= 4 else 0
            assert fulltext.removals(a, most) & fulltext.removals(b, own), (a, b)
    assert len(fulltext.removals("abcdefghijklmnopqrstuvwxyz" * 100, 2)) == 29


def test_stems_and_words(spark):
    asked = ["stories", "zombies", "pies", "ties", "matches", "shoes", "trees", "glass", "bus", "cats", "is", "as", "caries", "aies", "xeies", "foos", "gäs", "gäss"]
    got = spark.createDataFrame([(w,) for w in asked], "w string").select(weak_stem(F.col("w"))).collect()
    assert [r[0] for r in got] == [stem(w) for w in asked]
    assert spark.createDataFrame([("Ä_b c-d\n1é x́",), (None,)], "t string").select(word_list(F.col("t"))).collect()[0][0] == ["ä_b", "c", "d", "1é", "x́"]


def test_an_empty_table(spark, tmp_path):
    ix = fulltext.build(spark.createDataFrame([], SCHEMA), f"{tmp_path}/i", FIELDS, ("created_at",))
    q = spark.createDataFrame(QUERIES, "query_id long, query string")
    assert ix.ranked(q).count() == 0 and ix.with_typos(q).count() == 0


def test_a_search_makes_no_row_a_query_and_article(spark, index):
    """Searches that ask with a share of all articles would else grow with the square of the table."""
    _, ix = index
    asked = spark.createDataFrame([(i, "story governments the") for i in range(40)], "query_id long, query string")
    for found in (ix.ranked(asked, 3), ix.with_typos(asked, 3)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in plan and "explode" not in plan
        assert found.count() == 120


def test_an_index_for_one_search(spark, tmp_path):
    rows = spark.createDataFrame(made(2, 60), SCHEMA)
    asked = spark.createDataFrame(QUERIES, "query_id long, query string")
    both, one, other = (fulltext.build(rows, f"{tmp_path}/{name}", FIELDS, ("created_at",), 100, searches=s) for name, s in (("both", ("ranked", "typos")), ("one", ("ranked",)), ("other", ("typos",))))
    assert both.ranked(asked).sort("query_id", "rank").collect() == one.ranked(asked).sort("query_id", "rank").collect() != []
    assert both.with_typos(asked).sort("query_id", "rank").collect() == other.with_typos(asked).sort("query_id", "rank").collect() != []
    assert not (tmp_path / "one/words").exists() and not (tmp_path / "other/stems").exists()
