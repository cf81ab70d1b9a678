"""Operators with order-dependent rules against plain folds, and queries against their SQL."""

import os
import random
import re
from datetime import datetime, timedelta
from difflib import SequenceMatcher
from urllib.parse import urljoin

import duckdb
import pytest
from pyspark.sql import functions as F

from newsmill.functions import wordlists as L
from newsmill.operators import dedup, feed, ingest, notify, search
from newsmill.plans import registry
from newsmill.sources import feeds

DATA = "/root/testdata/sf0.001"
START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, sql, name):
    got = [r.asDict() for r in registry.QUERIES[name](spark, DATA).collect()]
    cur = sql.execute(registry.ORACLES[name])
    cols = [c[0] for c in cur.description]
    expected = [dict(zip(cols, r)) for r in cur.fetchall()]
    key = lambda r: repr(sorted(r.items()))
    assert sorted(map(key, got)) == sorted(map(key, expected))


def fold(articles, hours=48, title=0.8, cos=0.8):
    """The sequential rule, one article after another."""
    first, stored, out = {}, [], {}
    for a in sorted(articles, key=lambda a: (a["created_at"], a["article_id"])):
        if a["url"] in first:
            out[a["article_id"]] = (True, out[first[a["url"]]][1])
            continue
        first[a["url"]] = a["article_id"]
        near = [s for s in reversed(stored) if a["created_at"] - s["created_at"] <= timedelta(hours=hours)]
        hit = next((s for s in near if SequenceMatcher(None, a["title_original"], s["title_original"]).ratio() >= title), None)
        if hit is None:
            scored = [(sum(x * y for x, y in zip(a["embedding"], s["embedding"])), i, s) for i, s in enumerate(near) if a["embedding"] and s["embedding"]]
            scored = [x for x in scored if x[0] >= cos]
            hit = max(scored, key=lambda x: (x[0], -x[1]))[2] if scored else None
        if hit is None:
            stored.append(a)
        out[a["article_id"]] = (hit is not None, a["article_id"] if hit is None else hit["article_id"])
    return out


def test_three_layers_equal_the_fold(spark):
    rng = random.Random(4)
    titles = [" ".join(rng.choices("một hai ba bốn năm sáu bảy tám chín mười".split(), k=6)) for _ in range(12)]
    rows = []
    for i in range(160):
        t = rng.choice(titles)
        if rng.random() < 0.5:
            t = t[: rng.randrange(10, len(t))] + rng.choice(["", " x", " lại"])
        e = [rng.gauss(0, 1) for _ in range(3)]
        n = sum(x * x for x in e) ** 0.5
        rows.append({"article_id": i, "url": f"u{rng.randrange(140)}", "title_original": t, "created_at": START + timedelta(hours=rng.randrange(0, 200)), "embedding": [x / n for x in e]})
    df = spark.createDataFrame(rows, "article_id long, url string, title_original string, created_at timestamp_ntz, embedding array<double>")
    for parts in (1, 7):
        got = {r.article_id: (r.is_duplicate, r.cluster_id) for r in dedup.deduplicate(df.repartition(parts)).collect()}
        assert got == fold(rows)


def test_ingestion_loses_no_article(spark):
    rows = [(i, f"https://a.vn/{i % 25}", f"title {i} {i * i}", ("word number %d. " % i) * (i % 20), START + timedelta(hours=i), None) for i in range(60)]
    df = spark.createDataFrame(rows, "article_id long, url string, title_original string, text string, created_at timestamp_ntz, embedding array<double>")
    known = spark.createDataFrame([("https://a.vn/3",)], "url string")
    out = ingest.process(df, known)
    s = ingest.stats(out).first()
    assert s.new + s.duplicate + s.failed == 60 and s.duplicate >= 3
    short = {r.article_id for r in out.where("char_length(text) < 100 AND NOT known").collect()}
    assert all(r.status == "failed" for r in out.where(F.col("article_id").isin(*short)).collect())


def test_caps_refuse_in_order(spark):
    rows = [(1, i, k, START + timedelta(hours=h)) for i, (k, h) in enumerate([("a", 0), ("a", 1), ("a", 2), ("b", 3), ("b", 4), ("a", 23), ("a", 24), ("b", 25), ("b", 40)])]
    df = spark.createDataFrame(rows, "user_id long, article_id long, type string, created_at timestamp_ntz")
    got = [r.accepted for r in notify.within_caps(df, {"a": 2}, 3).orderBy("created_at").collect()]
    assert got == [True, True, False, True, False, False, True, True, True]


def test_interleaving(spark):
    items = spark.createDataFrame([(100 + i, i) for i in range(1, 13)], "item_id long, pos int")
    ads = spark.createDataFrame([(i, i) for i in range(1, 4)], "ad_id long, pos int")
    kinds = [r.kind for r in feed.interleave(items, ads).orderBy("position").collect()]
    assert [i for i, k in enumerate(kinds) if k == "ad"] == [5, 11] and len(kinds) == 14


def test_rss(spark):
    xml = """<rss><channel><item><title>A &amp; B</title><link>https://x.vn/1</link><pubDate>Tue, 16 Jan 2024 10:00:00 +0000</pubDate><media:thumbnail url="https://i/1.jpg"/></item>
    <item><title>none</title></item><entry><title>C</title><link href="https://x.vn/2"/><media:content url="https://i/2.png" medium="image"/></entry>"""
    df = spark.createDataFrame([("s", xml), ("t", "<rss><broken")], "source string, xml string")
    got = {r.url: r for r in feeds.rss_entries(df).collect()}
    assert set(got) == {"https://x.vn/1", "https://x.vn/2"}
    assert got["https://x.vn/1"].title == "A & B" and got["https://x.vn/1"].image_url == "https://i/1.jpg" and got["https://x.vn/2"].image_url == "https://i/2.png"


def test_listing_links(spark):
    page = '<a href="/b">B</a><a href="#x">no</a><a href="javascript:1">no</a><a href="c?d=1">C <b>c</b></a><a href="/b">again</a><a href="//y.vn/z">Z</a>'
    df = spark.createDataFrame([(1, "https://x.vn/a/b.html?q", page)], "page_id int, url string, html string")
    got = [(r.link, r.title) for r in feeds.listing_links(df).orderBy("position").collect()]
    assert got == [("https://x.vn/b", "B"), ("https://x.vn/a/c?d=1", "C c"), ("https://y.vn/z", "Z")]


def test_feed_links(spark):
    head = '<link rel="alternate" type="application/rss+xml" href="/feed.xml"><link rel="stylesheet" href="a.css">'
    df = spark.createDataFrame([(1, "https://x.vn/", head), (2, "https://www.y.vn/", "")], "page_id int, url string, html string")
    got = feeds.feed_links(df).collect()
    assert [r.feed for r in got if r.page_id == 1] == ["https://x.vn/feed.xml"]
    assert len([r for r in got if r.page_id == 2]) == 7 and all(r.feed.startswith("https://y.vn/") for r in got if r.page_id == 2)


def test_stream_caps_equal_batch(spark):
    q = registry.QUERIES
    stream = {(r.user_id, r.article_id, r.action, r.created_at): r.accepted for r in q["stream_notification_caps"](spark, DATA).collect()}
    batch = {(r.user_id, r.article_id, r.type, r.created_at.strftime("%Y-%m-%d %H:%M:%S.%f")): r.accepted for r in q["notification_caps"](spark, DATA).collect()}
    assert stream == batch


WITHOUT_SQL = {
    "clean_html", "dedup_three_layers", "dedup_title_pairs", "detected_languages", "discovery", "distinct_paragraphs", "extractive_summary", "ingestion", "ingestion_stats",
    "page_articles", "quality_scores", "stream_recent_duplicates", "summary_validate",
}


def test_which_queries_have_no_sql():
    assert set(registry.QUERIES) - set(registry.ORACLES) == WITHOUT_SQL


def rows_of(spark, name, d=DATA):
    return [r.asDict() for r in registry.QUERIES[name](spark, d).collect()]


def texts(sql):
    return dict(sql.execute("SELECT doc_id, text FROM documents").fetchall())


def test_three_layers_of_the_test_table_equal_the_fold(spark, sql):
    got = {r["article_id"]: (r["is_duplicate"], r["cluster_id"]) for r in rows_of(spark, "dedup_three_layers")}
    vectors = dict(sql.execute("SELECT vec_id, embedding::DOUBLE[] FROM embeddings").fetchall())
    rows = [
        {"article_id": i, "url": f"https://a.example/{i - (i % 40 == 1)}", "title_original": t.split("\n")[0][:80], "created_at": START + timedelta(hours=i % 720), "embedding": vectors.get(i)}
        for i, t in texts(sql).items()
    ]
    pairs = {(r["later"], r["earlier"]) for r in rows_of(spark, "dedup_title_pairs")}
    assert got == fold(rows, cos=0.4) and sum(d for d, _ in got.values()) > 10
    order = sorted((r for r in rows if r["article_id"] % 40 != 1), key=lambda r: (r["created_at"], r["article_id"]))
    near = [(a["article_id"], b["article_id"]) for k, a in enumerate(order) for b in order[max(0, k - 200) : k] if a["created_at"] - b["created_at"] <= timedelta(hours=48) and SequenceMatcher(None, a["title_original"], b["title_original"]).ratio() >= 0.8]
    assert set(near) <= pairs and all(a > 0 for a, _ in pairs)


def test_summaries_of_the_test_table(spark, sql):
    t = texts(sql)
    got = {r["doc_id"]: r for r in rows_of(spark, "extractive_summary")}
    valid = {r["doc_id"]: r for r in rows_of(spark, "summary_validate")}
    assert set(got) == set(valid) == set(t)
    for i, r in got.items():
        plain = [x.strip() for x in re.split(r"(?<=[.!?。])\s+", t[i]) if x.strip()]
        assert r["summary_bullets"] == [*plain[:3], "", "", ""][:3] and r["reason"] in L.FALLBACK_REASONS
        assert r["title_ai"] == (" ".join(plain[0].split()[:12]) if plain else t[i][:80])
        title = len(r["title_ai"].split())
        scores = [1.0 if 3 <= title <= 15 else 0.5 if title else 0.0, 1.0, sum(5 <= len(b.split()) <= 60 for b in r["summary_bullets"]) / 3, 1.0, 1.0]
        overall = sum(w * s for w, s in zip((0.15, 0.25, 0.15, 0.25, 0.2), scores))
        assert valid[i]["overall"] == pytest.approx(overall, abs=6e-4) and valid[i]["valid"] == (overall >= 0.6)


def test_quality_of_the_test_table(spark, sql):
    got = {r["doc_id"]: r for r in rows_of(spark, "quality_scores")}
    marked = set(L.vietnamese_letters())
    for i, t in texts(sql).items():
        letters = sum(c.isalpha() for c in t)
        urls, caps = len(re.findall(r"https?://\S+", t, re.I)), len(re.findall(r"\b[A-ZÀÁẠẢÃÂẦẤẬẨẪĂẰẮẶẲẴ]{5,}\b", t))
        spam = (min(1, urls / max(len(t.split()), 1) * 10) + min(1, caps / 5) + min(1, len(re.findall(r"(.{10,}?)\1{2,}", t)) / 3)) / 3 if t.strip() else 0
        parts = [max(0, min(1, (len(t) - 100) / 700)), min(1, sum(bool(p.strip()) for p in t.split("\n\n")) / 3), min(1, sum(c in marked for c in t) / letters) if letters else 0]
        overall = 0.3 * parts[0] + 0.25 * parts[1] + 0.25 * parts[2] + 0.2 * (1 - spam)
        assert (got[i]["spam_score"], got[i]["overall"]) == (pytest.approx(spam, abs=2e-6), pytest.approx(overall, abs=2e-6))


def test_ingestion_of_the_test_table(spark, sql):
    rows = {r["article_id"]: r for r in rows_of(spark, "ingestion")}
    t = texts(sql)
    assert set(rows) == set(t)
    for i, r in rows.items():
        if "stupid" in t[i].lower() or "worthless" in t[i].lower():
            assert r["status"] == "blocked"
        assert r["status"] in ("done", "duplicate", "failed", "blocked") and (r["cluster_id"] is None) == (r["status"] in ("failed", "blocked"))
    n = lambda *s: sum(r["status"] in s for r in rows.values())
    assert rows_of(spark, "ingestion_stats") == [{"new": n("done"), "duplicate": n("duplicate"), "failed": n("failed", "blocked")}]


def test_pages_of_the_test_table(spark, sql):
    pages = {i: (u, h) for i, u, h in sql.execute("SELECT page_id, url, html FROM pages").fetchall()}
    clean = {r["page_id"]: r["text"] for r in rows_of(spark, "clean_html")}
    assert set(clean) == set(pages)
    for i, (_, h) in pages.items():
        bare = set(re.findall(r"\w+", re.sub(r"(?s)<(script|style|nav|header|footer|aside)\b.*?</\1>|<[^>]*>", " ", h)))
        assert "<p" not in clean[i] and len(set(re.findall(r"\w+", clean[i])) - bare) <= 2
    links = rows_of(spark, "listing_links")
    for i, (u, h) in pages.items():
        hrefs = [x for x in re.findall(r"""<a\b[^>]*\bhref=["']([^"']+)["']""", h, re.I) if not x.strip().lower().startswith(("#", "javascript:"))]
        own = [r for r in links if r["page_id"] == i]
        assert len(own) == min(20, len({urljoin(u, x.strip()) for x in hrefs})) and [r["position"] for r in sorted(own, key=lambda r: r["position"])] == list(range(1, len(own) + 1))
    found = rows_of(spark, "feed_autodetect")
    assert {r["page_id"] for r in found} == set(pages) and all(len([x for x in found if x["page_id"] == i]) == 7 for i in pages if not any(x["in_page"] for x in found if x["page_id"] == i))
    assert all(0.4 <= r["quality"] <= 1 and not r["domain"].startswith("a") for r in rows_of(spark, "discovery"))


def test_fuzzy_search_of_the_test_table(spark, sql):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            out = [i]
            for j, y in enumerate(b, 1):
                out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
            row = out
        return row[-1]

    titles = {i: (t.split("\n")[0][:80], i % 720) for i, t in texts(sql).items()}
    hits = sorted(((-h, i) for i, (t, h) in titles.items() if any(distance(w, "ering") <= 1 for w in re.split(r"[^\w]+", t.lower()))))[:50]
    got = rows_of(spark, "search_fuzzy")
    assert sorted(r["article_id"] for r in got) == sorted(i for _, i in hits)
    assert all("<mark>" in r["highlighted"] and re.sub("</?mark>", "", r["highlighted"]) == titles[r["article_id"]][0] for r in got)


def test_paragraphs_of_the_test_table(spark, sql):
    got = {r["doc_id"]: r["clean"] for r in rows_of(spark, "distinct_paragraphs")}
    for i, t in texts(sql).items():
        lines = [p for p in (t.replace("\n", "\n\n") + "\n\nx\n\n" + t.split("\n")[0]).split("\n\n") if p.strip()]
        assert len(got[i].split("\n\n")) <= len({p.strip() for p in lines}) and got[i].split("\n\n")[0].strip() in {p.strip() for p in lines} | {""}
        assert len(set(map(str.strip, got[i].split("\n\n")))) == len(got[i].split("\n\n"))


def test_streams_without_sql(spark, sql):
    events = sql.execute("SELECT user_id, ts, event_type, event_id FROM events ORDER BY ts, event_id").fetchall()
    breaker = rows_of(spark, "stream_circuit_breaker")
    assert len(breaker) == len(events)
    state = {}
    expected = []
    for user, at, kind, _ in events:
        now, failures, opened = state.get(user % 5, ("closed", 0, None))
        if now == "open" and (at - opened).total_seconds() >= 3600:
            now = "half_open"
        if now != "open":
            if kind in ("view", "click", "purchase", "signup"):
                now, failures = "closed", 0
            else:
                failures += 1
                if now == "half_open" or failures >= 2:
                    now, opened = "open", at
        state[user % 5] = now, failures, opened
        expected.append((user % 5, at.strftime("%Y-%m-%d %H:%M:%S.%f"), now))
    assert sorted((r["source_id"], r["at"], r["state"]) for r in breaker) == sorted(expected)
    kept = rows_of(spark, "stream_without_repeats")
    assert len({(r["user_id"], r["article_id"], r["action"]) for r in kept}) == len(kept) > 0


def test_nearest_in_blocks(spark):
    e = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(40)], "article_id long, embedding array<double>")
    q = e.where("article_id % 4 = 0").select(F.col("article_id").alias("query_id"), F.col("embedding").alias("q"))
    got = {tuple(r) for r in search.nearest(e, q, 3, block=4).collect()}
    assert got == {tuple(r) for r in search.nearest(e, q, 3).collect()} and len(got) == 30
    want = set()
    for i in range(0, 40, 4):
        best = sorted((-float((i % 7) * (j % 7) + (i % 5) * (j % 5) + 1), j) for j in range(40))[:3]
        want |= {(i, j, -s, n + 1) for n, (s, j) in enumerate(best)}
    assert got == want


def test_odd_vectors_have_no_neighbours(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [1.0, 0.0, 0.0]), (None, [1.0, 0.0])]
    e = spark.createDataFrame(rows, "article_id long, embedding array<double>").withColumn("topic", F.lit("t")).withColumn("created_at", F.lit(1))
    q = e.select(F.col("article_id").alias("query_id"), F.col("embedding").alias("q"))
    assert {tuple(r)[:3] for r in search.nearest(e, q, 5).collect()} == {(1, 1, 1.0), (1, 2, 1.0), (2, 1, 1.0), (2, 2, 1.0), (6, 6, 1.0)}
    assert {tuple(r)[:2] for r in search.related(e, "topic").collect()} == {(1, 2), (2, 1)}


def test_encoder_hook(spark):
    a = spark.createDataFrame([(1, "t", "text")], "article_id long, title string, text string").withColumn("embedding_input", feed.embedding_input(F.col("title"), F.col("text")))
    e = feed.with_embeddings(a, lambda c: F.array(F.char_length(c).cast("double"), F.lit(0.0), F.lit(6.0))).first()
    assert e.embedding_input == "t\ntext" and e.embedding == pytest.approx([0.5**0.5, 0.0, 0.5**0.5])


def test_a_feed_makes_no_row_a_user_and_candidate(spark):
    """What a user viewed moves down among its own rows; only rows that are asked for are made."""
    at = datetime(2024, 1, 30)
    top = spark.createDataFrame([(i, "ai" if i % 3 else "sport", at - timedelta(hours=i % 7), (i % 5) / 10) for i in range(60)], "article_id long, topic string, created_at timestamp_ntz, feed_score double")
    users = spark.createDataFrame([(1, ["sport"]), (2, ["sport", "ai"]), (3, None), (4, [])], "user_id long, interests array<string>")
    viewed = spark.createDataFrame([(1, i) for i in range(0, 60, 2)] * 2 + [(4, 59), (4, 999), (9, 1), (2, None)], "user_id long, article_id long")
    every = feed.ranked_feed(top, users, viewed, "2024-01-31 00:00:00", 50).collect()
    first = feed.ranked_feed(top, users, viewed, "2024-01-31 00:00:00", 50, keep=7)
    assert sorted(first.collect()) == sorted(r for r in every if r["rank"] <= 7) and len(every) == 200
    listed = sorted(top.collect(), key=lambda r: (-r.feed_score, -r.created_at.timestamp(), r.article_id))[:50]
    for user, likes in ((1, ["sport"]), (2, ["sport", "ai"]), (3, []), (4, [])):
        old = {i for u, i in [(v.user_id, v.article_id) for v in viewed.collect()] if u == user}
        score = lambda r: (r.feed_score or max(0.0, 1 - (datetime(2024, 1, 31) - r.created_at).total_seconds() / 3600 / 48)) + 2.0 * (r.topic in likes) - 5.0 * (r.article_id in old)
        want = [r.article_id for r in sorted(listed, key=lambda r: (-score(r), -r.created_at.timestamp(), r.article_id))]
        assert [r.article_id for r in sorted((r for r in every if r.user_id == user), key=lambda r: r["rank"])] == want
    plan = first._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "seen#" in plan
