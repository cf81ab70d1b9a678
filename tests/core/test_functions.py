"""Column functions against plain restatements of their rules."""

import random
import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newsmill.functions import html, text as X, urls as U, wordlists as L
from newsmill.functions.keywords import count_groups, group_counts

TEXT = st.text(st.characters(codec="utf-8", exclude_characters="\x00"), max_size=400)
VN = st.text(st.sampled_from("aăâeêioôơuưyđáàảãạ ĐẾ.!?\n xyz ai"), min_size=1, max_size=300)


def column(spark, values, expr, name="v"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(values)], f"i int, {name} string")
    return [r.o for r in df.select("i", expr(F.col(name)).alias("o")).orderBy("i").collect()]


def test_vietnamese_letters_from_the_rule():
    letters = L.vietnamese_letters()
    assert len(letters) == 134 and len(set(letters)) == 134
    assert set("àảãáạăằẳẵắặâầẩẫấậđèẻẽéẹêềểễếệìỉĩíịòỏõóọôồổỗốộơờởỡớợùủũúụưừửữứựỳỷỹýỵ") == {c for c in letters if c.islower()}
    assert all(unicodedata.is_normalized("NFC", c) for c in letters)


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(TEXT, VN), min_size=40, max_size=60))
def test_quality_signals_lie_between_zero_and_one(spark, texts):
    def signals(t):
        parts = (X.length_score(t), X.structure_score(t), X.vietnamese_ratio(t), X.spam_score(t))
        return F.array(*parts, X.overall_quality(*parts))

    for t, s in zip(texts, column(spark, texts, signals)):
        assert all(0 <= x <= 1 for x in s)
        n = len(t)
        assert s[0] == pytest.approx(0.0 if n < 100 else min(1.0, (n - 100) / 700))
        assert s[4] == pytest.approx(0.3 * s[0] + 0.25 * s[1] + 0.25 * s[2] + 0.2 * (1 - s[3]))


def test_spam_signals(spark):
    got = column(spark, ["", "word " * 10, "SALES ABCDE WORLD! " * 9, "see http://a.b https://c.d", "HELLO"], lambda t: X.spam_score(t))
    assert got[0] == 0.0 and got[4] == pytest.approx(0.2 / 3)
    assert got[2] >= 1 / 3 and got[3] >= 1 / 3


def plain_topic(title, text, topics):
    def hits(t, k):
        return len(re.findall(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(k, key=len, reverse=True))) + r")(?!\w)", t, re.I))

    scores = {t: 2 * hits(title, k) + hits(text, k) for t, k in topics.items()}
    best = max(scores, key=lambda t: scores[t])
    return best if scores[best] else "lifestyle"


def test_topics(spark):
    rows = [
        ("AI", "x"), ("", "éai ai-ai"), ("bóng đá", "nhạc phim"), ("", "không có gì"), ("Dividend", "gdp GDP data"), ("", "Language Model và dữ liệu data"),
        ("", "box office BOX OFFICE"), ("SỨC KHỎE", ""), ("game", "game game"), ("", "fanfare fan."),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, title string, body string")
    s = X.topic_scores(F.col("title"), F.col("body"), L.TOPIC_KEYWORDS)
    got = [r.t for r in df.select("i", X.best_topic(s, list(L.TOPIC_KEYWORDS)).alias("t")).orderBy("i").collect()]
    assert got == [plain_topic(a, b, L.TOPIC_KEYWORDS) for a, b in rows]


def test_a_dictionary_of_thousands_equals_the_patterns(spark):
    rng = random.Random(8)
    part = lambda: "".join(rng.choices("abcđeéAK ", k=rng.randint(1, 5))).strip() or "a"
    topics = {f"t{i}": list({part() for _ in range(400)} | {part() + " " + part() for _ in range(200)}) for i in range(6)}
    texts = ["".join(rng.choices("abcđeéĐÉAKk _-1.", k=rng.randint(0, 400))) for _ in range(40)] + ["", "Đé", "a" * 5000, "K\u212a \u0130 i ſ s"]
    groups = tuple(tuple(k) for k in topics.values())
    patterns = [re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(k, key=len, reverse=True))) + r")(?!\w)", re.I) for k in topics.values()]
    for t in texts[:-1]:
        assert count_groups(t, groups) == [len(p.findall(t)) for p in patterns]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", group_counts(F.col("t"), list(topics.values())).alias("c")).collect()}
    assert got[0] == count_groups(texts[0], groups) and got[99] is None
    many = sorted({k for g in groups for k in g})
    some = {r.i: r.c for r in df.select("i", X.containing(F.col("t"), many).alias("c")).collect()}
    assert {k.lower() for k in some[3]} == {k.lower() for k in many if k.lower() in texts[3].lower()} and some[99] is None


def test_topics_of_a_table(spark):
    rows = [("sport", "b"), ("own", "x"), ("ai", "a"), ("sport", "a"), ("sport", "a")]
    assert L.topics_from(spark.createDataFrame(rows, "topic string, keyword string")) == {"ai": ["a"], "sport": ["a", "b"], "own": ["x"]}
    assert list(L.topics_from(spark.createDataFrame(rows, "topic string, keyword string"))) == ["ai", "sport", "own"]


def test_hybrid_topic_uses_the_model_only_at_few_hits(spark):
    names = ["a", "b"]
    df = spark.createDataFrame([(0, {"a": 3.0, "b": 0.0}, {"a": 0.0, "b": 1.0}), (1, {"a": 2.0, "b": 0.0}, {"a": 0.0, "b": 1.0}), (2, {"a": 1.0, "b": 0.0}, None)], "i int, k map<string,double>, z map<string,double>")
    got = [r.t for r in df.select("i", X.hybrid_topic(F.col("k"), F.col("z"), names).alias("t")).orderBy("i").collect()]
    assert got == ["a", "b", "a"]


def test_sentiment_counts_words_of_the_lists_once_each(spark):
    texts = ["success growth record", "crash crisis", "scandal", "success crash", "", "war war war"]
    assert column(spark, texts, lambda t: X.sentiment(t)) == ["positive", "negative", "negative", "neutral", "neutral", "neutral"]


def test_moderation_order(spark):
    df = spark.createDataFrame([(0, "https://bad.example/x", "t", "casino"), (1, "https://ok.example", "Essex", "sponsored"), (2, "https://ok.example", "a", "sponsored"), (3, "https://ok.example", "a", "b")], "i int, u string, t string, b string")
    m = X.moderation(F.col("u"), F.col("t"), F.col("b"), block_domains=["bad"])
    got = [tuple(r.m) for r in df.select("i", m.alias("m")).orderBy("i").collect()]
    assert got == [("blocked", ["source:blocked_domain:bad"]), ("blocked", ["keyword:sex", "flag:sponsored"]), ("flagged", ["flag:sponsored"]), ("passed", [])]


def test_source_lists(spark):
    got = column(spark, ["https://www.a.vn/x", "https://b.com", "https://c.a.vn:80/"], lambda u: U.source_check(u, ["b."], ["a.vn"])["reason"])
    assert got == ["whitelisted", "blocked_domain:b.", "whitelisted"]
    assert column(spark, ["https://x.org"], lambda u: U.source_check(u, [], ["a.vn"])["reason"]) == ["not_in_whitelist"]


def test_domains(spark):
    urls = ["https://www.News-Site.com.vn:8080/a?b", "http://u@x.vn", "no url", "https://m.facebook.com/p"]
    assert column(spark, urls, U.domain) == ["news-site.com.vn:8080", "u@x.vn", "", "m.facebook.com"]
    assert column(spark, urls, lambda u: U.is_skipped(U.domain(u))) == [False, False, False, True]
    assert column(spark, ["x.com.vn", "vn.com", "x.vn.org"], U.is_vietnamese) == [True, False, False]
    assert column(spark, ["the-daily-news.vn"], U.source_name) == ["The Daily News"]


def test_dates(spark):
    values = ["2024-01-16T10:00:00", "2024-01-16T10:00:00Z", "2024-01-16T10:00:00+07:00", "2024-01-16 10:00:00", "2024-01-16", "16/01/2024 10:00", "16/01/2024", "Tue, 16 Jan 2024 10:00:00 +0700", "Tue, 16 Jan 2024 10:00:00 GMT", "soon", None]
    got = column(spark, values, lambda t: F.date_format(X.parsed_date(t), "dd HH:mm"))
    assert got == ["16 10:00", "16 10:00", "16 03:00", "16 10:00", "16 00:00", "16 10:00", "16 00:00", "16 03:00", "16 10:00", None, None]


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(VN, min_size=30, max_size=50))
def test_summaries(spark, texts):
    for t, s in zip(texts, column(spark, texts, lambda t: X.extractive_summary(t))):
        assert len(s.summary_bullets) == 3 and s.reason
        assert len(s.title_ai.split()) <= 12 or s.title_ai == t[:80]
        plain = [x.strip() for x in re.split(r"(?<=[.!?。])\s+", t) if x.strip()]
        assert [b for b in s.summary_bullets if b] == plain[:3]


def test_reply_and_validation(spark):
    good = "title: A b c\nTITLE: One two three four\n- a b c d e\n- f g h i j\n- k l m n o\nREASON: because it matters to you"
    got = column(spark, [good, "TITLE: x\n- a\nREASON: y", "nothing"], X.parsed_reply)
    assert got[0].title_ai == "One two three four" and got[0].summary_bullets == ["a b c d e", "f g h i j", "k l m n o"]
    assert got[1:] == [None, None]
    df = spark.createDataFrame([("One two three", ["a b c d e"] * 3, "because it matters to you", ""), ("", [], L.GENERIC_REASONS[0], "x"), ("see http://x.y now", ["a b c d e"] * 3, "because it matters to you", "text")], "t string, b array<string>, r string, o string")
    v = [r.v for r in df.select(X.summary_scores(F.col("t"), F.col("b"), F.col("r"), F.col("o")).alias("v")).collect()]
    assert v[0].overall == pytest.approx(0.96) and v[0].valid
    assert v[1].overall == pytest.approx(0.2) and not v[1].valid
    assert v[2].no_invented_urls == 0.0 and v[2].overall == pytest.approx(0.8)


def test_paragraphs_and_artifacts(spark):
    t = " Một. \n\nHai\n\nMột.\n\n\n\nXem thêm: gì đó\nBa © 2024\nNguồn: báo"
    assert column(spark, [t], X.without_artifacts) == ["Một. \n\nHai\n\n\nBa"]
    assert column(spark, ["p\n\n" * 5], X.distinct_paragraphs) == ["p"]


def test_html(spark):
    page = "<html><head><style>a{}</style></head><body><nav>menu</nav><div class='Main'>Xin <b>chào</b> &amp; bạn<br>dòng</div><div class='ad-banner'>x<p>y</div><p id='sharebox'>z</p><script>1</script>tail</body>"
    got = column(spark, [page, None, ""], html.clean_html)
    assert got[0].split("\n") == ["Xin ", "chào", " & bạn", "dòng", "tail"] and got[1:] == ["", ""]
    nfd = unicodedata.normalize("NFD", "tiếng Việt")
    assert column(spark, [nfd], html.nfc) == ["tiếng Việt"]


def test_title_ratio(spark):
    from difflib import SequenceMatcher

    pairs = [("a b c d", "a b c e"), ("same", "same"), ("", ""), ("abc", "xyz"), ("tin nóng hôm nay", "tin hôm nay nóng")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = [r.o for r in df.select("i", html.title_ratio(F.col("a"), F.col("b")).alias("o")).orderBy("i").collect()]
    for g, (a, b) in zip(got, pairs):
        exact = SequenceMatcher(None, a, b).ratio()
        assert g == pytest.approx(exact) if exact >= 0.5 else g < 0.8
