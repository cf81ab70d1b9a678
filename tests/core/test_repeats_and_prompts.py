"""Repeated phrases, paragraphs, prompts and replies against plain restatements."""

import random
import re

import pytest
from pyspark.sql import functions as F

from newsmill.functions import text as X, urls as U
from newsmill.functions.repeats import repeated_in_line
from newsmill.operators import notify

PATTERN = re.compile(r"(.{10,}?)\1{2,}")


def test_repeated_phrases_equal_the_pattern():
    rng = random.Random(3)
    for _ in range(3000):
        unit = "".join(rng.choices("ab ", k=rng.randint(1, 16)))
        line = "".join(rng.choices("ab c", k=rng.randint(0, 20))) + unit * rng.randint(1, 5) + "".join(rng.choices("abc ", k=rng.randint(0, 15))) + unit * rng.randint(0, 4)
        assert repeated_in_line(line) == len(PATTERN.findall(line)), line
    assert repeated_in_line("ab" * 50_000) == 1
    assert repeated_in_line(" ".join(str(i) for i in range(30_000))) == 0


def test_spam_score_counts_repeats_by_line(spark):
    df = spark.createDataFrame([("buy this now " * 4 + "\n" + "limited offer " * 5,), ("buy this now \n" * 4,), (None,)], "t string")
    got = [r.s for r in df.select(X.spam_score(F.col("t")).alias("s")).collect()]
    assert got[0] == pytest.approx(2 / 9) and got[1] == 0.0


def test_distinct_paragraphs_equal_a_plain_loop(spark):
    rng = random.Random(5)
    texts = ["\n\n".join(rng.choice(["a", " a ", "b\nb", "", " ", "c", "\td", "d "]) for _ in range(rng.randint(0, 12))) for _ in range(80)]

    def plain(t):
        seen, out = set(), []
        for p in t.split("\n\n"):
            if p.strip() and p.strip() not in seen:
                seen.add(p.strip())
                out.append(p)
        return "\n\n".join(out)

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.o for r in df.select("i", X.distinct_paragraphs(F.col("t")).alias("o")).orderBy("i").collect()]
    assert got == [plain(t) for t in texts]


def test_prompts_and_batches(spark):
    df = spark.createDataFrame([("body {text}", "ai"), ("other", "sport"), ("x", None)], "t string, topic string")
    got = [r.p for r in df.select(X.prompt(F.col("t"), F.col("topic"), {"ai": "AI: {text}!"}, "Any: {text}").alias("p")).collect()]
    assert got == ["AI: body {text}!", "Any: other", "Any: x"]
    one = spark.createDataFrame([(["first", "second"],)], "ts array<string>").select(X.batch_prompt(F.col("ts"), "{count} articles:{articles}").alias("p")).first().p
    assert one == "2 articles:\n[ARTICLE 1]\nfirst\n\n[ARTICLE 2]\nsecond\n"
    raw = "preamble [ARTICLE 2]\nTITLE: b\n[ARTICLE  1] one [ARTICLE 7] far [ARTICLE x] not a mark"
    parts = spark.createDataFrame([(raw, 3), ("nothing", 2)], "raw string, n int").select(X.batch_replies(F.col("raw"), F.col("n")).alias("p")).collect()
    assert parts[0].p == [" one ", "\nTITLE: b\n", None] and parts[1].p == [None, None]


def test_small_scalars(spark):
    df = spark.createDataFrame([("10.0.0.1", [3, 1], " <b>x</b> <script>y", None, "http://i/x.png")], "ip string, ids array<long>, r string, a string, img string")
    r = df.select(U.ip_hash(F.col("ip")).alias("h"), U.etag(F.col("ids")).alias("e"), X.report_text(F.col("r")).alias("t"), X.first_content(F.col("a"), F.lit(" "), F.lit("c")).alias("c"), U.is_image_url(F.col("img")).alias("i"), U.is_image_url(F.col("a")).alias("n")).first()
    import hashlib

    assert r.h == hashlib.sha256(b"10.0.0.1").hexdigest()[:16] and r.e == hashlib.md5(b"[3,1]").hexdigest()
    assert (r.t, r.c, r.i, r.n) == ("x y", "c", True, False)


def test_language_asks_the_detector_last(spark):
    df = spark.createDataFrame([("short",), ("plain words of no marks at all here",), ("tiếng Việt có rất nhiều dấu thanh điệu",)], "t string")
    got = [r.l for r in df.select(X.language(F.col("t"), detector=lambda c: F.when(F.contains(c, F.lit("plain")), "en")).alias("l")).collect()]
    assert got == ["vi", "en", "vi"]


def test_caps_keep_large_and_null_ids(spark):
    from datetime import datetime

    big = 1152921504606846977
    rows = [(1, big, "a", datetime(2024, 1, 1)), (1, None, "a", datetime(2024, 1, 1, 1)), (None, 5, "b", datetime(2024, 1, 1)), (None, big + 2, "b", datetime(2024, 1, 1, 2))]
    df = spark.createDataFrame(rows, "user_id long, article_id long, type string, created_at timestamp_ntz")
    got = {(r.user_id, r.article_id, r.accepted) for r in notify.within_caps(df, {"a": 1}, 3).collect()}
    assert got == {(1, big, True), (1, None, False), (None, 5, True), (None, big + 2, True)}
