"""The gates of ingestion: what costs is computed once, and shortcuts change no result."""

import random
from functools import reduce

from pyspark.sql import functions as F

from newsmill.functions import repeats
from newsmill.functions import text as X
from newsmill.functions import wordlists as L


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_text_is_lower_case_once_whatever_the_number_of_words(spark):
    texts = spark.createDataFrame([("Good ÉCLAT bad",), ("",), (None,)], "t string").repartition(1)
    found = texts.select(X.containing(F.col("t"), ["good", "Éclat", "x"]).alias("a"), X.containing(F.col("t"), []).alias("none"))
    assert "Contains(lower(" not in plan_of(found)
    assert [r.a for r in found.collect()] == [["good", "Éclat"], [], []] and {tuple(r.none) for r in found.collect()} == {()}
    # The two long lists are looked for in a scan of both, no keyword in a scan of its own.
    assert "Contains(" not in plan_of(texts.select(X.sentiment(F.col("t"))))


def test_sentiment_of_long_and_of_short_lists(spark):
    rng = random.Random(4)
    rows = ["".join(w + " " for w in rng.choices([*L.POSITIVE, *map(str.upper, L.NEGATIVE), "x", "y"], k=rng.randint(0, 9))) for _ in range(300)]
    found = spark.createDataFrame([(t,) for t in rows] + [(None,)], "t string").select("t", X.sentiment(F.col("t")).alias("s"), X.sentiment(F.col("t"), L.POSITIVE[:5], L.NEGATIVE[:5]).alias("few")).collect()
    for r in found:
        for got, n in ((r.s, None), (r.few, 5)):
            good, bad = (sum(k.lower() in (r.t or "").lower() for k in words[:n]) for words in (L.POSITIVE, L.NEGATIVE))
            assert got == ("positive" if good > bad + 1 else "negative" if bad > good + 1 else "neutral")
    assert {r.s for r in found} == {"positive", "negative", "neutral"}


def test_signs_of_artifacts_lose_no_match(spark):
    """Patterns after patterns, in odd cases and with letters that equal others only without case."""
    rng = random.Random(5)
    pieces = [*"Đọc thêm|Xem Thêm|TIN LIÊN QUAN|bài liên quan|:| |\n|\n\n|\r\n| |nguồn|NGUỒN|Theo|THEO|©|chia sẻ|CHIA SẺ|facebooK|Twitter|qua|bài viết|ſhare thiſ|SHARE THİS".split("|"),
              *"ſponſored|SPONSORED|advertısement|Advert|isement|tài trợ|QUẢNG CÁO|comment|Com|ment|BÌNH LUẬN|gửi bình luận|abc".split("|")]
    texts = spark.createDataFrame([("".join(rng.choices(pieces, k=rng.randint(1, 10))),) for _ in range(3000)], "t string")
    plain = X.strip(X.distinct_paragraphs(reduce(lambda c, p: F.regexp_replace(c, p, ""), L.ARTIFACTS, F.col("t"))))
    found = texts.select(plain.alias("a"), X.without_artifacts(F.col("t")).alias("b"), "t").collect()
    assert [r.a for r in found] == [r.b for r in found] and sum(r.a != r.t for r in found) > 1000


def test_trimming_takes_what_the_pattern_takes(spark):
    points = spark.range(1, 0x3100).select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("x")).select(F.concat("x", F.lit("a b"), "x").alias("s"))
    old = F.regexp_replace("s", r"(?U)^\s+|\s+$", "")
    assert points.where(old != X.strip(F.col("s"))).count() == 0 and points.where(X.strip(F.col("s")) == "a b").count() > 20
    assert "regexp" not in plan_of(points.select(X.strip(F.col("s"))))


def test_lines_that_are_passed_over_have_no_repeated_phrase(monkeypatch):
    rng = random.Random(6)
    lines = []
    for _ in range(4000):
        phrase = "".join(rng.choices("ab c", k=rng.randint(10, 45)))
        line = "".join(rng.choices("abcdefgh ", k=rng.randint(0, 60))) + phrase * rng.randint(1, 4) + phrase[: rng.randint(0, 9)] + "".join(rng.choices("abcdefgh ", k=rng.randint(0, 60)))
        lines.append(line)
    got = [repeats.repeated_in_line(x) for x in lines]
    monkeypatch.setattr(repeats, "_may_repeat", lambda line: True)
    assert got == [repeats.repeated_in_line(x) for x in lines] and 500 < sum(map(bool, got)) < 3500
    monkeypatch.undo()
    # A line of plain words isn't sorted at all.
    monkeypatch.setattr(repeats, "_periods", None)
    assert repeats.repeated_in_line(" ".join(f"word{i * 7919}" for i in range(300))) == 0
