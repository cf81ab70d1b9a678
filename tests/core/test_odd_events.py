"""Rows that must not stop a query: events without an article, busy domains, long lines, ties."""

import os
import random
import re
import time

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from newsmill.functions.repeats import repeated_in_line
from newsmill.operators.commerce import domain_delays
from newsmill.sources.feeds import newest_cached

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    """The smallest tables, with events whose props name no article, or a number beyond a bigint."""
    d = str(tmp_path_factory.mktemp("odd"))
    for f in os.listdir(SMALL):
        if f != "events.parquet":
            os.symlink(f"{SMALL}/{f}", f"{d}/{f}")
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    props = F.expr("CASE event_id % 10 WHEN 0 THEN '{}' WHEN 1 THEN '' WHEN 2 THEN NULL WHEN 3 THEN '{\"page\": 99999999999999999999}' ELSE props END")
    events.withColumn("props", props).coalesce(1).write.parquet(f"{d}/parts")
    part = next(f for f in os.listdir(f"{d}/parts") if f.endswith(".parquet"))
    os.symlink(f"{d}/parts/{part}", f"{d}/events.parquet")
    return d


@pytest.mark.parametrize(
    "name",
    ["trending_top50", "daily_rollup", "user_activity", "dau", "retention_d7", "reading_history", "continue_reading", "view_counts_feed_score", "article_flags", "latest_views", "stream_daily_activity", "stream_trending_push"],
)
def test_events_without_an_article_stop_nothing(spark, odd_dir, name):
    con = duckdb.connect()
    for f in os.listdir(odd_dir):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{odd_dir}/{f}'")
    got = __spark_entry__.queries()[name](spark, odd_dir)
    want = con.execute(__spark_entry__.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    plain = lambda rows: sorted((str([None if pd.isna(x) else float(x) if isinstance(x, (int, float)) else str(x) for x in r]) for r in rows))
    assert plain(got.select(*columns).toPandas().values.tolist()) == plain(want[columns].values.tolist())


def test_a_busy_domain(spark):
    rows = spark.range(3000).select(F.col("id").alias("request_id"), F.lit("one").alias("domain"), (F.col("id") * 10).alias("at"))
    last = domain_delays(rows).orderBy(F.desc("request_id")).first()
    assert last.made_at == 2999 * 1_500_000 and last.waited == 2999 * 1_500_000 - 29_990


def test_copies_of_one_time_are_chosen_by_hash(spark):
    rows = [("a", "2024-01-01 00:00:00", f"v{i}") for i in range(50)]
    df = spark.createDataFrame(rows, "id string, cached_at string, v string")
    assert {newest_cached(df.repartition(n)).first().v for n in (1, 3, 7)} == {newest_cached(df).first().v}


PATTERN = re.compile(r"(.{10,}?)\1{2,}")


def test_repeats_equal_the_pattern():
    rng = random.Random(1)
    for _ in range(1500):
        letters = "abcé"[: rng.randint(1, 4)]
        line = "".join("".join(rng.choices(letters, k=rng.randint(1, 25))) * rng.randint(1, 6) for _ in range(rng.randint(1, 6)))
        assert repeated_in_line(line) == sum(1 for _ in PATTERN.finditer(line)), line


@pytest.mark.parametrize("line", ["a" * 100_000, "abcdefghijk " * 8333, ("x" * 9 + "y") * 10_000, "lorem ipsum dolor sit amet " * 2 + "-".join(f"{i} word word word" for i in range(6000))])
def test_long_lines_take_little_time(line):
    repeated_in_line("warm up " * 50)
    began = time.process_time()
    repeated_in_line(line)
    assert time.process_time() - began < 1.0
