"""Tables that batches change, the memo, bitmaps of users and the language detector."""

import glob
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsmill.operators import bitmaps, engagement, languages
from newsmill.operators.keyed import MEMO, KeyedTable, memoised


def keyed(spark, path, ddl, buckets=8):
    from pyspark.sql.types import StructType

    return KeyedTable(spark, str(path), ["k"], StructType.fromDDL(ddl), buckets)


def test_batches_that_repeat_or_die_change_nothing(spark, tmp_path):
    t = keyed(spark, tmp_path / "t", "k long, at long, v string")
    assert t.read().count() == 0
    rng = random.Random(1)
    want = {}
    for n in range(4):
        rows = [(rng.randrange(40), rng.randrange(100), f"v{rng.randrange(9)}") for _ in range(30)]
        df = spark.createDataFrame(rows, "k long, at long, v string")
        assert t.upsert(df, n, "at") and not t.upsert(df, n, "at")
        for k, at, v in rows:
            want[k] = max(want.get(k, (at, v)), (at, v))
        assert {r.k: (r.at, r.v) for r in t.read().collect()} == want

    def dies(old, new):
        spark.createDataFrame([(1, 1, "half")], t.schema).write.parquet(f"{t.path}/batch=9/bucket=0")  # what a dead batch leaves
        raise RuntimeError

    with pytest.raises(RuntimeError):
        t.merge(df, 9, dies)
    assert {r.k: (r.at, r.v) for r in t.read().collect()} == want
    files = set(glob.glob(f"{t.path}/batch=*/bucket=*/*.parquet"))
    assert t.upsert(spark.createDataFrame([(7, 1000, "last")], t.schema), 9, "at")
    new = set(glob.glob(f"{t.path}/batch=*/bucket=*/*.parquet"))
    assert files - new <= set(glob.glob(f"{t.path}/batch=9/*/*")) | {f for f in files if "batch=9" in f} and len({f.rsplit("/", 1)[0] for f in new if "batch=9" in f}) == 1
    want[7] = (1000, "last")
    assert {r.k: (r.at, r.v) for r in t.read().collect()} == want
    assert t.vacuum() > 0 and {r.k: (r.at, r.v) for r in t.read().collect()} == want


def test_inserts_deletes_and_counters(spark, tmp_path):
    t = keyed(spark, tmp_path / "t", "k long, n long, v string")
    df = lambda rows: spark.createDataFrame(rows, t.schema)
    t.insert(df([(1, 5, "a"), (1, 4, "b"), (2, 1, "c")]), 0)
    t.insert(df([(1, 0, "z"), (3, 0, "d")]), 1)
    assert {tuple(r) for r in t.read().collect()} == {(1, 4, "b"), (2, 1, "c"), (3, 0, "d")}
    t.increment(df([(1, 10, None), (1, 1, None), (4, 2, "new"), (2, None, None)]), 2, ["n"])
    assert {tuple(r) for r in t.read().collect()} == {(1, 15, "b"), (2, 1, "c"), (3, 0, "d"), (4, 2, "new")}
    t.delete(spark.createDataFrame([(1,), (99,), (2,), (3,), (4,)], "k long"), 3)
    assert t.read().count() == 0
    t.upsert(df([]), 4, "n")
    assert not t.upsert(df([(5, 5, "x")]), 4, "n") and t.upsert(df([(None, 5, "x")]), 5, "n") and t.read().first().v == "x"


def test_a_stream_into_a_table(spark, tmp_path):
    schema = "k long, at long, v string"
    t = keyed(spark, tmp_path / "t", schema)
    for n in range(3):
        spark.createDataFrame([(i, n, f"{n}") for i in range(n, n + 5)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = t.sink(source, lambda rows, n: t.upsert(rows, n, "at")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert {(r.k, r.v) for r in t.read().collect()} == {(0, "0"), (1, "1"), (2, "2"), (3, "2"), (4, "2"), (5, "2"), (6, "2")}


def test_the_memo_lasts_a_day(spark, tmp_path):
    memo = KeyedTable(spark, str(tmp_path / "memo"), ["key"], MEMO, 4)
    texts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "id int, text string")
    more = texts.unionByName(spark.createDataFrame([(5, "c")], "id int, text string"))

    def run(df, as_of, number):
        found = memoised(df, memo, lambda c: F.concat(F.lit(f"{as_of}/"), F.coalesce(c, F.lit("none"))), F.md5(F.coalesce("text", F.lit(""))), as_of, number)
        return {r.id: (r.value.split("/")[0][8:13], r.value.split("/")[1], r.computed) for r in found.collect()}

    first = run(texts, "2024-01-01 10:00:00", 0)
    assert first == {1: ("01 10", "a", True), 2: ("01 10", "b", True), 3: ("01 10", "a", True), 4: ("01 10", "none", True)}
    again = run(more, "2024-01-02 09:59:59", 1)
    assert {i: x[2] for i, x in again.items()} == {1: False, 2: False, 3: False, 4: False, 5: True} and again[1][:2] == ("01 10", "a")
    late = run(more, "2024-01-02 10:00:00", 2)
    assert {i: x[2] for i, x in late.items()} == {1: True, 2: True, 3: True, 4: True, 5: False}


def test_bitmaps_equal_counts_of_the_log(spark):
    rng = random.Random(3)
    users = [1, 2, 32_767, 32_768, 32_769, 65_537, 10**9, 2**40, -5, 0, None] + [rng.randrange(200_000) for _ in range(40)]
    rows = [(rng.choice(users), datetime(2024, 1, 25) + timedelta(hours=rng.randrange(24 * 20))) for _ in range(900)]
    i = spark.createDataFrame(rows, "user_id long, created_at timestamp_ntz").repartition(4)
    daily = bitmaps.daily_users(i)
    held = {(u, t.date()) for u, t in rows if u is not None}
    day = {r.period: r.active_users for r in bitmaps.active_users(daily, F.col("day")).collect()}
    assert day == {d: sum(x == d for _, x in held) for d in {x for _, x in held}}
    month = {r.period: r.active_users for r in bitmaps.active_users(daily, F.date_format("day", "yyyy-MM")).collect()}
    assert month == {m: len({u for u, x in held if x.strftime("%Y-%m") == m}) for m in ("2024-01", "2024-02")}
    activity = i.where("user_id IS NOT NULL").select("user_id", F.to_date("created_at").alias("day")).distinct()
    assert sorted(map(tuple, bitmaps.retention(daily).collect())) == sorted(map(tuple, engagement.retention(activity).select("day", "cohort", "retained", "rate").collect()))
    assert bitmaps.daily_users(i.where("false")).count() == 0 and date(2024, 1, 25) in day


def test_languages_of_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    held_out = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    detector = languages.fit(docs.where(~held_out))
    found = docs.where(held_out & (F.char_length("text") >= 100)).select("lang", detector(F.col("text")).alias("got")).collect()
    assert len(found) > 150 and sum(r.lang == r.got for r in found) >= 0.95 * len(found)
    odd = spark.createDataFrame([(None,), ("",), ("12 34 !",), ("x",)], "t string").select(detector(F.col("t")).alias("l")).collect()
    assert [r.l for r in odd[:3]] == [None] * 3 and odd[3].l in detector.names
    assert languages.fit(docs.where("false")).of("any text") is None
