"""Keyed state over several triggers and a restart, against folds in arrival order."""

import random
import tracemalloc
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from test_dedup_window import whole_fold

from newsmill.functions.recent import Recent
from newsmill.plans import registry
from newsmill.streaming import jobs
from newsmill.streaming.processors import Breaker, RecentDuplicates

START = datetime(2024, 1, 1)
ARTICLES = "article_id long, created_at timestamp, title_original string, embedding array<double>, lang string"


def arrivals(seed, n):
    rng = random.Random(seed)
    pool = ["".join(rng.choices("abcdefghijklm nopq", k=24)) for _ in range(25)]
    rows, at = [], 0
    for i in range(n):
        at += rng.choice([0, 2, 9])
        title = list(rng.choice(pool))
        title[rng.randrange(24)] = rng.choice("xyz")
        vec = [rng.choice([0.0, 0.6, 0.8]) for _ in range(3)] if rng.random() < 0.5 else None
        rows.append((i * 10 + rng.randrange(10), START + timedelta(minutes=at), "".join(title), vec, rng.choice(["vi", "en"])))
    return rows


def run(stream, path):
    """What a stream writes to ``path`` in its next run, one file a trigger."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", path + "-state").trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None


def test_recent_duplicates_over_triggers_and_a_restart(spark, tmp_path):
    rows = arrivals(3, 240)
    source = lambda: spark.readStream.schema(ARTICLES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withWatermark("created_at", "1 hour")
    for part in range(6):  # three files, a restart, three files more
        spark.createDataFrame(rows[part * 40 : part * 40 + 40], ARTICLES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if part in (2, 5):
            run(jobs.recent_duplicates(source(), "lang", hours=6, most=12), f"{tmp_path}/out")
    got = {r.article_id: (r.layer, r.like) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {}
    for lang in ("vi", "en"):
        own = [(i, f"u{i}", at, title, vec) for i, at, title, vec, l in rows if l == lang]
        want |= {i: (layer, like if layer else None) for i, (_, layer, like) in whole_fold(own, 6, 12).items()}
    assert got == want and 30 < sum(layer is not None for layer, _ in got.values()) < 230


def test_caps_keep_large_and_missing_ids(spark, tmp_path):
    big = 2**62 + 1
    rows = [(1, big, "view", START), (1, None, "view", START), (1, big + 2, "share", START + timedelta(hours=1)), (2, None, "view", START), (1, big + 4, "view", START + timedelta(hours=25))]
    spark.createDataFrame(rows, "user_id long, article_id long, action string, created_at timestamp").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("user_id long, article_id long, action string, created_at timestamp").parquet(f"{tmp_path}/in").withWatermark("created_at", "1 hour")
    run(jobs.capped(stream, {"view": 1}, 2), f"{tmp_path}/out")
    got = {(r.user_id, r.article_id, r.action, r.accepted) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(1, None, "view", True), (1, big, "view", False), (1, big + 2, "share", True), (2, None, "view", True), (1, big + 4, "view", True)}


def test_attempts_of_one_time_go_by_id(spark, tmp_path):
    rows = [(7, n, START, ok) for n, ok in ((3, False), (1, False), (2, True), (4, False), (5, True))] + [(7, 6, START + timedelta(seconds=40), True)]
    spark.createDataFrame(rows, "source_id long, attempt_id long, created_at timestamp, ok boolean").repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("source_id long, attempt_id long, created_at timestamp, ok boolean").parquet(f"{tmp_path}/in")
    run(jobs.circuit_breaker(stream, 2, 30), f"{tmp_path}/out")
    found = spark.read.parquet(f"{tmp_path}/out").orderBy("at", F.desc("state")).collect()
    assert sorted(r.state for r in found) == sorted(["closed", "closed", "closed", "open", "open", "closed"])


def test_the_stream_query_equals_a_fold_of_each_language(spark):
    d = "/root/testdata/sf0.001"
    vectors = {r.vec_id: [float(x) for x in r.embedding] for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()}
    windows, want = {}, {}
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang").collect()
    for r in sorted(docs, key=lambda r: (r.doc_id % 720, r.doc_id)):
        window = windows.setdefault(r.lang, Recent(48, 200, 0.8, 0.4))
        want[r.doc_id] = window.arrive(r.doc_id, r.doc_id % 720 * 3_600_000_000, r.text.split("\n")[0][:80], vectors.get(r.doc_id))
    got = {r.article_id: r.layer and (r.layer, r.like) for r in registry.QUERIES["stream_recent_duplicates"](spark, d).collect()}
    assert got == want and any(want.values())


class _OneValue:
    """A state variable and the handle that gives it."""

    def __init__(self):
        self.value = None

    def __getattr__(self, name):
        if name in ("getValueState", "getListState"):
            return lambda *_: self
        raise AttributeError(name)

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_a_breaker_gives_a_large_key_in_frames():
    """A key's rows leave in frames of bounded size, and wait as arrays; as row objects 200,000 attempts took over 100 MB."""
    n = 200_000
    frames = (pd.DataFrame({"source_id": 3, "attempt_id": np.arange(i, i + 10_000), "time": np.arange(i, i + 10_000)[::-1] * 1000, "ok": np.arange(i, i + 10_000) % 7 > 2}) for i in range(0, n, 10_000))
    breaker, handle = Breaker(2, 1), _OneValue()
    breaker.init(handle)
    tracemalloc.start()
    sizes, last = [], -1
    for f in breaker.handleInputRows((3,), frames, None):
        sizes.append(len(f))
        assert f["time"].is_monotonic_increasing and f["time"].iloc[0] > last and set(f["source_id"]) == {3}
        last = f["time"].iloc[-1]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sizes) == n and max(sizes) <= 10_000 and peak < 20e6 and handle.value[0] in ("open", "closed", "half_open")


class _Timed(_OneValue):
    put = _OneValue.update

    def listTimers(self):
        return []

    def registerTimer(self, millis):
        self.timer = millis

    def getCurrentWatermarkInMs(self):
        return 0


def test_recent_duplicates_give_a_large_key_in_frames():
    """A key's articles leave in frames of bounded size, in the order of the fold, with null titles and vectors among them."""
    rng, n = random.Random(8), 12_000
    rows = [(i, rng.randrange(n) * 1_000_000, rng.choice([None, "", f"é title {i % 50}"]), np.array([0.6, 0.8]) if i % 9 == 0 else None) for i in range(n)]
    frames = [pd.DataFrame(rows[i : i + 1000], columns=["article_id", "time", "title_original", "embedding"]) for i in range(0, n, 1000)]
    processor, handle = RecentDuplicates(1, 5, 0.8, 0.8), _Timed()
    processor.init(handle)
    got = list(processor.handleInputRows(("vi",), iter(frames), handle))
    window = Recent(1, 5, 0.8, 0.8)
    want = {r[0]: window.arrive(r[0], *r[1:]) for r in sorted(rows, key=lambda r: (r[1], r[0]))}
    assert [len(f) for f in got] == [10_000, 2_000] and handle.timer > 0 and len(handle.value) <= 5
    found = {int(i): None if pd.isna(layer) else (int(layer), int(like)) for f in got for i, layer, like in zip(f["article_id"], f["layer"], f["like"])}
    assert found == want and any(want.values())
