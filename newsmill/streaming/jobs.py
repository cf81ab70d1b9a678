"""The timer-driven jobs as Structured Streaming queries.

Event time with a watermark replaces the reference's clock: a late row within the watermark
still counts in its window, a later one is dropped. Each function takes and returns a frame;
``available_now`` runs one to completion, as the tests and a scheduler do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import LongType, StructField, StructType

from newsmill.session import shared_path, ship_package
from newsmill.sources.views import article_of
from newsmill.streaming.processors import Breaker, Caps, RecentDuplicates

LATE = "1 hour"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def interactions_stream(spark: SparkSession, sf_dir: str, late: str = LATE) -> DataFrame:
    """The events table as a stream of interactions."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).parquet(path[:-1] + "[t]")  # a pattern may name a file or a folder
    action = F.when(F.col("event_type") == "click", "click_original").when(F.col("event_type") == "purchase", "share").when(F.col("event_type") == "signup", "bookmark").when(F.col("event_type") == "view", "view").otherwise("other")
    found = rows.select(
        F.col("user_id").cast("bigint").alias("user_id"), article_of(F.col("props")).alias("article_id"),
        action.alias("action"), F.col("ts").cast("timestamp").alias("created_at"), F.col("event_id"),
    )
    return found.withWatermark("created_at", late)


def _windowed(rows: DataFrame, size: str, slide: str | None, *keys: str) -> DataFrame:
    w = F.window("created_at", size, slide or size)
    return rows.groupBy(w.alias("w"), *keys)


def trending_push(interactions: DataFrame, least: int = 1000) -> DataFrame:
    """Articles of many views within an hour, every half hour."""
    counts = _windowed(interactions.where("action = 'view'"), "1 hour", "30 minutes", "article_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= least).select(F.col("w.start").alias("start"), "article_id", "n")


def topic_updates(interactions: DataFrame, articles: DataFrame, least: int = 5) -> DataFrame:
    """Topics of much use within two hours (a stream joined with a table)."""
    joined = interactions.join(articles.select("article_id", "topic"), "article_id")
    counts = _windowed(joined, "2 hours", None, "topic").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= least).select(F.col("w.start").alias("start"), "topic", "n")


def daily_activity(interactions: DataFrame) -> DataFrame:
    """A row a user and day."""
    a = _windowed(interactions, "1 day", None, "user_id").agg(F.count(F.lit(1)).alias("sessions"), F.count_if(F.col("action") == "view").alias("articles_viewed"), F.min("created_at").alias("first_seen_at"), F.max("created_at").alias("last_seen_at"))
    return a.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "user_id", "sessions", "articles_viewed", "first_seen_at", "last_seen_at")


def error_rates(interactions: DataFrame, minutes: int = 5) -> DataFrame:
    """Errors among requests in tumbling windows, in per cent, and whether to alert (twenty and more, over five per cent)."""
    e = _windowed(interactions, f"{minutes} minutes", None).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("action") == "other").alias("errors"))
    rate = F.floor(F.col("errors") / F.col("total") * 10000.0 + 0.5) / 100.0
    return e.select(F.col("w.start").alias("start"), "total", "errors", rate.alias("rate"), ((F.col("total") >= 20) & (rate > 5)).alias("alert"))


def provider_health(calls: DataFrame) -> DataFrame:
    """Success rate of each provider in tumbling ten minutes; healthy below three calls or from one half."""
    h = _windowed(calls, "10 minutes", None, "provider").agg(F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("good"))
    rate = F.col("good") / F.col("total")
    return h.select(F.col("w.start").alias("start"), "provider", "total", rate.alias("success_rate"), ((F.col("total") < 3) | (rate >= 0.5)).alias("healthy"))


def rate_usage(calls: DataFrame, most: int, seconds: int = 60) -> DataFrame:
    """Calls of each provider within a sliding minute, and whether four fifths of the limit are used."""
    u = _windowed(calls, f"{seconds} seconds", f"{seconds // 6} seconds", "provider").agg(F.count(F.lit(1)).alias("used"))
    return u.select(F.col("w.start").alias("start"), "provider", "used", (F.col("used") >= 0.8 * most).alias("warn"))


def without_repeats(candidates: DataFrame) -> DataFrame:
    """The first of equal (user, article, action) rows within the watermark (set it to 24 hours)."""
    return candidates.dropDuplicatesWithinWatermark(["user_id", "article_id", "action"])


def _micros() -> Column:
    return F.unix_micros("created_at").alias("time")


def _stamped(rows: DataFrame, name: str) -> DataFrame:
    return rows.select(*[F.timestamp_micros("time").alias(name) if c == "time" else c for c in rows.columns])


def _with_state(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str, timers: str, frames: bool = False) -> DataFrame:
    """``frames``: the processor takes and gives pandas frames of bounded size rather than rows, which Spark gathers for a whole key."""
    ship_package(rows.sparkSession)
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)  # state of lists and timers needs it
    grouped = rows.groupBy(key)
    return (grouped.transformWithStateInPandas if frames else grouped.transformWithState)(processor, schema, "append", timers)


def capped(candidates: DataFrame, by_type: dict[str, int], overall: int, hours: int = 24) -> DataFrame:
    """Sequential caps for each user; the state holds what was accepted within the last ``hours``.

    Rows of one trigger are taken in time; a row older than accepted ones counts from its own time on.
    """
    rows = candidates.select("user_id", "article_id", "action", _micros(), "created_at")
    found = _with_state(rows, "user_id", Caps(by_type, overall, hours), "user_id long, article_id long, action string, time long, accepted boolean", "eventTime")
    return _stamped(found, "created_at")


def circuit_breaker(attempts: DataFrame, most_failures: int = 5, open_seconds: int = 30) -> DataFrame:
    """The state after each attempt (source_id, attempt_id, created_at, ok): closed, open after ``most_failures`` in a row, half open
    for the first attempt ``open_seconds`` later; attempts while open change nothing. Attempts of one time go by their id."""
    first = F.coalesce("attempt_id", F.lit(-(2**63)))
    rows = attempts.select("source_id", first.alias("attempt_id"), F.coalesce("ok", F.lit(False)).alias("ok"), _micros())
    return _stamped(_with_state(rows, "source_id", Breaker(most_failures, open_seconds), "source_id long, time long, state string", "none", frames=True), "at")


def recent_duplicates(articles: DataFrame, by: str, hours: int = 48, most: int = 200, title_threshold: float = 0.8, embed_threshold: float = 0.8) -> DataFrame:
    """(article_id, layer, like): what each article (article_id, created_at, title_original, embedding, ``by``) duplicates among the last ``most``
    kept ones of ``hours``, null where it is kept. Each value of ``by`` has a window of its own, which
    is what spreads the work; a constant has the one window of a single node. The state leaves by a timer."""
    rows = articles.select(F.col(by).alias("by"), "article_id", "title_original", F.col("embedding").cast("array<double>").alias("embedding"), _micros(), "created_at")
    return _with_state(rows, "by", RecentDuplicates(hours, most, title_threshold, embed_threshold), "article_id long, layer int, like long", "eventTime", frames=True)


def first_of_url(articles: DataFrame) -> DataFrame:
    """Articles (url, …) whose URL didn't arrive within the watermark (set it to 48 hours); older state is dropped."""
    return articles.withColumn("url_hash", F.md5("url")).dropDuplicatesWithinWatermark(["url_hash"])


def _batches(stream: DataFrame, path: str, mode: str, process: Callable[[DataFrame], DataFrame] | None = None):
    """A writer that puts each batch into a folder of its own, so that a batch that runs again replaces itself."""

    def one(batch: DataFrame, number: int) -> None:
        (process(batch) if process else batch).write.mode("overwrite").parquet(f"{path}/_n={number}")

    return stream.writeStream.outputMode(mode).foreachBatch(one).option("checkpointLocation", path + "-state")


def crawl_cycle(source: DataFrame, process: Callable[[DataFrame], DataFrame], path: str):
    """A writer that processes each batch of new articles and adds the result to ``path``; start it with a trigger of its own."""
    return _batches(source, path, "append", process)


def written(spark: SparkSession, path: str, schema: StructType, keys: tuple[str, ...] = ()) -> DataFrame:
    """What a stream wrote to ``path``: all rows, or each key's latest ones."""
    rows = spark.read.option("basePath", path).schema(StructType([*schema.fields, StructField("_n", LongType())])).parquet(path)
    if not keys:
        return rows.drop("_n")
    rest = [c for c in schema.names if c not in keys]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_n").alias("_v"))
    return latest.select(*[F.col(f"_v.{c}").alias(c) if c in rest else F.col(c) for c in schema.names])


def available_now(stream: DataFrame, keys: tuple[str, ...] = (), process: Callable[[DataFrame], DataFrame] | None = None, schema: StructType | None = None) -> DataFrame:
    """Runs a stream over what is there and returns its rows, written to the shared folder.

    With ``keys`` (an aggregate's) it runs in update mode: each batch writes the groups it changed, the
    latest of a key counts, and the watermark evicts the state of windows that are over.
    """
    spark, schema = stream.sparkSession, schema or stream.schema
    path = shared_path(spark, "stream")
    spark.createDataFrame([], schema).write.parquet(f"{path}/_n=-1")
    q = _batches(stream, path, "update" if keys else "append", process).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return written(spark, path, schema, keys)
