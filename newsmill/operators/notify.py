"""Notification queries, opt-in rules and sequential caps."""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from newsmill.operators.engagement import since
from newsmill.session import ship_package


def most_viewed(interactions: DataFrame, as_of: str, interval: str, k: int, least: int = 1) -> DataFrame:
    """The k articles of most views within the interval, with at least ``least``; ties by id."""
    counts = since(interactions.where("action = 'view'"), as_of, interval).groupBy("article_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= least).orderBy(F.desc("n"), "article_id").limit(k)


def topic_updates(articles: DataFrame, as_of: str, interval: str = "2 HOURS", least: int = 5) -> DataFrame:
    """Topics with at least ``least`` new finished articles, and the latest of them."""
    new = since(articles.where("processing_status = 'done' AND topic IS NOT NULL"), as_of, interval)
    latest = F.max_by("article_id", F.struct("created_at", "article_id"))
    return new.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), latest.alias("latest")).where(F.col("n") >= least)


def opted_in(users: DataFrame, preference: str) -> DataFrame:
    """Users with notifications who didn't turn this kind off; a missing preference counts as on."""
    return users.where(F.col("notifications_enabled") & ~F.col(preference).eqNullSafe(False))


def subscribers(users: DataFrame, topics: DataFrame) -> DataFrame:
    interests = opted_in(users, "pref_topic").select("user_id", F.explode("interests").alias("topic"))
    return interests.join(topics, "topic").select("user_id", "topic")


def within_caps(candidates: DataFrame, by_type: dict[str, int], overall: int, hours: int = 24) -> DataFrame:
    """``candidates`` (user_id, article_id, type, created_at) and accepted: at most ``overall`` and ``by_type`` accepted
    ones in the hours before. Refused candidates don't count, so this is a fold over a user's rows in time: rows come
    sorted by user and time, and what is carried along is what the present user accepted within the hours."""
    ship_package(candidates.sparkSession)
    span = hours * 3_600_000_000

    def fold(batches):
        user, sent = None, deque()
        for b in batches:
            accepted = []
            for u, t, kind in zip(b.column("user_id").to_pylist(), b.column("created_at").cast("int64").to_pylist(), b.column("type").to_pylist()):
                if u != user:
                    user, sent = u, deque()
                while sent and t - sent[0][0] >= span:
                    sent.popleft()
                ok = len(sent) < overall and sum(k == kind for _, k in sent) < by_type.get(kind, overall)
                if ok:
                    sent.append((t, kind))
                accepted.append(ok)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(accepted, pa.bool_())], [*b.schema.names, "accepted"])

    rows = candidates.select("user_id", "article_id", "type", "created_at").where("created_at IS NOT NULL")
    rows = rows.repartition("user_id").sortWithinPartitions("user_id", "created_at", "article_id", "type")
    return rows.mapInArrow(fold, StructType([*rows.schema.fields, StructField("accepted", BooleanType())]))
