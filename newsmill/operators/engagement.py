"""Aggregates and windows over interactions: rollups, activity, retention, streaks, histories, trending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsmill.sources.views import before


def half_up(x: Column, digits: int) -> Column:
    """Rounds halves up on doubles."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def since(df: DataFrame, as_of: str, interval: str, time: str = "created_at") -> DataFrame:
    return df.where(F.col(time) >= before(as_of, interval))


def daily_rollup(interactions: DataFrame) -> DataFrame:
    """Counts of each action and distinct users for each day; days are half-open."""
    count = lambda a: F.count_if(F.col("action") == a)
    return interactions.groupBy(F.to_date("created_at").alias("day")).agg(
        count("view").alias("views"), count("click_original").alias("clicks"), count("share").alias("shares"),
        count("bookmark").alias("bookmarks"), F.count_distinct("user_id").alias("unique_users"),
    )


def user_activity(interactions: DataFrame) -> DataFrame:
    """A row a user and day: recorded actions as sessions, articles viewed, first and last time."""
    return interactions.groupBy("user_id", F.to_date("created_at").alias("day")).agg(
        F.count(F.lit(1)).alias("sessions"), F.count_if(F.col("action") == "view").alias("articles_viewed"),
        F.min("created_at").alias("first_seen_at"), F.max("created_at").alias("last_seen_at"),
    )


def active_users(activity: DataFrame, period: Column) -> DataFrame:
    return activity.groupBy(period.alias("period")).agg(F.count_distinct("user_id").alias("active_users"))


def retention(activity: DataFrame, days: int = 7) -> DataFrame:
    """Of each day's users, how many came again exactly ``days`` later; zero for none."""
    cohort = activity.select("user_id", "day").distinct()
    later = cohort.select("user_id", F.date_sub("day", days).alias("day"), F.lit(1).alias("came"))
    rate = half_up(F.col("retained") / F.col("cohort") * 100.0, 2)
    return cohort.join(later, ["user_id", "day"], "left").groupBy("day").agg(F.count(F.lit(1)).alias("cohort"), F.count("came").alias("retained")).withColumn("rate", rate)


def engagement_averages(activity: DataFrame) -> DataFrame:
    return activity.agg(F.coalesce(F.avg("sessions"), F.lit(0.0)).alias("avg_sessions"), F.coalesce(F.avg("articles_viewed"), F.lit(0.0)).alias("avg_articles"))


def streaks(activity: DataFrame) -> DataFrame:
    """Each user's current and longest run of consecutive days (gaps and islands)."""
    w = Window.partitionBy("user_id").orderBy("day")
    days = activity.select("user_id", "day").distinct()
    islands = days.withColumn("island", F.date_sub("day", F.row_number().over(w)))
    runs = islands.groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("length"), F.max("day").alias("last_day"))
    return runs.groupBy("user_id").agg(F.max_by("length", "last_day").alias("current_streak"), F.max("length").alias("longest_streak"), F.max("last_day").alias("last_active"))


def top_articles(interactions: DataFrame, k: int, least: int = 1) -> DataFrame:
    """The k articles of most rows, with their rank; ties by id."""
    counts = interactions.groupBy("article_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    top = counts.orderBy(F.desc("n"), "article_id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "article_id")))


def trending(interactions: DataFrame, articles: DataFrame, as_of: str, k: int = 50, visible: tuple[str, ...] = ("done", "fallback", "cached"), topic: str | None = None) -> DataFrame:
    """The last day's k most used articles that are visible, in rank order; a topic filters after the cut."""
    top = top_articles(since(interactions, as_of, "24 HOURS"), k)
    found = top.join(articles.where(F.col("processing_status").isin(*visible)), "article_id")
    return found if topic is None else found.where(F.col("topic") == topic)


def reading_history(interactions: DataFrame) -> DataFrame:
    """The last view of each article by each user."""
    return interactions.where("action = 'view'").groupBy("user_id", "article_id").agg(F.max("created_at").alias("last_viewed"))


def continue_reading(interactions: DataFrame, k: int = 5) -> DataFrame:
    """Of each user's k latest articles viewed once, those without a click. The cut comes first, so fewer than k may stay."""
    viewed = interactions.where("action = 'view'").groupBy("user_id", "article_id").agg(F.count(F.lit(1)).alias("views"), F.max("created_at").alias("last_viewed"))
    latest = Window.partitionBy("user_id").orderBy(F.desc("last_viewed"), "article_id")
    once = viewed.where("views = 1").withColumn("rn", F.row_number().over(latest)).where(F.col("rn") <= k)
    clicked = interactions.where("action = 'click_original'").select("user_id", "article_id").distinct()
    return once.join(clicked, ["user_id", "article_id"], "left_anti").select("user_id", "article_id", "last_viewed")


def user_stats(interactions: DataFrame, activity: DataFrame) -> DataFrame:
    """Views, bookmarks, shares and the current streak of each user, in one pass over each input."""
    count = lambda a: F.count_if(F.col("action") == a)
    counts = interactions.groupBy("user_id").agg(count("view").alias("views"), count("bookmark").alias("bookmarks"), count("share").alias("shares"))
    return counts.join(streaks(activity).select("user_id", "current_streak"), "user_id", "left")


def preferences(interactions: DataFrame, articles: DataFrame, latest: int = 50) -> DataFrame:
    """Each user's topic weights over the latest actions (view 1, bookmark 3, share 5), adding up to one."""
    weight = F.create_map(*[F.lit(x) for x in ("view", 1.0, "bookmark", 3.0, "share", 5.0)])[F.col("action")]
    w = Window.partitionBy("user_id").orderBy(F.desc("created_at"), "article_id", "action")
    recent = interactions.where(F.col("action").isin("view", "bookmark", "share")).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= latest)
    sums = recent.join(articles.select("article_id", "topic"), "article_id").groupBy("user_id", "topic").agg(F.sum(weight).alias("w"))
    return sums.withColumn("weight", F.col("w") / F.sum("w").over(Window.partitionBy("user_id"))).select("user_id", "topic", "weight")


def expire(df: DataFrame, as_of: str, days: int, time: str = "created_at") -> DataFrame:
    return since(df, as_of, f"{days} DAYS", time)


def gated_views(interactions: DataFrame, opens: tuple[str, ...]) -> DataFrame:
    """Views of each user and day that count: those from the day's first action in ``opens`` on, for that makes the day's row; days without one have no row."""
    day = F.to_date("created_at")
    opened = interactions.where(F.col("action").isin(*opens)).groupBy("user_id", day.alias("day")).agg(F.count(F.lit(1)).alias("sessions"), F.min("created_at").alias("opened_at"))
    views = interactions.where("action = 'view'").select("user_id", day.alias("day"), "created_at")
    counted = views.join(opened, ["user_id", "day"]).where("created_at >= opened_at").groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("articles_viewed"))
    return opened.join(counted, ["user_id", "day"], "left").select("user_id", "day", "sessions", F.coalesce("articles_viewed", F.lit(0)).alias("articles_viewed"))


def unique_users(rollup: DataFrame, dau: DataFrame) -> DataFrame:
    """``rollup`` (day, unique_users) with the activity's daily users (day, active_users) in their place, where these are known and not zero."""
    users = F.coalesce(F.nullif("active_users", F.lit(0)), F.col("unique_users"))
    return rollup.join(dau, "day", "left").withColumn("unique_users", users).drop("active_users")
