"""Exact counts of users that add up: a bitmap of each day's users, kept as a table, from which periods are made without the log.

A row holds the users of one range of 32,768 ids, so a day has as many rows as its users have ranges, and any
union of days is a bitwise or of rows. Users without an id don't count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsmill.operators.engagement import half_up


def daily_users(interactions: DataFrame) -> DataFrame:
    """(day, bucket, users) of interactions (user_id, created_at): a day's log is read once for it."""
    rows = interactions.where("user_id IS NOT NULL").select(F.to_date("created_at").alias("day"), "user_id")
    return rows.groupBy("day", F.bitmap_bucket_number("user_id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("user_id")).alias("users"))


def active_users(daily: DataFrame, period: Column) -> DataFrame:
    """(period, active_users) for any grouping of days."""
    ranges = daily.groupBy(period.alias("period"), "bucket").agg(F.bitmap_or_agg("users").alias("users"))
    return ranges.groupBy("period").agg(F.sum(F.bitmap_count("users")).alias("active_users"))


def retention(daily: DataFrame, days: int = 7) -> DataFrame:
    """(day, cohort, retained, rate): of each day's users those of the day ``days`` later, as bits that both have."""
    own = daily.select("day", "bucket", "users", F.lit(1).alias("own"))
    later = daily.select(F.date_sub("day", days).alias("day"), "bucket", "users", F.lit(0).alias("own"))
    ranges = own.unionByName(later).groupBy("day", "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.max("own").alias("own"), F.bitmap_and_agg("users").alias("both"), F.max(F.when(F.col("own") == 1, F.bitmap_count("users"))).alias("cohort")
    )
    counted = ranges.where("own = 1").groupBy("day").agg(F.sum("cohort").alias("cohort"), F.sum(F.when(F.col("n") == 2, F.bitmap_count("both")).otherwise(0)).alias("retained"))
    return counted.withColumn("rate", half_up(F.col("retained") / F.col("cohort") * 100.0, 2))
