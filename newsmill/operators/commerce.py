"""Advertising, affiliates, referrals, reactions, subscriptions, sources, moderation counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsmill.operators.engagement import half_up


def active_ads(ads: DataFrame, today: str, topic: str | None = None) -> DataFrame:
    """Active, not ended, money left; a start is not looked at."""
    found = ads.where((F.col("status") == "active") & (F.col("end_on") >= F.lit(today).cast("date")) & (F.col("spent_cents") < F.col("budget_cents")))
    return found if topic is None else found.where(F.col("topic") == topic)


def viewability(ads: DataFrame) -> DataFrame:
    rate = F.when(F.sum("impressions") > 0, F.sum("viewable_impressions") / F.sum("impressions") * 100.0).otherwise(0.0)
    return ads.groupBy("topic").agg(F.sum("impressions").alias("impressions"), half_up(rate, 1).alias("rate"))


def top_referrers(referrals: DataFrame, users: DataFrame, k: int = 20) -> DataFrame:
    """The k that referred most; the cut comes before the join, unmatched ones drop out."""
    top = referrals.groupBy("referrer_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "referrer_id").limit(k)
    return top.join(users.select(F.col("user_id").alias("referrer_id"), "email"), "referrer_id")


def referral_cap(referrals: DataFrame, cap: int = 10) -> DataFrame:
    """Which referrals of a month are within the cap, in order."""
    w = Window.partitionBy("referrer_id", F.date_trunc("month", "created_on")).orderBy("created_on", "referral_id")
    return referrals.withColumn("nth", F.row_number().over(w)).withColumn("accepted", F.col("nth") <= cap)


def reaction_counts(reactions: DataFrame) -> DataFrame:
    """A map of counts by type for each article."""
    counts = reactions.groupBy("article_id", "type").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("article_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "n")))).alias("counts"))


def latest_wins(rows: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """An upsert's result: each key's values at its greatest ``order``."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("_v")).select(*keys, "_v.*")


def insert_new(existing: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't there yet (an idempotent insert)."""
    return rows.join(existing.select(*keys).distinct(), keys, "left_anti")


def counters(dimension: DataFrame, log: DataFrame, key: str, name: str) -> DataFrame:
    """A counter kept as an event log, joined to what it counts."""
    return dimension.join(log.groupBy(key).agg(F.count(F.lit(1)).alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def source_health(sources: DataFrame) -> DataFrame:
    disabled, active = F.col("auto_disabled"), F.col("is_active") & ~F.col("auto_disabled")
    return sources.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(active).alias("active"), F.count_if(disabled).alias("disabled"),
        F.count_if((F.col("success_rate") < 0.5) & ~disabled).alias("degraded"),
    )


def auto_disable(attempts: DataFrame, least: int = 5, rate: float = 0.1) -> DataFrame:
    """Success rate of each source, and whether it is to be disabled. ``attempts``: source_id, ok."""
    r = F.count_if("ok") / F.count(F.lit(1))
    return attempts.groupBy("source_id").agg(F.count(F.lit(1)).alias("total"), half_up(r, 3).alias("success_rate"), ((F.count(F.lit(1)) >= least) & (r < rate)).alias("disable"))


def failures_in_a_row(attempts: DataFrame) -> DataFrame:
    """At each attempt the failures since the last success (gaps and islands)."""
    w = Window.partitionBy("source_id").orderBy("at", "attempt_id")
    island = attempts.withColumn("island", F.count_if("ok").over(w))
    within = Window.partitionBy("source_id", "island").orderBy("at", "attempt_id")
    return island.withColumn("failures", F.count_if(~F.col("ok")).over(within)).drop("island")


def subscription_intervals(payments: DataFrame) -> DataFrame:
    """Each activation closes the one before: (user_id, started_on, ended_on)."""
    w = Window.partitionBy("user_id").orderBy("started_on", "payment_id")
    return payments.withColumn("ended_on", F.lead("started_on").over(w))


def auto_hide(reports: DataFrame, least: int = 3) -> DataFrame:
    """Articles that at least ``least`` different users reported."""
    return reports.groupBy("article_id").agg(F.count_distinct("user_id").alias("reporters")).where(F.col("reporters") >= least)


def affiliate_totals(links: DataFrame) -> DataFrame:
    return links.agg(F.coalesce(F.sum("clicks"), F.lit(0)).alias("clicks"), F.coalesce(F.sum("impressions"), F.lit(0)).alias("impressions"))


def active_subscription(subscriptions: DataFrame, as_of: str) -> DataFrame:
    """Each user's subscription that is active or on trial and hasn't expired; of several the first by id."""
    live = subscriptions.where(F.col("status").isin("active", "trial") & (F.col("expires_on") > F.lit(as_of).cast("date")))
    return live.groupBy("user_id").agg(F.min_by(F.struct("subscription_id", "status", "expires_on"), "subscription_id").alias("s")).select("user_id", "s.*")


def crawlable(sources: DataFrame, as_of: str) -> DataFrame:
    """``sources`` (auto_disabled, disabled_until, failures) with decision: ``skip`` while disabled, ``re-enable`` after it (the failures start anew), else ``crawl``."""
    skip = F.col("auto_disabled") & (F.col("disabled_until") > F.lit(as_of).cast("timestamp_ntz"))
    decision = F.when(F.coalesce(skip, F.lit(False)), "skip").when(F.col("auto_disabled"), "re-enable").otherwise("crawl")
    out = sources.withColumn("decision", decision)
    again = F.col("decision") == "re-enable"
    return out.withColumn("failures", F.when(again, 0).otherwise(F.col("failures"))).withColumn("auto_disabled", F.col("auto_disabled") & ~again).withColumn("disabled_until", F.when(~again, F.col("disabled_until")))


def delete_keys(existing: DataFrame, keys: DataFrame, by: list[str]) -> DataFrame:
    """``existing`` without the rows of ``keys``; unknown keys delete nothing."""
    return existing.join(keys.select(*by).distinct(), by, "left_anti")


def domain_delays(requests: DataFrame, least_micros: int = 1_500_000) -> DataFrame:
    """When each request (request_id, domain, at) is made if a domain's requests keep a distance.

    Each waits for the one before: the greatest of its own time and that one's plus the distance. Unrolled,
    this is n distances and the greatest of (at - n distances) so far, a running maximum.
    """
    w = Window.partitionBy("domain").orderBy("at", "request_id")
    behind = F.row_number().over(w).cast("bigint") * F.lit(least_micros).cast("bigint")
    rows = requests.withColumn("_behind", behind)
    made = F.max(F.col("at") - F.col("_behind")).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_behind")
    return rows.withColumn("made_at", made).withColumn("waited", F.col("made_at") - F.col("at")).drop("_behind")


def domain_stats(requests: DataFrame, now_micros: int, most: int = 20) -> DataFrame:
    """The ``most`` domains asked last and the seconds since, in tenths."""
    last = requests.groupBy("domain").agg(F.max("at").alias("last")).orderBy(F.desc("last"), "domain").limit(most)
    return last.select("domain", half_up((F.lit(now_micros) - F.col("last")) / 1e6, 1).alias("last_request_ago_sec"))


def provider_status(calls: DataFrame, most: int | None = None) -> DataFrame:
    """Each provider's calls (provider, ok): rate in thousandths, healthy below three calls or from one half, use of the limit."""
    total, rate = F.count(F.lit(1)), F.count_if("ok") / F.count(F.lit(1))
    use = F.lit(None).cast("double") if most is None else half_up(total / float(most) * 100.0, 1)
    return calls.groupBy("provider").agg(total.alias("total"), half_up(rate, 3).alias("success_rate"), ((total < 3) | (rate >= 0.5)).alias("healthy"), use.alias("usage_pct"))


def classifier_metrics(classified: DataFrame) -> DataFrame:
    """total, keyword_hits, llm_calls, cache_hits and the rate of hits over classified articles (via)."""
    n = lambda v: F.count_if(F.col("via") == v)
    rate = half_up(n("keyword") / F.greatest(F.count(F.lit(1)), F.lit(1)), 3)
    return classified.agg(F.count(F.lit(1)).alias("total"), n("keyword").alias("keyword_hits"), n("model").alias("llm_calls"), n("cache").alias("cache_hits"), rate.alias("keyword_hit_rate"))


def recent_records(records: DataFrame, key: str, order: str, tie: str, most: int = 1000) -> DataFrame:
    """What a bounded list of records holds for each key: the last ``most``."""
    w = Window.partitionBy(key).orderBy(F.desc(order), F.desc(tie))
    return records.withColumn("age", F.row_number().over(w)).where(F.col("age") <= most)


def best_summary(attempts: DataFrame, fallback: DataFrame, least: float = 0.6) -> DataFrame:
    """(article_id, attempt, quality, provider): of an article's attempts (article_id, attempt, quality, provider) the first of
    enough quality, else the best above zero, else what ``fallback`` (article_id) has, with quality 0."""
    good = F.col("quality") >= least
    order = F.struct(good.alias("good"), F.when(good, F.lit(0.0)).otherwise(F.col("quality")).alias("q"), (-F.col("attempt")).alias("a"))
    best = attempts.where("quality > 0").groupBy("article_id").agg(F.max_by(F.struct("attempt", "quality", "provider"), order).alias("b"))
    joined = fallback.select("article_id").join(best, "article_id", "left")
    return joined.select("article_id", "b.attempt", F.coalesce("b.quality", F.lit(0.0)).alias("quality"), F.coalesce("b.provider", F.lit("extractive_fallback")).alias("provider"))
