"""Queries over ads, referrals, reactions, sources, notifications and administration, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from newsmill.operators import commerce as C
from newsmill.operators import engagement as E
from newsmill.operators import feed, notify
from newsmill.operators.keyed import KeyedTable
from newsmill.session import shared_path
from newsmill.sources import views as v
from newsmill.sources.views import AS_OF, MID, with_views

QUERIES, ORACLES = {}, {}


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


ACTIVE = "status = 'active' AND end_on >= DATE '2024-01-31' AND spent_cents < budget_cents"


@query(with_views("v_ads", body=f" SELECT ad_id, topic, budget_cents - spent_cents AS left_cents FROM v_ads WHERE {ACTIVE}"))
def active_ads(spark, d):
    return C.active_ads(v.ads(spark, d), "2024-01-31").select("ad_id", "topic", (F.col("budget_cents") - F.col("spent_cents")).alias("left_cents"))


@query(with_views("v_ads", body=" SELECT topic, sum(impressions)::BIGINT AS impressions, floor(sum(viewable_impressions)::DOUBLE / sum(impressions)::DOUBLE * 100.0::DOUBLE * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE AS rate FROM v_ads GROUP BY 1"))
def viewability(spark, d):
    return C.viewability(v.ads(spark, d))


@query(with_views("v_ads", body=" SELECT coalesce(sum(impressions), 0)::BIGINT AS ad_impressions, coalesce(sum(clicks), 0)::BIGINT AS ad_clicks FROM v_ads"))
def ad_totals(spark, d):
    return v.ads(spark, d).agg(F.coalesce(F.sum("impressions"), F.lit(0)).alias("ad_impressions"), F.coalesce(F.sum("clicks"), F.lit(0)).alias("ad_clicks"))


@query(with_views("v_referrals", "v_users", body=" , t AS (SELECT referrer_id, count(*) AS n FROM v_referrals GROUP BY 1 ORDER BY n DESC, referrer_id LIMIT 20) SELECT t.referrer_id, t.n, u.email FROM t JOIN v_users u ON u.user_id = t.referrer_id"))
def top_referrers(spark, d):
    return C.top_referrers(v.referrals(spark, d), v.users(spark, d)).select("referrer_id", "n", "email")


@query(with_views("v_referrals", body=" , r AS (SELECT *, row_number() OVER (PARTITION BY referrer_id, date_trunc('month', created_on) ORDER BY created_on, referral_id) AS nth FROM v_referrals) SELECT referral_id, referrer_id, nth, nth <= 2 AS accepted FROM r"))
def referral_cap(spark, d):
    return C.referral_cap(v.referrals(spark, d), 2).select("referral_id", "referrer_id", "nth", "accepted")


@query(with_views("v_users", body=" SELECT user_id, upper(substr(string_split(email, '@')[1], 1, 8)) || '_TB' || upper(substr(md5(CAST(user_id AS VARCHAR)), 1, 4)) AS code FROM v_users"))
def referral_codes(spark, d):
    code = F.concat(F.upper(F.substring(F.split("email", "@")[0], 1, 8)), F.lit("_TB"), F.upper(F.substring(F.md5(F.col("user_id").cast("string")), 1, 4)))
    return v.users(spark, d).select("user_id", code.alias("code"))


@query(with_views("v_reactions", body=" , c AS (SELECT article_id, type, count(*) AS n FROM v_reactions GROUP BY 1, 2) SELECT article_id, string_agg(type || ':' || n, ',' ORDER BY type) AS counts FROM c GROUP BY 1"))
def reaction_counts(spark, d):
    text = F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat_ws(":", e["key"], e["value"])), ",")
    return C.reaction_counts(v.reactions(spark, d)).select("article_id", text.alias("counts"))


@query(with_views("v_reactions", "v_ads", body=" , t AS (SELECT article_id, count(*) AS n FROM v_reactions GROUP BY 1 ORDER BY n DESC, article_id LIMIT 10) SELECT t.article_id, t.n, a.name FROM t JOIN v_ads a ON a.ad_id = t.article_id"))
def most_reacted(spark, d):
    top = v.reactions(spark, d).groupBy("article_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "article_id").limit(10)
    return top.join(v.ads(spark, d).select(F.col("ad_id").alias("article_id"), "name"), "article_id").select("article_id", "n", "name")


@query(with_views("v_reactions", body=" SELECT article_id, user_id, max(type) AS type FROM v_reactions GROUP BY 1, 2"))
def reaction_upsert(spark, d):
    """One reaction a user and article; of several the greatest type counts as the latest."""
    return C.latest_wins(v.reactions(spark, d).withColumn("t", F.col("type")), ["article_id", "user_id"], "t", ["type"])


@query(ORACLES["reaction_upsert"])
def reaction_table(spark, d):
    """The same as a table that three batches change, one of them twice."""
    rows = v.reactions(spark, d).select("article_id", "user_id", "type")
    table = KeyedTable(spark, shared_path(spark, "reactions"), ["article_id", "user_id"], rows.schema, 16)
    for n in (0, 1, 1, 2):
        table.upsert(rows.where(F.pmod("user_id", F.lit(3)) == n), n, "type")
    return table.read()


@query(with_views("v_interactions", body=" SELECT article_id, count(*) FILTER (WHERE action = 'view') AS views, count(*) FILTER (WHERE action = 'share') AS shares FROM v_interactions WHERE article_id IS NOT NULL GROUP BY 1"))
def article_counters(spark, d):
    """Views and shares of each article as a table that batches add to."""
    rows = v.interactions(spark, d).where("article_id IS NOT NULL")
    rows = rows.select("article_id", (F.col("action") == "view").cast("bigint").alias("views"), (F.col("action") == "share").cast("bigint").alias("shares"), F.pmod(F.col("user_id"), F.lit(3)).alias("part"))
    table = KeyedTable(spark, shared_path(spark, "counters"), ["article_id"], rows.drop("part").schema, 16)
    for n in (0, 1, 2, 2):
        table.increment(rows.where(F.col("part") == n).drop("part"), n, ["views", "shares"])
    return table.read()


RECENT = "created_at >= TIMESTAMP '2024-01-16 12:00:00' - INTERVAL 24 HOURS"


@query(with_views("v_articles", body=f" SELECT coalesce(processing_status, 'unknown') AS status, count(*) AS n FROM v_articles WHERE {RECENT} GROUP BY 1"))
def status_counts(spark, d):
    return E.since(v.articles(spark, d), MID, "24 HOURS").groupBy(F.coalesce("processing_status", F.lit("unknown")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(with_views("v_articles", body=f" SELECT ai_provider, count(*) AS n FROM v_articles WHERE {RECENT} AND ai_provider IS NOT NULL GROUP BY 1"))
def provider_counts(spark, d):
    return E.since(v.articles(spark, d), MID, "24 HOURS").where("ai_provider IS NOT NULL").groupBy("ai_provider").agg(F.count(F.lit(1)).alias("n"))


@query(with_views("v_articles", body=" SELECT count(*) AS total, CASE WHEN count(*) = 0 THEN 0.0::DOUBLE ELSE floor(count(*) FILTER (WHERE processing_status IN ('done', 'cached'))::DOUBLE / count(*)::DOUBLE * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE END AS success_rate FROM v_articles"))
def success_rate(spark, d):
    good = F.count_if(F.col("processing_status").isin("done", "cached"))
    total = F.count(F.lit(1))
    return v.articles(spark, d).agg(total.alias("total"), F.when(total == 0, 0.0).otherwise(E.half_up(good / total, 2)).alias("success_rate"))


@query(with_views("v_sources", body=""" SELECT count(*) AS total, count(*) FILTER (WHERE is_active AND NOT auto_disabled) AS active, count(*) FILTER (WHERE auto_disabled) AS disabled,
 count(*) FILTER (WHERE success_rate < 0.5::DOUBLE AND NOT auto_disabled) AS degraded FROM v_sources"""))
def source_health(spark, d):
    return C.source_health(v.sources(spark, d))


ATTEMPTS = "SELECT event_id AS attempt_id, user_id % 20 AS source_id, event_type <> 'error' AS ok, ts AS moment FROM events"


def _attempts(spark, d):
    return v.table(spark, d, "events").select(F.col("event_id").alias("attempt_id"), (F.col("user_id") % 20).alias("source_id"), (F.col("event_type") != "error").alias("ok"), F.col("ts").alias("at"))


@query(f"WITH a AS ({ATTEMPTS}) SELECT source_id, count(*) AS total, floor(count(*) FILTER (WHERE ok)::DOUBLE / count(*)::DOUBLE * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE AS success_rate, count(*) >= 5 AND count(*) FILTER (WHERE ok)::DOUBLE / count(*)::DOUBLE < 0.8::DOUBLE AS disable FROM a GROUP BY 1")
def auto_disable(spark, d):
    return C.auto_disable(_attempts(spark, d), 5, 0.8)


@query(f"""WITH a AS ({ATTEMPTS}), i AS (SELECT *, count(*) FILTER (WHERE ok) OVER (PARTITION BY source_id ORDER BY moment, attempt_id) AS island FROM a)
SELECT attempt_id, source_id, count(*) FILTER (WHERE NOT ok) OVER (PARTITION BY source_id, island ORDER BY moment, attempt_id) AS failures FROM i""")
def consecutive_failures(spark, d):
    return C.failures_in_a_row(_attempts(spark, d)).select("attempt_id", "source_id", "failures")


@query("SELECT c_custkey AS user_id, count(o_orderkey) AS clicks FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def counter_increments(spark, d):
    users = v.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return C.counters(users, v.table(spark, d, "orders").select(F.col("o_custkey").alias("user_id")), "user_id", "clicks")


@query(with_views("v_referrals", body=" SELECT referral_id, referrer_id AS user_id, strftime(created_on, '%Y-%m-%d') AS started_on, strftime(lead(created_on) OVER (PARTITION BY referrer_id ORDER BY created_on, referral_id), '%Y-%m-%d') AS ended_on FROM v_referrals"))
def subscription_intervals(spark, d):
    p = v.referrals(spark, d).select(F.col("referral_id").alias("payment_id"), F.col("referrer_id").alias("user_id"), F.col("created_on").alias("started_on"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return C.subscription_intervals(p).select(F.col("payment_id").alias("referral_id"), "user_id", day("started_on"), day("ended_on"))


@query(with_views("v_reactions", body=" SELECT article_id, count(DISTINCT user_id) AS reporters FROM v_reactions WHERE type = 'R' GROUP BY 1 HAVING count(DISTINCT user_id) >= 3"))
def report_auto_hide(spark, d):
    return C.auto_hide(v.reactions(spark, d).where("type = 'R'"), 3)


@query(with_views("v_reactions", "v_articles", body=""" , r AS (SELECT article_id, count(*) FILTER (WHERE type = 'R') AS reports FROM v_reactions GROUP BY 1)
SELECT a.article_id, a.processing_status, coalesce(r.reports, 0) AS reports FROM v_articles a LEFT JOIN r ON r.article_id = a.article_id
WHERE a.processing_status = 'hidden' OR coalesce(r.reports, 0) >= 1 ORDER BY reports DESC, a.created_at DESC, a.article_id LIMIT 20"""))
def moderation_queue(spark, d):
    reports = v.reactions(spark, d).groupBy("article_id").agg(F.count_if(F.col("type") == "R").alias("reports"))
    rows = v.articles(spark, d).join(reports, "article_id", "left").withColumn("reports", F.coalesce("reports", F.lit(0)))
    rows = rows.where((F.col("processing_status") == "hidden") | (F.col("reports") >= 1))
    return feed.page(rows, 1, 20, F.desc("reports"), F.desc("created_at"), "article_id").select("article_id", "processing_status", "reports")


# --- notifications


@query(with_views("v_interactions", body=f" SELECT article_id, count(*) AS n FROM v_interactions WHERE action = 'view' AND created_at >= TIMESTAMP '{MID}' - INTERVAL 24 HOURS GROUP BY 1 HAVING count(*) >= 2 ORDER BY n DESC, article_id LIMIT 5"))
def trending_push(spark, d):
    return notify.most_viewed(v.interactions(spark, d), MID, "24 HOURS", 5, 2)


@query(with_views("v_interactions", body=f" SELECT article_id, count(*) AS n FROM v_interactions WHERE action = 'view' AND created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOURS GROUP BY 1 ORDER BY n DESC, article_id LIMIT 1"))
def daily_digest(spark, d):
    return notify.most_viewed(v.interactions(spark, d), AS_OF, "24 HOURS", 1)


@query(with_views("v_interactions", body=f" SELECT article_id, count(*) AS n FROM v_interactions WHERE action = 'view' AND created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAYS GROUP BY 1 ORDER BY n DESC, article_id LIMIT 5"))
def weekly_digest(spark, d):
    return notify.most_viewed(v.interactions(spark, d), AS_OF, "7 DAYS", 5)


@query(with_views("v_articles", body=f""" SELECT topic, count(*) AS n, arg_max(article_id, (epoch_us(created_at), article_id)) AS latest FROM v_articles
WHERE processing_status = 'done' AND topic IS NOT NULL AND created_at >= TIMESTAMP '{MID}' - INTERVAL 24 HOURS GROUP BY 1 HAVING count(*) >= 2"""))
def topic_update(spark, d):
    return notify.topic_updates(v.articles(spark, d), MID, "24 HOURS", 2)


@query(with_views("v_users", "v_articles", body=f""" , t AS (SELECT topic, count(*) AS n FROM v_articles WHERE processing_status = 'done' AND created_at >= TIMESTAMP '{MID}' - INTERVAL 24 HOURS GROUP BY 1 HAVING count(*) >= 2),
 i AS (SELECT user_id, unnest(interests) AS topic FROM v_users WHERE notifications_enabled AND pref_topic IS DISTINCT FROM false)
SELECT i.user_id, i.topic FROM i JOIN t ON t.topic = i.topic"""))
def notification_targets(spark, d):
    topics = notify.topic_updates(v.articles(spark, d), MID, "24 HOURS", 2).select("topic")
    return notify.subscribers(v.users(spark, d), topics)


@query(with_views("v_users", "v_interactions", body=f""" , t AS (SELECT article_id, count(*) AS n FROM v_interactions WHERE action = 'view' AND created_at >= TIMESTAMP '{MID}' - INTERVAL 24 HOURS GROUP BY 1 HAVING count(*) >= 2 ORDER BY n DESC, article_id LIMIT 5)
SELECT u.user_id, t.article_id FROM v_users u CROSS JOIN t WHERE u.notifications_enabled AND u.pref_trending IS DISTINCT FROM false"""))
def trending_targets(spark, d):
    """Every opted-in user with each of at most five articles."""
    five = F.broadcast(notify.most_viewed(v.interactions(spark, d), MID, "24 HOURS", 5, 2).select("article_id"))
    return notify.opted_in(v.users(spark, d), "pref_trending").select("user_id").crossJoin(five)


#: The fold in SQL: a step a candidate of a user, with what was accepted within 24 hours as a list.
CAPS = """ , n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at, article_id NULLS FIRST, action) AS i FROM v_interactions),
 r AS (SELECT user_id, article_id, action, created_at, i, true AS accepted, [{'t': created_at, 'k': action}] AS sent FROM n WHERE i = 1
  UNION ALL SELECT user_id, article_id, action, created_at, i, ok, CASE WHEN ok THEN list_append(live, {'t': created_at, 'k': action}) ELSE live END FROM
   (SELECT n.*, live, len(live) < 3 AND len(list_filter(live, lambda x: x.k = n.action)) < CASE n.action WHEN 'share' THEN 1 ELSE 3 END AS ok FROM
    (SELECT n.*, list_filter(r.sent, lambda x: x.t > n.created_at - INTERVAL 24 HOURS) AS live FROM r JOIN n ON n.user_id = r.user_id AND n.i = r.i + 1) n))"""


@query("WITH RECURSIVE" + with_views("v_interactions", body=CAPS + " SELECT user_id, article_id, action AS type, created_at, accepted FROM r")[4:])
def notification_caps(spark, d):
    """Candidates accepted under the caps, one after another in time for each user."""
    c = v.interactions(spark, d).select("user_id", "article_id", F.col("action").alias("type"), "created_at")
    return notify.within_caps(c, {"view": 3, "share": 1}, 3).select("user_id", "article_id", "type", "created_at", "accepted")


@query(with_views("v_interactions", body=""" , c AS (SELECT user_id, article_id, action, created_at, lag(created_at) OVER (PARTITION BY user_id, article_id, action ORDER BY created_at) AS last FROM v_interactions)
SELECT user_id, article_id, action, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM c WHERE last IS NULL OR created_at - last >= INTERVAL 24 HOURS"""))
def notification_gaps(spark, d):
    """Events at least 24 hours after the one before of the same user, article and kind."""
    w = Window.partitionBy("user_id", "article_id", "action").orderBy("created_at")
    last = F.lag("created_at").over(w)
    return v.interactions(spark, d).withColumn("last", last).where("last IS NULL OR created_at - last >= INTERVAL '24' HOUR").select("user_id", "article_id", "action", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))
