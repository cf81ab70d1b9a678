"""Queries over interactions and articles, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsmill.operators import bitmaps, engagement as E
from newsmill.operators import feed
from newsmill.session import materialize
from newsmill.sources import views as v
from newsmill.sources.views import AS_OF, MID, with_views

QUERIES, ORACLES = {}, {}


def query(sql: str = ""):
    """Registers a query under its function's name, with its SQL if it has any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {0}"
ACTIVITY = """, act AS (SELECT user_id, CAST(created_at AS DATE) AS day, count(*) AS sessions,
  count(*) FILTER (WHERE action = 'view') AS articles_viewed, min(created_at) AS first_seen_at, max(created_at) AS last_seen_at
  FROM v_interactions GROUP BY 1, 2)"""


def activity(spark, d):
    return E.user_activity(v.interactions(spark, d))


TRENDING = """, top AS (SELECT article_id, count(*) AS n FROM v_interactions WHERE created_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 24 HOURS
  GROUP BY article_id ORDER BY n DESC, article_id LIMIT 50),
  ranked AS (SELECT *, row_number() OVER (ORDER BY n DESC, article_id) AS rank FROM top)
SELECT r.article_id, a.title_original, a.topic, r.n, r.rank FROM ranked r JOIN v_articles a ON r.article_id = a.article_id
WHERE a.processing_status IN ('done', 'fallback', 'cached')"""


@query(with_views("v_interactions", "v_articles", body=TRENDING))
def trending_top50(spark, d):
    found = E.trending(v.interactions(spark, d), v.articles(spark, d), AS_OF)
    return found.select("article_id", "title_original", "topic", "n", "rank").orderBy("rank")


@query(with_views("v_interactions", "v_articles", body=TRENDING + " AND a.topic = 'finance'"))
def trending_by_topic(spark, d):
    found = E.trending(v.interactions(spark, d), v.articles(spark, d), AS_OF, topic="finance")
    return found.select("article_id", "title_original", "topic", "n", "rank").orderBy("rank")


@query(with_views("v_interactions", body="""
SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) FILTER (WHERE action = 'view') AS views, count(*) FILTER (WHERE action = 'click_original') AS clicks,
  count(*) FILTER (WHERE action = 'share') AS shares, count(*) FILTER (WHERE action = 'bookmark') AS bookmarks, count(DISTINCT user_id) AS unique_users
FROM v_interactions GROUP BY 1"""))
def daily_rollup(spark, d):
    return E.daily_rollup(v.interactions(spark, d)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(with_views("v_interactions", body="""
SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) FILTER (WHERE action = 'view') AS views, count(*) FILTER (WHERE action = 'click_original') AS clicks,
  count(*) FILTER (WHERE action = 'share') AS shares, count(*) FILTER (WHERE action = 'bookmark') AS bookmarks, count(DISTINCT user_id) AS unique_users
FROM v_interactions WHERE created_at >= TIMESTAMP '2024-01-10' AND created_at < TIMESTAMP '2024-01-15' GROUP BY 1"""))
def analytics_range(spark, d):
    """Daily analytics between two date strings, in order."""
    daily = E.daily_rollup(v.interactions(spark, d)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))
    return daily.where(F.col("day").between("2024-01-10", "2024-01-14")).orderBy("day")


@query(with_views("v_interactions", body=ACTIVITY + " SELECT user_id, strftime(day, '%Y-%m-%d') AS day, sessions, articles_viewed, " + STAMP.format("first_seen_at") + ", " + STAMP.format("last_seen_at") + " FROM act"))
def user_activity(spark, d):
    return activity(spark, d).select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "sessions", "articles_viewed", stamp("first_seen_at"), stamp("last_seen_at"))


@query(with_views("v_interactions", body=ACTIVITY + " SELECT strftime(day, '%Y-%m-%d') AS period, count(DISTINCT user_id) AS active_users FROM act GROUP BY 1"))
def dau(spark, d):
    return E.active_users(activity(spark, d), F.date_format("day", "yyyy-MM-dd"))


@query(with_views("v_interactions", body=ACTIVITY + " SELECT strftime(day, '%Y-%m') AS period, count(DISTINCT user_id) AS active_users FROM act GROUP BY 1"))
def mau(spark, d):
    return E.active_users(activity(spark, d), F.date_format("day", "yyyy-MM"))


@query(with_views("v_interactions", body=ACTIVITY + """ SELECT c.day_s AS day, count(*) AS cohort, count(l.user_id) AS retained,
  floor(count(l.user_id)::DOUBLE / count(*)::DOUBLE * 100.0::DOUBLE * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS rate
FROM (SELECT user_id, day, strftime(day, '%Y-%m-%d') AS day_s FROM act) c LEFT JOIN act l ON l.user_id = c.user_id AND l.day = c.day + 7 GROUP BY 1"""))
def retention_d7(spark, d):
    return E.retention(activity(spark, d)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def _daily(spark, d):
    """The bitmaps of all days, as the table that a daily job keeps."""
    return materialize(bitmaps.daily_users(v.interactions(spark, d)), "daily-users")


@query(ORACLES["dau"])
def dau_bitmaps(spark, d):
    return bitmaps.active_users(_daily(spark, d), F.date_format("day", "yyyy-MM-dd"))


@query(ORACLES["mau"])
def mau_bitmaps(spark, d):
    return bitmaps.active_users(_daily(spark, d), F.date_format("day", "yyyy-MM"))


@query(ORACLES["retention_d7"])
def retention_bitmaps(spark, d):
    return bitmaps.retention(_daily(spark, d)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(with_views("v_interactions", body=ACTIVITY + " SELECT floor(avg(sessions) * 1000000 + 0.5) / 1000000 AS avg_sessions, floor(avg(articles_viewed) * 1000000 + 0.5) / 1000000 AS avg_articles FROM act"))
def engagement_avg(spark, d):
    a = E.engagement_averages(activity(spark, d))
    return a.select(E.half_up(F.col("avg_sessions"), 6).alias("avg_sessions"), E.half_up(F.col("avg_articles"), 6).alias("avg_articles"))


STREAKS = """, isl AS (SELECT user_id, day, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS island FROM act),
 runs AS (SELECT user_id, island, count(*) AS length, max(day) AS last_day FROM isl GROUP BY 1, 2),
 streak AS (SELECT user_id, arg_max(length, last_day) AS current_streak, max(length) AS longest_streak, max(last_day) AS last_active FROM runs GROUP BY 1)"""


@query(with_views("v_interactions", body=ACTIVITY + STREAKS + " SELECT user_id, current_streak, longest_streak, strftime(last_active, '%Y-%m-%d') AS last_active FROM streak"))
def streaks(spark, d):
    return E.streaks(activity(spark, d)).withColumn("last_active", F.date_format("last_active", "yyyy-MM-dd"))


@query(with_views("v_interactions", body=ACTIVITY + STREAKS + """ SELECT c.user_id, c.views, c.bookmarks, c.shares, s.current_streak FROM
 (SELECT user_id, count(*) FILTER (WHERE action = 'view') AS views, count(*) FILTER (WHERE action = 'bookmark') AS bookmarks,
  count(*) FILTER (WHERE action = 'share') AS shares FROM v_interactions GROUP BY 1) c LEFT JOIN streak s ON s.user_id = c.user_id"""))
def user_stats(spark, d):
    return E.user_stats(v.interactions(spark, d), activity(spark, d))


@query(with_views("v_interactions", "v_articles", body="""
SELECT h.user_id, h.article_id, """ + STAMP.format("last_viewed") + """, a.title_original FROM
 (SELECT user_id, article_id, max(created_at) AS last_viewed FROM v_interactions WHERE action = 'view' GROUP BY 1, 2) h
 LEFT JOIN v_articles a ON a.article_id = h.article_id"""))
def reading_history(spark, d):
    history = E.reading_history(v.interactions(spark, d))
    return history.join(v.articles(spark, d).select("article_id", "title_original"), "article_id", "left").select("user_id", "article_id", stamp("last_viewed"), "title_original")


@query(with_views("v_interactions", body=""", seen AS (SELECT user_id, article_id, count(*) AS n, max(created_at) AS last_viewed FROM v_interactions WHERE action = 'view' GROUP BY 1, 2 HAVING count(*) = 1),
 latest AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_viewed DESC, article_id) AS rn FROM seen)
SELECT user_id, article_id, """ + STAMP.format("last_viewed") + """ FROM latest l WHERE rn <= 5
 AND NOT EXISTS (SELECT 1 FROM v_interactions c WHERE c.action = 'click_original' AND c.user_id = l.user_id AND c.article_id = l.article_id)"""))
def continue_reading(spark, d):
    return E.continue_reading(v.interactions(spark, d)).withColumn("last_viewed", stamp("last_viewed"))


AGE = "CAST(date_diff('microsecond', created_at, TIMESTAMP '{0}') AS DOUBLE) / 3.6e9"
SCORES = f""", views AS (SELECT article_id, count(*) AS views FROM v_interactions WHERE action = 'view' GROUP BY 1),
 scores AS (SELECT a.article_id, a.topic, a.created_at, coalesce(w.views, 0) AS views,
  floor((0.4::DOUBLE * greatest(0.0::DOUBLE, 1.0::DOUBLE - {AGE.format(AS_OF)} / 72.0::DOUBLE)
   + 0.25::DOUBLE * (CASE WHEN coalesce(w.views, 0) > 0 THEN least(log10(w.views + 1.0::DOUBLE) / 4.0::DOUBLE, 1.0::DOUBLE) ELSE 0.0::DOUBLE END)
   + 0.2::DOUBLE * coalesce(q.quality_score, 0.5::DOUBLE) + 0.15::DOUBLE * 0.7::DOUBLE) * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE AS feed_score
  FROM v_articles a LEFT JOIN views w ON w.article_id = a.article_id LEFT JOIN v_quality q ON q.article_id = a.article_id
  WHERE a.processing_status IN ('done', 'fallback', 'cached') AND a.created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 72 HOURS)"""


def _scores(spark, d, as_of=AS_OF):
    return feed.feed_scores(v.articles(spark, d), v.interactions(spark, d), v.qualities(spark, d), as_of)


@query(with_views("v_interactions", "v_articles", "v_quality", body=SCORES + " SELECT article_id, views, feed_score FROM scores"))
def view_counts_feed_score(spark, d):
    return _scores(spark, d).select("article_id", "views", "feed_score")


RANKED = SCORES + f""", cand AS (SELECT * FROM scores ORDER BY feed_score DESC, created_at DESC, article_id LIMIT 500),
 scored AS (SELECT u.user_id, c.article_id, c.topic, c.created_at,
  (CASE WHEN coalesce(c.feed_score, 0) <> 0 THEN c.feed_score ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE - {AGE.format(AS_OF)} / 48.0::DOUBLE) END)
   + (CASE WHEN list_contains(u.interests, c.topic) THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END) - (CASE WHEN s.user_id IS NOT NULL THEN 5.0::DOUBLE ELSE 0.0::DOUBLE END) AS score
  FROM v_users u CROSS JOIN cand c LEFT JOIN (SELECT DISTINCT user_id, article_id FROM v_interactions WHERE action = 'view') s ON s.user_id = u.user_id AND s.article_id = c.article_id),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, created_at DESC, article_id) AS rank FROM scored)"""


def _ranked(spark, d):
    """The twenty first rows of all users' feeds."""
    viewed = v.interactions(spark, d).where("action = 'view'")
    return feed.ranked_feed(_scores(spark, d), v.users(spark, d), viewed, AS_OF, keep=20)


@query(with_views("v_interactions", "v_articles", "v_quality", "v_users", body=RANKED + " SELECT user_id, article_id, topic, floor(score * 1000 + 0.5) / 1000 AS score, rank FROM ranked WHERE rank <= 20"))
def feed_ranked(spark, d):
    return _ranked(spark, d).where("rank <= 20").select("user_id", "article_id", "topic", E.half_up(F.col("score"), 3).alias("score"), "rank")


@query(with_views("v_interactions", "v_articles", "v_quality", "v_users", body=RANKED + " SELECT article_id, rank FROM ranked WHERE user_id = 7 ORDER BY rank LIMIT 10 OFFSET 10"))
def feed_page2(spark, d):
    return feed.page(_ranked(spark, d).where("user_id = 7").select("article_id", "rank"), 2, 10, "rank")


@query(with_views("v_articles", body=""" , got AS (SELECT article_id, title_original FROM v_articles WHERE processing_status IN ('done', 'fallback') AND article_id < 150 ORDER BY article_id DESC LIMIT 21)
SELECT article_id, title_original, (SELECT count(*) FROM got) > 20 AS has_more FROM got ORDER BY article_id DESC LIMIT 20"""))
def feed_cursor(spark, d):
    visible = v.articles(spark, d).where(F.col("processing_status").isin("done", "fallback")).select("article_id", "title_original")
    return feed.cursor_page(visible, 150, 20)


@query(with_views("v_interactions", "v_articles", "v_quality", "v_users", "v_ads", body=RANKED + """, items AS (SELECT article_id, row_number() OVER (ORDER BY rank) AS pos FROM ranked WHERE user_id = 7 AND rank <= 20),
 a AS (SELECT ad_id, row_number() OVER (ORDER BY ad_id) AS pos FROM (SELECT ad_id FROM v_ads WHERE status = 'active' AND end_on >= DATE '2024-01-31' AND spent_cents < budget_cents ORDER BY ad_id LIMIT 3)),
 u AS (SELECT 'article' AS kind, article_id AS id, pos AS major, 0 AS minor FROM items UNION ALL SELECT 'ad', ad_id, pos * 5, 1 FROM a WHERE pos <= (SELECT count(*) // 5 FROM items))
SELECT row_number() OVER (ORDER BY major, minor) AS position, kind, id FROM u"""))
def feed_with_ads(spark, d):
    from pyspark.sql import Window

    from newsmill.operators.commerce import active_ads

    items = _ranked(spark, d).where("user_id = 7 AND rank <= 20").select(F.col("article_id").alias("item_id"), F.col("rank").alias("pos"))
    three = active_ads(v.ads(spark, d), "2024-01-31").orderBy("ad_id").limit(3)
    return feed.interleave(items, three.select("ad_id", F.row_number().over(Window.orderBy("ad_id")).alias("pos")))


@query(with_views("v_interactions", "v_articles", body=f""", recent AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, article_id, action) AS rn FROM v_interactions WHERE action IN ('view', 'bookmark', 'share')),
 sums AS (SELECT r.user_id, a.topic, sum(CASE r.action WHEN 'view' THEN 1.0::DOUBLE WHEN 'bookmark' THEN 3.0::DOUBLE ELSE 5.0::DOUBLE END) AS w FROM recent r JOIN v_articles a ON a.article_id = r.article_id WHERE rn <= 50 GROUP BY 1, 2),
 weights AS (SELECT user_id, topic, w / sum(w) OVER (PARTITION BY user_id) AS weight FROM sums),
 top AS (SELECT article_id, count(*) AS n FROM v_interactions WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOURS GROUP BY 1 ORDER BY n DESC, article_id LIMIT 50),
 cand AS (SELECT a.* FROM top t JOIN v_articles a ON a.article_id = t.article_id),
 scored AS (SELECT u.user_id, c.article_id, c.created_at, floor((0.6::DOUBLE * coalesce(w.weight, 0.1::DOUBLE) + 0.4::DOUBLE * greatest(0.0::DOUBLE, 1.0::DOUBLE - {AGE.format(AS_OF)} / 72.0::DOUBLE)) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE AS score
  FROM (SELECT DISTINCT user_id FROM weights) u CROSS JOIN cand c LEFT JOIN weights w ON w.user_id = u.user_id AND w.topic = c.topic),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, created_at DESC, article_id) AS rank FROM scored)
SELECT user_id, article_id, score, rank FROM ranked WHERE rank <= 10"""))
def personalize(spark, d):
    """The day's 50 most used articles, ordered anew for every user."""
    i, a = v.interactions(spark, d), v.articles(spark, d)
    fifty = F.broadcast(E.top_articles(E.since(i, AS_OF, "24 HOURS"), 50).join(a, "article_id"))
    return feed.personalise(fifty, E.preferences(i, a), AS_OF)


@query(with_views("v_interactions", "v_articles", body=""", recent AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, article_id, action) AS rn FROM v_interactions WHERE action IN ('view', 'bookmark', 'share')),
 sums AS (SELECT r.user_id, a.topic, sum(CASE r.action WHEN 'view' THEN 1.0::DOUBLE WHEN 'bookmark' THEN 3.0::DOUBLE ELSE 5.0::DOUBLE END) AS w FROM recent r JOIN v_articles a ON a.article_id = r.article_id WHERE rn <= 50 GROUP BY 1, 2)
SELECT user_id, topic, floor(w / sum(w) OVER (PARTITION BY user_id) * 1000000 + 0.5) / 1000000 AS weight FROM sums"""))
def topic_preferences(spark, d):
    return E.preferences(v.interactions(spark, d), v.articles(spark, d)).withColumn("weight", E.half_up(F.col("weight"), 6))


@query(with_views("v_interactions", body=f" SELECT count(*) AS kept, strftime(min(created_at), '%Y-%m-%d %H:%M:%S') AS oldest FROM v_interactions WHERE created_at >= TIMESTAMP '{MID}' - INTERVAL 7 DAYS"))
def ttl_expiry(spark, d):
    kept = E.expire(v.interactions(spark, d), MID, 7)
    return kept.agg(F.count(F.lit(1)).alias("kept"), F.date_format(F.min("created_at"), "yyyy-MM-dd HH:mm:ss").alias("oldest"))


@query(with_views("v_interactions", body="""
SELECT DISTINCT i.user_id, i.article_id, EXISTS (SELECT 1 FROM v_interactions b WHERE b.article_id = i.article_id AND b.user_id = i.user_id AND b.action = 'bookmark') AS bookmarked,
 EXISTS (SELECT 1 FROM v_interactions b WHERE b.article_id = i.article_id AND b.user_id = i.user_id AND b.action = 'share') AS shared FROM v_interactions i WHERE i.action = 'view'"""))
def article_flags(spark, d):
    """What every user viewed, marked as bookmarked and shared by that user (mark joins)."""
    i, keys = v.interactions(spark, d), ["user_id", "article_id"]
    out = i.where("action = 'view'").select(*keys).distinct()
    for action, name in (("bookmark", "bookmarked"), ("share", "shared")):
        mark = i.where(F.col("action") == action).select(*keys).distinct().withColumn(name, F.lit(True))
        out = out.join(mark, keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out


@query(with_views("v_interactions", body=" , w AS (SELECT user_id, article_id, created_at, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, article_id) AS rn FROM v_interactions WHERE action = 'view') SELECT user_id, article_id, " + STAMP.format("created_at") + ", rn FROM w WHERE rn <= 20"))
def latest_views(spark, d):
    """Each user's 20 latest views."""
    views = v.interactions(spark, d).where("action = 'view'")
    return feed.top_per_key(views, "user_id", 20, F.desc("created_at"), "article_id").select("user_id", "article_id", stamp("created_at"), "rn")
