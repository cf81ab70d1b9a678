"""Streams run over the events to completion; their SQL is that of the batch over all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsmill.plans.commerce import CAPS
from newsmill.sources import views as v
from newsmill.sources.views import with_views
from newsmill.streaming import jobs

QUERIES, ORACLES = {}, {}


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _start(df):
    return df.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


def _stream(spark, d, late=jobs.LATE):
    """Windows and days are those of the session's time zone, which the driver contract and the library's sessions set to UTC."""
    return jobs.interactions_stream(spark, d, late)


@query(with_views("v_interactions", body=""" , s AS (SELECT article_id, time_bucket(INTERVAL 30 MINUTES, created_at) AS b FROM v_interactions WHERE action = 'view'),
 w AS (SELECT article_id, b AS start FROM s UNION ALL SELECT article_id, b - INTERVAL 30 MINUTES FROM s)
SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, article_id, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(*) >= 2"""))
def stream_trending_push(spark, d):
    return _start(jobs.available_now(jobs.trending_push(_stream(spark, d), 2), ("start", "article_id")))


@query(with_views("v_interactions", "v_articles", body=""" SELECT strftime(time_bucket(INTERVAL 2 HOURS, i.created_at), '%Y-%m-%d %H:%M:%S') AS start, a.topic, count(*) AS n
FROM v_interactions i JOIN v_articles a ON a.article_id = i.article_id GROUP BY 1, 2 HAVING count(*) >= 3"""))
def stream_topic_updates(spark, d):
    return _start(jobs.available_now(jobs.topic_updates(_stream(spark, d), v.articles(spark, d), 3), ("start", "topic")))


@query(with_views("v_interactions", body=""" SELECT strftime(created_at, '%Y-%m-%d') AS day, user_id, count(*) AS sessions, count(*) FILTER (WHERE action = 'view') AS articles_viewed FROM v_interactions GROUP BY 1, 2"""))
def stream_daily_activity(spark, d):
    return jobs.available_now(jobs.daily_activity(_stream(spark, d)), ("day", "user_id")).select("day", "user_id", "sessions", "articles_viewed")


@query(with_views("v_interactions", body=""" SELECT strftime(time_bucket(INTERVAL 5 MINUTES, created_at), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS total, count(*) FILTER (WHERE action = 'other') AS errors,
 floor(count(*) FILTER (WHERE action = 'other')::DOUBLE / count(*)::DOUBLE * 10000.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS rate FROM v_interactions GROUP BY 1"""))
def stream_error_rates(spark, d):
    return _start(jobs.available_now(jobs.error_rates(_stream(spark, d)), ("start",))).select("start", "total", "errors", "rate")


def _calls(spark, d):
    i = _stream(spark, d)
    provider = F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string"))
    return i.select("created_at", provider.alias("provider"), (F.col("action") != "other").alias("ok"))


@query(with_views("v_interactions", body=""" SELECT strftime(time_bucket(INTERVAL 10 MINUTES, created_at), '%Y-%m-%d %H:%M:%S') AS start, 'p' || (user_id % 3) AS provider, count(*) AS total,
 count(*) < 3 OR count(*) FILTER (WHERE action <> 'other')::DOUBLE / count(*)::DOUBLE >= 0.5::DOUBLE AS healthy FROM v_interactions GROUP BY 1, 2"""))
def stream_provider_health(spark, d):
    return _start(jobs.available_now(jobs.provider_health(_calls(spark, d)), ("start", "provider"))).select("start", "provider", "total", "healthy")


@query(with_views("v_interactions", body=""" , c AS (SELECT time_bucket(INTERVAL 10 SECONDS, created_at) AS b, 'p' || (user_id % 3) AS provider FROM v_interactions), w AS (SELECT b - to_seconds(10 * k) AS start, provider FROM c, range(6) AS t(k))
SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, provider, count(*) AS used, count(*) >= 0.8 * 3 AS warn FROM w GROUP BY 1, 2"""))
def stream_rate_usage(spark, d):
    return _start(jobs.available_now(jobs.rate_usage(_calls(spark, d), 3), ("start", "provider")))


@query("SELECT DISTINCT md5(CAST(regexp_extract(props, '([0-9]+)', 1) AS VARCHAR)) AS url_hash FROM events WHERE regexp_extract(props, '([0-9]+)', 1) <> ''")
def stream_first_of_url(spark, d):
    """Each URL's first arrival (the stream reads all files at once, so nothing expires in between)."""
    a = _stream(spark, d, "48 hours").where("article_id IS NOT NULL").select(F.col("article_id").cast("string").alias("url"), "created_at")
    return jobs.available_now(jobs.first_of_url(a)).select("url_hash")


@query("""SELECT doc_id AS article_id, CASE WHEN contains(lower(text), 'stupid') THEN 'blocked' WHEN length(text) < 100 THEN 'failed' ELSE 'done' END AS status FROM documents""")
def stream_crawl_cycle(spark, d):
    """New articles, batch by batch, through the cheap gates to the articles' table."""
    path = f"{d}/documents.parquet"
    source = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path[:-1] + "[t]")
    status = F.when(F.contains(F.lower("text"), F.lit("stupid")), "blocked").when(F.char_length("text") < 100, "failed").otherwise("done")
    gates = lambda rows: rows.select(F.col("doc_id").alias("article_id"), status.alias("status"))
    return jobs.available_now(source, process=gates, schema=gates(spark.read.parquet(path)).schema)


@query(with_views("v_interactions", body=" SELECT DISTINCT user_id, article_id, action FROM v_interactions"))
def stream_without_repeats(spark, d):
    """The stream reads all files at once, so nothing expires in between."""
    return jobs.available_now(jobs.without_repeats(_stream(spark, d, "24 hours"))).select("user_id", "article_id", "action")


@query("WITH RECURSIVE" + with_views("v_interactions", body=CAPS + " SELECT user_id, article_id, action, strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at, accepted FROM r")[4:])
def stream_notification_caps(spark, d):
    out = jobs.available_now(jobs.capped(_stream(spark, d), {"view": 3, "share": 1}, 3))
    return out.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query("""WITH RECURSIVE n AS (SELECT user_id % 5 AS source_id, CAST(ts AS TIMESTAMP) AS t, event_type IN ('view', 'click', 'purchase', 'signup') AS ok, row_number() OVER (PARTITION BY user_id % 5 ORDER BY ts, event_id) AS i FROM events),
 r AS (SELECT source_id, t, i, 'closed' AS state, CASE WHEN ok THEN 0 ELSE 1 END AS failures, t AS opened FROM n WHERE i = 1
  UNION ALL SELECT source_id, t, i, CASE WHEN now = 'open' THEN 'open' WHEN ok THEN 'closed' WHEN now = 'half_open' OR failures + 1 >= 2 THEN 'open' ELSE now END,
    CASE WHEN now = 'open' THEN failures WHEN ok THEN 0 ELSE failures + 1 END, CASE WHEN now <> 'open' AND NOT ok AND (now = 'half_open' OR failures + 1 >= 2) THEN t ELSE opened END FROM
   (SELECT n.*, r.failures, r.opened, CASE WHEN r.state = 'open' AND n.t - r.opened >= INTERVAL 1 HOUR THEN 'half_open' ELSE r.state END AS now FROM r JOIN n ON n.source_id = r.source_id AND n.i = r.i + 1))
SELECT source_id, strftime(t, '%Y-%m-%d %H:%M:%S.%f') AS "at", state FROM r""")
def stream_circuit_breaker(spark, d):
    a = _stream(spark, d).select((F.col("user_id") % 5).alias("source_id"), F.col("event_id").cast("bigint").alias("attempt_id"), "created_at", (F.col("action") != "other").alias("ok"))
    out = jobs.available_now(jobs.circuit_breaker(a, 2, 3600))
    return out.withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query()
def stream_recent_duplicates(spark, d):
    """What arriving articles duplicate among the last kept ones of their language, by title or vector."""
    path = f"{d}/documents.parquet"
    source = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path[:-1] + "[t]")
    title = F.substring(F.split("text", "\n")[0], 1, 80).alias("title_original")
    at = F.expr("TIMESTAMP'2024-01-01 00:00:00' + make_dt_interval(0, cast(pmod(doc_id, 720) as int), 0, 0)")
    a = source.select(F.col("doc_id").alias("article_id"), title, F.coalesce("lang", F.lit("")).alias("lang"), at.alias("created_at")).withWatermark("created_at", "1 hour")
    a = a.join(v.embeddings(spark, d).select("article_id", "embedding"), "article_id", "left")
    return jobs.available_now(jobs.recent_duplicates(a, "lang", embed_threshold=0.4))
