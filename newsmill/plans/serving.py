"""Queries over affiliates, subscriptions, crawling, feed items, prompts and sinks, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from newsmill.functions import text as X, urls as U
from newsmill.operators import commerce as C
from newsmill.operators import engagement as E
from newsmill.operators import feed, notify
from newsmill.sources import feeds
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


def _docs(spark, d):
    return v.table(spark, d, "documents").select("doc_id", "text")


def _ids(column: str):
    return F.concat_ws(",", F.transform(column, lambda x: x.cast("string")))


# --- affiliates, subscriptions, administration


@query(with_views("v_affiliates", body=" SELECT coalesce(sum(clicks), 0)::BIGINT AS clicks, coalesce(sum(impressions), 0)::BIGINT AS impressions FROM v_affiliates"))
def affiliate_totals(spark, d):
    return C.affiliate_totals(v.affiliates(spark, d))


@query(with_views("v_affiliates", body=" SELECT link_id, title, commission FROM v_affiliates WHERE topic = 'finance' AND is_active"))
def active_affiliates(spark, d):
    return v.affiliates(spark, d).where("topic = 'finance' AND is_active").select("link_id", "title", "commission")


@query(with_views("v_affiliates", "v_articles", body=""" , r AS (SELECT topic, link_id, row_number() OVER (PARTITION BY topic ORDER BY commission DESC, link_id) AS rn FROM v_affiliates WHERE is_active),
 l AS (SELECT topic, string_agg(link_id, ',' ORDER BY rn) AS ids FROM r WHERE rn <= 2 GROUP BY 1)
SELECT a.article_id, a.topic, coalesce(l.ids, '') AS affiliate_ids FROM v_articles a LEFT JOIN l ON l.topic = a.topic"""))
def article_affiliates(spark, d):
    rows = feed.article_affiliates(v.articles(spark, d).select("article_id", "topic"), v.affiliates(spark, d))
    return rows.select("article_id", "topic", _ids("affiliate_ids").alias("affiliate_ids"))


@query(with_views("v_affiliates", body=" SELECT link_id, title, row_number() OVER (ORDER BY commission DESC, link_id DESC) AS position FROM v_affiliates ORDER BY commission DESC, link_id DESC LIMIT 50"))
def newest_listing(spark, d):
    """An administrator's list, the first page: greatest first, ties by id."""
    order = (F.desc("commission"), F.desc("link_id"))
    top = feed.page(v.affiliates(spark, d), 1, 50, *order)
    return top.select("link_id", "title", F.row_number().over(Window.orderBy(*order)).alias("position"))


@query(with_views("v_subscriptions", body=""" , r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY subscription_id) AS rn FROM v_subscriptions WHERE status IN ('active', 'trial') AND expires_on > DATE '1996-06-30')
SELECT user_id, subscription_id, status, strftime(expires_on, '%Y-%m-%d') AS expires_on FROM r WHERE rn = 1"""))
def active_subscriptions(spark, d):
    return C.active_subscription(v.subscriptions(spark, d), "1996-06-30").withColumn("expires_on", F.date_format("expires_on", "yyyy-MM-dd"))


SOURCES = """ , s AS (SELECT source_id, name, auto_disabled, CASE WHEN source_id % 5 = 4 THEN NULL ELSE TIMESTAMP '2024-01-30 00:00:00' + to_hours(CAST(source_id % 48 AS INTEGER)) END AS disabled_until, source_id % 7 AS failures FROM v_sources)"""


@query(with_views("v_sources", body=SOURCES + f""" SELECT source_id, CASE WHEN auto_disabled AND disabled_until > TIMESTAMP '{AS_OF}' THEN 'skip' WHEN auto_disabled THEN 're-enable' ELSE 'crawl' END AS decision,
 CASE WHEN auto_disabled AND NOT coalesce(disabled_until > TIMESTAMP '{AS_OF}', false) THEN 0 ELSE failures END AS failures, auto_disabled AND coalesce(disabled_until > TIMESTAMP '{AS_OF}', false) AS auto_disabled FROM s"""))
def crawlable_sources(spark, d):
    k = F.col("source_id")
    until = F.when(k % 5 != 4, F.expr("TIMESTAMP_NTZ'2024-01-30 00:00:00' + make_dt_interval(0, cast(source_id % 48 as int), 0, 0)"))
    rows = v.sources(spark, d).select("source_id", "name", "auto_disabled", until.alias("disabled_until"), (k % 7).alias("failures"))
    return C.crawlable(rows, AS_OF).select("source_id", "decision", "failures", "auto_disabled")


@query(with_views("v_requests", body=""" , n AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY "at", request_id) * 1500000 AS behind FROM v_requests)
SELECT request_id, domain, max("at" - behind) OVER (PARTITION BY domain ORDER BY "at", request_id) + behind AS made_at, max("at" - behind) OVER (PARTITION BY domain ORDER BY "at", request_id) + behind - "at" AS waited FROM n"""))
def domain_delays(spark, d):
    return C.domain_delays(v.requests(spark, d)).select("request_id", "domain", "made_at", "waited")


@query(with_views("v_requests", body=' SELECT domain, floor((1000000000 - max("at"))::DOUBLE / 1e6::DOUBLE * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE AS last_request_ago_sec FROM v_requests GROUP BY 1 ORDER BY max("at") DESC, domain LIMIT 20'))
def domain_stats(spark, d):
    return C.domain_stats(v.requests(spark, d), 1_000_000_000)


@query("""SELECT 'p' || (user_id % 3) AS provider, count(*) AS total, floor(count(*) FILTER (WHERE event_type <> 'error')::DOUBLE / count(*)::DOUBLE * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE AS success_rate,
 count(*) < 3 OR count(*) FILTER (WHERE event_type <> 'error')::DOUBLE / count(*)::DOUBLE >= 0.5::DOUBLE AS healthy, floor(count(*)::DOUBLE / 100000.0::DOUBLE * 100.0::DOUBLE * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE AS usage_pct FROM events GROUP BY 1""")
def provider_status(spark, d):
    calls = v.table(spark, d, "events").select(F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("provider"), (F.col("event_type") != "error").alias("ok"))
    return C.provider_status(calls, 100_000)


VIA = "CASE WHEN doc_id % 7 = 0 THEN 'cache' WHEN doc_id % 5 = 0 THEN 'model' ELSE 'keyword' END"


@query(f"""WITH c AS (SELECT {VIA} AS via FROM documents) SELECT count(*) AS total, count(*) FILTER (WHERE via = 'keyword') AS keyword_hits, count(*) FILTER (WHERE via = 'model') AS llm_calls, count(*) FILTER (WHERE via = 'cache') AS cache_hits,
 floor(count(*) FILTER (WHERE via = 'keyword')::DOUBLE / greatest(count(*), 1)::DOUBLE * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE AS keyword_hit_rate FROM c""")
def classifier_metrics(spark, d):
    return C.classifier_metrics(_docs(spark, d).select(F.expr(VIA).alias("via")))


@query("""WITH r AS (SELECT event_id, user_id % 20 AS ad_id, row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts DESC, event_id DESC) AS age FROM events) SELECT ad_id, event_id, age FROM r WHERE age <= 30""")
def recent_viewability(spark, d):
    rows = v.table(spark, d, "events").select("event_id", (F.col("user_id") % 20).alias("ad_id"), "ts")
    return C.recent_records(rows, "ad_id", "ts", "event_id", 30).select("ad_id", "event_id", "age")


# --- feed items, paging, marks


@query(with_views("v_articles", "v_interactions", body=""" , b AS (SELECT DISTINCT article_id FROM v_interactions WHERE action = 'bookmark')
SELECT CAST(a.article_id AS VARCHAR) AS id, a.title_original AS "titleOriginal", coalesce(CASE WHEN a.article_id % 4 = 0 THEN NULL ELSE lower(a.title_original) END, '') AS "titleAi",
 CASE WHEN a.article_id % 3 = 0 THEN '' ELSE a.title_original || '|' || a.source END AS bullets, CASE WHEN a.article_id % 3 = 0 THEN NULL ELSE a.topic END IS NULL AS defaulted,
 coalesce(CASE WHEN a.article_id % 3 = 0 THEN NULL ELSE a.topic END, 'ai') AS topic, a.source, CASE WHEN a.article_id % 2 = 0 THEN '' ELSE strftime(a.created_at, '%Y-%m-%dT%H:%M:%S.000Z') END AS "publishedAt",
 b.article_id IS NOT NULL AS "isBookmarked", strftime(a.created_at, '%Y-%m-%dT%H:%M:%S.000Z') AS "createdAt" FROM v_articles a LEFT JOIN b ON b.article_id = a.article_id"""))
def feed_items(spark, d):
    """Articles as feed items; parts are left out of some, so that the defaults show."""
    k = F.col("article_id")
    a = v.articles(spark, d).withColumn("title_ai", F.when(k % 4 != 0, F.lower("title_original"))).withColumn("summary_bullets", F.when(k % 3 != 0, F.array("title_original", "source")))
    a = a.withColumn("topic", F.when(k % 3 != 0, F.col("topic"))).withColumn("published_at", F.when(k % 2 != 0, F.col("created_at"))).withColumn("reason", F.lit(None).cast("string")).withColumn("url", F.lit("https://n.example/"))
    items = feed.feed_items(a, v.interactions(spark, d).where("action = 'bookmark'"))
    bullets = F.array_join("summaryBullets", "|")
    return items.select("id", "titleOriginal", "titleAi", bullets.alias("bullets"), (F.col("id").cast("bigint") % 3 == 0).alias("defaulted"), "topic", "source", "publishedAt", "isBookmarked", "createdAt")


@query(with_views("v_articles", body=" SELECT topic, count(*) FILTER (WHERE processing_status = 'failed') AS total, greatest(1, ceil(count(*) FILTER (WHERE processing_status = 'failed')::DOUBLE / 20.0::DOUBLE))::BIGINT AS pages, ceil(count(*) FILTER (WHERE processing_status = 'failed')::DOUBLE / 20.0::DOUBLE)::BIGINT AS admin_pages FROM v_articles GROUP BY 1"))
def page_totals(spark, d):
    totals = v.articles(spark, d).groupBy("topic").agg(F.count_if(F.col("processing_status") == "failed").alias("total"))
    return totals.select("topic", "total", feed.page_count(F.col("total"), 20).alias("pages"), feed.page_count(F.col("total"), 20, 0).alias("admin_pages"))


@query(with_views("v_articles", body=" SELECT topic, md5('[' || string_agg(article_id, ',' ORDER BY article_id) || ']') AS etag FROM v_articles GROUP BY 1"))
def etags(spark, d):
    lists = v.articles(spark, d).groupBy("topic").agg(F.sort_array(F.collect_list("article_id")).alias("ids"))
    return lists.select("topic", U.etag(F.col("ids")).alias("etag"))


@query("SELECT c_custkey AS user_id, substr(sha256(c_name), 1, 16) AS ip_hash FROM customer")
def ip_hashes(spark, d):
    return v.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), U.ip_hash(F.col("c_name")).alias("ip_hash"))


@query("SELECT page_id, substr(trim(regexp_replace(html, '<[^>]*>', '', 'g'), ' ' || chr(9) || chr(10) || chr(13)), 1, 500) AS report FROM pages")
def report_texts(spark, d):
    return v.pages(spark, d).select("page_id", X.report_text(F.col("html")).alias("report"))


@query(with_views("v_interactions", "v_articles", body=" SELECT i.user_id, i.article_id, strftime(i.created_at, '%Y-%m-%d %H:%M:%S') AS sent_at, a.title_original, a.article_id IS NULL AS gone FROM v_interactions i LEFT JOIN v_articles a ON a.article_id = i.article_id AND a.processing_status <> 'hidden' WHERE i.action IN ('share', 'bookmark')"))
def log_articles(spark, d):
    """Logged sends and bookmarks with their articles; hidden or deleted ones are null."""
    shown = v.articles(spark, d).where("processing_status <> 'hidden'").select("article_id", "title_original", F.lit(False).alias("gone"))
    logs = v.interactions(spark, d).where(F.col("action").isin("share", "bookmark"))
    return logs.join(shown, "article_id", "left").select("user_id", "article_id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("sent_at"), "title_original", F.coalesce("gone", F.lit(True)).alias("gone"))


@query(with_views("v_interactions", body=""" , o AS (SELECT user_id, CAST(created_at AS DATE) AS day, count(*) AS sessions, min(created_at) AS opened_at FROM v_interactions WHERE action IN ('click_original', 'other') GROUP BY 1, 2)
SELECT o.user_id, strftime(o.day, '%Y-%m-%d') AS day, o.sessions, (SELECT count(*) FROM v_interactions i WHERE i.user_id = o.user_id AND CAST(i.created_at AS DATE) = o.day AND i.action = 'view' AND i.created_at >= o.opened_at) AS articles_viewed FROM o"""))
def gated_views(spark, d):
    return E.gated_views(v.interactions(spark, d), ("click_original", "other")).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(with_views("v_interactions", body=""" , r AS (SELECT CAST(created_at AS DATE) AS day, count(DISTINCT user_id) AS unique_users FROM v_interactions GROUP BY 1), a AS (SELECT CAST(created_at AS DATE) AS day, count(DISTINCT user_id) FILTER (WHERE action = 'share') AS n FROM v_interactions GROUP BY 1)
SELECT strftime(r.day, '%Y-%m-%d') AS day, coalesce(nullif(CASE WHEN day(r.day) % 3 = 0 THEN 0 WHEN day(r.day) % 3 = 1 THEN a.n END, 0), r.unique_users) AS unique_users FROM r JOIN a ON a.day = r.day"""))
def unique_users(spark, d):
    """Daily users by the activity table where it knows them, else by the rollup."""
    i, day = v.interactions(spark, d), F.to_date("created_at").alias("day")
    rollup = i.groupBy(day).agg(F.count_distinct("user_id").alias("unique_users"))
    known = i.groupBy(day).agg(F.count_distinct(F.when(F.col("action") == "share", F.col("user_id"))).alias("n")).where(F.dayofmonth("day") % 3 != 2)
    known = known.select("day", F.when(F.dayofmonth("day") % 3 == 1, F.col("n")).otherwise(0).alias("active_users"))
    return E.unique_users(rollup, known).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "unique_users")


@query(with_views("v_interactions", "v_articles", body=f""" , c AS (SELECT article_id, count(*) AS n FROM v_interactions WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOURS GROUP BY 1),
 r AS (SELECT a.topic, c.article_id, c.n FROM c JOIN v_articles a ON a.article_id = c.article_id UNION ALL SELECT NULL, c.article_id, c.n FROM c JOIN v_articles a ON a.article_id = c.article_id),
 k AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n DESC, article_id) AS rank FROM r) SELECT coalesce(topic, '*') AS topic, article_id, n, rank FROM k WHERE rank <= 50"""))
def trending_cache(spark, d):
    return feed.trending_by_topic(v.interactions(spark, d), v.articles(spark, d), AS_OF).withColumn("topic", F.coalesce("topic", F.lit("*")))


@query(with_views("v_articles", body=f" SELECT count(*) AS articles, count(*) FILTER (WHERE len(e.embedding) > 0) AS candidates FROM v_articles a LEFT JOIN embeddings e ON e.vec_id = a.article_id WHERE a.created_at >= TIMESTAMP '{MID}' - INTERVAL 48 HOURS AND a.created_at <= TIMESTAMP '{MID}'"))
def embedding_candidates(spark, d):
    """Articles of the last 48 hours, and those of them with a vector to compare with."""
    vectors = v.embeddings(spark, d).select("article_id", "embedding")
    recent = E.since(v.articles(spark, d), MID, "48 HOURS").where(F.col("created_at") <= v.at(MID))
    has = F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    return recent.join(vectors, "article_id", "left").agg(F.count(F.lit(1)).alias("articles"), F.count_if(has).alias("candidates"))


@query(with_views("v_articles", body=" SELECT article_id, md5(substr(title_original || chr(10) || content_clean, 1, 4000)) AS input_hash FROM v_articles"))
def embedding_inputs(spark, d):
    return v.articles(spark, d).select("article_id", F.md5(feed.embedding_input(F.col("title_original"), F.col("content_clean"))).alias("input_hash"))


# --- sinks


@query(with_views("v_interactions", body=""" , b AS (SELECT DISTINCT user_id, article_id FROM v_interactions WHERE action = 'bookmark'), e AS (SELECT * FROM b WHERE user_id % 2 = 0 UNION SELECT * FROM b WHERE user_id % 2 = 1)
SELECT user_id, article_id, user_id % 2 = 0 AS existed FROM e WHERE user_id % 5 <> 0"""))
def bookmark_insert_delete(spark, d):
    """Bookmarks inserted once whatever comes again, then some users' deleted by key."""
    keys = ["user_id", "article_id"]
    all_ = v.interactions(spark, d).where("action = 'bookmark'").select(*keys)
    existing = all_.where("user_id % 2 = 0").distinct().withColumn("existed", F.lit(True))
    added = C.insert_new(existing, all_.distinct(), keys).withColumn("existed", F.lit(False))
    return C.delete_keys(existing.unionByName(added), all_.where("user_id % 5 = 0"), keys)


@query("SELECT doc_id AS article_id, source, array_to_string(list_slice(string_split(text, chr(10)), 1, 3), ' ') AS summary_text FROM documents")
def search_documents(spark, d):
    rows = v.table(spark, d, "documents").select(F.col("doc_id").alias("article_id"), "source", F.slice(F.split("text", "\n"), 1, 3).alias("summary_bullets"))
    return feeds.search_documents(rows)


@query(with_views("v_interactions", body=""" , r AS (SELECT article_id AS id, created_at AS cached_at, row_number() OVER (PARTITION BY article_id ORDER BY created_at DESC) AS rn FROM v_interactions)
SELECT id, strftime(cached_at, '%Y-%m-%d %H:%M:%S') AS cached_at FROM r WHERE rn = 1 ORDER BY r.cached_at DESC, id LIMIT 50"""))
def client_cache(spark, d):
    rows = v.interactions(spark, d).select(F.col("article_id").alias("id"), F.col("created_at").alias("cached_at"))
    return feeds.newest_cached(rows).withColumn("cached_at", F.date_format("cached_at", "yyyy-MM-dd HH:mm:ss"))


NEWS = '<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:news="http://www.google.com/schemas/sitemap-news/0.9">'


@query(with_views("v_articles", body=f""" , t AS (SELECT * FROM v_articles WHERE processing_status IN ('done', 'fallback') AND created_at >= TIMESTAMP '{MID}' - INTERVAL 48 HOURS ORDER BY created_at DESC, article_id DESC LIMIT 1000)
SELECT '{NEWS}' || coalesce(string_agg('<url><loc>https://news.example/article/' || article_id || '</loc><news:news><news:publication><news:name>News</news:name><news:language>vi</news:language></news:publication><news:publication_date>' ||
 strftime(created_at, '%Y-%m-%dT%H:%M:%S.000Z') || '</news:publication_date><news:title>' || replace(replace(title_original, '&', '&amp;'), '<', '&lt;') || '</news:title></news:news></url>', '' ORDER BY created_at DESC, article_id DESC), '') || '</urlset>' AS xml FROM t"""))
def news_sitemap(spark, d):
    return feeds.news_sitemap(v.articles(spark, d).withColumn("title_ai", F.lit(None).cast("string")), "https://news.example", "News", "vi", MID)


LOCAL = "'https://www.' || (page_id % 37) || CASE WHEN page_id % 4 = 0 THEN '.com' ELSE '.vn' END || '/x'"


@query("SELECT (page_id % 37) || '.vn' AS domain, count(*) AS n FROM pages WHERE page_id % 4 <> 0 GROUP BY 1")
def news_domains(spark, d):
    """Local domains of an aggregator's items: by the source's address, else by the link."""
    url = F.expr(LOCAL)
    item = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<item><title>t</title><link>https://aggregator.example/1</link><source url="'), url, F.lit('">S</source></item>')))
    item = item.otherwise(F.concat(F.lit("<item><title>t</title><link>"), url, F.lit("</link></item>")))
    return feeds.news_domains(v.pages(spark, d).select(F.concat(F.lit("<rss><channel>"), item, F.lit("</channel></rss>")).alias("xml")))


@query("""SELECT 's' || (page_id % 9) AS source, 'https://l.example/a' || page_id AS url, 'T ' || page_id AS title, NULL::VARCHAR AS published_at FROM pages WHERE page_id % 2 = 0
UNION ALL SELECT 's' || (page_id % 9), 'https://f.example/' || page_id, 'F ' || page_id, '2024-01-16 03:00:00' FROM pages WHERE page_id % 2 = 1""")
def source_dispatch(spark, d):
    """Fetched sources by their type: listings give their links, feeds their entries."""
    n = F.col("page_id").cast("string")
    listing = F.concat(F.lit('<a href="#top">x</a><a href="/a'), n, F.lit('">T <b>'), n, F.lit("</b></a>"))
    rss = F.concat(F.lit("<rss><item><title>F "), n, F.lit("</title><link>https://f.example/"), n, F.lit("</link><pubDate>Tue, 16 Jan 2024 10:00:00 +0700</pubDate></item></rss>"))
    html = F.col("page_id") % 2 == 0
    fetched = v.pages(spark, d).select("page_id", F.concat(F.lit("s"), (F.col("page_id") % 9).cast("string")).alias("source"), F.when(html, "html_scrape").alias("type"), F.lit("https://l.example/").alias("url"), F.when(html, listing).otherwise(rss).alias("body"))
    return feeds.crawled(fetched).select("source", "url", "title", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"))


# --- models' prompts and replies


@query("""WITH b AS (SELECT doc_id // 5 AS batch, count(*) AS articles, string_agg(substr(text, 1, 4000), chr(1) ORDER BY doc_id) AS t FROM documents GROUP BY 1),
 p AS (SELECT batch, articles, array_to_string(list_transform(string_split(t, chr(1)), lambda x, i: chr(10) || '[ARTICLE ' || i || ']' || chr(10) || x || chr(10)), '') AS body FROM b)
SELECT batch, articles, md5('Summarise ' || articles || ':' || body) AS prompt_hash FROM p""")
def batch_prompts(spark, d):
    """Prompts of five articles each."""
    groups = _docs(spark, d).groupBy(F.expr("doc_id div 5").alias("batch")).agg(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"]).alias("texts"))
    prompt = X.batch_prompt(F.col("texts"), "Summarise {count}:{articles}")
    return groups.select("batch", F.size("texts").cast("bigint").alias("articles"), F.md5(prompt).alias("prompt_hash"))


@query("""SELECT doc_id // 5 AS batch, doc_id % 5 + 1 AS place, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'T ' || doc_id || ' x y' END AS title_ai FROM documents""")
def batch_replies(spark, d):
    """Replies to batches taken apart: an article that has no part, or one that can't be parsed, gets none."""
    n = F.col("doc_id").cast("string")
    part = F.concat(F.lit("[ARTICLE "), (F.col("doc_id") % 5 + 1).cast("string"), F.lit("]\nTITLE: T "), n, F.lit(" x y\n- a\n- b\n"), F.when(F.col("doc_id") % 3 != 0, "- c\n").otherwise(""), F.lit("REASON: r\n"))
    raw = _docs(spark, d).groupBy(F.expr("doc_id div 5").alias("batch")).agg(F.array_join(F.sort_array(F.collect_list(part), asc=False), "").alias("raw"), F.count(F.lit(1)).alias("n"))
    parts = raw.select("batch", F.posexplode(X.batch_replies(F.col("raw"), F.lit(5))).alias("i", "part"))
    known = _docs(spark, d).select(F.expr("doc_id div 5").alias("batch"), (F.col("doc_id") % 5).cast("int").alias("i"))
    return parts.join(known, ["batch", "i"]).select("batch", (F.col("i") + 1).cast("bigint").alias("place"), X.parsed_reply(F.col("part"))["title_ai"].alias("title_ai"))


ATTEMPTS = "SELECT doc_id AS article_id, a AS attempt, ((doc_id * 31 + a * 17) % 23)::DOUBLE / 30.0::DOUBLE AS quality, 'p' || (doc_id % 3) AS provider FROM documents, range(3) AS t(a) WHERE doc_id % 10 <> 0"


@query(f"""WITH t AS ({ATTEMPTS}), r AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY quality >= 0.6::DOUBLE DESC, CASE WHEN quality >= 0.6::DOUBLE THEN 0.0::DOUBLE ELSE quality END DESC, attempt) AS rn FROM t WHERE quality > 0)
SELECT d.doc_id AS article_id, r.attempt, floor(coalesce(r.quality, 0.0::DOUBLE) * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE AS quality, coalesce(r.provider, 'extractive_fallback') AS provider FROM documents d LEFT JOIN r ON r.article_id = d.doc_id AND r.rn = 1""")
def best_summaries(spark, d):
    """Of up to three attempts a summary each: the first good one, else the best, else the extractive one."""
    docs = _docs(spark, d).select(F.col("doc_id").alias("article_id"))
    attempts = docs.where("article_id % 10 <> 0").select("article_id", F.explode(F.sequence(F.lit(0), F.lit(2)).cast("array<bigint>")).alias("attempt"))
    quality = F.pmod(F.col("article_id") * 31 + F.col("attempt") * 17, F.lit(23)) / 30.0
    attempts = attempts.select("article_id", "attempt", quality.alias("quality"), F.concat(F.lit("p"), (F.col("article_id") % 3).cast("string")).alias("provider"))
    return C.best_summary(attempts, docs).withColumn("quality", E.half_up(F.col("quality"), 3))


@query(with_views("v_articles", body=" SELECT article_id, md5(replace(CASE topic WHEN 'ai' THEN 'On AI: {text}' WHEN 'sport' THEN 'Sports. {text} End.' ELSE 'Sum up: {text}' END, '{text}', substr(content_clean, 1, 4000))) AS prompt_hash FROM v_articles"))
def prompt_choice(spark, d):
    made = X.prompt(F.col("content_clean"), F.col("topic"), {"ai": "On AI: {text}", "sport": "Sports. {text} End."}, "Sum up: {text}")
    return v.articles(spark, d).select("article_id", F.md5(made).alias("prompt_hash"))


@query("""WITH t AS (SELECT doc_id, lang, text, CASE WHEN doc_id % 4 = 0 THEN substr(text, 1, CAST(length(text) // 4 AS INTEGER)) WHEN doc_id % 4 = 1 THEN NULL ELSE lower(text) END AS tr FROM documents)
SELECT doc_id, CASE WHEN lang <> 'fr' AND coalesce(length(tr)::DOUBLE >= 0.3::DOUBLE * length(text), false) THEN md5(tr) ELSE md5(text) END AS text_hash, lang <> 'fr' AND coalesce(length(tr)::DOUBLE >= 0.3::DOUBLE * length(text), false) AS translated FROM t""")
def ensured_language(spark, d):
    """Translations joined in where a text needs one; one that is missing or too short leaves the text as it is (here 'fr' stands for the target)."""
    k = F.col("doc_id")
    tr = F.when(k % 4 == 0, F.expr("substring(text, 1, cast(char_length(text) div 4 as int))")).when(k % 4 == 1, F.lit(None).cast("string")).otherwise(F.lower("text"))
    rows = v.table(spark, d, "documents").select("doc_id", X.translated(F.col("text"), tr, F.when(F.col("lang") == "fr", "vi").otherwise(F.col("lang"))).alias("t"))
    return rows.select("doc_id", F.md5("t.text").alias("text_hash"), F.col("t.translated").alias("translated"))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE 'Title ' || doc_id END AS title_ai, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE 'one|two|three' END AS bullets, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE 'why ' || doc_id END AS reason FROM documents""")
def parsed_replies(spark, d):
    n = F.col("doc_id").cast("string")
    raw = F.concat(F.lit("Sure!\n title: old\nTITLE: Title "), n, F.lit("\n- one\n -  two \n"), F.when(F.col("doc_id") % 4 != 3, "- three\n- four\n").otherwise(""), F.lit("reason:  why "), n)
    r = _docs(spark, d).select("doc_id", X.parsed_reply(raw).alias("r"))
    return r.select("doc_id", "r.title_ai", F.array_join("r.summary_bullets", "|").alias("bullets"), "r.reason")


@query(with_views("v_articles", body=""" , r AS (SELECT source, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (length(content_clean) - 100)::DOUBLE / 700.0::DOUBLE)) AS s, row_number() OVER (PARTITION BY source ORDER BY created_at DESC, article_id) AS rn FROM v_articles)
SELECT source, count(*) AS samples, floor(sum(s)::DOUBLE / count(*)::DOUBLE * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE AS quality FROM r WHERE rn <= 3 GROUP BY 1"""))
def source_quality(spark, d):
    """The mean score of each source's three newest articles."""
    newest = feed.top_per_key(v.articles(spark, d), "source", 3, F.desc("created_at"), "article_id").withColumn("s", X.length_score(F.col("content_clean")))
    return newest.groupBy("source").agg(F.count(F.lit(1)).alias("samples"), E.half_up(F.sum("s") / F.count(F.lit(1)), 3).alias("quality"))


@query(with_views("v_users", "v_interactions", body=f""" , n AS (SELECT article_id, count(*) AS n FROM v_interactions WHERE action = 'view' AND created_at >= TIMESTAMP '{MID}' - INTERVAL 1 HOUR AND created_at <= TIMESTAMP '{MID}' GROUP BY 1)
SELECT (SELECT count(*) FROM v_users WHERE notifications_enabled AND pref_topic IS DISTINCT FROM false) AS topic_users, (SELECT count(*) FROM v_users WHERE notifications_enabled AND pref_trending IS DISTINCT FROM false) AS trending_users, (SELECT count(*) FROM n) AS articles"""))
def push_audience(spark, d):
    """How many users a push could reach by kind, and how many articles the last hour's views name."""
    u = v.users(spark, d)
    recent = E.since(v.interactions(spark, d).where("action = 'view'"), MID, "1 HOUR").where(F.col("created_at") <= v.at(MID))
    counts = [notify.opted_in(u, c).agg(F.count(F.lit(1)).alias(n)) for c, n in (("pref_topic", "topic_users"), ("pref_trending", "trending_users"))]
    return counts[0].crossJoin(counts[1]).crossJoin(recent.agg(F.count_distinct("article_id").alias("articles")))
