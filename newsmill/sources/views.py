"""The application's collections as views of the driver's tables, in Spark and as SQL text.

Each view is a narrow projection, so filters and column lists reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Topics in the order that breaks ties.
TOPICS = ("ai", "finance", "lifestyle", "drama", "career", "insight", "sport", "technology", "health", "entertainment")
STATUSES = ("done", "done", "done", "done", "cached", "done", "fallback", "done", "failed", "hidden")
PROVIDERS = ("ollama", "groq", "gemini", None)
ACTIONS = {"view": "view", "click": "click_original", "purchase": "share", "signup": "bookmark"}
AS_OF = "2024-01-31 00:00:00"
MID = "2024-01-16 12:00:00"


def at(moment: str) -> Column:
    return F.expr(f"TIMESTAMP_NTZ'{moment}'")


def before(moment: str, interval: str) -> Column:
    return F.expr(f"TIMESTAMP_NTZ'{moment}' - INTERVAL {interval}")


def _pick(values: tuple, number: Column) -> Column:
    return F.array(*[F.lit(v) for v in values])[F.pmod(number, F.lit(len(values))).cast("int")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def article_of(props: Column) -> Column:
    """The first number in ``props``, or null where there is none or it isn't a bigint."""
    return F.regexp_extract(props, r"(\d+)", 1).try_cast("bigint")


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, article_id, action, created_at. An event that names no article stays, with a null article: it counts as its user's."""
    kind = F.coalesce(F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])[F.col("event_type")], F.lit("other"))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("bigint").alias("user_id"),
        article_of(F.col("props")).alias("article_id"),
        kind.alias("action"),
        F.col("ts").cast("timestamp_ntz").alias("created_at"),
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """article_id, title_original, content_clean, source, lang, created_at, topic, processing_status, ai_provider."""
    n = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        n.alias("article_id"),
        F.substring(F.split("text", "\n")[0], 1, 80).alias("title_original"),
        F.col("text").alias("content_clean"),
        "source",
        "lang",
        F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, cast(pmod(doc_id, 720) as int), 0, 0)").alias("created_at"),
        _pick(TOPICS, n).alias("topic"),
        _pick(STATUSES, n).alias("processing_status"),
        _pick(PROVIDERS, n).alias("ai_provider"),
    )


def qualities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("article_id"), F.col("quality").cast("double").alias("quality_score"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, email, interests, prefs (null means enabled), notifications_enabled."""
    k = F.col("c_custkey").cast("bigint")
    pref = lambda r: F.when(k % 3 == r, F.lit(False)).when(k % 3 == (r + 1) % 3, F.lit(True))
    return table(spark, sf_dir, "customer").select(
        k.alias("user_id"),
        F.concat(F.col("c_name"), F.lit("@mail.example")).alias("email"),
        F.array_distinct(F.array(_pick(TOPICS, k), _pick(TOPICS, k * 7))).alias("interests"),
        pref(0).alias("pref_trending"),
        pref(1).alias("pref_topic"),
        (k % 5 != 0).alias("notifications_enabled"),
    )


def referrals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("bigint").alias("referral_id"), F.col("o_custkey").cast("bigint").alias("referrer_id"), F.to_date("o_orderdate").alias("created_on")
    )


def reactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").cast("bigint").alias("article_id"), F.col("l_orderkey").cast("bigint").alias("user_id"), F.col("l_returnflag").alias("type")
    )


def ads(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey").cast("bigint")
    size = F.col("p_size").cast("bigint")
    return table(spark, sf_dir, "part").select(
        k.alias("ad_id"),
        F.round(F.col("p_retailprice") * 100).cast("bigint").alias("budget_cents"),
        (size * 3000).alias("spent_cents"),
        _pick(("active", "active", "paused", "expired"), k).alias("status"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(k, F.lit(60)).cast("int")).alias("end_on"),
        _pick(TOPICS, k).alias("topic"),
        (size * 100).alias("impressions"),
        (size * (k % 100)).alias("viewable_impressions"),
        (size * (k % 7)).alias("clicks"),
        F.col("p_name").alias("name"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey").cast("bigint")
    return table(spark, sf_dir, "supplier").select(
        k.alias("source_id"),
        F.col("s_name").alias("name"),
        ((k % 11).cast("double") / 10.0).alias("success_rate"),
        (k % 4 != 3).alias("is_active"),
        (F.col("s_acctbal") < 0).alias("auto_disabled"),
    )


def affiliates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """link_id, title, topic, commission, is_active, clicks, impressions."""
    k, size = F.col("p_partkey").cast("bigint"), F.col("p_size").cast("bigint")
    return table(spark, sf_dir, "part").select(
        k.alias("link_id"), F.col("p_name").alias("title"), _pick(TOPICS, k).alias("topic"), size.cast("double").alias("commission"),
        (k % 3 != 0).alias("is_active"), (size * 3).alias("clicks"), (size * 40).alias("impressions"),
    )


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subscription_id, user_id, status, expires_on."""
    status = F.when(F.col("o_orderstatus") == "F", "active").when(F.col("o_orderstatus") == "O", "trial").otherwise("expired")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("bigint").alias("subscription_id"), F.col("o_custkey").cast("bigint").alias("user_id"), status.alias("status"), F.date_add(F.to_date("o_orderdate"), 365).alias("expires_on"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """request_id, domain, at (microseconds) of a crawler's requests, all made within 17 minutes."""
    n = F.col("event_id").cast("bigint")
    return table(spark, sf_dir, "events").select(n.alias("request_id"), F.concat(F.lit("d"), (F.col("user_id") % 50).cast("string")).alias("domain"), (F.pmod(n * 7919, F.lit(1_000_000)) * 1000).alias("at"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", "html")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("article_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, label, order, is_active."""
    key = F.lower(F.translate(F.col("n_name"), " ", "-"))
    return table(spark, sf_dir, "nation").select(key.alias("key"), F.col("n_name").alias("label"), F.col("n_nationkey").cast("int").alias("order"), (F.col("n_regionkey") != 2).alias("is_active"))


def _list(values: tuple) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


def _of(values: tuple, number: str) -> str:
    return f"({_list(values)})[CAST(({number}) % {len(values)} AS INTEGER) + 1]"


SQL_VIEWS = {
    "v_interactions": """SELECT CAST(user_id AS BIGINT) AS user_id, TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS article_id,
        CASE event_type WHEN 'view' THEN 'view' WHEN 'click' THEN 'click_original' WHEN 'purchase' THEN 'share'
             WHEN 'signup' THEN 'bookmark' ELSE 'other' END AS action, CAST(ts AS TIMESTAMP) AS created_at FROM events""",
    "v_articles": f"""SELECT doc_id AS article_id, substr(string_split(text, chr(10))[1], 1, 80) AS title_original, text AS content_clean,
        source, lang, TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id % 720 AS INTEGER)) AS created_at,
        {_of(TOPICS, 'doc_id')} AS topic, {_of(STATUSES, 'doc_id')} AS processing_status,
        {_of(PROVIDERS, 'doc_id')} AS ai_provider FROM documents""",
    "v_quality": "SELECT doc_id AS article_id, CAST(quality AS DOUBLE) AS quality_score FROM labels",
    "v_users": f"""SELECT CAST(c_custkey AS BIGINT) AS user_id, c_name || '@mail.example' AS email,
        CASE WHEN c_custkey % 10 = (c_custkey * 7) % 10 THEN [{_of(TOPICS, 'c_custkey')}]
             ELSE [{_of(TOPICS, 'c_custkey')}, {_of(TOPICS, 'c_custkey * 7')}] END AS interests,
        CASE c_custkey % 3 WHEN 0 THEN false WHEN 1 THEN true END AS pref_trending,
        CASE c_custkey % 3 WHEN 1 THEN false WHEN 2 THEN true END AS pref_topic,
        c_custkey % 5 <> 0 AS notifications_enabled FROM customer""",
    "v_referrals": "SELECT CAST(o_orderkey AS BIGINT) AS referral_id, CAST(o_custkey AS BIGINT) AS referrer_id, CAST(o_orderdate AS DATE) AS created_on FROM orders",
    "v_reactions": "SELECT CAST(l_partkey AS BIGINT) AS article_id, CAST(l_orderkey AS BIGINT) AS user_id, l_returnflag AS type FROM lineitem",
    "v_ads": f"""SELECT CAST(p_partkey AS BIGINT) AS ad_id, CAST(round(p_retailprice * 100) AS BIGINT) AS budget_cents, CAST(p_size AS BIGINT) * 3000 AS spent_cents,
        {_of(('active', 'active', 'paused', 'expired'), 'p_partkey')} AS status, DATE '2024-01-01' + CAST(p_partkey % 60 AS INTEGER) AS end_on,
        {_of(TOPICS, 'p_partkey')} AS topic, CAST(p_size AS BIGINT) * 100 AS impressions, CAST(p_size AS BIGINT) * (p_partkey % 100) AS viewable_impressions, CAST(p_size AS BIGINT) * (p_partkey % 7) AS clicks, p_name AS name FROM part""",
    "v_affiliates": f"""SELECT CAST(p_partkey AS BIGINT) AS link_id, p_name AS title, {_of(TOPICS, 'p_partkey')} AS topic, CAST(p_size AS DOUBLE) AS commission,
        p_partkey % 3 <> 0 AS is_active, CAST(p_size AS BIGINT) * 3 AS clicks, CAST(p_size AS BIGINT) * 40 AS impressions FROM part""",
    "v_subscriptions": """SELECT CAST(o_orderkey AS BIGINT) AS subscription_id, CAST(o_custkey AS BIGINT) AS user_id,
        CASE o_orderstatus WHEN 'F' THEN 'active' WHEN 'O' THEN 'trial' ELSE 'expired' END AS status, CAST(o_orderdate AS DATE) + 365 AS expires_on FROM orders""",
    "v_requests": """SELECT CAST(event_id AS BIGINT) AS request_id, 'd' || (user_id % 50) AS domain, (CAST(event_id AS BIGINT) * 7919 % 1000000) * 1000 AS "at" FROM events""",
    "v_topics": "SELECT lower(replace(n_name, ' ', '-')) AS key, n_name AS label, CAST(n_nationkey AS INTEGER) AS \"order\", n_regionkey <> 2 AS is_active FROM nation",
    "v_sources": """SELECT CAST(s_suppkey AS BIGINT) AS source_id, s_name AS name, CAST(s_suppkey % 11 AS DOUBLE) / 10.0 AS success_rate,
        s_suppkey % 4 <> 3 AS is_active, s_acctbal < 0 AS auto_disabled FROM supplier""",
}


def with_views(*names: str, body: str) -> str:
    """SQL with the views it reads as common table expressions."""
    return "WITH " + ", ".join(f"{n} AS ({SQL_VIEWS[n]})" for n in names) + body
