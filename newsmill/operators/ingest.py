"""Ingestion as one frame: every gate adds a column, the status is the first gate that stops an article."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsmill.functions import text as X
from newsmill.functions import wordlists as L
from newsmill.functions.urls import url_hash
from newsmill.operators.dedup import deduplicate
from newsmill.session import materialize, ship_package


@dataclass
class Settings:
    topics: dict[str, list[str]] = field(default_factory=lambda: L.TOPIC_KEYWORDS)
    blocked: list[str] = field(default_factory=lambda: L.BLOCKED)
    flagged: list[str] = field(default_factory=lambda: L.FLAGGED)
    block_domains: tuple[str, ...] = ()
    allow_domains: tuple[str, ...] = ()
    least_chars: int = 100
    least_quality: float = 0.3
    window_hours: int = 48
    title_threshold: float = 0.8
    embed_threshold: float = 0.8


def process(articles: DataFrame, known_urls: DataFrame | None, settings: Settings = Settings()) -> DataFrame:
    """``articles`` (article_id, url, title_original, text, created_at, embedding) with status and what was derived.

    Gates in order: a URL that is known, the source and words, the length, the quality; what passes
    them is compared with each other. The cheap gates come first, so dedup only sees what they leave.
    """
    s = settings
    ship_package(articles.sparkSession)
    rows = articles.withColumn("text", X.without_artifacts(F.coalesce("text", F.lit(""))))
    if known_urls is None:
        rows = rows.withColumn("known", F.lit(False))
    else:
        known = known_urls.select(url_hash(F.col("url")).alias("h")).distinct().withColumn("known", F.lit(True))
        rows = rows.withColumn("h", url_hash(F.col("url"))).join(known, "h", "left").withColumn("known", F.coalesce("known", F.lit(False))).drop("h")
    t = F.col("text")
    quality = X.overall_quality(X.length_score(t), X.structure_score(t), X.vietnamese_ratio(t), X.spam_score(t))
    m = X.moderation(F.col("url"), F.col("title_original"), t, s.blocked, s.flagged, list(s.block_domains), list(s.allow_domains))
    scores = X.topic_scores(F.coalesce("title_original", F.lit("")), t, s.topics)
    rows = rows.withColumn("quality", quality).withColumn("moderated", m["status"]).withColumn("topic", X.best_topic(scores, list(s.topics))).withColumn("sentiment", X.sentiment(t))
    # What costs is computed once, as columns of a table; gates in the same plan would repeat it.
    rows = materialize(rows, "scored")
    gate = (
        F.when(F.col("known"), "duplicate").when(F.col("moderated") == "blocked", "blocked")
        .when(F.char_length("text") < s.least_chars, "failed").when(F.col("quality") < s.least_quality, "failed")
    )
    rows = rows.withColumn("gate", gate).drop("moderated")
    passed = rows.where("gate IS NULL").select("article_id", "url", "created_at", "title_original", "embedding")
    found = deduplicate(passed, s.window_hours, s.title_threshold, s.embed_threshold)
    status = F.coalesce("gate", F.when(F.col("is_duplicate"), "duplicate").otherwise("done"))
    return rows.join(found, "article_id", "left").withColumn("status", status)


def stats(processed: DataFrame) -> DataFrame:
    """new, duplicate and failed: they add up to all rows."""
    s = F.col("status")
    return processed.agg(F.count_if(s == "done").alias("new"), F.count_if(s == "duplicate").alias("duplicate"), F.count_if(~s.isin("done", "duplicate")).alias("failed"))
