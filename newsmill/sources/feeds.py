"""Feeds, listings and discovery as sources; sitemaps, cards and search documents as sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsmill.functions.text import parsed_date, strip
from newsmill.operators.engagement import since
from newsmill.functions.urls import domain, is_skipped, is_vietnamese, links, source_name, xml_escaped


def _tag(item: Column, name: str) -> Column:
    raw = F.regexp_extract(item, rf"(?is)<{name}(?:\s[^>]*)?>(.*?)</{name}>", 1)
    plain = strip(F.regexp_replace(raw, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"))
    for entity, letter in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(letter))
    return plain


def _attribute(item: Column, tag: str, name: str, also: str = "") -> Column:
    return F.nullif(F.regexp_extract(item, rf"""(?is)<{tag}\b{also}[^>]*?\b{name}=["']([^"']+)["']""", 1), F.lit(""))


def rss_entries(feeds: DataFrame) -> DataFrame:
    """(source, url, title, published_at, image_url) of feeds (source, xml); entries without a link go, a feed without entries gives none."""
    item = F.regexp_extract_all("xml", F.lit(r"(?is)(<item\b.*?</item>|<entry\b.*?</entry>)"), 1)
    rows = feeds.select("source", F.explode(item).alias("item"))
    i = F.col("item")
    link = F.coalesce(F.nullif(_tag(i, "link"), F.lit("")), _attribute(i, "link", "href"))
    image = F.coalesce(
        _attribute(i, "media:content", "url", r'(?=[^>]*(?:medium="image"|type="image))'),
        _attribute(i, "media:thumbnail", "url"),
        _attribute(i, "enclosure", "url", r'(?=[^>]*type="image)'),
    )
    date = F.coalesce(parsed_date(F.nullif(_tag(i, "pubDate"), F.lit(""))), parsed_date(F.nullif(_tag(i, "published"), F.lit(""))))
    found = rows.select("source", strip(link).alias("url"), _tag(i, "title").alias("title"), date.alias("published_at"), image.alias("image_url"))
    return found.where(F.coalesce(F.col("url"), F.lit("")) != "")


def resolved(base: Column, href: Column) -> Column:
    """An address relative to a page's."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    folder = F.regexp_extract(F.regexp_replace(base, r"[?#].*$", ""), r"^([A-Za-z][A-Za-z0-9+.-]*://.*/)", 1)
    folder = F.when(F.char_length(folder) > F.char_length(root), folder).otherwise(F.concat(root, F.lit("/")))
    return (
        F.when(F.rlike(href, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:")), href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme, href))
        .when(F.startswith(href, F.lit("/")), F.concat(root, href))
        .when(F.startswith(href, F.lit("?")), F.concat(F.regexp_replace(base, r"[?#].*$", ""), href))
        .otherwise(F.concat(folder, href))
    )


def listing_links(pages: DataFrame, most: int = 20) -> DataFrame:
    """(page_id, position, link, title): a page's first ``most`` different links, the first of each."""
    anchors = F.regexp_extract_all("html", F.lit(r"""(?is)(<a\b[^>]*\bhref=["'][^"']+["'][^>]*>.*?</a>)"""), 1)
    rows = pages.select("page_id", "url", F.posexplode(anchors).alias("pos", "a"))
    href = strip(F.regexp_extract("a", r"""(?is)\bhref=["']([^"']+)["']""", 1))
    title = strip(F.regexp_replace(F.regexp_extract("a", r"(?is)>(.*)</a>", 1), r"<[^>]*>", ""))
    rows = rows.withColumn("href", href).where(~F.rlike("href", F.lit(r"(?i)^(#|javascript:)")))
    first = rows.withColumn("link", resolved(F.col("url"), F.col("href"))).groupBy("page_id", "link").agg(F.min("pos").alias("pos"), F.min_by(title, "pos").alias("title"))
    w = Window.partitionBy("page_id").orderBy("pos")
    return first.withColumn("position", F.row_number().over(w)).where(F.col("position") <= most).select("page_id", "position", "link", "title")


def feed_links(pages: DataFrame) -> DataFrame:
    """(page_id, feed): alternate links of a feed type; else the usual paths, to be probed."""
    tags = F.filter(F.regexp_extract_all("html", F.lit(r"(?is)(<link\b[^>]*>)"), 1), lambda t: F.rlike(t, F.lit(r"""(?is)rel=["']?alternate""")) & F.rlike(t, F.lit(r"""(?is)type=["'][^"']*(rss|atom|xml)""")))
    hrefs = F.filter(F.transform(tags, lambda t: F.regexp_extract(t, r"""(?is)href=["']([^"']+)["']""", 1)), lambda h: h != "")
    named = F.transform(hrefs, lambda h: resolved(F.col("url"), h))
    paths = ("/rss", "/rss/home.rss", "/rss/tin-moi-nhat.rss", "/feed", "/feed/rss", "/atom.xml", "/rss.xml")
    usual = F.array(*[F.concat(F.lit("https://"), domain(F.col("url")), F.lit(p)) for p in paths])
    listed = F.size(named) > 0
    return pages.select("page_id", listed.alias("in_page"), F.explode(F.when(listed, named).otherwise(usual)).alias("feed"))


def domain_counts(texts: DataFrame, column: str, least: int = 1, most: int | None = None) -> DataFrame:
    """(domain, n): how often each domain is linked, frequent ones only, commonest first."""
    found = texts.select(F.explode(links(F.col(column))).alias("url")).select(domain(F.col("url")).alias("domain")).where("domain <> ''")
    counts = found.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return counts if most is None else counts.orderBy(F.desc("n"), "domain").limit(most)


def discovered(backlinks: DataFrame, news: DataFrame, known: DataFrame, quality: DataFrame, most: int = 20, least_quality: float = 0.4) -> DataFrame:
    """New sources: unknown domains of both counters (domain, n), the most mentioned twice ``most``, with enough quality (domain, quality)."""
    both = backlinks.select("domain", "n", F.lit("backlink").alias("via")).unionByName(news.select("domain", "n", F.lit("news").alias("via")))
    merged = both.groupBy("domain").agg(F.sum("n").alias("mentions"), F.array_sort(F.collect_set("via")).alias("discovered_via"))
    fresh = merged.join(known.select("domain").distinct(), "domain", "left_anti").where(~is_skipped(F.col("domain")))
    top = fresh.orderBy(F.desc("mentions"), "domain").limit(2 * most)
    good = top.join(quality, "domain").where(F.col("quality") >= least_quality).orderBy(F.desc("quality"), "domain").limit(most)
    return good.select("domain", source_name(F.col("domain")).alias("name"), is_vietnamese(F.col("domain")).alias("vietnamese"), "mentions", "discovered_via", "quality", F.lit(False).alias("is_active"))


def search_documents(articles: DataFrame) -> DataFrame:
    """What a search index takes: bullets joined to one text."""
    return articles.withColumn("summary_text", F.array_join("summary_bullets", " ")).drop("summary_bullets")


def sitemap(articles: DataFrame, base: str, most: int = 1000) -> DataFrame:
    """One row of XML: the newest visible articles (article_id, created_at, processing_status)."""
    top = articles.where(F.col("processing_status").isin("done", "fallback")).orderBy(F.desc("created_at"), F.desc("article_id")).limit(most)
    url = F.format_string("<url><loc>%s/article/%d</loc><lastmod>%s</lastmod></url>", F.lit(base), F.col("article_id"), F.date_format("created_at", "yyyy-MM-dd"))
    listed = top.agg(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("created_at", "article_id", url.alias("u"))))), lambda x: x["u"]).alias("urls"))
    head = '<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'
    return listed.select(F.concat(F.lit(head), F.array_join("urls", ""), F.lit("</urlset>")).alias("xml"))


def share_card(title: Column, bullet: Column) -> Column:
    """The lines of a share image: a title in two lines, a bullet of 80 characters, escaped."""
    cut = lambda c, a, n: xml_escaped(F.substring(c, a, n))
    return F.struct(cut(title, 1, 60).alias("line1"), cut(title, 61, 60).alias("line2"), cut(bullet, 1, 80).alias("bullet"))


def share_image(topic: Column, title: Column, bullet: Column, brand: str, site: str) -> Column:
    """The share image of an article as SVG: its topic, its title in one or two lines and its first bullet; ``brand`` and ``site`` stand below."""
    card, line = share_card(title, F.coalesce(bullet, F.lit(""))), lambda y, size, c: F.concat(F.lit(f'<text x="64" y="{y}" font-size="{size}" fill="#f8fafc">'), c, F.lit("</text>"))
    head = '<svg xmlns="http://www.w3.org/2000/svg" width="1200" height="630"><rect width="100%" height="100%" fill="#0f172a"/><g font-family="sans-serif">'
    second = F.when(F.char_length(title) > 60, line(232, 46, card["line2"])).otherwise(F.lit(""))
    foot = line(552, 26, xml_escaped(F.lit(brand))), line(590, 20, xml_escaped(F.lit(site)))
    return F.concat(F.lit(head), line(88, 24, xml_escaped(F.upper(topic))), line(172, 46, card["line1"]), second, line(328, 28, card["bullet"]), *foot, F.lit("</g></svg>"))


def newest_cached(rows: DataFrame, most: int = 50) -> DataFrame:
    """A client's cache: the latest copy of each id, the newest ``most``. Of copies of one time the one of the greatest hash stays."""
    w = Window.partitionBy("id").orderBy(F.desc("cached_at"), F.desc(F.xxhash64(*sorted(rows.columns))))
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn").orderBy(F.desc("cached_at"), "id").limit(most)


def news_sitemap(articles: DataFrame, base: str, name: str, language: str, as_of: str, most: int = 1000) -> DataFrame:
    """One row of XML: the newest visible articles of the last 48 hours with their titles."""
    recent = since(articles.where(F.col("processing_status").isin("done", "fallback")), as_of, "48 HOURS")
    top = recent.orderBy(F.desc("created_at"), F.desc("article_id")).limit(most)
    title = xml_escaped(F.coalesce("title_ai", F.col("title_original"), F.lit("")), quotes=False)
    news = f"<news:publication><news:name>{name}</news:name><news:language>{language}</news:language></news:publication>"
    url = F.concat(
        F.lit(f"<url><loc>{base}/article/"), F.col("article_id").cast("string"), F.lit(f"</loc><news:news>{news}<news:publication_date>"),
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit("</news:publication_date><news:title>"), title, F.lit("</news:title></news:news></url>"),
    )
    listed = top.agg(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("created_at", "article_id", url.alias("u"))))), lambda x: x["u"]).alias("urls"))
    head = '<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:news="http://www.google.com/schemas/sitemap-news/0.9">'
    return listed.select(F.concat(F.lit(head), F.array_join("urls", ""), F.lit("</urlset>")).alias("xml"))


def news_domains(feeds: DataFrame) -> DataFrame:
    """(domain, n) of a news aggregator's feeds (xml): each item counts for its source's address, or else its link; local domains that aren't skipped."""
    item = F.explode(F.regexp_extract_all("xml", F.lit(r"(?is)(<item\b.*?</item>)"), 1)).alias("item")
    i = F.col("item")
    url = F.coalesce(_attribute(i, "source", "url"), F.nullif(_tag(i, "link"), F.lit("")))
    named = feeds.select(item).select(domain(url).alias("domain")).where(is_vietnamese(F.col("domain")) & ~is_skipped(F.col("domain")))
    return named.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


def crawled(pages: DataFrame) -> DataFrame:
    """(source, url, title, published_at, image_url) of fetched sources (page_id, source, type, url, body): pages of type ``html_scrape`` are listings, all others feeds."""
    listed = listing_links(pages.where("type = 'html_scrape'").select("page_id", "url", F.col("body").alias("html")))
    names = pages.select("page_id", "source")
    a = listed.join(names, "page_id").select("source", F.col("link").alias("url"), "title", F.lit(None).cast("timestamp").alias("published_at"), F.lit(None).cast("string").alias("image_url"))
    b = rss_entries(pages.where("type IS NULL OR type <> 'html_scrape'").select("source", F.col("body").alias("xml")))
    return a.unionByName(b.withColumn("published_at", F.col("published_at").cast("timestamp")))
