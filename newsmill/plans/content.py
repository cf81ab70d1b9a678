"""Queries over texts, pages and vectors, with their SQL where it can state them."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsmill.functions import html, text as X, tree, urls as U, vectors as V, wordlists as L
from newsmill.functions.stems import WEAK_STEM_SQL, word_list
from newsmill.operators import dedup, fulltext, ingest, languages, search
from newsmill.operators.commerce import insert_new
from newsmill.operators.engagement import half_up
from newsmill.operators.feed import reading_seconds, top_per_key
from newsmill.operators.keyed import MEMO, KeyedTable, memoised
from newsmill.session import shared_path, ship_package
from newsmill.sources import feeds
from newsmill.sources.feedsource import FeedSource
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


VN = X.VN
#: Words that occur in the driver's texts, so that keyword operators have hits.
FIXTURE_TOPICS = {"ai": ["ai", "data"], "finance": ["fed", "gdp"], "drama": ["trend", "fan"], "technology": ["ev", "app"], "health": ["who", "es"]}
FIXTURE_GOOD, FIXTURE_BAD = ["that", "ing", "le"], ["stupid", "worthless", "erst", "en"]


def _docs(spark, d):
    return v.table(spark, d, "documents").select("doc_id", "text")


BLANK = "'^[\\s\\x0B\\x1C-\\x1F\\x85\\xA0]+|[\\s\\x0B\\x1C-\\x1F\\x85\\xA0]+$'"


@query(f"""WITH q AS (SELECT doc_id, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (length(text) - 100)::DOUBLE / 700.0::DOUBLE)) AS length_score,
 least(1.0::DOUBLE, len(list_filter(string_split(text, chr(10) || chr(10)), lambda p: trim(p) <> ''))::DOUBLE / 3.0::DOUBLE) AS structure_score,
 CASE WHEN len(regexp_extract_all(text, '\\p{{L}}')) = 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, len(regexp_extract_all(text, '{VN}'))::DOUBLE / len(regexp_extract_all(text, '\\p{{L}}'))::DOUBLE) END AS vietnamese_ratio FROM documents)
SELECT doc_id, floor(length_score * 1000000 + 0.5) / 1000000 AS length_score, floor(structure_score * 1000000 + 0.5) / 1000000 AS structure_score, floor(vietnamese_ratio * 1000000 + 0.5) / 1000000 AS vietnamese_ratio FROM q""")
def quality_signals(spark, d):
    r = lambda c, n: half_up(c, 6).alias(n)
    t = F.col("text")
    return _docs(spark, d).select("doc_id", r(X.length_score(t), "length_score"), r(X.structure_score(t), "structure_score"), r(X.vietnamese_ratio(t), "vietnamese_ratio"))


@query()
def quality_scores(spark, d):
    """All signals with repeated phrases (a pattern with a back-reference, beyond the SQL engine's), the overall score and the gate."""
    t = F.col("text")
    parts = _docs(spark, d).select("doc_id", X.length_score(t).alias("l"), X.structure_score(t).alias("s"), X.vietnamese_ratio(t).alias("r"), X.spam_score(t).alias("spam"))
    overall = X.overall_quality(F.col("l"), F.col("s"), F.col("r"), F.col("spam"))
    return parts.select("doc_id", half_up(F.col("spam"), 6).alias("spam_score"), half_up(overall, 6).alias("overall"), (overall >= 0.3).alias("passed"))


def _token_count(words: list[str]) -> str:
    return f"len(list_filter(w, lambda x: list_contains({words!r}, x)))"


@query("WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{Nd}_]+') AS w FROM documents), s AS (SELECT doc_id, " + ", ".join(f"{_token_count(k)} AS n_{t}" for t, k in FIXTURE_TOPICS.items()) + " FROM t) SELECT *, CASE " + " ".join(f"WHEN n_{t} > 0 AND n_{t} = greatest({', '.join('n_' + o for o in FIXTURE_TOPICS)}) THEN '{t}'" for t in FIXTURE_TOPICS) + " ELSE 'lifestyle' END AS topic FROM s")
def topic_scores(spark, d):
    ship_package(spark)
    rows = _docs(spark, d).withColumn("s", X.topic_scores(F.lit(""), F.col("text"), FIXTURE_TOPICS))
    return rows.select("doc_id", *[F.col("s")[t].cast("bigint").alias(f"n_{t}") for t in FIXTURE_TOPICS], X.best_topic(F.col("s"), list(FIXTURE_TOPICS)).alias("topic"))


def _hybrid_sql() -> str:
    names = list(FIXTURE_TOPICS)
    tokens = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{M}}\\p{{Nd}}_]+')"
    count = lambda w, k: f"len(list_filter({w}, lambda x: list_contains({k!r}, x)))"
    best = lambda p: "CASE " + " ".join(f"WHEN {p}{t} > 0 AND {p}{t} = greatest({', '.join(p + o for o in names)}) THEN '{t}'" for t in names) + " ELSE 'lifestyle' END"
    most = f"greatest({', '.join('k_' + t for t in names)})::DOUBLE"
    return with_views("v_articles", body=f""" , w AS (SELECT article_id, {tokens.format('title_original')} AS a, {tokens.format('content_clean')} AS b FROM v_articles),
 k AS (SELECT article_id, {', '.join(f"2 * {count('a', FIXTURE_TOPICS[t])} + {count('b', FIXTURE_TOPICS[t])} AS k_{t}" for t in names)} FROM w),
 c AS (SELECT *, {', '.join(f"0.4::DOUBLE * (CASE WHEN {most} > 0 THEN k_{t}::DOUBLE / {most} ELSE 0.0::DOUBLE END) + 0.6::DOUBLE * (((article_id + {i}) % 7)::DOUBLE / 7.0::DOUBLE) AS c_{t}" for i, t in enumerate(names))} FROM k)
SELECT article_id, CASE WHEN {' + '.join('k_' + t for t in names)} > 2 OR article_id % 5 <> 0 THEN {best('k_')} ELSE {best('c_')} END AS topic FROM c""")


@query(_hybrid_sql())
def hybrid_topics(spark, d):
    """Keyword topics, with scores of a model joined in for a fifth of the articles (here: made from the id)."""
    ship_package(spark)
    a = v.articles(spark, d)
    names = list(FIXTURE_TOPICS)
    model = F.when(F.col("article_id") % 5 == 0, F.create_map(*[x for i, t in enumerate(names) for x in (F.lit(t), (F.pmod(F.col("article_id") + i, F.lit(7)) / 7.0))]))
    scored = a.select("article_id", X.topic_scores(F.col("title_original"), F.col("content_clean"), FIXTURE_TOPICS).alias("k"), model.alias("z"))
    return scored.select("article_id", X.hybrid_topic(F.col("k"), F.col("z"), names).alias("topic"))


@query("WITH s AS (SELECT doc_id, " + " + ".join(f"contains(lower(text), '{k}')::INT" for k in FIXTURE_GOOD) + " AS good, " + " + ".join(f"contains(lower(text), '{k}')::INT" for k in FIXTURE_BAD) + " AS bad FROM documents) SELECT doc_id, CASE WHEN good > bad + 1 THEN 'positive' WHEN bad > good + 1 THEN 'negative' ELSE 'neutral' END AS sentiment FROM s")
def sentiment(spark, d):
    return _docs(spark, d).select("doc_id", X.sentiment(F.col("text"), FIXTURE_GOOD, FIXTURE_BAD).alias("sentiment"))


@query("""WITH s AS (SELECT doc_id, list_filter(['stupid', 'worthless', 'moron'], lambda k: contains(lower(text), k)) AS bad, list_filter(['free', 'rights'], lambda k: contains(lower(text), k)) AS odd, source = 'src3' AS blocked FROM documents)
SELECT doc_id, CASE WHEN blocked OR len(bad) > 0 THEN 'blocked' WHEN len(odd) > 0 THEN 'flagged' ELSE 'passed' END AS status,
 CASE WHEN blocked THEN 'source:blocked_domain:src3' ELSE array_to_string(list_concat(list_transform(bad, lambda k: 'keyword:' || k), list_transform(odd, lambda k: 'flag:' || k)), ',') END AS reasons FROM s""")
def moderation(spark, d):
    docs = v.table(spark, d, "documents").withColumn("url", F.concat(F.lit("https://"), F.when(F.col("source") == "src3", F.lit("src3")).otherwise(F.lit("other")), F.lit(".example.com/")))
    m = X.moderation(F.col("url"), F.lit(""), F.col("text"), ["stupid", "worthless", "moron"], ["free", "rights"], ["src3"])
    return docs.select("doc_id", m.alias("m")).select("doc_id", F.col("m.status").alias("status"), F.array_join("m.reasons", ",").alias("reasons"))


@query(f"""WITH h AS (SELECT doc_id, text, substr(text, 1, 2000) AS t FROM documents), r AS (SELECT doc_id, text, len(regexp_extract_all(t, '{VN}'))::DOUBLE AS n, len(regexp_extract_all(t, '\\p{{L}}'))::DOUBLE AS letters FROM h)
SELECT doc_id, CASE WHEN length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) < 20 THEN 'vi' WHEN letters > 0 AND least(1.0::DOUBLE, n / letters) >= 0.05::DOUBLE THEN 'vi' ELSE 'other' END AS language FROM r""")
def lang_heuristic(spark, d):
    return _docs(spark, d).select("doc_id", X.language(F.col("text")).alias("language"))


@query("""WITH w AS (SELECT doc_id, len(regexp_split_to_array(trim(text, ' '), '[ \\t\\n\\x0B\\f\\r]+')) AS n, trim(text, ' ') = '' AS blank FROM documents)
SELECT doc_id, CAST(least(greatest(ceil((CASE WHEN blank THEN 0 ELSE n END)::DOUBLE / 200.0::DOUBLE * 60.0::DOUBLE), 15), 60) AS BIGINT) AS seconds FROM w""")
def reading_time(spark, d):
    return _docs(spark, d).select("doc_id", reading_seconds(F.col("text")).alias("seconds"))


@query()
def extractive_summary(spark, d):
    s = _docs(spark, d).select("doc_id", X.extractive_summary(F.col("text")).alias("s"))
    return s.select("doc_id", "s.*")


@query()
def summary_validate(spark, d):
    """Scores of the extractive summaries against their texts."""
    s = _docs(spark, d).select("doc_id", "text", X.extractive_summary(F.col("text")).alias("s"))
    scored = s.select("doc_id", X.summary_scores(F.col("s.title_ai"), F.col("s.summary_bullets"), F.col("s.reason"), F.col("text")).alias("v"))
    return scored.select("doc_id", *[half_up(F.col(f"v.{c}"), 3).alias(c) for c in ("title_length", "bullet_count", "bullet_length", "reason", "no_invented_urls", "overall")], "v.valid")


@query("""WITH p AS (SELECT doc_id, list_filter(string_split(text, '. '), lambda s: true)[1] AS s FROM documents) SELECT doc_id, sha256(substr(text, 1, 4000)) AS content_hash, md5(text) AS text_hash FROM documents""")
def content_hashes(spark, d):
    return _docs(spark, d).select("doc_id", U.content_hash(F.col("text")).alias("content_hash"), F.md5("text").alias("text_hash"))


@query("""WITH f AS (SELECT sha256(substr(text, 1, 4000)) AS h, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1) SELECT d.doc_id, f.first_id, f.copies, d.doc_id = f.first_id AS computed FROM documents d JOIN f ON f.h = sha256(substr(d.text, 1, 4000))""")
def exact_text_dedup(spark, d):
    """Which articles an expensive step runs for, and whose result the others take (a memo by content hash)."""
    rows = _docs(spark, d).select("doc_id", U.content_hash(F.col("text")).alias("h"))
    first = rows.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    return rows.join(first, "h").select("doc_id", "first_id", "copies", (F.col("doc_id") == F.col("first_id")).alias("computed"))


@query("""WITH h AS (SELECT doc_id, text, sha256(substr(text, 1, 4000)) AS h FROM documents), k AS (SELECT DISTINCT h FROM h WHERE doc_id % 2 = 0), m AS (SELECT h, min(text) AS t FROM h WHERE h NOT IN (SELECT h FROM k) GROUP BY 1 UNION ALL SELECT h, min(text) FROM h WHERE doc_id % 2 = 0 GROUP BY 1)
SELECT h.doc_id, md5(m.t) AS value, h.h NOT IN (SELECT h FROM k) AS computed FROM h JOIN m ON m.h = h.h""")
def memo_results(spark, d):
    """An expensive step over the even ids, then, some hours later, over all: what the memo holds isn't computed again."""
    docs, key = _docs(spark, d), U.content_hash(F.col("text"))
    memo = KeyedTable(spark, shared_path(spark, "memo"), ["key"], MEMO, 16)
    memoised(docs.where("doc_id % 2 = 0"), memo, F.md5, key, "2024-01-31 00:00:00", 0)
    return memoised(docs, memo, F.md5, key, "2024-01-31 09:00:00", 1).select("doc_id", "value", "computed")


@query()
def detected_languages(spark, d):
    """Each document's language by a detector that is fitted on documents of known language, nulls for those without a letter."""
    docs = v.table(spark, d, "documents")
    return docs.select("doc_id", languages.fit(docs)(F.col("text")).alias("language"))


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
 u AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM l), f AS (SELECT doc_id, trim(line, ' ' || chr(9) || chr(13)) AS k, min(pos) AS pos FROM u WHERE trim(line, ' ' || chr(9) || chr(13)) <> '' GROUP BY 1, 2)
SELECT doc_id, count(*) AS n_lines, string_agg(k, chr(10) ORDER BY pos) AS lines FROM f GROUP BY 1""")
def repeated_lines(spark, d):
    """Each document's different lines, in order of their first place."""
    lines = F.array_distinct(F.filter(F.transform(F.split("text", "\n"), X.strip), lambda p: p != ""))
    return _docs(spark, d).select("doc_id", F.size(lines).cast("bigint").alias("n_lines"), F.array_join(lines, "\n").alias("lines")).where("n_lines > 0")


@query()
def distinct_paragraphs(spark, d):
    doubled = F.concat_ws("\n\n", F.replace("text", F.lit("\n"), F.lit("\n\n")), F.lit("x"), F.split("text", "\n")[0])
    return _docs(spark, d).select("doc_id", X.without_artifacts(doubled).alias("clean"))


# --- pages and addresses


@query("WITH p AS (SELECT page_id, url FROM pages UNION ALL SELECT page_id + 100000, url FROM pages WHERE page_id % 3 = 0), f AS (SELECT md5(url) AS h, min(page_id) AS first_id FROM p GROUP BY 1) SELECT p.page_id, md5(p.url) AS url_hash, p.page_id <> f.first_id AS is_duplicate FROM p JOIN f ON f.h = md5(p.url)")
def url_hash_dedup(spark, d):
    p = v.pages(spark, d).select(F.col("page_id").alias("article_id"), "url")
    again = p.where("article_id % 3 = 0").withColumn("article_id", F.col("article_id") + 100000)
    rows = p.unionByName(again).withColumn("created_at", F.lit(0))
    return dedup.url_duplicates(rows).select(F.col("article_id").alias("page_id"), "url_hash", (F.col("article_id") != F.col("first_id")).alias("is_duplicate"))


HOST = "regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '')"


@query(f"SELECT {HOST} AS domain, count(*) AS n FROM pages WHERE {HOST} <> '' GROUP BY 1")
def domain_counts(spark, d):
    return feeds.domain_counts(v.pages(spark, d).select(F.concat_ws(" ", F.lit("see"), "url").alias("t")), "t")


@query(f"""SELECT page_id, {HOST} AS domain, regexp_matches({HOST}, '(?i)\\.(vn|com\\.vn|net\\.vn|org\\.vn|gov\\.vn|edu\\.vn)$') AS vietnamese FROM pages""")
def page_domains(spark, d):
    name = U.domain(F.col("url"))
    return v.pages(spark, d).select("page_id", name.alias("domain"), U.is_vietnamese(name).alias("vietnamese"))


@query(f"SELECT {HOST} AS domain, 2 * count(*) AS n FROM pages WHERE {HOST} <> '' GROUP BY 1 HAVING 2 * count(*) >= 3")
def backlinks(spark, d):
    """Domains that texts link to at least three times, as candidates for new sources (here each page names its address twice)."""
    text = F.concat(F.lit('<a href="'), F.col("url"), F.lit('">see</a> or '), F.col("url"), F.lit(" "), F.regexp_replace("html", "https?://", ""))
    return feeds.domain_counts(v.pages(spark, d).select(text.alias("t")), "t", 3)


@query()
def discovery(spark, d):
    """Unknown domains linked from pages, by the mean quality of three of their pages."""
    linked = feeds.domain_counts(v.pages(spark, d), "html")
    text = X.strip(F.regexp_replace("html", "<[^>]*>", " "))
    own = v.pages(spark, d).select("page_id", U.domain(F.col("url")).alias("domain"), text.alias("t"))
    three = top_per_key(own, "domain", 3, "page_id")
    t = F.col("t")
    score = X.overall_quality(X.length_score(t), X.structure_score(t), X.vietnamese_ratio(t), X.spam_score(t))
    quality = three.withColumn("s", score).groupBy("domain").agg(half_up(F.avg("s"), 3).alias("quality"))
    news = own.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    known = own.where("domain LIKE 'a%'")
    found = feeds.discovered(linked, news, known, quality)
    return found.select("domain", "name", "vietnamese", "mentions", F.array_join("discovered_via", ",").alias("via"), half_up(F.col("quality"), 3).alias("quality"))


@query()
def clean_html(spark, d):
    ship_package(spark)
    return v.pages(spark, d).select("page_id", html.clean_html(F.col("html")).alias("text"))


ANCHORS = """(?is)<a\\b[^>]*\\bhref=["''][^"'']+["''][^>]*>.*?</a>"""


@query(f"""WITH p AS (SELECT page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS root, regexp_extract_all(html, '{ANCHORS}') AS a FROM pages),
 x AS (SELECT page_id, root, unnest(a) AS a, unnest(range(len(a))) AS pos FROM p),
 l AS (SELECT page_id, pos, CASE WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN h ELSE root || h END AS link, title FROM
  (SELECT page_id, root, pos, trim(regexp_extract(a, '(?is)\\bhref=["'']([^"'']+)["'']', 1)) AS h, trim(regexp_replace(regexp_extract(a, '(?is)>(.*)</a>', 1), '<[^>]*>', '', 'g')) AS title FROM x) WHERE NOT regexp_matches(h, '(?i)^(#|javascript:)')),
 f AS (SELECT page_id, link, min(pos) AS pos, arg_min(title, pos) AS title FROM l GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS position FROM f)
SELECT page_id, position, link, title FROM r WHERE position <= 20""")
def listing_links(spark, d):
    return feeds.listing_links(v.pages(spark, d))


@query("""WITH n AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') AS root, regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) AS nav FROM pages),
 a AS (SELECT page_id, root, unnest(regexp_extract_all(nav, '(?s)<a href="[^"]*">.*?</a>')) AS a, unnest(range(len(regexp_extract_all(nav, '(?s)<a href="[^"]*">.*?</a>')))) AS pos FROM n),
 l AS (SELECT page_id, pos, root || trim(replace(regexp_extract(a, 'href="([^"]*)"', 1), '&amp;', '&')) AS link, trim(replace(regexp_extract(a, '(?s)>(.*?)<', 1), '&amp;', '&')) AS title FROM a),
 f AS (SELECT page_id, link, min(pos) AS pos, arg_min(title, pos) AS title FROM l GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS position FROM f)
SELECT page_id, position::INTEGER AS position, link, title FROM r WHERE position <= 20""")
def listing_selected(spark, d):
    """The links that a selector finds on each page, the first of each, twenty at most."""
    ship_package(spark)
    found = v.pages(spark, d).select("page_id", F.posexplode(tree.selected_links(F.col("html"), F.col("url"), "nav a")).alias("i", "l"))
    return found.select("page_id", (F.col("i") + 1).alias("position"), "l.link", "l.title")


@query()
def page_articles(spark, d):
    """Title and text of each page's article, and how they were found."""
    ship_package(spark)
    return v.pages(spark, d).select("page_id", tree.article_of_page(F.col("html")).alias("a")).select("page_id", "a.title", "a.text", "a.via")


@query("""SELECT DISTINCT 'https://a.example/' || doc_id AS url, trim(regexp_replace(regexp_replace(substr(text, 1, 40), '[<>&]', ' ', 'g'), '\\s+', ' ', 'g')) AS title FROM documents""")
def feed_files(spark, d):
    """Entries of feed files, which are written here from the documents and read through the feed source."""
    ship_package(spark)
    path = shared_path(spark, "feed-files")
    title = F.trim(F.regexp_replace(F.regexp_replace(F.substring("text", 1, 40), "[<>&]", " "), r"\s+", " "))
    items = F.concat(F.lit("<item><title>"), title, F.lit("</title><link>https://a.example/"), F.col("doc_id").cast("string"), F.lit("</link></item>"))
    _docs(spark, d).select(items.alias("value")).write.text(path)
    spark.dataSource.register(FeedSource)
    return spark.read.format("feed").option("endings", ".txt").load(path).select("url", "title")


@query("""WITH p AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '') AS domain, len(list_filter(regexp_extract_all(html, '(?is)<link\\b[^>]*>'), lambda t: regexp_matches(t, '(?is)rel=["'']?alternate'))) AS n FROM pages)
SELECT page_id, n > 0 AS in_page, 'https://' || domain || unnest(['/rss', '/rss/home.rss', '/rss/tin-moi-nhat.rss', '/feed', '/feed/rss', '/atom.xml', '/rss.xml']) AS feed FROM p""")
def feed_autodetect(spark, d):
    return feeds.feed_links(v.pages(spark, d))


@query("SELECT 'pages' AS source, url, CAST(page_id AS VARCHAR) AS title, '2024-01-16 03:00:00' AS published_at, 'https://i.example/' || page_id || '.jpg' AS image_url FROM pages")
def rss_entries(spark, d):
    """Pages wrapped as feeds and read back."""
    p = v.pages(spark, d)
    item = F.concat(F.lit("<rss><channel><item><title><![CDATA["), F.col("page_id").cast("string"), F.lit("]]></title><link>"), U.xml_escaped(F.col("url")), F.lit('</link><pubDate>Tue, 16 Jan 2024 10:00:00 +0700</pubDate><enclosure url="https://i.example/'), F.col("page_id").cast("string"), F.lit('.jpg" type="image/jpeg"/></item><item><title>no link</title></item></channel></rss>'))
    found = feeds.rss_entries(p.select(F.lit("pages").alias("source"), item.alias("xml")))
    return found.withColumn("published_at", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss"))


@query(with_views("v_articles", body=""" , t AS (SELECT * FROM v_articles WHERE processing_status IN ('done', 'fallback') ORDER BY created_at DESC, article_id DESC LIMIT 100)
SELECT '<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' || string_agg('<url><loc>https://news.example/article/' || article_id || '</loc><lastmod>' || strftime(created_at, '%Y-%m-%d') || '</lastmod></url>', '' ORDER BY created_at DESC, article_id DESC) || '</urlset>' AS xml FROM t"""))
def sitemap(spark, d):
    return feeds.sitemap(v.articles(spark, d), "https://news.example", 100)


@query("SELECT doc_id, replace(replace(replace(replace(substr(text, 1, 60), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS line1, replace(replace(replace(replace(substr(text, 61, 60), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS line2 FROM documents")
def share_cards(spark, d):
    return _docs(spark, d).select("doc_id", feeds.share_card(F.col("text"), F.lit("")).alias("c")).select("doc_id", "c.line1", "c.line2")


ESCAPED = "replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
SVG_LINE = "'<text x=\"64\" y=\"{}\" font-size=\"{}\" fill=\"#f8fafc\">' || {} || '</text>'"


@query(with_views("v_articles", body=f""" SELECT article_id, '<svg xmlns="http://www.w3.org/2000/svg" width="1200" height="630"><rect width="100%" height="100%" fill="#0f172a"/><g font-family="sans-serif">'
 || {SVG_LINE.format(88, 24, "upper(topic)")} || {SVG_LINE.format(172, 46, ESCAPED.format("substr(title_original, 1, 60)"))}
 || CASE WHEN length(title_original) > 60 THEN {SVG_LINE.format(232, 46, ESCAPED.format("substr(title_original, 61, 60)"))} ELSE '' END
 || {SVG_LINE.format(328, 28, ESCAPED.format("substr(content_clean, 81, 80)"))} || {SVG_LINE.format(552, 26, "'News &amp; more'")} || {SVG_LINE.format(590, 20, "'news.example'")} || '</g></svg>' AS svg FROM v_articles"""))
def share_images(spark, d):
    """Each article's share image; its bullet is what follows the title."""
    a = v.articles(spark, d)
    return a.select("article_id", feeds.share_image(F.col("topic"), F.col("title_original"), F.substring("content_clean", 81, 1000), "News & more", "news.example").alias("svg"))


@query("""WITH h AS (SELECT page_id, url, CASE page_id % 3 WHEN 0 THEN 404 ELSE 200 END AS status, CASE page_id % 4 WHEN 1 THEN 'text/html' WHEN 2 THEN NULL ELSE 'image/png' END AS kind, CASE WHEN page_id % 5 > 0 THEN page_id * 40 END AS size FROM pages)
SELECT page_id, CASE WHEN url LIKE 'http%' AND status = 200 AND kind LIKE 'image/%' AND coalesce(size, 5000) >= 5000 THEN url END AS image_url FROM h""")
def valid_images(spark, d):
    """Addresses whose replies are images (replies are made from the pages' ids here)."""
    n = F.col("page_id")
    kind = F.when(n % 4 == 1, "text/html").when(n % 4 == 2, F.lit(None)).otherwise("image/png")
    status, size = F.when(n % 3 == 0, 404).otherwise(200), F.when(n % 5 > 0, n * 40)
    return v.pages(spark, d).select("page_id", U.valid_image(F.col("url"), status, kind, size, 5000).alias("image_url"))


@query(with_views("v_articles", body=" SELECT * EXCLUDE (content_clean, created_at), strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM v_articles"))
def article_listing(spark, d):
    """All of an article but its text, which a listing doesn't read."""
    return v.articles(spark, d).drop("content_clean").withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


@query("""WITH d AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'm.facebook.com' WHEN 1 THEN 'x.com' WHEN 2 THEN 'box.com' ELSE regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '') END AS domain FROM pages)
SELECT page_id, domain, domain IN ('m.facebook.com', 'x.com') AS skipped, array_to_string(list_transform(string_split(replace(split_part(domain, '.', 1), '-', ' '), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS name FROM d""")
def skipped_domains(spark, d):
    """Whether a domain is passed over, itself or as part of one that is, and the name of its source."""
    n = F.col("page_id") % 5
    name = F.when(n == 0, "m.facebook.com").when(n == 1, "x.com").when(n == 2, "box.com").otherwise(U.domain(F.col("url")))
    rows = v.pages(spark, d).select("page_id", name.alias("domain"))
    return rows.select("page_id", "domain", U.is_skipped(F.col("domain")).alias("skipped"), U.source_name(F.col("domain")).alias("name"))


# --- vectors, search, dedup


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings), p AS (SELECT q.query_id, e.vec_id AS article_id, floor(list_sum(list_transform(range(1, len(q.q) + 1), lambda i: q.q[i] * e.embedding[i]::DOUBLE)) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE AS score FROM embeddings e CROSS JOIN q),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, article_id) AS rank FROM p) SELECT query_id, article_id, score, rank FROM r WHERE rank <= 3""")
def knn_topk(spark, d):
    """The three nearest of every vector."""
    e = v.embeddings(spark, d)
    return search.nearest(e, e.select(F.col("article_id").alias("query_id"), F.col("embedding").alias("q")), 3)


@query("""WITH e AS (SELECT vec_id AS article_id, embedding::DOUBLE[] AS v, label, row_number() OVER (PARTITION BY label ORDER BY vec_id % 240 DESC, vec_id DESC) AS rn FROM embeddings),
 n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM e),
 p AS (SELECT a.article_id, b.article_id AS related_id, floor(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) / (a.norm * b.norm + 1e-9::DOUBLE) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE AS score FROM n a JOIN n b ON a.label = b.label AND b.rn <= 50 AND a.article_id <> b.article_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY score DESC, related_id) AS rank FROM p) SELECT article_id, related_id, score, rank FROM r WHERE rank <= 5""")
def related_articles(spark, d):
    e = v.embeddings(spark, d).withColumn("created_at", F.col("article_id") % 240)
    return search.related(e, "label")


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(vec_id % 720 AS INTEGER)) AS t FROM embeddings), n AS (SELECT *, row_number() OVER (ORDER BY t, vec_id) AS n FROM e),
 p AS (SELECT a.vec_id AS later, b.vec_id AS earlier, list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS s FROM n a JOIN n b ON a.n > b.n AND a.n - b.n <= 200 AND b.t >= a.t - INTERVAL 48 HOURS)
SELECT later, earlier, floor(s * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE AS score FROM p WHERE s >= 0.4::DOUBLE""")
def dedup_embedding_pairs(spark, d):
    """Pairs of similar vectors among neighbours in arrival order."""
    e = _timed(v.embeddings(spark, d)).withColumn("title_original", F.lit(None).cast("string"))
    found = dedup.similar_pairs(e, 48, 0.8, 0.4)
    return found.select("later", "earlier", half_up(F.col("score"), 6).alias("score"))


def _timed(rows):
    return rows.withColumn("created_at", F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, cast(pmod(article_id, 720) as int), 0, 0)"))


def _arrivals(spark, d):
    """Documents as arriving articles, with the vectors of the same ids."""
    a = v.articles(spark, d).select("article_id", "title_original", "created_at")
    vectors = v.embeddings(spark, d).select("article_id", "embedding")
    url = F.concat(F.lit("https://a.example/"), (F.col("article_id") - F.when(F.col("article_id") % 40 == 1, 1).otherwise(0)).cast("string"))
    return a.join(vectors, "article_id", "left").withColumn("url", url)


@query()
def dedup_three_layers(spark, d):
    """The three layers against all articles of 48 hours, not the newest 200."""
    return dedup.deduplicate(_arrivals(spark, d), embed_threshold=0.4, most=None)


@query()
def dedup_title_pairs(spark, d):
    a = _arrivals(spark, d).withColumn("embedding", F.lit(None).cast("array<double>"))
    return dedup.similar_pairs(a, most=None).select("later", "earlier")


@query("""WITH e AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS i FROM embeddings), n AS (SELECT label, count(*) AS article_count FROM embeddings GROUP BY 1)
SELECT e.label AS cluster_id, n.article_count, e.i::INTEGER AS i, floor(avg(e.x) * 1000000 + 0.5) / 1000000 AS x FROM e JOIN n ON n.label = e.label GROUP BY 1, 2, 3""")
def cluster_centroids(spark, d):
    """Each cluster's size and the components of its centroid."""
    c = dedup.clusters(v.embeddings(spark, d).select(F.col("label").alias("cluster_id"), "embedding"))
    return c.select("cluster_id", "article_count", F.posexplode("centroid").alias("i", "x")).withColumn("x", half_up(F.col("x"), 6))


@query(with_views("v_articles", body=""" , s AS (SELECT article_id, 2.0::DOUBLE * len(list_filter(regexp_split_to_array(lower(title_original), '\\s+'), lambda x: x IN ('the', 'and'))) + len(list_filter(regexp_split_to_array(lower(content_clean), '\\s+'), lambda x: x IN ('the', 'and'))) AS score FROM v_articles)
SELECT article_id, score FROM s WHERE score > 0 ORDER BY score DESC, article_id LIMIT 20"""))
def search_tokens(spark, d):
    found = search.text_search(v.articles(spark, d), "the and", {"title_original": 2.0, "content_clean": 1.0})
    return found.orderBy(F.desc("score"), "article_id").limit(20).select("article_id", "score")


@query(with_views("v_articles", body=""" , t AS (SELECT article_id, created_at, title_original, list_filter(regexp_split_to_array(lower(title_original), '[^\\p{L}\\p{M}\\p{Nd}_]+'), lambda w: levenshtein(translate(w, 'èéñßêçíüöóä', 'ABCDEFGHIJK'), 'ering') <= 1) AS hits FROM v_articles)
SELECT article_id, replace(regexp_replace(regexp_replace(title_original, '([^\\p{L}\\p{M}\\p{Nd}_])', '\\1' || chr(1), 'g'), '(^|' || chr(1) || ')(' || array_to_string(list_distinct(hits), '|') || ')($|[^\\p{L}\\p{M}\\p{Nd}_])', '\\1<mark>\\2</mark>\\3', 'gi'), chr(1), '') AS highlighted FROM t WHERE len(hits) > 0 ORDER BY created_at DESC, article_id LIMIT 50"""))
def search_fuzzy(spark, d):
    found = search.fuzzy_search(v.articles(spark, d), "ering", "title_original")
    return found.orderBy(F.desc("created_at"), "article_id").limit(50).select("article_id", "highlighted")


#: The tokens of a column in SQL, as the index finds them.
SQL_WORDS = "regexp_extract_all(lower(coalesce({}, '')), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')"
#: This SQL's edit distance counts bytes, so the letters of two bytes in the driver's texts become capitals, which lowered words don't have.
ONE_BYTE = "translate({}, 'èéñßêçíüöóä', 'ABCDEFGHIJK')"
SEARCH_FIELDS = {"title_ai": 3.0, "title_original": 2.0, "summary_text": 1.0, "topic": 1.0, "source": 1.0}
SEARCH_VIEW = """ , f AS (SELECT article_id AS id, substr(content_clean, 1, 40) AS title_ai, title_original, content_clean AS summary_text, topic, source,
 created_at, processing_status FROM v_articles)"""


def _searched(spark, d, search):
    """Articles with the five fields that a search looks at, and an index of them for it."""
    a = v.articles(spark, d)
    a = a.select("article_id", F.substring("content_clean", 1, 40).alias("title_ai"), "title_original", F.col("content_clean").alias("summary_text"), "topic", "source", "created_at", "processing_status")
    return a, fulltext.build(a, shared_path(spark, "search-index"), SEARCH_FIELDS, ("title_ai", "topic", "created_at", "processing_status"), searches=(search,))


@query(with_views("v_articles", body=SEARCH_VIEW + f""", w AS (
 SELECT id, unnest({SQL_WORDS.format('title_ai')}) AS w, 3.0::DOUBLE AS g FROM f UNION ALL SELECT id, unnest({SQL_WORDS.format('title_original')}), 2.0::DOUBLE FROM f
 UNION ALL SELECT id, unnest({SQL_WORDS.format('summary_text')}), 1.0::DOUBLE FROM f UNION ALL SELECT id, unnest({SQL_WORDS.format('topic')}), 1.0::DOUBLE FROM f
 UNION ALL SELECT id, unnest({SQL_WORDS.format('source')}), 1.0::DOUBLE FROM f
), s AS (SELECT id, {WEAK_STEM_SQL} AS term, g FROM w), p AS (SELECT id, term, sum(g) AS tf FROM s GROUP BY 1, 2),
 n AS (SELECT f.id, coalesce(sum(p.tf), 0.0::DOUBLE) AS length FROM f LEFT JOIN p ON p.id = f.id GROUP BY 1),
 m AS (SELECT count(*)::DOUBLE AS n, avg(length) AS mean FROM n), h AS (SELECT term, count(*)::DOUBLE AS holders FROM p GROUP BY 1),
 a AS (SELECT id AS query_id, unnest(string_split(title_original, ' ')[1:6]) AS x FROM f WHERE id % 100 = 0),
 b AS (SELECT query_id, unnest({SQL_WORDS.format('x')}) AS w FROM a), q AS (SELECT DISTINCT query_id, {WEAK_STEM_SQL} AS term FROM b),
 r AS (SELECT q.query_id, p.id AS article_id, floor(sum(ln(1.0::DOUBLE + (m.n - h.holders + 0.5::DOUBLE) / (h.holders + 0.5::DOUBLE)) * (p.tf * 2.2::DOUBLE / (p.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n.length / m.mean)))) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE AS score
  FROM q JOIN p ON p.term = q.term JOIN h ON h.term = q.term JOIN n ON n.id = p.id, m GROUP BY 1, 2),
 o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, article_id) AS rank FROM r)
SELECT query_id, article_id, score, rank FROM o WHERE rank <= 10"""))
def search_bm25(spark, d):
    """The ten best articles for the first six words of each title whose id is divisible by 100."""
    a, index = _searched(spark, d, "ranked")
    asked = a.where("article_id % 100 = 0").select(F.col("article_id").alias("query_id"), F.array_join(F.slice(F.split("title_original", " "), 1, 6), " ").alias("query"))
    return index.ranked(asked)


@query(with_views("v_articles", body=SEARCH_VIEW + f""", w AS (
 SELECT DISTINCT id, unnest({SQL_WORDS.format('title_ai')}) AS word, 0 AS field FROM f UNION SELECT id, unnest({SQL_WORDS.format('title_original')}), 1 FROM f
 UNION SELECT id, unnest({SQL_WORDS.format('summary_text')}), 2 FROM f UNION SELECT id, unnest({SQL_WORDS.format('topic')}), 3 FROM f UNION SELECT id, unnest({SQL_WORDS.format('source')}), 4 FROM f
), a AS (SELECT id AS query_id, unnest(string_split(title_original, ' ')[1:3]) AS x FROM f WHERE id % 100 = 0),
 b AS (SELECT query_id, unnest({SQL_WORDS.format('x')}) AS y FROM a),
 q AS (SELECT DISTINCT query_id, CASE WHEN length(y) >= 6 THEN substr(y, 1, 2) || substr(y, 4, length(y) - 3) ELSE y END AS term FROM b),
 v AS (SELECT DISTINCT word FROM w), t AS (SELECT DISTINCT term FROM q),
 near AS (SELECT term, word, levenshtein({ONE_BYTE.format('term')}, {ONE_BYTE.format('word')}) AS typos FROM t JOIN v ON abs(length(term) - length(word)) <= 2
  WHERE levenshtein({ONE_BYTE.format('term')}, {ONE_BYTE.format('word')}) <= CASE WHEN length(term) >= 9 THEN 2 WHEN length(term) >= 5 THEN 1 ELSE 0 END),
 hit AS (SELECT q.query_id, q.term, w.id, min(near.typos * 10 + w.field) AS m FROM q JOIN near ON near.term = q.term JOIN w ON w.word = near.word GROUP BY 1, 2, 3),
 n AS (SELECT query_id, count(*) AS n FROM q GROUP BY 1),
 g AS (SELECT hit.query_id, hit.id, sum(m // 10) AS typos, min(m % 10) AS field FROM hit JOIN n ON n.query_id = hit.query_id GROUP BY 1, 2, n.n HAVING count(*) = n.n),
 o AS (SELECT g.*, row_number() OVER (PARTITION BY g.query_id ORDER BY g.typos, g.field, f.created_at DESC, g.id) AS rank FROM g JOIN f ON f.id = g.id WHERE f.processing_status = 'done')
SELECT query_id, id AS article_id, typos::INTEGER AS typos, field::INTEGER AS field, rank FROM o WHERE rank <= 20"""))
def search_typos(spark, d):
    """Finished articles with the first three words of each title whose id is divisible by 100, a letter missing in longer ones."""
    a, index = _searched(spark, d, "typos")
    asked = a.where("article_id % 100 = 0").select(F.col("article_id").alias("query_id"), F.explode(F.slice(F.split("title_original", " "), 1, 3)).alias("x"))
    y = F.col("y")
    short = F.when(F.char_length(y) >= 6, F.concat(F.substring(y, 1, 2), F.substring(y, F.lit(4), F.char_length(y) - 3))).otherwise(y)
    asked = asked.select("query_id", F.explode(word_list(F.col("x"))).alias("y")).groupBy("query_id").agg(F.array_join(F.collect_list(short), " ").alias("query"))
    return index.with_typos(asked, where=F.col("processing_status") == "done").select("query_id", "article_id", "typos", "field", "rank")


@query(with_views("v_articles", body=f""" , t AS (SELECT article_id, topic, title_original, created_at FROM v_articles WHERE processing_status = 'done' AND topic IN ('ai', 'finance') AND created_at >= TIMESTAMP '{MID}' - INTERVAL 24 HOURS AND created_at <= TIMESTAMP '{MID}' ORDER BY created_at DESC, article_id LIMIT 5)
SELECT coalesce(string_agg(title_original, ' | ' ORDER BY created_at DESC, article_id), '') AS briefing FROM t"""))
def briefing(spark, d):
    a = v.articles(spark, d).where(F.col("topic").isin("ai", "finance") & (F.col("processing_status") == "done"))
    a = a.where((F.col("created_at") >= v.before(MID, "24 HOURS")) & (F.col("created_at") <= v.at(MID)))
    top = a.orderBy(F.desc("created_at"), "article_id").limit(5)
    listed = top.agg(F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("t"), "article_id", "title_original"))).alias("l"))
    return listed.select(F.array_join(F.transform("l", lambda x: x["title_original"]), " | ").alias("briefing"))


@query(with_views("v_articles", body=f" SELECT article_id, topic FROM v_articles WHERE topic = 'finance' AND processing_status IN ('done', 'fallback') AND created_at <= TIMESTAMP '{AS_OF}' ORDER BY created_at DESC, article_id LIMIT 10"))
def related_fallback(spark, d):
    same = v.articles(spark, d).where((F.col("topic") == "finance") & F.col("processing_status").isin("done", "fallback") & (F.col("created_at") <= v.at(AS_OF)))
    return same.orderBy(F.desc("created_at"), "article_id").limit(10).select("article_id", "topic")


@query(with_views("v_topics", body=' SELECT key, label, "order" FROM v_topics WHERE is_active'))
def active_topics(spark, d):
    return v.topics(spark, d).where("is_active").orderBy("order").select("key", "label", "order")


@query(with_views("v_topics", body=""" , old AS (SELECT key, label, is_active FROM v_topics WHERE "order" % 3 <> 0)
SELECT * FROM old UNION ALL SELECT key, 'seed ' || key, true FROM v_topics WHERE key NOT IN (SELECT key FROM old)"""))
def seeded_topics(spark, d):
    """A collection after its seeds: known keys stay as they are, the others are inserted."""
    topics = v.topics(spark, d)
    old = topics.where("`order` % 3 <> 0").select("key", "label", "is_active")
    seeds = topics.select("key", F.concat(F.lit("seed "), "key").alias("label"), F.lit(True).alias("is_active"))
    return old.unionByName(insert_new(old, seeds, ["key"]))


@query("SELECT p_partkey AS product_id, floor((0.5::DOUBLE * least(((contains(lower(p_name), 'ring'))::INT + (contains(lower(p_name), 'small'))::INT)::DOUBLE / 2.0::DOUBLE, 1.0::DOUBLE) + 0.3::DOUBLE * (CASE WHEN p_size % 2 = 0 THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END) + 0.2::DOUBLE * least(p_size::DOUBLE / 15.0::DOUBLE, 1.0::DOUBLE)) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE AS score FROM part")
def affiliate_scores(spark, d):
    from newsmill.operators.feed import affiliate_score

    p = v.table(spark, d, "part")
    hits = F.size(X.containing(F.col("p_name"), ["ring", "small"]))
    score = affiliate_score(hits, F.lit(2), F.col("p_size") % 2 == 0, F.col("p_size").cast("double"))
    return p.select(F.col("p_partkey").alias("product_id"), half_up(score, 6).alias("score"))


@query()
def ingestion(spark, d):
    """Every article's status: the first gate that stops it, or done."""
    return ingest.process(_raw(spark, d), known_urls=None, settings=ingest.Settings(topics=FIXTURE_TOPICS, blocked=["stupid", "worthless"], flagged=["rights"], embed_threshold=0.4)).select("article_id", "status", "topic", "sentiment", "cluster_id")


@query()
def ingestion_stats(spark, d):
    return ingest.stats(ingestion(spark, d))


def _raw(spark, d):
    a = _arrivals(spark, d)
    return a.join(_docs(spark, d).select(F.col("doc_id").alias("article_id"), "text"), "article_id")
