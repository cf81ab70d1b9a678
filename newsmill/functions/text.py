"""Column functions on text: cleaning, quality, topics, sentiment, moderation, summaries, language."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsmill.functions import wordlists as L
from newsmill.functions.keywords import contained, group_counts
from newsmill.functions.repeats import repeated_phrases

VN = "[" + L.vietnamese_letters() + "]"
LETTER = r"\p{L}"
#: Keywords up to which a scan each, within the plan, costs less than handing the text to a task's Python.
LONG_LIST = 64
URL = r"(?i)https?://\S+"
CAPITALS = "[A-ZÀÁẠẢÃÂẦẤẬẨẪĂẰẮẶẲẴ]"
CAPS = rf"(?U)\b{CAPITALS}{{5,}}\b"
#: Unicode white space, as ``(?U)\s`` has it.
WHITE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    """Trims all Unicode white space."""
    return F.btrim(c, F.lit(WHITE))


def words(c: Column) -> Column:
    """White-space separated words; none in a blank text."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def quoted(keywords: list[str]) -> str:
    """An alternation, longest first."""
    return "|".join(re.sub(r"([^\w\s])", r"\\\1", k) for k in sorted(keywords, key=lambda k: (-len(k), keywords.index(k))))


# --- cleaning


def _let(value: Column, use) -> Column:
    """``use(value)``, with the value computed once."""
    return F.transform(F.array(value), use)[0]


def distinct_paragraphs(text: Column) -> Column:
    """The first of each paragraph, untrimmed; equal means equal when trimmed; blank ones go."""
    keyed = F.filter(F.transform(F.split(text, "\n\n"), lambda p, i: F.struct(strip(p).alias("key"), i.alias("i"), p.alias("raw"))), lambda s: s["key"] != "")
    first = lambda s: F.filter(s, lambda x, j: (j == 0) | (F.get(s, j - 1)["key"] != x["key"]))
    in_order = F.sort_array(F.transform(_let(F.sort_array(keyed), first), lambda x: F.struct(x["i"].alias("i"), x["raw"].alias("raw"))))
    return F.array_join(F.transform(in_order, lambda x: x["raw"]), "\n\n")


def without_artifacts(text: Column) -> Column:
    """Patterns go to a line's end, so a text without any of their signs (:data:`wordlists.ARTIFACT_SIGNS`) has no match, also after others are removed."""
    signs = lambda low: reduce(Column.__or__, [reduce(Column.__and__, [F.contains(low, F.lit(x)) for x in every]) for every in L.ARTIFACT_SIGNS])
    cleaned = reduce(lambda c, p: F.regexp_replace(c, p, ""), L.ARTIFACTS, text)
    return strip(distinct_paragraphs(F.when(_let(F.lower(text), signs), cleaned).otherwise(text)))


def parsed_date(text: Column) -> Column:
    """The first format that fits, else null; without a zone it is UTC."""
    value = F.regexp_replace(strip(text), r"^\w{3}, ", "")
    formats = (
        "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ssxx", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd",
        "dd/MM/yyyy HH:mm", "dd/MM/yyyy", "d MMM yyyy HH:mm:ss xx", "d MMM yyyy HH:mm:ss 'GMT'",
    )
    return F.coalesce(*[F.try_to_timestamp(value, F.lit(f)) for f in formats])


# --- quality


def length_score(text: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.char_length(text) - 100) / 700.0))


def structure_score(text: Column) -> Column:
    return F.least(F.lit(1.0), F.size(F.filter(F.split(text, "\n\n"), lambda p: strip(p) != "")) / 3.0)


def count_of(text: Column, without: Column) -> Column:
    return F.char_length(text) - F.char_length(without)


def vietnamese_ratio(text: Column) -> Column:
    """Letters with Vietnamese marks among all letters, counted by what is left when they are taken out."""
    letters = count_of(text, F.regexp_replace(text, LETTER + "+", ""))
    marked = count_of(text, F.translate(text, L.vietnamese_letters(), ""))
    return _let(letters, lambda n: F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), marked / n)))


def spam_score(text: Column) -> Column:
    """The mean of links, words in capitals and repeated phrases."""
    n = F.greatest(F.size(words(text)), F.lit(1))
    urls = F.least(F.lit(1.0), F.regexp_count(text, F.lit(URL)) * 10.0 / n)
    loud = F.when(~F.rlike(text, F.lit(CAPITALS + "{5}")), 0).otherwise(F.regexp_count(text, F.lit(CAPS)))
    caps = F.least(F.lit(1.0), loud / 5.0)
    again = F.least(F.lit(1.0), repeated_phrases(text) / 3.0)
    return F.when(strip(text) == "", 0.0).otherwise((urls + caps + again) / 3.0)


def overall_quality(length: Column, structure: Column, vietnamese: Column, spam: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.3 * length + 0.25 * structure + 0.25 * vietnamese + 0.2 * (1.0 - spam)))


# --- topics, sentiment, moderation


def topic_scores(title: Column, text: Column, topics: dict[str, list[str]]) -> Column:
    """A map of title hits twice and text hits once: whole keywords, longest first, without overlap, in either case; one scan a field."""
    groups = list(topics.values())
    both = lambda counts: F.create_map(*[x for i, t in enumerate(topics) for x in (F.lit(t), 2 * counts["a"][i] + counts["b"][i])])
    return _let(F.struct(group_counts(title, groups).alias("a"), group_counts(text, groups).alias("b")), both)


def best_topic(scores: Column, topics: list[str], default: str = L.DEFAULT_TOPIC) -> Column:
    """The greatest score; ties go to the topic that is listed first, no hits to the default."""
    rows = F.array(*[F.struct(scores[t].cast("double").alias("s"), F.lit(-i).alias("o"), F.lit(t).alias("t")) for i, t in enumerate(topics)])
    best = F.array_max(rows)
    return F.when(best["s"] > 0, best["t"]).otherwise(F.lit(default))


def combined_scores(keyword: Column, zero_shot: Column, topics: list[str], keyword_weight: float = 0.4, zero_shot_weight: float = 0.6) -> Column:
    """Keyword scores over their greatest, and the scores of a model that were joined in, weighted."""
    most = F.greatest(*[keyword[t] for t in topics])
    share = lambda t: F.when(most > 0, keyword[t] / most).otherwise(0.0)
    return F.create_map(*[x for t in topics for x in (F.lit(t), keyword_weight * share(t) + zero_shot_weight * F.coalesce(zero_shot[t], F.lit(0.0)))])


def hybrid_topic(keyword: Column, zero_shot: Column, topics: list[str], threshold: int = 2) -> Column:
    """Keywords alone with more than ``threshold`` hits or without model scores, else both."""
    total = reduce(Column.__add__, [keyword[t] for t in topics])
    alone = (total > threshold) | zero_shot.isNull()
    return F.when(alone, best_topic(keyword, topics)).otherwise(best_topic(combined_scores(keyword, zero_shot, topics), topics))


def _held(low: Column, keywords: list[str]) -> Column:
    """:func:`containing` of a text that is lower-case already."""
    if not keywords:
        return F.array().cast("array<string>")
    if len(keywords) > LONG_LIST:
        written = {k.lower(): k for k in keywords}
        return F.transform(contained(low, list(written)), lambda k: F.element_at(F.create_map(*[F.lit(x) for kv in written.items() for x in kv]), k))
    named = F.array(*[F.struct(F.lit(k).alias("written"), F.lower(F.lit(k)).alias("low")) for k in keywords])
    return _let(low, lambda t: F.transform(F.filter(named, lambda k: F.contains(t, k["low"])), lambda k: k["written"]))


def containing(text: Column, keywords: list[str]) -> Column:
    """The keywords that the lower-case text contains anywhere; a long list is looked for in one scan. A text is made lower-case once, not for each keyword."""
    return _held(F.lower(text), keywords)


def sentiment(text: Column, positive: list[str] = L.POSITIVE, negative: list[str] = L.NEGATIVE) -> Column:
    """More of the one list's keywords than of the other's, by two at least; long lists are looked for in one scan together."""
    if len(positive) + len(negative) > LONG_LIST:
        every = [[k.lower() for k in words_] for words_ in (positive, negative)]
        held = lambda found, words_: F.size(F.filter(F.array(*[F.lit(k) for k in words_]).cast("array<string>"), lambda k: F.array_contains(found, k)))
        counts = _let(contained(F.lower(text), list(dict.fromkeys(every[0] + every[1]))), lambda x: F.struct(held(x, every[0]).alias("good"), held(x, every[1]).alias("bad")))
    else:
        counts = F.struct(F.size(containing(text, positive)).alias("good"), F.size(containing(text, negative)).alias("bad"))
    return _let(counts, lambda n: F.when(n["good"] > n["bad"] + 1, "positive").when(n["bad"] > n["good"] + 1, "negative").otherwise("neutral"))


def moderation(url: Column, title: Column, text: Column, blocked: list[str] = L.BLOCKED, flagged: list[str] = L.FLAGGED, block_domains: list[str] = (), allow_domains: list[str] = ()) -> Column:
    """struct(status, reasons): a blocked source, blocked words (with the flagged ones), flagged words, or pass."""
    from newsmill.functions.urls import source_check

    whole = F.concat_ws(" ", title, text)
    found = F.struct(source_check(url, block_domains, allow_domains).alias("source"), containing(whole, blocked).alias("bad"), containing(whole, flagged).alias("odd"))
    named = lambda kind, words_: F.transform(words_, lambda k: F.concat(F.lit(kind), k))
    verdict = lambda x: (
        F.when(~x["source"]["allowed"], F.struct(F.lit("blocked").alias("status"), F.array(F.concat(F.lit("source:"), x["source"]["reason"])).alias("reasons")))
        .when(F.size(x["bad"]) > 0, F.struct(F.lit("blocked").alias("status"), F.concat(named("keyword:", x["bad"]), named("flag:", x["odd"])).alias("reasons")))
        .when(F.size(x["odd"]) > 0, F.struct(F.lit("flagged").alias("status"), named("flag:", x["odd"]).alias("reasons")))
        .otherwise(F.struct(F.lit("passed").alias("status"), F.array().cast("array<string>").alias("reasons")))
    )
    return _let(found, verdict)


# --- language and summaries


def language(text: Column, least: float = 0.05, detector: Callable[[Column], Column] | None = None) -> Column:
    """'vi' for short texts or many Vietnamese letters among the first 2000 characters; else what ``detector``
    makes of the first 3000 ('vi' if that is null), or 'other' without one. The two lengths belong to the rule."""
    rest = F.lit("other") if detector is None else F.coalesce(detector(F.substring(text, 1, 3000)), F.lit("vi"))
    return F.when(F.char_length(strip(text)) < 20, "vi").when(vietnamese_ratio(F.substring(text, 1, 2000)) >= least, "vi").otherwise(rest)


def translated(text: Column, translation: Column, language_: Column, least: float = 0.3) -> Column:
    """A translation that was joined in, unless the text needs none or the translation is too short."""
    good = (language_ != "vi") & (F.char_length(translation) >= least * F.char_length(text))
    return F.struct(F.when(good, translation).otherwise(text).alias("text"), F.coalesce(good, F.lit(False)).alias("translated"))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?U)(?<=[.!?。])\s+"), strip), lambda s: s != "")


def first_words(text: Column, n: int = 12) -> Column:
    return F.array_join(F.slice(words(text), 1, n), " ")


def extractive_summary(text: Column, reasons: list[str] = L.FALLBACK_REASONS) -> Column:
    """struct(title_ai, summary_bullets of three, reason); the reason follows from the text's hash."""
    s = sentences(text)
    title = F.when(F.size(s) > 0, first_words(s[0])).otherwise(F.substring(text, 1, 80))
    bullets = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.coalesce(F.get(s, i), F.lit("")))
    pick = F.element_at(F.array(*[F.lit(r) for r in reasons]), (F.pmod(F.xxhash64(text), F.lit(len(reasons))) + 1).cast("int"))
    return F.struct(title.alias("title_ai"), bullets.alias("summary_bullets"), pick.alias("reason"))


def parsed_reply(raw: Column) -> Column:
    """struct of a model's reply, null unless it has a title, a reason and three bullets; the last title wins."""
    lines = F.transform(F.split(raw, "\n"), strip)
    of = lambda tag: strip(F.substr(F.element_at(F.filter(lines, lambda x: F.startswith(F.upper(x), F.lit(tag))), -1), F.lit(len(tag) + 1)))
    has = lambda tag: F.exists(lines, lambda x: F.startswith(F.upper(x), F.lit(tag)))
    bullets = F.filter(F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit("- "))), lambda x: strip(F.substr(x, F.lit(3)))), lambda x: x != "")
    title = F.when(has("TITLE:"), of("TITLE:"))
    reason = F.when(has("REASON:"), of("REASON:"))
    good = (title != "") & (reason != "") & (F.size(bullets) >= 3)
    return F.when(good, F.struct(title.alias("title_ai"), F.slice(bullets, 1, 3).alias("summary_bullets"), reason.alias("reason")))


def summary_scores(title: Column, bullets: Column, reason: Column, original: Column) -> Column:
    """struct of the five scores, their weighted mean and whether it is at least 0.6."""
    n = F.size(words(F.coalesce(title, F.lit(""))))
    title_score = F.when(n.between(3, 15), 1.0).when(n > 0, 0.5).otherwise(0.0)
    count = F.size(bullets)
    bullet_count = F.when(count == 3, 1.0).when(count >= 2, 0.5).otherwise(0.0)
    good = F.size(F.filter(bullets, lambda b: F.size(words(b)).between(5, 60)))
    bullet_length = F.when(count > 0, good / count).otherwise(0.0)
    empty = F.coalesce(strip(reason), F.lit("")) == ""
    reason_score = F.when(empty | strip(reason).isin(*L.GENERIC_REASONS), 0.0).when(F.size(words(reason)) < 5, 0.3).otherwise(1.0)
    urls = lambda c: F.regexp_extract_all(c, F.lit(r"(https?://[^\s]+)"), 1)
    told = F.concat_ws(" ", title, F.array_join(bullets, " "), reason)
    no_original = F.coalesce(original, F.lit("")) == ""
    invented = F.size(F.array_except(urls(told), urls(F.coalesce(original, F.lit("")))))
    faithful = F.when(no_original, 0.8).when(invented == 0, 1.0).otherwise(0.0)
    overall = 0.15 * title_score + 0.25 * bullet_count + 0.15 * bullet_length + 0.25 * reason_score + 0.2 * faithful
    names = ("title_length", "bullet_count", "bullet_length", "reason", "no_invented_urls")
    scores = (title_score, bullet_count, bullet_length, reason_score, faithful)
    return F.struct(*[s.alias(k) for s, k in zip(scores, names)], overall.alias("overall"), (overall >= 0.6).alias("valid"))


# --- prompts, batches of articles, attempts


def prompt(text: Column, topic: Column, templates: dict[str, str], default: str, most: int = 4000) -> Column:
    """The topic's template, or the default one, with the article in the place of ``{text}``; an article's first ``most`` characters are what a model takes."""
    named = F.create_map(*[F.lit(x) for kv in templates.items() for x in kv]) if templates else F.create_map().cast("map<string,string>")
    return F.replace(F.coalesce(F.try_element_at(named, topic), F.lit(default)), F.lit("{text}"), F.substring(text, 1, most))


def batch_prompt(texts: Column, head: str, most: int = 4000) -> Column:
    """One prompt of several articles, each after a line ``[ARTICLE n]``."""
    marked = F.transform(texts, lambda t, i: F.concat(F.lit("\n[ARTICLE "), (i + 1).cast("string"), F.lit("]\n"), F.substring(t, 1, most), F.lit("\n")))
    return F.replace(F.replace(F.lit(head), F.lit("{count}"), F.size(texts).cast("string")), F.lit("{articles}"), F.array_join(marked, ""))


def batch_replies(raw: Column, count: Column) -> Column:
    """The part of a reply that belongs to each article, from 1 to ``count``: what stands after its last mark, or null."""
    parts = F.slice(F.split(raw, r"\[ARTICLE\s+(?=\d+\])"), 2, F.greatest(F.size(F.split(raw, r"\[ARTICLE\s+(?=\d+\])")) - 1, F.lit(1)))
    named = F.transform(parts, lambda p: F.struct(F.try_to_number(F.regexp_extract(p, r"^(\d+)\]", 1), F.lit("9" * 18)).cast("bigint").alias("n"), F.regexp_replace(p, r"^\d+\]", "").alias("part")))
    return F.transform(F.sequence(F.lit(1), count), lambda k: F.try_element_at(F.filter(named, lambda x: x["n"] == k), F.lit(-1))["part"])


def report_text(text: Column, most: int = 500) -> Column:
    """What a reader's report keeps: no tags, trimmed, 500 characters (the form's limit)."""
    return F.substring(strip(F.regexp_replace(text, "<[^>]*>", "")), 1, most)


def first_content(*extractors: Column) -> Column:
    """What the first extractor found that found anything."""
    return F.coalesce(*[F.when(strip(x) != "", x) for x in extractors])
