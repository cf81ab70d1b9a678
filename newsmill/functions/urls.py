"""Column functions on URLs and hashes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsmill.functions.wordlists import SKIPPED_DOMAINS

VIETNAMESE = r"(?i)\.(vn|com\.vn|net\.vn|org\.vn|gov\.vn|edu\.vn)$"


def url_hash(url: Column) -> Column:
    """Of the raw URL; other parameters are another URL."""
    return F.md5(url)


def content_hash(text: Column) -> Column:
    return F.sha2(F.substring(text, 1, 4000), 256)


def ip_hash(address: Column) -> Column:
    """Sixteen hex digits that stand for an address."""
    return F.substring(F.sha2(address, 256), 1, 16)


def etag(ids: Column) -> Column:
    """A page's mark: the hash of its ids as a JSON list."""
    return F.md5(F.to_json(ids))


def is_image_url(url: Column) -> Column:
    """Whether an image's address can be asked for; asking is the crawler's work."""
    return F.coalesce(F.startswith(url, F.lit("http")), F.lit(False))


def valid_image(url: Column, status: Column, content_type: Column, length: Column, least: int) -> Column:
    """The address if the reply to a request for its head (joined in) is an image of at least ``least`` bytes, or of unknown size; else null."""
    good = is_image_url(url) & (status == 200) & F.startswith(content_type, F.lit("image/")) & (F.coalesce(length, F.lit(least)) >= least)
    return F.when(good, url)


def authority(url: Column) -> Column:
    """Host with port and user, in lower case; empty without one."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def domain(url: Column) -> Column:
    return F.regexp_replace(authority(url), r"^www\.", "")


def is_vietnamese(name: Column) -> Column:
    return F.rlike(name, F.lit(VIETNAMESE))


def is_skipped(name: Column, skipped: list[str] = SKIPPED_DOMAINS) -> Column:
    return name.isin(*skipped) | reduce(Column.__or__, [F.endswith(name, F.lit("." + s)) for s in skipped])


def source_name(name: Column) -> Column:
    """The first label, with blanks for hyphens and capitals."""
    return F.initcap(F.replace(F.split(name, r"\.")[0], F.lit("-"), F.lit(" ")))


def links(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"""(https?://[^\s<>"']+)"""), 1)


def source_check(url: Column, blocked: list[str], allowed: list[str]) -> Column:
    """struct(allowed, reason): a blocked part of the domain, then the list of allowed ones, if there is any."""
    name = domain(url)
    bad = F.filter(F.array(*[F.lit(b) for b in blocked]).cast("array<string>"), lambda b: F.contains(name, b))
    good = F.exists(F.array(*[F.lit(a) for a in allowed]).cast("array<string>"), lambda a: F.contains(name, a))
    result = lambda ok, reason: F.struct(F.lit(ok).alias("allowed"), reason.alias("reason"))
    listed = F.when(good, result(True, F.lit("whitelisted"))).otherwise(result(False, F.lit("not_in_whitelist")))
    rest = listed if allowed else result(True, F.lit("no_restrictions"))
    return F.when(F.size(bad) > 0, result(False, F.concat(F.lit("blocked_domain:"), bad[0]))).otherwise(rest)


def xml_escaped(text: Column, quotes: bool = True) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;")] + ([(">", "&gt;"), ('"', "&quot;")] if quotes else [])
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)
