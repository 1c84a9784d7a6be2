"""URL canonicalisation, safety and host rules as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline import vocab
from strandline.functions.rules import lit_array, lit_map

ABSOLUTE = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#\s]+"
HOST = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]+)"
PRIVATE_V4 = r"^(10\.|172\.(1[6-9]|2\d|3[01])\.|192\.168\.|169\.254\.)"


def is_absolute(url: Column) -> Column:
    return F.coalesce(F.trim(url).rlike(ABSOLUTE), F.lit(False))


def host(url: Column) -> Column:
    """Lower-case host, or null when the URL does not parse."""
    h = F.lower(F.regexp_extract(F.trim(url), HOST, 1))
    return F.when(is_absolute(url) & (h != ""), h)


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def canonical_url(url: Column, params=tuple(vocab.TRACKING_PARAMS), *, lower: bool = True,
                  strip_slash: bool = True) -> Column:
    """Drop the fragment, tracking parameters and the final slash; lower-case the rest.

    A URL that does not parse is only trimmed and lower-cased.  Parameters that
    stay keep their order and spelling.
    """
    url = F.coalesce(url, F.lit(""))
    full = F.regexp_replace(F.trim(url), r"(?s)#.*$", "")
    base = F.substring_index(full, "?", 1)
    base = F.regexp_replace(base, r"(?i)^(https://[^/]+):443(/|$)", "$1$2")
    base = F.regexp_replace(base, r"(?i)^(http://[^/]+):80(/|$)", "$1$2")
    query = F.when(full.contains("?"),
                   F.regexp_replace(full, r"(?s)^[^?]*\?", "")).otherwise(F.lit(""))
    drop = lit_array(params)
    kept = F.array_join(
        F.filter(F.split(query, "&"),
                 lambda p: ~F.array_contains(drop, F.substring_index(p, "=", 1))), "&")
    rooted = F.when(base.rlike(r"^[^/]+://[^/]+$"), F.concat(base, F.lit("/"))).otherwise(base)
    out = F.concat(rooted, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))
    if strip_slash:
        out = F.regexp_replace(out, "/$", "")
    if lower:
        return F.when(is_absolute(url), F.lower(out)).otherwise(F.lower(F.trim(url)))
    return F.when(is_absolute(url), out).otherwise(url)


def canonical_url_dedupe(url: Column) -> Column:
    return canonical_url(url, vocab.DEDUPE_PARAMS)


def canonical_url_sample(url: Column) -> Column:
    return canonical_url(url, vocab.SAMPLE_PARAMS, lower=False, strip_slash=False)


def upgrade_http(url: Column, known_host: str = "arxiv.org") -> Column:
    """Rewrite one known host to https."""
    return F.when(F.startswith(url, F.lit(f"http://{known_host}")),
                  F.regexp_replace(url, "^http://", "https://")).otherwise(url)


def is_private_host(h: Column) -> Column:
    return (h.isin("localhost", "127.0.0.1", "::1", "[::1]") | h.endswith(".local")
            | h.endswith(".internal") | h.rlike(PRIVATE_V4))


def url_safety_status(url: Column, redirect_target: Column | None = None) -> Column:
    """safe / private_ip / unsafe_protocol / invalid, without any network call.

    ``redirect_target`` is a landed probe result for http URLs: where it points to
    a public https host the status is ``http_redirects_to_https``, elsewhere
    ``unsafe_redirect``.
    """
    scheme = F.lower(F.regexp_extract(F.trim(F.coalesce(url, F.lit(""))), r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1))
    h = host(url)
    out = (F.when(h.isNull(), F.when(scheme.isin("", "http", "https"), F.lit("invalid"))
                  .otherwise(F.lit("unsafe_protocol")))
           .when(scheme.isin("http", "https") & is_private_host(h), F.lit("private_ip"))
           .when(scheme == "https", F.lit("safe")))
    if redirect_target is not None:
        th = host(redirect_target)
        good = F.lower(redirect_target).startswith("https:") & ~is_private_host(th)
        out = (out.when((scheme == "http") & F.coalesce(good, F.lit(False)),
                        F.lit("http_redirects_to_https"))
               .when((scheme == "http") & redirect_target.isNotNull(), F.lit("unsafe_redirect")))
    return out.otherwise(F.lit("unsafe_protocol"))


def is_safe_url(url: Column) -> Column:
    return url_safety_status(url) == "safe"


def safety_class(status: Column) -> Column:
    """Coarse class used by stored validation results."""
    return (F.when(status.isin("safe", "http_redirects_to_https"), F.lit("safe"))
            .when(status.isin("private_ip", "unsafe_redirect"), F.lit("unsafe"))
            .when(status == "unsafe_protocol", F.lit("suspicious"))
            .otherwise(F.lit("unknown")))


def lookup_publisher(url: Column, table: dict[str, str] | None = None) -> Column:
    """Known host -> publisher name, else the host, else ``Unknown``."""
    table = vocab.DOMAIN_PUBLISHERS if table is None else table
    h = bare_host(url)
    return F.coalesce(F.element_at(lit_map(table), h), h, F.lit("Unknown"))


def infer_publisher(publisher: Column, url: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(publisher), F.lit("")), bare_host(url), F.lit("Unknown"))


def curated_publisher(url: Column) -> Column:
    h = bare_host(url)
    named = [F.when(h.contains(part), F.lit(name)) for part, name in vocab.CURATED_HOST_PUBLISHERS]
    return F.coalesce(*named, h, F.lit("Unknown"))


def infer_date(url: Column, as_of: Column) -> Column:
    """First plausible date in the path or query: 2020 or later, not after ``as_of``.

    A month counts only where no day follows it: a day outside the range is not taken for the first of its month.
    """
    found = [
        F.regexp_replace(F.regexp_extract(url, r"/(\d{4}/\d{2}/\d{2})/", 1), "/", "-"),
        F.concat(F.regexp_replace(F.regexp_extract(url, r"/(\d{4}/\d{2})/(?!\d{2}/)", 1), "/", "-"), F.lit("-01")),
        F.regexp_extract(url, r"-(\d{4}-\d{2}-\d{2})[-/.]", 1),
        F.regexp_extract(url, r"[?&](?:date|d)=(\d{4}-\d{2}-\d{2})", 1),
    ]

    def plausible(text: Column) -> Column:
        d = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))
        ok = (F.year(d) >= 2020) & (d <= F.to_date(as_of))
        return F.when(ok, d)

    return F.coalesce(*[plausible(t) for t in found])


def source_id(url: Column, fallback: Column) -> Column:
    """36 hex digits of SHA-256 of the canonical URL, or of ``fallback`` without one."""
    key = F.when(F.coalesce(url, F.lit("")) != "", url).otherwise(fallback)
    return F.substring(F.sha2(key, 256), 1, 36)
