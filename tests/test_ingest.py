"""Normalisation, URL, acceptance, eligibility and dedupe cases."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from strandline.functions import times, urls
from strandline.operators import classify, dedupe, filters
from strandline.plans import ingest

NOW = F.lit("2025-03-01 12:00:00").cast("timestamp_ntz")


@pytest.mark.parametrize("url, want", [
    ("https://Example.org/a/?utm_source=x&id=1#top", "https://example.org/a/?id=1"), ("https://example.org/a/?ref=x", "https://example.org/a"),
    ("https://example.org", "https://example.org"), ("https://example.org?x=1", "https://example.org/?x=1"),
    ("https://example.org:443/a", "https://example.org/a"), (" Not A Url ", "not a url"), ("", "")])
def test_canonical_url(one, url, want):
    assert one(urls.canonical_url(F.col("u")), u=url) == want


@pytest.mark.parametrize("url, status", [
    ("https://example.org/x", "safe"), ("http://example.org/x", "unsafe_protocol"), ("https://localhost/x", "private_ip"),
    ("https://192.168.1.4/x", "private_ip"), ("https://172.20.0.1/", "private_ip"), ("https://172.40.0.1/", "safe"),
    ("http://10.0.0.1/", "private_ip"), ("ftp://example.org/x", "unsafe_protocol"), ("nonsense", "invalid"), ("https://a.internal/", "private_ip")])
def test_url_safety(one, url, status):
    assert one(urls.url_safety_status(F.col("u")), u=url) == status


def test_landed_redirects(one):
    s = urls.url_safety_status(F.col("u"), F.col("r"))
    assert one(s, u="http://a.org", r="https://a.org/") == "http_redirects_to_https"
    assert one(s, u="http://a.org", r="http://b.org/") == "unsafe_redirect"
    assert one(s, u="http://a.org", r=None) == "unsafe_protocol"


@pytest.mark.parametrize("url, want", [
    ("https://a.org/2024/05/06/x", "2024-05-06"), ("https://a.org/2024/05/x", "2024-05-01"), ("https://a.org/x-2024-05-06.html", "2024-05-06"),
    ("https://a.org/x?date=2024-05-06", "2024-05-06"), ("https://a.org/2019/05/06/x", None), ("https://a.org/2030/01/01/x", None),
    ("https://a.org/2024/13/06/x?d=2024-02-03", "2024-02-03")])
def test_infer_date(one, url, want):
    got = one(urls.infer_date(F.col("u"), NOW), u=url)
    assert (got and got.isoformat()) == want


@pytest.mark.parametrize("raw, want", [
    ("2024-05-06T07:08:09Z", "2024-05-06 07:08:09"), ("Mon, 06 May 2024 07:08:09 GMT", "2024-05-06 07:08:09"),
    ("Mon, 06 May 2024 07:08:09 +0200", "2024-05-06 05:08:09"), ("soon", None), ("", None)])
def test_parse_date(one, raw, want):
    got = one(times.parse_date(F.col("d")), d=raw)
    assert (str(got) if got else None) == want


def test_windows(one):
    before, after = (F.lit(f"2025-03-01 {t}").cast("timestamp_ntz") for t in ("21:59:59", "22:00:00"))
    assert one(times.window_end(before)) == dt.datetime(2025, 2, 28, 22)
    assert one(times.window_end(after)) == dt.datetime(2025, 3, 1, 22)
    assert one(times.iso_week_key(F.lit("2024-12-30 00:00:00").cast("timestamp_ntz"))) == "2025-W01"
    w = one(times.iso_week_window(NOW, -1))
    assert w.is_complete and w.end_utc - w.start_utc == dt.timedelta(days=7)
    assert one(times.snapshot_key(F.lit("2025-03-01 21:59:00").cast("timestamp_ntz"))) == "snapshot-2025-03-02"
    assert one(times.snapshot_key(F.lit("2025-03-01 22:00:00").cast("timestamp_ntz"))) == "snapshot-2025-03-03"
    assert one(times.serial_date(F.lit(45000.5))) == dt.datetime(2023, 3, 15, 12)


def raw_items(spark, rows):
    schema = ("title string, url string, date_published timestamp_ntz, date_published_actual timestamp_ntz, "
              "has_actual_date boolean, date_confidence string")
    return spark.createDataFrame(rows, schema)


def test_normalise_dates(spark):
    day = dt.datetime(2024, 5, 6)
    rows = raw_items(spark, [("a", "https://x.org/a", day, None, False, None), ("b", "https://x.org/b", None, None, False, None),
                             ("c", "https://x.org/c", day, None, False, "estimated"), ("d", "https://x.org/d", day, None, True, None)])
    got = {r.title: r for r in ingest.normalize_source(rows, NOW).collect()}
    assert got["a"].date_confidence == "exact" and got["a"].date_published_actual == day
    assert got["b"].date_confidence == "none" and got["b"].date_published is None and got["b"].date_discovered is not None
    assert got["c"].date_confidence == "estimated"
    assert got["d"].date_published_actual is None
    assert got["a"].trust_tier == "unknown" and got["a"].publisher == "Unknown" and len(got["a"].id) == 36


def test_same_article_same_id(spark):
    rows = raw_items(spark, [("a", "https://x.org/a?utm_source=n", None, None, False, None), ("a", "https://x.org/a#top", None, None, False, None)])
    assert ingest.normalize_source(rows, NOW).select("id").distinct().count() == 1


DEDUPE = "id string, url string, title string, trust_tier string, full_text string, date_published timestamp_ntz, date_confidence string, clean_text_hash string, position bigint"


def kept_ids(spark, rows, **kw):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], DEDUPE)
    return sorted(r.id for r in dedupe.dedupe_exact(df, **kw)[0].collect())


def test_dedupe_cases(spark):
    same_url = [("a", "https://x.org/1", "One", "medium", "t", None, "none", None), ("b", "https://x.org/1?ref=z", "Two", "primary", "t", None, "none", None)]
    assert kept_ids(spark, same_url) == ["b"]
    same_title = [("a", "https://x.org/1", "Same: title", "medium", "t", None, "none", None), ("b", "https://x.org/2", "same title", "medium", "t" * 600, None, "none", None)]
    assert kept_ids(spark, same_title) == ["b"]
    cve = [("a", "https://x.org/1", "Same", "medium", "t", None, "none", None), ("b", "https://x.org/2", "Same", "medium", "see CVE-2024-1234", None, "none", None)]
    assert kept_ids(spark, cve) == ["b"]
    apart = [("a", None, "", "medium", "t", None, "none", None), ("b", None, "", "medium", "t", None, "none", None)]
    assert kept_ids(spark, apart) == ["a", "b"]


def test_acceptance(spark):
    rows = [("ok", "https://x.org", "incident", "medium", []), ("unknown", "https://x.org", "unknown", "medium", []), ("odd", "https://x.org", "social_signal", "primary", []),
            ("curated", "https://x.org", "social_signal", "curated", []), ("tagged", "https://x.org", "odd", "low", ["curated"]), ("", "https://x.org", "incident", "high", [])]
    df = spark.createDataFrame(rows, "title string, url string, source_type string, trust_tier string, tags array<string>")
    got = {r.title: r.acceptance for r in filters.filter_acceptable(df).collect()}
    assert got["ok"].accepted and not got["ok"].needs_review
    assert got["unknown"].accepted and got["unknown"].needs_review
    assert got["odd"].reason == "Unsupported source_type: social_signal"
    assert got["curated"].accepted and got["tagged"].accepted
    assert got[""].reason == "Missing title or URL"


def test_eligibility(spark):
    ago = lambda **k: dt.datetime(2025, 3, 1, 12) - dt.timedelta(**k)
    rows = [("h", ago(hours=3), "exact", None), ("w", ago(days=5), "exact", None), ("m", ago(days=20), "estimated", None), ("none", ago(hours=3), "none", None),
            ("future", ago(days=-3), "exact", None), ("undated", None, "exact", None), ("pre", ago(days=5), "exact", True)]
    df = spark.createDataFrame(rows, "title string, date_published timestamp_ntz, date_confidence string, precomputed_daily boolean").withColumns({
        "trust_tier": F.lit("high"), "source_type": F.lit("incident"), "publisher": F.lit("P"), "full_text": F.lit("x" * 300)})
    got = {r.title: r for r in classify.eligibility(df, NOW).collect()}
    flags = lambda t: [got[t][f"eligible_for_{p}"] for p in ("daily_report", "weekly_report", "monthly_report", "horizon_scan")]
    assert flags("h") == [True] * 4 and flags("w") == [False, True, True, True] and flags("m") == [False, False, True, True]
    assert flags("none") == [False] * 4 and got["none"].needs_review
    assert flags("future") == [True] * 4 and flags("undated") == [False] * 4 and got["undated"].needs_review
    assert flags("pre")[0] is True and got["h"].eligible_for_reference_context and got["h"].eligible_for_trend_analysis


def test_curated_exempt_tier(spark):
    row = [("Long enough title here", "https://x.org", "P", "y" * 300, dt.datetime(2024, 1, 1), "curated", "incident", "exact")]
    df = spark.createDataFrame(row, "title string, url string, publisher string, full_text string, date_published timestamp_ntz, trust_tier string, source_type string, date_confidence string")
    status = lambda tiers: classify.classify_layer(df, exempt_tiers=tiers).first().gate_status
    assert status(("primary", "high")) == "reject" and status(("primary", "high", "curated")) == "review"
