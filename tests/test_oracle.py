"""Registered queries against their SQL.  A quick set runs by default on the smallest tables;
STRANDLINE_ORACLE=all runs every query (see tools/check.py for larger tables)."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from catalog import load_all
from tools.check import compare, connect

SF = "/root/testdata/sf0.001"
QUICK = ["canonical_url", "clean_plaintext", "extract_iocs", "dedupe_exact", "dedupe_near_title", "cluster_records", "classify_layer", "two_pass_score",
         "corpus_frequencies", "trend_delta", "select_dossier", "link_evidence", "audit_all", "daily_window", "list_sources", "ingest_batch",
         "sink_keyed_replace", "stream_daily_counts", "number_trace_join", "event_clusters"]
NAMES = sorted(load_all().QUERIES) if os.environ.get("STRANDLINE_ORACLE") == "all" else QUICK


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    status, detail = compare(spark, con, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert status in ("ok", "rows-only"), detail


def test_every_catalog_query_has_an_oracle():
    found = load_all()
    assert set(found.ORACLES) == set(found.QUERIES) and set(found.QUERIES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
