"""Registered queries: each runs one operator over the given tables, beside the SQL
that states the same result independently."""

from __future__ import annotations

import importlib

MODULES = ["q_functions", "q_dedupe", "q_stored", "q_analysis", "q_reports", "q_io"]


def load_all():
    for name in MODULES:
        importlib.import_module(f"catalog.{name}")
    return importlib.import_module("catalog.registry")
