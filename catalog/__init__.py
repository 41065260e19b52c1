"""Checked queries over the driver's tables."""

from __future__ import annotations

import importlib

from catalog.base import ORACLE, QUERIES

MODULES = [
    "timeline", "texts", "cleaning", "exports", "sources", "chunking", "labels", "evidence", "framing", "stores", "streams",
]


def all_queries():
    for name in MODULES:
        importlib.import_module(f"catalog.{name}")
    return QUERIES, ORACLE
