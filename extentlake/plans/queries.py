"""Queries of the archive engine over the given tables, with the same queries in DuckDB's SQL."""

from __future__ import annotations

from importlib import import_module

QUERIES, SQL = {}, {}
for _name in ("relational", "ranges", "structure", "decoding", "streams", "reports", "catalogue", "evidence", "texts"):
    _module = import_module(f"extentlake.plans.{_name}")
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
