"""All queries of these operators and the SQL of those that SQL can express."""

from importlib import import_module

MODULES = ["language", "pii", "token_store", "mixing", "line_dedup", "licences", "warc", "quality", "decontaminate", "jaccard_join"]

QUERIES, SQL = {}, {}
for _name in MODULES:
    _module = import_module(f"extentlake.llm.{_name}")
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
