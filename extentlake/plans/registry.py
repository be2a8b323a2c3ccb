"""How a module collects its queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixture import Archive, with_ctes


def registry() -> tuple[dict, dict, Callable]:
    """(queries, sql, decorator): the decorated function takes an Archive; sql is DuckDB's form, CTEs added as needed."""
    queries, sqls = {}, {}

    def query(sql: str | None = None):
        def put(f: Callable[[Archive], DataFrame]) -> Callable[[Archive], DataFrame]:
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return f(Archive(spark, sf_dir))

            queries[f.__name__] = run
            if sql:
                sqls[f.__name__] = with_ctes(sql.strip())
            return f

        return put

    return queries, sqls, query
