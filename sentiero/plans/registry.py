"""All queries outside the llm subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import core_queries, data_queries, io_queries, territory_queries  # noqa: F401

#: ``io_queries`` and ``territory_queries`` register their queries with those of ``core_queries``.
MODULES = (core_queries, data_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core_queries.index_composite_sections(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for m in MODULES for name, query in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.oracle_sql().items()}
