"""All queries of the core library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkstream.plans import bibliography, blocks, convert, corpus, detection, problems, quality, relational, rules, typography

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = (problems, detection, typography, blocks, bibliography, quality, corpus, relational, convert, rules)


def queries() -> dict[str, Query]:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["language_profile"](spark, sf_dir)
