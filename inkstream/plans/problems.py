"""Queries of the general problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkstream.operators.packed_values import unpack_values
from inkstream.sources.tables import spread, table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of every author or pages value that packs two or more."""
    return unpack_values(spread(table(spark, sf_dir, "bib_entries").select("bib_id", "author", "pages")), "bib_id")


QUERIES = {"p4_found": p4_found}
SQL: dict[str, str] = {}
