"""Small helpers for regular expressions in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count(text: Column, pattern: str) -> Column:
    """Number of non-overlapping matches as BIGINT; null for null."""
    return F.regexp_count(text, F.lit(pattern)).cast("bigint")


def has(text: Column, pattern: str) -> Column:
    """Whether ``pattern`` occurs in ``text``; false for null."""
    return F.coalesce(text.rlike(pattern), F.lit(False))


def every(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches as an array."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def let(value: Column, fix) -> Column:
    """``fix`` of ``value``, which is computed once however often ``fix`` uses it.

    Plain expressions would repeat a costly value at each use, and nested uses
    multiply; a lambda variable doesn't.
    """
    return F.element_at(F.transform(F.array(value), fix), 1)


def gaps(text: Column, pattern: str) -> Column:
    """The text between the matches of ``pattern``: one piece more than there are matches."""
    return F.split(text, pattern, -1)


def splice(text: Column, pattern: str, fix_gap=None, fix_match=None) -> Column:
    """``text`` with the stretches between matches, or the matches, rewritten.

    ``fix_gap`` and ``fix_match`` map a Column to a Column. This is the way to
    leave protected spans (code, formulas, addresses) untouched without a UDF.
    """
    hits = every(text, pattern)
    if fix_match is not None:
        hits = F.transform(hits, fix_match)
    parts = gaps(text, pattern)
    if fix_gap is not None:
        parts = F.transform(parts, fix_gap)
    hits = F.concat(hits, F.array(F.lit("")))
    return F.array_join(F.zip_with(parts, hits, lambda g, h: F.concat(F.coalesce(g, F.lit("")), F.coalesce(h, F.lit("")))), "")
