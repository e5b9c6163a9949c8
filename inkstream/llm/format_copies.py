"""Duplicates hidden by formatting differences (problem 1).

Columns are dictionary-encoded. Each distinct raw value is canonicalised once,
each distinct canonical value gets an integer, records become sorted tuples of
(field number, integer), and the compact tuples are grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstream.llm.staging import written

FIELDS = ("title", "author", "year", "doi")


def canonical(value: Column) -> Column:
    """The letters and digits of ``value`` in their order, with case folded away.

    upper before lower folds letters with several lower-case forms; sharp s is
    the two letters of its upper case. Whitespace, punctuation, marks and format characters are set aside. Null
    becomes the empty string.
    """
    folded = F.replace(F.lower(F.upper(F.coalesce(value, F.lit("")))), F.lit("ß"), F.lit("ss"))
    return F.regexp_replace(folded, r"[^\p{L}\p{Nd}]+", "")


def encode(df: DataFrame, key: str, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(key, tuple): each record as its sorted (field number, value id) integers.

    A value's id is the smallest key among the records that have it in that
    field, which is unique in the field, deterministic, and needs no numbering
    pass. A value without letters and digits has no element in the tuple, so
    null, empty and blank values are the same. Raw values are aggregated
    before they are joined; a value that most records share is one row of the
    dictionary, and its records are split by the adaptive skew join.
    """
    raw = df.select(
        F.col(key).alias("__k"),
        F.posexplode(F.array(*(F.col(f).cast("string") for f in fields))).alias("__f", "__raw"),
    )
    raw = raw.where(F.col("__raw").isNotNull() & (F.col("__raw") != ""))
    values = raw.groupBy("__f", "__raw").agg(F.min("__k").alias("__m")).withColumn("__canon", canonical(F.col("__raw")))
    values = values.where(F.col("__canon") != "")
    ids = values.groupBy("__f", "__canon").agg(F.min("__m").alias("__id"))
    dictionary = values.join(ids, ["__f", "__canon"]).select("__f", "__raw", "__id")
    parts = raw.join(dictionary, ["__f", "__raw"]).select("__k", F.struct("__f", "__id").alias("__p"))
    tuples = parts.groupBy("__k").agg(F.array_sort(F.collect_set("__p")).alias("tuple"))
    # records with no value at all are copies of each other: the empty tuple
    keys = df.select(F.col(key).alias("__k")).where(F.col(key).isNotNull()).distinct()
    empty = F.array().cast("array<struct<__f:int,__id:bigint>>")
    return keys.join(tuples, "__k", "left").select(F.col("__k").alias(key), F.coalesce("tuple", empty).alias("tuple"))


def copies(df: DataFrame, key: str, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row (first key, n_copies) for each distinct record of ``df``.

    Rows that repeat a key count once; rows with a null key are left out. An
    empty table gives no rows.
    """
    return encode(df, key, fields).groupBy("tuple").agg(F.min(key).alias(f"first_{key}"), F.count("*").alias("n_copies")).drop("tuple")


def later_copies(df: DataFrame, key: str, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(first key, key) for every record that isn't the first of its copies.

    The first is found by a partial aggregation and joined back, so a group
    with a third of all rows is never collected or sorted in one task; the
    join's hot tuple is split by the adaptive skew join.
    """
    coded = written(encode(df, key, fields))  # the dictionaries are built once
    firsts = coded.groupBy("tuple").agg(F.min(key).alias(f"first_{key}"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    return coded.join(firsts, "tuple").where(F.col(f"first_{key}") != F.col(key)).select(f"first_{key}", key)
