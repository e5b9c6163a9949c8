"""The engine's front: scan a folder, convert it, report on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstream.functions import detect, persian, slugs
from inkstream.operators import convert, corpus, quality
from inkstream.sources import files


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Documents below ``path`` with text, encoding, language and features."""
    docs = files.decode(files.scan(spark, path).where("kind = 'document'")).drop("content")
    fmt = F.when(F.col("format") == "unknown", detect.content_format(F.col("text"))).otherwise(F.col("format"))
    docs = docs.withColumn("format", fmt).withColumn("l", persian.language(F.col("text")))
    return docs.select("path", "format", "text", "encoding", "has_bom", "confidence", "size_bytes", "zwnj_count", "l.*", *detect.features(F.col("text")))


def run(spark: SparkSession, path: str, framework: str = "next") -> DataFrame:
    """(path, target, mdx, status, readiness, score) of every document below ``path``; failures are rows."""
    docs = corpus.inlined(scan(spark, path), "path", "text", F.col("format") == "latex")
    # texts travel with their MDX: every file is read and decoded once, and nothing is joined
    docs = convert.to_mdx(docs, "path", "text", "format", keep=("text",))
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.[A-Za-z0-9]+$", "")
    score = quality.content_score(quality.counters(F.col("text")), quality.counters(F.col("mdx")))
    return docs.select("path", corpus.deploy_path(framework, slugs.persian_slug(stem, F.lit("document"))).alias("target"), "mdx", "status", quality.readiness(quality.issues(F.col("text"), F.col("format"))).alias("readiness"), F.round(score, 2).alias("score"))
