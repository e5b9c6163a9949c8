"""Streams: new documents as they arrive, and windows over events with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstream.functions import detect, persian


def document_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 8) -> DataFrame:
    """Rows of Parquet files as they appear in ``folder``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def profiled(docs: DataFrame) -> DataFrame:
    """Language and features of each document; stateless, so it runs on streams and tables alike."""
    return docs.select("doc_id", persian.language(F.col("text")).alias("l"), *detect.features(F.col("text"))).select("doc_id", "l.*", *detect.FEATURES)


def _timed(events: DataFrame) -> DataFrame:
    """Event times with a zone, which watermarks need."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events by hour and type; events later than ``late`` are dropped by the watermark, which bounds the state."""
    e = _timed(events).withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return e.select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each user."""
    e = _timed(events).withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return e.select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def once(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Each event once, however often it is delivered within ``late``."""
    return _timed(events).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
