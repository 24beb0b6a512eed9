"""Streams over event logs (an extension: the batch logs of training runs as a file stream)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "time timestamp, event string, language string, sentences bigint"


def exposure_stream(spark: SparkSession, path: str, delay: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Sentences shown by language and window, from JSON-lines logs as they grow.

    Only training and validation events count; late ones beyond the watermark are left out, so
    the state holds the open windows only.
    """
    rows = spark.readStream.schema(EVENT).json(path).where(F.col("event").isin("train", "validation"))
    return (
        rows.withWatermark("time", delay)
        .groupBy(F.window("time", window), "language", "event")
        .agg(F.sum("sentences").alias("sentences"))
        .select(F.col("window.start").alias("start"), "language", "event", "sentences")
    )


def event_totals_stream(spark: SparkSession, path: str, schema, time: str, by: str, value: str) -> DataFrame:
    """Running totals of a parquet stream by group (complete mode; the state has one row a group)."""
    reader = spark.readStream.schema(schema)
    if os.path.isfile(path):  # a stream reads folders
        reader, path = reader.option("pathGlobFilter", os.path.basename(path)), os.path.dirname(path)
    rows = reader.parquet(path)
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(time).alias("last"))


def run_once(df: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Drain a stream into a memory table and return it."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
