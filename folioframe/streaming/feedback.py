"""Streaming forms of the feedback logs; extensions of ours, as the page store itself is batch only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.files import HISTORY, SAMPLES


def stream(spark: SparkSession, path: str, schema: str = SAMPLES) -> DataFrame:
    """New files of an append-only JSON log, with event time from epoch seconds."""
    return spark.readStream.schema(schema).json(path).withColumn("at", F.timestamp_seconds("t"))


def once_per_key(samples: DataFrame) -> DataFrame:
    """The first sample of each key, once for good: state keeps every key, without expiry."""
    return samples.dropDuplicates(["key"])


def windowed_acceptance(history: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Acceptance by kind and window, late events included up to the watermark."""
    sums = history.withWatermark("at", late).groupBy(F.window("at", window), "kind").agg(F.sum("total").alias("total"), F.sum("changed").alias("changed"))
    return sums.withColumn("rate", 1 - F.try_divide("changed", "total"))


def retrain(samples: DataFrame, train: Callable[[DataFrame, int], None], checkpoint: str):
    """Calls train with each batch of new samples; returns the streaming query, which stops when all are seen."""
    return samples.writeStream.foreachBatch(train).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def history_stream(spark: SparkSession, path: str) -> DataFrame:
    return stream(spark, path, HISTORY)
