"""Accuracy of predictions as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.metrics import correct

SCHEMA = "record_id bigint, arm string, gold int, predicted int, recorded_at timestamp"


def read_predictions(spark: SparkSession, folder: str, *, files_per_trigger: int = 64) -> DataFrame:
    """Stream of JSON-lines predictions dropped into a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def windowed_accuracy(stream: DataFrame, *, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """arm, window start, records, accuracy.

    A record delivered again within the watermark counts once; later rows than
    the watermark are dropped by it.
    """
    once = stream.withWatermark("recorded_at", late).dropDuplicatesWithinWatermark(["record_id"])
    grouped = once.groupBy("arm", F.window("recorded_at", window).alias("w"))
    return grouped.agg(F.count("*").alias("n_records"), F.avg(correct().cast("double")).alias("accuracy")).select("arm", F.col("w.start").alias("start"), "n_records", "accuracy")
