"""Named Parquet tables below one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Lazy scan of ``root/name.parquet``; projections and filters reach the scan."""
    return spark.read.parquet(f"{root}/{name}.parquet")
