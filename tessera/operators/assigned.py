"""Items with their client assignments, and views of the other fact tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assigned(items: DataFrame, assignments: DataFrame) -> DataFrame:
    """example_id, client_id, original_split, role, subject; repeated assignments count once, null clients not at all."""
    rows = assignments.where(F.col("client_id").isNotNull()).select("example_id", "client_id", "original_split", "role").distinct()
    return rows.join(items.select("example_id", "subject"), "example_id")


def paired_predictions(events: DataFrame) -> DataFrame:
    """Two arms that predict every event: the shape of predictions with one gold label an item."""
    value = F.floor("value").cast("bigint")
    third = F.floor(F.col("value") / 3).cast("bigint")
    left = F.when(F.col("event_type") != "error", ((F.col("event_id") + value) % 4).cast("int"))
    right = ((F.col("event_id") + third % 3) % 4).cast("int")
    arms = F.explode(F.array(F.struct(F.lit("left").alias("arm"), left.alias("predicted")), F.struct(F.lit("right").alias("arm"), right.alias("predicted"))))
    likelihood = ((F.col("event_id") + F.floor(F.col("value") * 7).cast("bigint")) % 4).cast("int")
    rows = events.select("event_id", "user_id", "event_type", likelihood.alias("likelihood_predicted"), arms.alias("a"))
    return rows.select(
        F.col("a.arm").alias("arm"),
        F.col("event_id").alias("example_id"),
        (F.col("user_id") % 5).cast("int").alias("client_id"),
        F.col("event_type").alias("subject"),
        (F.col("event_id") % 4).cast("int").alias("gold"),
        (42 + F.col("event_id") % 3).cast("int").alias("seed"),
        F.col("a.predicted").alias("predicted"),
        "likelihood_predicted",
    )
