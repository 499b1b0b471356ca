"""Predictions as JSON lines, with their summary written last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.manifest import canonical_json, checksum

FIELDS = (
    "arm string, seed int, split string, example_id string, client_id int, subject string, gold int, predicted int, stage string, "
    "likelihood_predicted int, likelihood_confidence double, generated_text string, prompt_tokens int, exemplar_ids array<string>"
)


def read(spark: SparkSession, paths) -> DataFrame:
    """Predictions of JSON lines, either bare or inside an object under ``prediction``; a line may be of either form, blank ones are skipped."""
    lines = spark.read.text(paths).where(F.trim("value") != "")
    both = lines.select(F.from_json("value", f"prediction struct<{_nested()}>").alias("e"), F.from_json("value", FIELDS).alias("b"))
    return both.select(F.coalesce("e.prediction", "b").alias("p")).select("p.*")


def _nested() -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (f.split() for f in FIELDS.split(", ")))


def write(predictions: DataFrame, root: str, summary: DataFrame) -> None:
    """``root/predictions`` and then ``root/summary``: one JSON object with the summary's rows, the number of predictions and their checksum.

    The summary is written when the predictions are complete, so a folder without it
    is unfinished.
    """
    lines = predictions.select(F.to_json(F.struct(*sorted(predictions.columns)), {"ignoreNullFields": "false"}).alias("value"))
    lines.write.mode("overwrite").text(f"{root}/predictions")
    spark = predictions.sparkSession
    proof = stated(spark, root)
    rows = [r.asDict(recursive=True) for r in summary.limit(10_000).collect()]  # one row an arm, seed and slice
    spark.createDataFrame([(canonical_json({"n_predictions": proof[0], "checksum": proof[1], "rows": rows}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/summary")


def stated(spark: SparkSession, root: str) -> tuple[int, int]:
    """Lines and checksum of the predictions as they are on disk."""
    found = spark.read.text(f"{root}/predictions").agg(F.count("*").alias("n"), F.coalesce(checksum(F.col("value")), F.lit(0)).alias("c")).first()
    return found["n"], found["c"]


def load(spark: SparkSession, root: str) -> DataFrame:
    """Predictions of a finished folder; one without summary or with other lines than it states is an error."""
    import json

    try:
        summary = json.loads(spark.read.text(f"{root}/summary").first()["value"])
    except Exception as error:
        raise ValueError(f"{root} has no summary") from error
    if (summary["n_predictions"], summary["checksum"]) != stated(spark, root):
        raise ValueError(f"the predictions in {root} are not those of its summary")
    return read(spark, f"{root}/predictions")
