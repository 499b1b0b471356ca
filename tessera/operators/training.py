"""Data steps around training: batches, masks, weighted means, choice of checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IGNORED = -100  # fixed value: label of a position without loss


def weighted_vector_mean(states: DataFrame, *by: str) -> DataFrame:
    """by, pos, value: sum of weight * element over the sum of weights, for each position."""
    flat = states.where((F.col("weight") > 0) & F.col("vector").isNotNull()).select(*by, "weight", F.posexplode("vector").alias("pos", "x"))
    return flat.groupBy(*by, "pos").agg(F.round(F.sum(F.col("x").cast("double") * F.col("weight")) / F.sum("weight"), 6).alias("value"))


def shape_issues(states: DataFrame, *by: str) -> DataFrame:
    """Groups whose vectors differ in length or that have a weight of 0 or less."""
    per = states.groupBy(*by).agg(F.countDistinct(F.size("vector")).alias("lengths"), F.count_if(~F.coalesce(F.col("weight") > 0, F.lit(False))).alias("bad_weights"))
    return per.where((F.col("lengths") > 1) | (F.col("bad_weights") > 0))


def communication(states: DataFrame, *, clients: int, element_bytes: int = 4) -> DataFrame:
    """Bytes sent up (every state) and down (one state to every client)."""
    per = states.agg(F.sum(F.size("vector")).alias("elements"), F.max(F.size("vector")).alias("one"))
    return per.select((F.col("elements") * element_bytes).alias("bytes_up"), (F.col("one") * element_bytes * clients).cast("bigint").alias("bytes_down"))


def token_weighted_loss(losses: DataFrame, *by: str) -> DataFrame:
    return losses.groupBy(*by).agg(F.round(F.sum(F.col("loss") * F.col("tokens")) / F.sum("tokens"), 6).alias("loss"), F.sum("tokens").cast("bigint").alias("tokens"))


def pad_width(rows: DataFrame, *, multiple: int = 8) -> DataFrame:
    """batch, width: the longest row, rounded up."""
    return rows.groupBy("batch").agg((F.ceil(F.max("n_tokens") / multiple) * multiple).cast("bigint").alias("width"))


def chunk_weights(rows: DataFrame, *, size: int) -> DataFrame:
    """batch, chunk, weight: supervised tokens of each chunk of a batch over those of the batch; empty chunks are left out."""
    per = rows.withColumn("chunk", F.floor(F.col("at") / size)).groupBy("batch", "chunk").agg(F.sum("supervised").alias("t"))
    whole = F.sum("t").over(Window.partitionBy("batch"))
    return per.select("batch", "chunk", "t", (F.col("t") / whole).alias("w")).where("t > 0").select("batch", "chunk", F.round("w", 6).alias("weight"))


def accumulation_groups(batches: DataFrame, *, every: int) -> DataFrame:
    """batch, step, group_size, is_step: batches of one optimizer step; the last may be smaller."""
    w = Window.partitionBy("epoch", "step")
    rows = batches.withColumn("step", F.floor(F.col("batch") / every))
    return rows.select("epoch", "batch", "step", F.count("*").over(w).alias("group_size"), (F.col("batch") == F.max("batch").over(w)).alias("is_step"))


def masked_labels(prompt: Column, answer: Column) -> Column:
    """Prompt positions ignored, then the answer ids."""
    return F.concat(F.array_repeat(F.lit(IGNORED), F.size(prompt)), answer)


def best_checkpoint(checkpoints: DataFrame, *by: str) -> DataFrame:
    """Lowest loss; first by round, step, epoch and name among equals; round 0 and null losses are left out."""
    order = F.struct("loss", "round", "step", "epoch", "name")
    return checkpoints.where(F.col("loss").isNotNull() & (F.col("round") > 0)).groupBy(*by).agg(F.min(order).alias("b")).select(*by, F.col("b.name").alias("name"), F.round("b.loss", 6).alias("loss"))


def latest_checkpoint(checkpoints: DataFrame, *by: str) -> DataFrame:
    """Furthest by round, epoch and step; the latest written among equals, then the last by name."""
    return checkpoints.groupBy(*by).agg(F.max(F.struct("round", "epoch", "step", "mtime", "name")).alias("b")).select(*by, F.col("b.name").alias("name"))


def prunable(checkpoints: DataFrame, *by: str, keep: int) -> DataFrame:
    """Unprotected step checkpoints behind the newest ``keep``."""
    w = Window.partitionBy(*by).orderBy(F.desc("mtime"), "name")
    return checkpoints.where(F.col("is_step") & ~F.col("protected")).withColumn("r", F.row_number().over(w)).where(F.col("r") > keep).select(*by, "name")


def best_round(scores: DataFrame) -> DataFrame:
    """Round with the highest mean accuracy over seeds; the earliest among equals."""
    per = scores.groupBy("round").agg(F.round(F.avg("accuracy"), 9).alias("a"))
    return per.agg(F.max(F.struct(F.col("a"), (-F.col("round")).alias("r"))).alias("b")).select((-F.col("b.r")).alias("round"), F.round("b.a", 6).alias("accuracy"))


def throughput(runs: DataFrame, *by: str) -> DataFrame:
    """Exposures and updates a second, 0 without time."""
    total = runs.groupBy(*by).agg(F.sum("exposures").alias("e"), F.sum("seconds").alias("s"))
    return total.select(*by, F.round(F.when(F.col("s") > 0, F.col("e") / F.col("s")).otherwise(0.0), 6).alias("exposures_per_s"))


def client_seed(seed: Column, round_: Column, client: Column) -> Column:
    return seed * 1_000_000 + round_ * 1_000 + client


def last_summaries(summaries: DataFrame) -> DataFrame:
    """Per arm and seed the summary whose folder comes last by name."""
    return summaries.groupBy("arm", "seed").agg(F.max_by("accuracy", "folder").alias("accuracy"), F.max("folder").alias("folder"))


def history_gaps(history: DataFrame, checkpoints: DataFrame, *, completed: int) -> DataFrame:
    """round, problem: rounds up to ``completed`` that the history lacks (with or without a checkpoint to rebuild them from), and rounds ahead of it.

    Both inputs have a column round.
    """
    due = history.sparkSession.range(1, completed + 1).select(F.col("id").cast("int").alias("round"))
    have = history.select("round").distinct().withColumn("h", F.lit(True))
    saved = checkpoints.select("round").distinct().withColumn("c", F.lit(True))
    missing = due.join(have, "round", "left").join(saved, "round", "left").where("h IS NULL").select("round", F.when(F.col("c"), "rebuild").otherwise("lost").alias("problem"))
    return missing.unionAll(history.where(F.col("round") > completed).select("round", F.lit("ahead").alias("problem")).distinct())


def epoch_checkpoints(checkpoints: DataFrame, *by: str, epoch: int) -> DataFrame:
    """by, name, n_matches of the checkpoints at the end of an epoch; anything but one match is an error to the reader."""
    return checkpoints.where((F.col("epoch") == epoch) & (F.col("batch_in_epoch") == 0)).groupBy(*by).agg(F.min("name").alias("name"), F.count("*").alias("n_matches"))


def fit_overlap(fit: DataFrame, validation: DataFrame) -> DataFrame:
    """example_id of fit rows that share an id or a question-and-options hash (qh) with validation rows."""
    by_id = fit.join(validation.select("example_id").distinct(), "example_id", "left_semi")
    by_text = fit.join(validation.select("qh").distinct(), "qh", "left_semi").select(*fit.columns)
    return by_id.select("example_id").unionAll(by_text.select("example_id")).distinct()


def ordered_identity(rows: DataFrame, *by: str) -> DataFrame:
    """by, n_rows, identity: a hash of the rows' ids and text hashes (example_id, qh) in id order, equal for equal sets.

    Row hashes are summed, so no group is gathered to be hashed.
    """
    half = lambda a: F.sum(F.conv(F.substring(F.md5(F.concat_ws(":", "example_id", "qh")), a, 8), 16, 10).cast("decimal(38,0)"))
    return rows.groupBy(*by).agg(F.count("*").alias("n_rows"), F.md5(F.concat_ws("-", *[half(a).cast("string") for a in (1, 9, 17, 25)])).alias("identity"))
