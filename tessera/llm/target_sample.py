"""Problem 5: a sample that matches target category proportions.

Each category's quota is the larger of its minimum and its target share of the
sample, rounded up.  A record is accepted on its own, by a hash of seed and id
below its category's acceptance probability: quota over observed, slightly
raised.  The counts are then corrected exactly: accepted records are counted in
hash bins, whole bins below the cut are kept, and only the records of the one
bin at the cut are ranked, so no category is ever sorted in one task.  A
category that the draw left short is drawn with probability 1.  What cannot be
met is reported.

An id counts once per split and subject.  ``split`` is read without regard to
case (dev, valid and val are validation); the subject must be equal to the
target's.  Null ids, splits and subjects match no target.  Targets without a
share or minimum count as 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import canonical_split
from tessera.operators.partition import hashed
from tessera.plans.staging import stage

SEED, BINS = 20260901, 4096


def quotas(targets: DataFrame) -> DataFrame:
    """split, subject, quota; of a target given twice the larger.  Products are rounded to 6 decimals first, so 10.000000001 is 10."""
    want = F.ceil(F.round(F.coalesce("target_share", F.lit(0.0)) * F.coalesce("sample_size", F.lit(0)), 6))
    return targets.groupBy("split", "subject").agg(F.max(F.greatest(F.coalesce("min_rows", F.lit(0)), want).cast("bigint")).alias("quota"))


def _members(examples: DataFrame) -> DataFrame:
    return examples.select(canonical_split(F.col("split")).alias("split"), "subject", "example_id").where(F.col("example_id").isNotNull()).distinct()


def _placed(examples: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: quota and deficit, the rows that ``draw`` did not place."""
    got = draw(examples, targets).groupBy("split", "subject").agg(F.count("*").alias("placed"))
    return quotas(targets).join(got, ["split", "subject"], "left").select("split", "subject", "quota", F.greatest(F.lit(0), F.col("quota") - F.coalesce("placed", F.lit(0))).alias("deficit"))


def target_report(examples: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: quota, available records, deficit of the sample drawn."""
    have = _members(examples).groupBy("split", "subject").agg(F.count("*").alias("available"))
    return _placed(examples, targets).join(have, ["split", "subject"], "left").select("split", "subject", "quota", F.coalesce("available", F.lit(0)).alias("available"), "deficit")


def unmet(examples: DataFrame, targets: DataFrame) -> DataFrame:
    """split, subject of the targets that the sample drawn does not meet."""
    return _placed(examples, targets).where("deficit > 0").select("split", "subject")


def draw(examples: DataFrame, targets: DataFrame, *, seed: int = SEED) -> DataFrame:
    """split, subject, example_id of the sample: exactly the quota of each target, or all there are."""
    u = hashed(seed, "sample", F.col("split"), F.col("example_id"))
    rows = stage(_members(examples).join(quotas(targets), ["split", "subject"]).select("split", "subject", "example_id", "quota", u.alias("u")), "p5-members")
    observed = rows.groupBy("split", "subject").agg(F.count("*").alias("n"), F.max("quota").alias("quota"))
    raised = F.col("quota") + 4 * F.sqrt(F.col("quota").cast("double")) + 4
    limits = observed.select("split", "subject", "n", F.least(F.lit(1.0), raised / F.col("n")).alias("p"))
    drawn = rows.join(limits, ["split", "subject"]).withColumn("accepted", F.col("u") < F.col("p") * (1 << 32))
    got = drawn.groupBy("split", "subject").agg(F.count_if("accepted").alias("got"))
    chosen = stage(drawn.join(got, ["split", "subject"]).where(F.col("accepted") | (F.col("got") < F.col("quota"))).select("split", "subject", "example_id", "quota", "u", F.floor(F.col("u") / ((1 << 32) // BINS)).alias("bin")), "p5-accepted")
    so_far = Window.partitionBy("split", "subject").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = chosen.groupBy("split", "subject", "bin").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(so_far), F.lit(0)))
    placed = chosen.join(bins.where(F.col("before") >= 0), ["split", "subject", "bin"]).where(F.col("before") < F.col("quota"))
    inside = placed.where(F.col("before") + F.col("n") <= F.col("quota"))
    ranked = placed.where(F.col("before") + F.col("n") > F.col("quota")).withColumn("rank", F.row_number().over(Window.partitionBy("split", "subject", "bin").orderBy("u", "example_id")))
    at_cut = ranked.where(F.col("before") + F.col("rank") <= F.col("quota"))
    return inside.select("split", "subject", "example_id").unionAll(at_cut.select("split", "subject", "example_id"))
