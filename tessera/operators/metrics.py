"""Metrics of predictions.

A record is correct if predicted equals gold; an unresolved (null) prediction
is wrong.  Means are doubles; empty input gives no row or a null, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELS, BINS = 4, 10


def correct(predicted: str = "predicted", gold: str = "gold") -> Column:
    return F.coalesce(F.col(predicted) == F.col(gold), F.lit(False))


def _rate(flag: Column) -> Column:
    return F.round(F.avg(flag.cast("double")), 6)


def accuracy(records: DataFrame, *by: str) -> DataFrame:
    return records.groupBy(*by).agg(F.count("*").alias("n_records"), _rate(correct()).alias("accuracy"))


def macro_f1(records: DataFrame, *by: str) -> DataFrame:
    """Mean F1 over all four labels; a label without a denominator counts 0.  One pass, twelve counters."""
    aggs, terms = [], []
    for k in range(LABELS):
        is_p, is_g = F.coalesce(F.col("predicted") == k, F.lit(False)), F.coalesce(F.col("gold") == k, F.lit(False))
        aggs += [F.count_if(is_p & is_g).alias(f"tp{k}"), F.count_if(is_p & ~is_g).alias(f"fp{k}"), F.count_if(~is_p & is_g).alias(f"fn{k}")]
        bottom = 2 * F.col(f"tp{k}") + F.col(f"fp{k}") + F.col(f"fn{k}")
        terms.append(F.when(bottom > 0, 2 * F.col(f"tp{k}") / bottom).otherwise(0.0))
    mean = sum(terms[1:], terms[0]) / LABELS
    return records.groupBy(*by).agg(*aggs).select(*by, F.round(mean, 6).alias("macro_f1"))


def stage_rates(records: DataFrame, *by: str) -> DataFrame:
    """Shares of exact matches, semantic matches and unresolved records."""
    exact = F.col("stage").isin("terminal_label", "exact_option")
    return records.groupBy(*by).agg(
        F.count("*").alias("n_records"),
        _rate(F.coalesce(exact, F.lit(False))).alias("exact_match_coverage"),
        _rate(F.coalesce(F.col("stage") == "semantic_option", F.lit(False))).alias("semantic_fallback_rate"),
        _rate(F.col("predicted").isNull()).alias("unresolved_rate"),
    )


def summary_cube(records: DataFrame) -> DataFrame:
    """Counts and accuracy of each arm: whole, by client, by subject, by gold and by predicted label, in one pass."""
    sets = [["arm"], ["arm", "client_id"], ["arm", "subject"], ["arm", "gold"], ["arm", "predicted"]]
    rows = records.select("arm", "client_id", "subject", "gold", "predicted", correct().cast("double").alias("c"))
    grouped = rows.groupingSets([[F.col(c) for c in s] for s in sets], "arm", "client_id", "subject", "gold", "predicted").agg(F.grouping_id().alias("gid"), F.count("*").alias("n_records"), F.round(F.avg("c"), 6).alias("accuracy"))
    # Bits from the left: arm, client, subject, gold, predicted; 0 means grouped by.
    name = F.when(F.col("gid") == 15, "all").when(F.col("gid") == 7, "client").when(F.col("gid") == 11, "subject").when(F.col("gid") == 13, "gold").when(F.col("gid") == 14, "predicted")
    value = F.coalesce(F.col("client_id").cast("string"), F.col("subject"), F.col("gold").cast("string"), F.col("predicted").cast("string"))
    return grouped.select("arm", name.alias("slice"), value.alias("value"), "n_records", "accuracy").where(~((F.col("slice") == "predicted") & F.col("value").isNull()))


def client_spread(records: DataFrame, *by: str) -> DataFrame:
    """Mean and minimum of the clients' accuracies."""
    per = records.groupBy(*by, "client_id").agg(F.avg(correct().cast("double")).alias("a"))
    return per.groupBy(*by).agg(F.count("*").alias("n_clients"), F.round(F.avg("a"), 6).alias("mean_client_accuracy"), F.round(F.min("a"), 6).alias("min_client_accuracy"))


def calibration_bins(records: DataFrame, *by: str, bins: int = BINS) -> DataFrame:
    """Per bin of likelihood confidence: records, accuracy of the likelihood prediction, mean confidence.

    Bin i holds [i / b, (i + 1) / b), the last also 1.  Edges are compared, not
    computed from the value, and confidences are added up as decimals, so no order
    of rows changes the result.  Values outside [0, 1] have bin -1.
    """
    c = F.col("likelihood_confidence")
    edge = F.lit(-1)
    for i in range(bins):
        upper = (c <= 1.0) if i == bins - 1 else (c < (i + 1) / bins)
        edge = F.when((c >= i / bins) & upper, i).otherwise(edge)
    rows = records.where(c.isNotNull() & F.col("likelihood_predicted").isNotNull()).withColumn("bin", edge)
    return rows.groupBy(*by, "bin").agg(F.count("*").alias("n_records"), (F.count_if(correct("likelihood_predicted")) / F.count("*")).alias("accuracy"), (F.sum(F.col("likelihood_confidence").cast("decimal(20,12)")).cast("double") / F.count("*")).alias("confidence"))


def expected_calibration_error(records: DataFrame, *by: str, bins: int = BINS) -> DataFrame:
    """Sum over bins of share times gap; values outside [0, 1] count in the total only."""
    per = calibration_bins(records, *by, bins=bins)
    gap = F.when(F.col("bin") >= 0, F.col("n_records") * F.abs(F.col("accuracy") - F.col("confidence"))).otherwise(0.0)
    return per.groupBy(*by).agg(F.sum("n_records").alias("n_records"), F.round(F.sum(gap) / F.sum("n_records"), 6).alias("ece"))


def agreement_matrix(records: DataFrame, *by: str) -> DataFrame:
    """Records by correctness of the pipeline and of the likelihood prediction."""
    p, q = correct(), correct("likelihood_predicted")
    return records.groupBy(*by).agg(F.count_if(p & q).alias("both"), F.count_if(p & ~q).alias("pipeline_only"), F.count_if(~p & q).alias("likelihood_only"), F.count_if(~p & ~q).alias("neither"))


def evaluator_agreement(records: DataFrame, *by: str) -> DataFrame:
    """Likelihood accuracy, and how often both evaluators say the same (null equals null)."""
    same = F.col("predicted").eqNullSafe(F.col("likelihood_predicted"))
    return records.groupBy(*by).agg(_rate(correct("likelihood_predicted")).alias("likelihood_accuracy"), _rate(same).alias("agreement"), _rate(~same).alias("disagreement"))


def token_percentiles(records: DataFrame, *by: str) -> DataFrame:
    """Interpolated median and 95th percentile, and maximum, of prompt tokens."""
    t = F.col("prompt_tokens")
    return records.groupBy(*by).agg(F.round(F.percentile(t, F.lit(0.5)), 6).alias("p50"), F.round(F.percentile(t, F.lit(0.95)), 6).alias("p95"), F.max(t).alias("max_tokens"))


def nearest_rank(records: DataFrame, *by: str) -> DataFrame:
    """Element n // 2 and element int(0.95 n) of the sorted prompt tokens, and rows over a budget.

    Ranks come from counts of equal values, so no group is sorted in one task.
    """
    from pyspark.sql import Window

    counts = records.where(F.col("prompt_tokens").isNotNull()).groupBy(*by, "prompt_tokens").agg(F.count("*").alias("n"))
    up = Window.partitionBy(*by).orderBy("prompt_tokens").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    ranked = counts.withColumn("upto", F.sum("n").over(up)).withColumn("all", F.sum("n").over(whole))
    hit = lambda at: F.min(F.when(F.col("upto") > at, F.col("prompt_tokens")))
    return ranked.groupBy(*by).agg(hit(F.floor(F.col("all") / 2)).alias("median_tokens"), hit(F.floor(F.col("all") * 0.95)).alias("p95_tokens"), F.max("prompt_tokens").alias("max_tokens"))


def exemplar_usage(records: DataFrame) -> DataFrame:
    """How often each exemplar was shown, by arm."""
    return records.select("arm", F.explode("exemplar_ids").alias("exemplar_id")).groupBy("arm", "exemplar_id").agg(F.count("*").alias("n_shown"))


METRICS = ("pipeline_accuracy", "macro_f1", "exact_match_coverage", "semantic_fallback_rate", "likelihood_accuracy", "ece")


def arm_comparison(records: DataFrame) -> DataFrame:
    """Per arm over its seeds: runs, mean and sample deviation (0 for one run) of the six metrics of a comparison."""
    by = ["arm", F.coalesce("seed", F.lit(-1)).alias("s")]
    keyed = records.select("*", by[1])
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    per = keyed.groupBy("arm", "s").agg(share(F.col("predicted") == F.col("gold")).alias("pipeline_accuracy"), share(F.col("stage").isin("terminal_label", "exact_option")).alias("exact_match_coverage"), share(F.col("stage") == "semantic_option").alias("semantic_fallback_rate"), share(F.col("likelihood_predicted") == F.col("gold")).alias("likelihood_accuracy"))
    # Both have a row an arm and seed.
    per = per.join(macro_f1(keyed, "arm", "s"), ["arm", "s"]).join(expected_calibration_error(keyed, "arm", "s").select("arm", "s", "ece"), ["arm", "s"], "left")
    long = per.select("arm", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("x")) for m in METRICS])).alias("m")).select("arm", "m.metric", "m.x")
    return long.groupBy("arm", "metric").agg(F.count("x").alias("runs"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("x"), F.lit(0.0)), 6).alias("std"))


def comparison_table(comparison: DataFrame) -> DataFrame:
    """One Markdown line an arm, best pipeline accuracy first; a missing metric is a dash."""
    from pyspark.sql import Window

    cell = F.when(F.col("runs") > 1, F.format_string("%.4f ± %.4f", "mean", "std")).when(F.col("runs") == 1, F.format_string("%.4f", "mean"))
    pick = lambda m: F.coalesce(F.max(F.when(F.col("metric") == m, F.col("cell"))), F.lit("-")).alias(m)
    wide = comparison.withColumn("cell", cell).groupBy("arm").agg(F.max(F.when(F.col("metric") == METRICS[0], F.col("mean"))).alias("score"), *[pick(m) for m in METRICS])
    line = F.concat(F.lit("| "), F.concat_ws(" | ", "arm", *METRICS), F.lit(" |"))
    # One row an arm: the arms of a study are a handful, whatever the records.
    return wide.select(F.row_number().over(Window.orderBy(F.desc_nulls_last("score"), "arm")).alias("position"), line.alias("line"))


def cohort_mismatches(left: DataFrame, right: DataFrame, key: str, same: list[str]) -> DataFrame:
    """Keys that one side lacks or that differ in a column: key, problem."""
    a = left.select(key, F.struct(*same).alias("a"), F.lit(True).alias("in_a"))
    b = right.select(key, F.struct(*same).alias("b"), F.lit(True).alias("in_b"))
    problem = F.when(F.col("in_b").isNull(), "missing_right").when(F.col("in_a").isNull(), "missing_left").when(~F.col("a").eqNullSafe(F.col("b")), "different")
    return a.join(b, key, "full_outer").select(key, problem.alias("problem")).where(F.col("problem").isNotNull())
