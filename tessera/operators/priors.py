"""Leave-one-client-out weakness of subjects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.metrics import correct


def _counts(records: DataFrame) -> DataFrame:
    return records.groupBy("client_id", "subject").agg(F.count("*").alias("n"), F.sum(correct().cast("int")).alias("c"))


def weakness(records: DataFrame) -> DataFrame:
    """client_id, subject, weight: the other clients' error rate, min-max scaled over the client's subjects.

    Every client gets every subject seen anywhere; a subject no other client has
    counts as no error.  Totals less the client's own counts, so nothing is
    aggregated once a client.
    """
    counts = _counts(records)
    totals = counts.groupBy("subject").agg(F.sum("n").alias("tn"), F.sum("c").alias("tc"))
    # Clients by subjects is the result itself.
    grid = counts.select("client_id").distinct().crossJoin(totals)
    own = grid.join(counts, ["client_id", "subject"], "left")
    n, c = F.col("tn") - F.coalesce("n", F.lit(0)), F.col("tc") - F.coalesce("c", F.lit(0))
    error = own.select("client_id", "subject", F.when(n > 0, 1 - c / n).otherwise(0.0).alias("e"))
    w = Window.partitionBy("client_id")
    low, high = F.min("e").over(w), F.max("e").over(w)
    return error.select("client_id", "subject", F.round(F.when(high > low, (F.col("e") - low) / (high - low)).otherwise(0.0), 6).alias("weight"))


def controlled_weakness(records: DataFrame, support: DataFrame, *, min_count: int) -> DataFrame:
    """client_id, subject, n_other, weight = (errors + 1) / (n + 2) over other clients, for the client's support subjects.

    Subjects with fewer than ``min_count`` rows elsewhere have a null weight.
    """
    counts = _counts(records)
    totals = counts.groupBy("subject").agg(F.sum("n").alias("tn"), F.sum("c").alias("tc"))
    wanted = support.select("client_id", "subject").distinct()
    joined = wanted.join(totals, "subject", "left").join(counts, ["client_id", "subject"], "left")
    n = F.coalesce("tn", F.lit(0)) - F.coalesce("n", F.lit(0))
    c = F.coalesce("tc", F.lit(0)) - F.coalesce("c", F.lit(0))
    return joined.select("client_id", "subject", n.alias("n_other"), F.when(n >= min_count, F.round((n - c + 1) / (n + 2), 6)).alias("weight"))


def variation_issues(priors: DataFrame) -> DataFrame:
    """client_id, rule of priors that cannot tell subjects apart: one subject, constant, out of range."""
    per = priors.groupBy("client_id").agg(F.count("*").alias("n"), (F.max("weight") - F.min("weight")).alias("range"), F.count_if(F.col("weight").isNull() | ~F.col("weight").between(0, 1)).alias("bad"))
    rule = F.when(F.col("bad") > 0, "out_of_range").when(F.col("n") < 2, "one_subject").when(F.col("range") <= 1e-12, "constant")
    return per.select("client_id", rule.alias("rule")).where(F.col("rule").isNotNull())


def shuffled(priors: DataFrame, *, seed: int) -> DataFrame:
    """Per client the same weights, permuted over its subjects by hash; a permutation that changes nothing is rotated by one."""
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("client_id"), F.col("subject")))
    w = Window.partitionBy("client_id")
    ranked = priors.select("client_id", "subject", "weight", F.row_number().over(w.orderBy("subject")).alias("at"), F.row_number().over(w.orderBy(key, "subject")).alias("to"), F.count("*").over(w).alias("n"))
    moved = ranked.select("client_id", "subject", F.col("at"), "n", F.col("weight").alias("old")).join(ranked.select("client_id", F.col("to").alias("at"), F.col("weight").alias("new")), ["client_id", "at"])
    same = F.min((F.col("old") == F.col("new")).cast("int")).over(w) == 1
    nxt = F.coalesce(F.lead("old").over(w.orderBy("at")), F.first("old").over(w.orderBy("at")))
    return moved.select("client_id", "subject", F.when(same, nxt).otherwise(F.col("new")).alias("weight"))
