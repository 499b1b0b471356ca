"""The arms of a study as a small dimension table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Name, checkpoint family, exemplars, client prior, diversity, shuffled prior.
ARMS = (
    ("B0", "base", False, False, False, False),
    ("B1", "base", True, False, False, False),
    ("L0", "local", False, False, False, False),
    ("L1", "local", True, False, False, False),
    ("F0", "federated", False, False, False, False),
    ("F1", "federated", True, False, False, False),
    ("F2", "federated", True, True, True, False),
    ("C0", "centralized", False, False, False, False),
    ("LM0", "local-matched", False, False, False, False),
    ("LM1", "local-matched", True, False, False, False),
    ("FD", "federated", True, False, True, False),
    ("FP", "federated", True, True, False, False),
    ("FS", "federated", True, True, True, True),
    ("LT0", "local-icl", False, False, False, False),
    ("LT1", "local-icl", True, False, False, False),
    ("FT0", "federated-icl", False, False, False, False),
    ("FT1", "federated-icl", True, False, False, False),
    ("C1", "centralized", True, False, False, False),
    ("CT0", "centralized-icl", False, False, False, False),
    ("CT1", "centralized-icl", True, False, False, False),
)
SCHEMA = "arm string, family string, uses_exemplars boolean, client_aware boolean, diversity boolean, shuffled_prior boolean"
BASIC, CONTROLLED = 8, 13


def arms(spark: SparkSession, *, controlled: bool = False, train_icl: bool = False) -> DataFrame:
    """8 arms; 13 with controls; all 20 with training on exemplars."""
    return spark.createDataFrame(list(ARMS if train_icl else ARMS[:CONTROLLED] if controlled else ARMS[:BASIC]), SCHEMA)


def runs(table: DataFrame, seeds: list[int]) -> DataFrame:
    """arm, seed of every run: base arms once without a seed, others with each seed."""
    each = F.explode(F.when(F.col("family") == "base", F.array(F.lit(None).cast("int"))).otherwise(F.array(*[F.lit(s) for s in seeds])))
    return table.select("arm", each.alias("seed"))


def chosen(pool: DataFrame, table: DataFrame, *, k: int = 5, alpha: float = 1.0, beta: float = 0.15, gamma: float = 0.2, weights: DataFrame | None = None) -> DataFrame:
    """arm, query_id, position, vec_id, example_id: the exemplars of all arms of a table, in one plan.

    The table's flags become terms of the score: an arm without any takes the pool
    in its order, and one that shows none has no rows.  Arms with a client prior
    need ``weights``.
    """
    from tessera.operators import retrieval

    if weights is None and table.where("uses_exemplars AND client_aware").limit(1).count():
        raise ValueError("client-aware arms need weights")
    rows = retrieval.weighted(pool, weights).crossJoin(F.broadcast(table.where("uses_exemplars")))  # 20 arms at most
    plain = ~F.col("client_aware") & ~F.col("diversity")
    scored = F.col("relevance") * alpha + F.col("weight") * F.when(F.col("client_aware"), gamma).otherwise(0.0)
    return retrieval.greedy(rows.withColumn("base", F.when(plain, -F.col("pool_rank").cast("double")).otherwise(scored)).withColumn("beta", F.when(F.col("diversity"), beta).otherwise(0.0)), ["arm", "query_id"], k)
