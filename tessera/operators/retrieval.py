"""Exemplar pools, eligibility, and reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REASONS = ("example_id", "normalized_question", "question_options_hash", "provenance_group", "lexical_near_duplicate", "semantic_near_duplicate")  # fixed value: order of precedence
SIZES = (50, 100)


def dot(a: Column, b: Column) -> Column:
    """Dot product in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


def unit(v: Column) -> Column:
    """Vector over its norm, the norm at least 1e-12, so a zero vector stays zero."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.greatest(norm, F.lit(1e-12)))


def score_pairs(queries: DataFrame, support: DataFrame) -> DataFrame:
    """client_id, query_id, support_id, relevance of every query with the support of its own client.

    An equi-join on the client; adaptive execution splits a client that is far
    larger than the rest.
    """
    q = queries.select("client_id", "query_id", F.col("vector").alias("qv"))
    s = support.select("client_id", "support_id", F.col("vector").alias("sv"))
    return q.join(s, "client_id").select("client_id", "query_id", "support_id", dot(F.col("qv"), F.col("sv")).alias("relevance"))


def ranked(scores: DataFrame, *, limit: int | None = None) -> DataFrame:
    """Scores with pool_rank by relevance rounded half even to 6 decimals, ties by support id."""
    order = Window.partitionBy("query_id").orderBy(F.bround("relevance", 6).desc(), "support_id")
    out = scores.withColumn("pool_rank", F.row_number().over(order))
    return out.where(F.col("pool_rank") <= limit) if limit else out


def ineligibility(q: dict[str, Column], s: dict[str, Column], *, lexical: tuple[int, int] = (17, 20), semantic: float = 0.92) -> Column:
    """First reason a support row may not serve a query, or null.

    Columns: id, nq, qh, provenance, words; ``s['duplicate']`` is the cosine of
    the bare questions.
    """
    num, den = lexical
    shared, total = F.size(F.array_intersect(q["words"], s["words"])), F.size(F.array_union(q["words"], s["words"]))
    tests = (
        q["id"] == s["id"],
        q["nq"] == s["nq"],
        q["qh"] == s["qh"],
        (q["provenance"] != "") & (q["provenance"] == s["provenance"]),
        (total == 0) | (shared * den >= total * num),
        s["duplicate"] >= semantic,
    )
    out = F.lit(None).cast("string")
    for reason, test in reversed(list(zip(REASONS, tests))):
        out = F.when(F.coalesce(test, F.lit(False)), reason).otherwise(out)
    return out


def progressive_pool(judged: DataFrame, *, minimum: int = 5, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """Rows of the smallest pool with enough eligible rows: input columns, pool_size, expanded, capacity_failure.

    ``judged`` has query_id, pool_rank (of all support rows) and reason.  Ranks
    and reasons are computed once; the pool is the first of the sizes, clipped to
    the support, that has ``minimum`` eligible rows.
    """
    per = Window.partitionBy("query_id")
    n = F.max("pool_rank").over(per)
    rows = judged.withColumn("n", n)
    size = F.lit(None).cast("int")
    for s in reversed((*sizes, None)):
        bound = F.least(F.lit(s), F.col("n")) if s else F.col("n")
        enough = F.sum((F.col("reason").isNull() & (F.col("pool_rank") <= bound)).cast("int")).over(per)
        size = F.when(enough >= minimum, bound).otherwise(size)
    rows = rows.withColumn("pool_size", size).withColumn("capacity_failure", F.col("pool_size").isNull())
    rows = rows.withColumn("pool_size", F.coalesce("pool_size", "n")).where(F.col("pool_rank") <= F.col("pool_size"))
    return rows.withColumn("expanded", F.col("pool_size") > F.least(F.lit(sizes[0]), F.col("n"))).drop("n")


def pool_diagnostics(pool: DataFrame) -> DataFrame:
    """Per query: searched and eligible rows, whether the pool was expanded, and failures."""
    return pool.groupBy("query_id").agg(F.max("pool_size").alias("searched"), F.count_if(F.col("reason").isNull()).alias("eligible"), F.max("expanded").alias("expanded"), F.max("capacity_failure").alias("capacity_failure"))


def exclusion_counts(pool: DataFrame) -> DataFrame:
    """Rows kept out of the pools, by reason."""
    return pool.where(F.col("reason").isNotNull()).groupBy("reason").agg(F.count("*").alias("n_rows"))


def clean_pool(retrieved: DataFrame, queries: DataFrame, *, dim: int = 64) -> DataFrame:
    """query_id, client_id, vec_id, example_id, subject, pool_rank, relevance, unit vector.

    Each vector once; rows without a usable vector are left out.  A relevance in
    percent is divided by 100, a missing one is computed from the query's vector.
    """
    usable = (F.size("vector") == dim) & F.exists("vector", lambda x: x != 0) & ~F.exists("vector", lambda x: x.isNull())
    one = retrieved.where(F.col("vec_id").isNotNull() & F.coalesce(usable, F.lit(False))).groupBy("vec_id").agg(F.max(F.struct("query_id", "client_id", "pool_rank", "example_id", "subject", "relevance", "vector")).alias("r")).select("vec_id", "r.*")
    q = queries.groupBy("query_id").agg(F.max("vector").alias("qv"))
    joined = one.withColumn("v", unit(F.col("vector"))).join(q, "query_id", "left")
    relevance = F.when(F.abs("relevance") > 1, F.col("relevance") / 100).otherwise(F.col("relevance"))
    return joined.select("query_id", "client_id", "vec_id", "example_id", "subject", "pool_rank", F.coalesce(relevance, F.round(dot(F.col("v"), F.col("qv")), 6)).alias("relevance"), F.col("v").alias("vector"))


def rerank(pool: DataFrame, *, k: int = 5, alpha: float = 1.0, beta: float = 0.15, gamma: float = 0.2, weights: DataFrame | None = None) -> DataFrame:
    """query_id, position, vec_id, example_id of a greedy choice per query.

    Each step takes the row with the highest alpha * relevance - beta * (largest
    dot product with a chosen row, at least 0) + gamma * weight of its subject;
    ties go to the better pool rank.  One array fold a query, and a pool is
    bounded by its search size.  ``weights`` has client_id, subject, weight;
    missing weights are 0.
    """
    rows = weighted(pool, weights)
    return greedy(rows.withColumn("base", F.col("relevance") * alpha + F.col("weight") * gamma).withColumn("beta", F.lit(beta)), ["query_id"], k)


def weighted(pool: DataFrame, weights: DataFrame | None) -> DataFrame:
    """Pool with the weight of each row's client and subject, 0 where there is none."""
    if weights is None:
        return pool.withColumn("weight", F.lit(0.0))
    return pool.join(weights.select("client_id", "subject", "weight"), ["client_id", "subject"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))


def greedy(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """by, position, vec_id, example_id: k steps that each take the row of highest base less beta times its largest product with a row taken."""
    packed = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("pool_rank", "vec_id", "example_id", "base", "beta", F.col("vector").alias("v")))).alias("pool"))

    def step(taken, _):
        def scored(c):
            redundancy = F.aggregate(taken, F.lit(0.0), lambda m, o: F.greatest(m, dot(c["v"], o["v"])))
            return F.struct((c["base"] - redundancy * c["beta"]).alias("score"), (-c["pool_rank"]).alias("first"), (-c["vec_id"]).alias("then"), c.alias("row"))

        left = F.filter(F.col("pool"), lambda c: ~F.exists(taken, lambda o: o["vec_id"] == c["vec_id"]))
        best = F.array_max(F.transform(left, scored))
        return F.when(F.size(left) > 0, F.concat(taken, F.array(best["row"]))).otherwise(taken)

    taken = F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.slice("pool", 1, 0), step)
    return packed.select(*by, F.posexplode(taken).alias("at", "row")).select(*by, (F.col("at") + 1).alias("position"), F.col("row.vec_id").alias("vec_id"), F.col("row.example_id").alias("example_id"))


def first_of_pool(pool: DataFrame, *, k: int = 5) -> DataFrame:
    """query_id, position, vec_id, example_id of the k best by pool rank."""
    w = Window.partitionBy("query_id").orderBy("pool_rank", "vec_id")
    return pool.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k).select("query_id", "position", "vec_id", "example_id")


def rerank_activity(pool: DataFrame, plain: DataFrame, chosen: DataFrame, without_prior: DataFrame, weights: DataFrame) -> DataFrame:
    """Queries, and how many were changed from the plain top, changed by the prior, or had a pool with varying prior."""
    listed = lambda df, name: df.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "vec_id"))), lambda x: x["vec_id"].cast("string")), ",").alias(name))
    varying = pool.join(weights, ["client_id", "subject"], "left").groupBy("query_id").agg((F.max(F.coalesce("weight", F.lit(0.0))) > F.min(F.coalesce("weight", F.lit(0.0)))).alias("varying"))
    joined = listed(chosen, "c").join(listed(plain, "p"), "query_id").join(listed(without_prior, "w"), "query_id").join(varying, "query_id")
    return joined.agg(F.count("*").alias("queries"), F.count_if(F.col("c") != F.col("p")).alias("changed_from_top"), F.count_if(F.col("c") != F.col("w")).alias("changed_by_prior"), F.count_if("varying").alias("varying_prior"))
