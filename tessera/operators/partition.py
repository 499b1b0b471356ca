"""Hold-outs and skewed client partitions by hash.

Every random choice is a hash of (seed, purpose, key), so it depends neither on
order nor on partitions.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED, CLIENTS, ALPHA, FIT_RATIO, MIN_SUPPORT = 20260901, 5, 0.5, 0.8, 5
BINS = 1024


def hashed(seed: int, purpose: str, *key: Column) -> Column:
    """32 hash bits of an md5, as a bigint."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit(purpose), *key)), 1, 8), 16, 10).cast("bigint")


def smallest(rows: DataFrame, by: list[str], h: str, tie: str, quota: Column) -> DataFrame:
    """Rows with ``taken``: true for the ``quota`` rows of each group with the smallest (h, tie).

    Groups are counted in hash bins first; only the bin at the cut is ranked, so
    a group with a third of all rows is never sorted in one task.
    """
    binned = rows.withColumn("_bin", F.floor(F.col(h) / ((1 << 32) // BINS)))
    up = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    counts = binned.groupBy(*by, "_bin").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(up), F.lit(0))).withColumn("_size", F.sum("_n").over(Window.partitionBy(*by)))
    placed = binned.join(counts, [*by, "_bin"]).withColumn("_quota", quota)
    cut = (F.col("_before") < F.col("_quota")) & (F.col("_before") + F.col("_n") > F.col("_quota"))
    sure = placed.where(~cut).withColumn("taken", F.col("_before") < F.col("_quota"))
    ranked = placed.where(cut).withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_bin").orderBy(h, tie)))
    unsure = ranked.withColumn("taken", F.col("_before") + F.col("_r") <= F.col("_quota")).drop("_r")
    return sure.unionByName(unsure).drop("_bin", "_n", "_before", "_size", "_quota")


def development_holdout(train: DataFrame, *, fraction: float = 0.1, seed: int = SEED) -> DataFrame:
    """Items with split validation or train: per subject max(1, min(n - 1, round half even of n * fraction)) are held out.

    A subject with one row keeps it in train.
    """
    n = F.col("_size")
    quota = F.greatest(F.least(F.lit(1), n - 1), F.least(n - 1, F.bround(n * fraction, 0).cast("bigint")))
    chosen = smallest(train.withColumn("_h", hashed(seed, "dev", F.col("example_id"))), ["subject"], "_h", "example_id", quota)
    return chosen.withColumn("split", F.when(F.col("taken"), "validation").otherwise("train")).drop("_h", "taken")


def dirichlet_weights(subjects: list[str], *, clients: int = CLIENTS, alpha: float = ALPHA, seed: int = SEED) -> list[tuple[str, int, float, float]]:
    """(subject, client, weight, cumulative) of normalised gamma draws, each subject with a stream of its own.

    Subjects are a dimension of bounded size; all-zero draws give equal weights.
    """
    if clients < 1 or alpha <= 0:
        raise ValueError("clients and alpha must be positive")
    rows = []
    for subject in sorted(subjects):
        stream = random.Random(f"{seed}:dirichlet:{subject}")
        draws = [stream.gammavariate(alpha, 1.0) for _ in range(clients)]
        total, so_far = sum(draws), 0.0
        for client, value in enumerate(draws):
            weight = value / total if total else 1.0 / clients
            so_far += weight
            rows.append((subject, client, weight, so_far if client < clients - 1 else 1.0))
    return rows


def subject_weights(items: DataFrame, *, clients: int = CLIENTS, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """subject, client, weight, cumulative of every subject of the items; drawn where the subjects are, so none is collected."""

    def draw(batches):
        import pyarrow as pa

        for batch in batches:
            rows = dirichlet_weights(batch.column(0).to_pylist(), clients=clients, alpha=alpha, seed=seed)
            yield pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate((("subject", pa.string()), ("client", pa.int32()), ("weight", pa.float64()), ("cumulative", pa.float64())))})

    return items.where(F.col("subject").isNotNull()).select("subject").distinct().mapInArrow(draw, "subject string, client int, weight double, cumulative double")


def assign_clients(items: DataFrame, weights: DataFrame, *, seed: int = SEED) -> DataFrame:
    """example_id, split, client_id: the first client whose cumulative weight reaches the item's hash number."""
    steps = weights.groupBy("subject").agg(F.sort_array(F.collect_list(F.struct("client", "cumulative"))).alias("w"))  # clients entries a subject
    u = hashed(seed, "client", F.col("split"), F.col("example_id")) / F.lit(4294967296.0)
    first = F.filter("w", lambda x: x["cumulative"] >= F.col("u"))[0]["client"]
    return items.select("example_id", "split", "subject", u.alias("u")).join(steps, "subject").select("example_id", "split", "subject", first.alias("client_id"))


def transfers(sizes: dict[int, int], minimum: int) -> list[tuple[int, int]]:
    """(donor, recipient) of every row that has to change its client until each client has ``minimum`` rows.

    What clients can spare is a list of steps, one a row, each at the size its
    client has before it; the highest steps go first, at equal heights those of the
    lower client.  Shortfalls are filled in the order of the clients.
    """
    short = {c: minimum - n for c, n in sorted(sizes.items()) if n < minimum}
    needed = sum(short.values())
    spare = sorted((-height, c) for c, n in sizes.items() for height in range(n, max(minimum, n - needed), -1))[:needed]
    if len(spare) < needed:
        raise ValueError(f"{needed} rows are short of {minimum} a client and only {len(spare)} can be spared")
    return list(zip((c for _, c in spare), (c for c, n in short.items() for _ in range(n))))


def rebalance(assigned: DataFrame, *, clients: int = CLIENTS, train_minimum: int = MIN_SUPPORT + 1, minimum: int = 1) -> DataFrame:
    """The assignment with short clients filled up; the moves are planned from the client counts, at most clients * minimum of them.

    A donor gives its rows of the greatest hash; they are found by hash bins, so
    the largest client is not sorted in one task.
    """
    counts = {(r["split"], r["client_id"]): r["n"] for r in assigned.groupBy("split", "client_id").agg(F.count("*").alias("n")).collect()}
    plan, given = [], {}
    for split in sorted({s for s, _ in counts}):
        for donor, recipient in transfers({c: counts.get((split, c), 0) for c in range(clients)}, train_minimum if split == "train" else minimum):
            given[split, donor] = given.get((split, donor), 0) + 1
            plan.append((split, donor, given[split, donor], recipient))
    if not plan:
        return assigned
    spark = assigned.sparkSession
    moves = spark.createDataFrame(plan, "split string, client_id int, back int, to_client int")
    quotas = spark.createDataFrame([(s, c, n) for (s, c), n in given.items()], "split string, client_id int, gives bigint")
    donors = assigned.join(F.broadcast(quotas), ["split", "client_id"]).withColumn("_h", F.lit((1 << 32) - 1) - hashed(0, "move", F.col("example_id")))
    few = smallest(donors, ["split", "client_id"], "_h", "example_id", F.col("gives")).where("taken")
    ranked = few.withColumn("back", F.row_number().over(Window.partitionBy("split", "client_id").orderBy("_h", "example_id")))
    moved = ranked.join(F.broadcast(moves), ["split", "client_id", "back"]).select("example_id", "split", "to_client")
    return assigned.join(moved, ["example_id", "split"], "left").select("example_id", "split", "subject", F.coalesce("to_client", "client_id").alias("client_id"))


def roles(assigned: DataFrame, *, fit_ratio: float = FIT_RATIO, min_support: int = MIN_SUPPORT, seed: int = SEED) -> DataFrame:
    """example_id, client_id, original_split, role: train rows become support or fit, others keep their split.

    Support: min(max(min_support, round half even of n * (1 - fit_ratio)), n - 1) rows of each client.
    """
    n = F.col("_size")
    quota = F.least(F.greatest(F.lit(min_support), F.bround(n * (1.0 - fit_ratio), 0).cast("bigint")), n - 1)
    train = assigned.where("split = 'train'").withColumn("_h", hashed(seed, "role", F.col("example_id")))
    cut = smallest(train, ["client_id"], "_h", "example_id", quota).select("example_id", "client_id", F.col("split").alias("original_split"), F.when(F.col("taken"), "support").otherwise("fit").alias("role"))
    return cut.unionByName(assigned.where("split <> 'train'").select("example_id", "client_id", F.col("split").alias("original_split"), F.col("split").alias("role")))
