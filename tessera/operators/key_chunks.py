"""Per-key results when a few keys hold most rows (problem 2).

Exact offset chunking.  Rows are range-partitioned by key and order, so a large
key spans as many partitions as it needs.  Keys are counted in each partition,
the counts are summed up to offsets, every row gets its exact number within its
key, and equal runs of numbers form chunks.  Chunks are processed alike whatever
their key; the states at their borders are merged in order.

Null keys are no keys.  Rows with equal order values are kept apart by their
position, so repeated rows count each time.  An empty table gives no rows.
Columns other than those named are not read, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.staging import stage

CHUNK_ROWS, CHUNKS_A_PART = 65_536, 4


def numbered(df: DataFrame, key: Column, at: Column, tie: Column, *, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """key, at, rn (1-based within the key, by at, nulls first, then tie), chunk.

    The ranged rows are staged: numbers need one fixed assignment of rows to
    partitions, also when a task is run again.
    """
    rows = df.select(key.alias("key"), at.alias("at"), tie.alias("tie")).where(F.col("key").isNotNull()).withColumn("pos", F.monotonically_increasing_id())
    # As many parts as the rows need, not a fixed number: a task sorts a few chunks.
    shares = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // (CHUNKS_A_PART * chunk_rows)))
    ranged = stage(rows.repartitionByRange(shares, "key", "at", "tie", "pos").withColumn("part", F.spark_partition_id()), "ranged")
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("part", "key").agg(F.count("*").alias("n")).select("part", "key", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("part", "key").orderBy("at", "tie", "pos")
    counted = ranged.withColumn("rn", F.row_number().over(within)).join(offsets, ["part", "key"])
    number = F.col("rn") + F.col("offset")
    return counted.select("key", "at", number.alias("rn"), F.floor((number - 1) / chunk_rows).alias("chunk"))


def profile(df: DataFrame, key: Column, at: Column, tie: Column, *, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """key, n_rows, first_at, last_at, max_gap_s (longest time between rows next to each other).

    Rows without a time count in n_rows and in nothing else; a key with fewer
    than two times has a null gap.
    """
    rows = numbered(df, key, at, tie, chunk_rows=chunk_rows)
    step = Window.partitionBy("key", "chunk").orderBy("rn")
    micros = F.unix_micros(F.col("at").cast("timestamp"))
    local = rows.withColumn("t", micros).withColumn("gap", F.col("t") - F.lag("t").over(step))
    states = local.groupBy("key", "chunk").agg(F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last"), F.max("gap").alias("gap"))
    # Borders: the last time before a chunk meets its first.  Chunks without times pass the state on.
    order = Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    merged = states.withColumn("border", F.col("first") - F.max("last").over(order))
    whole = merged.groupBy("key").agg(F.sum("n").alias("n_rows"), F.min("first").alias("first"), F.max("last").alias("last"), F.max(F.greatest("gap", "border")).alias("gap"))
    return whole.select("key", "n_rows", F.timestamp_micros("first").alias("first_at"), F.timestamp_micros("last").alias("last_at"), F.round(F.col("gap") / 1e6, 3).alias("max_gap_s"))


def heavy_keys(df: DataFrame, field: str, key: Column, at: Column, tie: Column, *, share: int = 20) -> DataFrame:
    """Keys with at least 1 / share of all rows (null keys in the total): field, key_value."""
    total = df.count()
    found = profile(df, key, at, tie).where(F.col("n_rows") * share >= F.lit(total))
    return found.select(F.lit(field).alias("field"), F.col("key").cast("string").alias("key_value"))


def skew_report(examples: DataFrame, assignments: DataFrame) -> DataFrame:
    """Heavy subjects of the items and heavy clients of the assignments."""
    subjects = heavy_keys(examples, "subject", F.col("subject"), F.col("ingested_at"), F.col("example_id"))
    clients = heavy_keys(assignments, "client_id", F.col("client_id"), F.col("assigned_at"), F.col("example_id"))
    return subjects.unionAll(clients)
