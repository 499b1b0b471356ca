"""Paired bootstrap by hash, Holm correction, and contrast reports.

Random draws are hashes of (seed, draw, key), so results do not depend on order
or partitions and any engine can repeat them.  Paired differences are -1, 0 or 1,
so a resample needs only the three counts: its sum is one multinomial draw.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.metrics import correct


def paired_differences(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """keys, d = right correct less left correct, of the keys both have."""
    a = left.select(*keys, correct().cast("int").alias("a"))
    b = right.select(*keys, correct().cast("int").alias("b"))
    return a.join(b, keys).select(*keys, (F.col("b") - F.col("a")).alias("d"))


def pairing_issues(left: DataFrame, right: DataFrame, keys: list[str], same: list[str]) -> DataFrame:
    """problem, n: keys given twice, missing on one side, or different in a column that must agree."""
    dup = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias("k")).where("k > 1").agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n")
    a = left.select(*keys, F.struct(*same).alias("a"), F.lit(1).alias("in_a"))
    b = right.select(*keys, F.struct(*same).alias("b"), F.lit(1).alias("in_b"))
    both = a.join(b, keys, "full_outer")
    problem = F.when(F.col("in_b").isNull(), "missing_right").when(F.col("in_a").isNull(), "missing_left").when(~F.col("a").eqNullSafe(F.col("b")), "inconsistent")
    joined = both.select(problem.alias("problem")).where("problem is not null").groupBy("problem").agg(F.count("*").alias("n"))
    return joined.unionAll(dup(left, "duplicate_left").where("n > 0")).unionAll(dup(right, "duplicate_right").where("n > 0"))


def effects(differences: DataFrame, *by: str) -> DataFrame:
    """Observed mean difference."""
    return differences.groupBy(*by).agg(F.count("*").alias("n_items"), F.round(F.avg("d"), 6).alias("effect"))


def _uniform(*parts: Column) -> Column:
    """Number in [0, 1) from the first 32 bits of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("double") / 4294967296.0


def two_sided_p(draw: Column) -> Column:
    return F.least(F.lit(1.0), 2 * F.least(F.avg((draw <= 0).cast("double")), F.avg((draw >= 0).cast("double"))))


def interval(draws: DataFrame, *by: str, confidence: float = 0.95) -> DataFrame:
    """Percentile interval and two-sided p-value of draws of ``x``."""
    tail = (1 - confidence) / 2
    return draws.groupBy(*by).agg(F.round(F.percentile("x", F.lit(tail)), 6).alias("ci_low"), F.round(F.percentile("x", F.lit(1 - tail)), 6).alias("ci_high"), F.round(two_sided_p(F.col("x")), 6).alias("p_value"))


def item_draws(differences: DataFrame, *by: str, samples: int, seed: int = 0) -> DataFrame:
    """by, draw, x: means of resampled differences, item by item.

    Items are numbered by a hash; a draw takes n numbers.  The cost is samples
    times items, so this is for checks; ``fast_draws`` is the way for reports.
    """
    order = Window.partitionBy(*by).orderBy(F.md5(F.concat_ws(":", F.lit("item"), *[F.col(c).cast("string") for c in differences.columns if c != "d"])), *[c for c in differences.columns if c != "d"])
    numbered = differences.withColumn("at", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(Window.partitionBy(*by)))
    slots = numbered.select(*by, "n", F.col("at").alias("slot"), F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("draw"))
    u = _uniform(F.lit(seed), *[F.col(c).cast("string") for c in by], F.col("draw").cast("string"), F.col("slot").cast("string"))
    chosen = slots.select(*by, "draw", F.floor(u * F.col("n")).cast("int").alias("at"))
    return chosen.join(numbered.select(*by, "at", "d"), [*by, "at"]).groupBy(*by, "draw").agg(F.avg("d").alias("x"))


def group_draws(differences: DataFrame, *by: str, samples: int, seed: int = 0) -> DataFrame:
    """by, draw, x: means of resampled differences, item by item, each group in one task.

    Items are in order of d and a draw's random numbers belong to (seed, by,
    draw), so results do not depend on order or partitions.
    """
    names = {f.name: f.dataType.simpleString() for f in differences.schema.fields}
    schema = ", ".join(f"`{c}` {names[c]}" for c in by) + ", draw int, x double"

    def draw(key, table):
        import zlib

        import numpy as np
        import pyarrow as pa

        d = np.sort(table.column("d").to_numpy())
        group = zlib.crc32(repr([k.as_py() for k in key]).encode())
        x = [d[np.random.default_rng([seed, group, i]).integers(0, len(d), len(d))].mean() for i in range(samples)]
        columns = {c: pa.array([k.as_py()] * samples, table.schema.field(c).type) for c, k in zip(by, key)}
        return pa.table(columns | {"draw": pa.array(np.arange(samples, dtype=np.int32)), "x": pa.array(x, pa.float64())})

    return differences.select(*by, "d").groupBy(*by).applyInArrow(draw, schema)


def fast_draws(differences: DataFrame, *by: str, samples: int, seed: int = 0) -> DataFrame:
    """by, draw, x: the same distribution from the counts of -1, 0 and 1 alone."""
    counts = differences.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("d") > 0).alias("up"), F.count_if(F.col("d") < 0).alias("down"))
    names = {f.name: f.dataType.simpleString() for f in counts.schema.fields}
    schema = ", ".join(f"`{c}` {names[c]}" for c in by) + (", " if by else "") + "draw int, x double"

    def draw(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                random = np.random.default_rng([seed, zlib.crc32(repr([row[c] for c in by]).encode())])
                n = row["n"]
                got = random.multinomial(n, [row["up"] / n, row["down"] / n, (n - row["up"] - row["down"]) / n], size=samples)
                columns = {c: pa.array([row[c]] * samples, batch.schema.field(c).type) for c in by}
                yield pa.RecordBatch.from_pydict(columns | {"draw": pa.array(np.arange(samples, dtype=np.int32)), "x": pa.array((got[:, 0] - got[:, 1]) / n)})

    return counts.mapInArrow(draw, schema)


def hierarchical_draws(per_seed: DataFrame, *by: str, samples: int, seed: int = 0, seed_column: str = "seed") -> DataFrame:
    """by, draw, x: seeds resampled with replacement, within each pick a fresh resample of its items.

    ``per_seed`` has by, seed column and d.  Every pick is a draw of its own, so
    a seed picked twice is resampled twice.
    """
    seeds = per_seed.groupBy(*by, seed_column).agg(F.count("*").alias("n"), F.count_if(F.col("d") > 0).alias("up"), F.count_if(F.col("d") < 0).alias("down"))
    packed = seeds.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(seed_column, "n", "up", "down"))).alias("s"))  # a handful of training seeds
    names = {f.name: f.dataType.simpleString() for f in packed.schema.fields}
    schema = ", ".join(f"`{c}` {names[c]}" for c in by) + (", " if by else "") + "draw int, x double"

    def draw(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                random = np.random.default_rng([seed, zlib.crc32(repr([row[c] for c in by]).encode())])
                s = row["s"]
                n, up, down = (np.array([x[k] for x in s], float) for k in ("n", "up", "down"))
                pick = random.integers(0, len(s), size=(samples, len(s)))
                plus = random.binomial(n[pick].astype(int), (up / n)[pick])
                rest = np.where(n[pick] > 0, down[pick] / np.maximum(n[pick] - up[pick], 1), 0)
                minus = random.binomial((n[pick] - plus).astype(int), np.clip(rest, 0, 1))
                columns = {c: pa.array([row[c]] * samples, batch.schema.field(c).type) for c in by}
                yield pa.RecordBatch.from_pydict(columns | {"draw": pa.array(np.arange(samples, dtype=np.int32)), "x": pa.array(((plus - minus) / n[pick]).mean(axis=1))})

    return packed.mapInArrow(draw, schema)


def holm(tests: DataFrame, *by: str, name: str = "name", p: str = "p_value") -> DataFrame:
    """Tests with holm_adjusted: ascending p (ties by name), (m - rank) p capped at 1, running maximum."""
    order = Window.partitionBy(*by).orderBy(p, name)
    m = F.count("*").over(Window.partitionBy(*by))
    candidate = F.least(F.lit(1.0), (m - F.row_number().over(order) + 1) * F.col(p))
    return tests.withColumn("_c", candidate).withColumn("holm_adjusted", F.round(F.max("_c").over(order.rowsBetween(Window.unboundedPreceding, 0)), 6)).drop("_c")
