"""Partitioned tables with a manifest that proves their content.

Rows are written once, partitioned by client and role.  The manifest has one
line a partition: rows and a checksum over all their columns that does not depend on
their order.  The
marker file comes last, so a table without it is unfinished.
"""

from __future__ import annotations

import json
import os
import tempfile
from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MARKER = "manifest.json"


def canonical_json(value) -> str:
    """Sorted keys, no spaces, non-ASCII kept."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def object_hash(value) -> str:
    return sha256(canonical_json(value).encode()).hexdigest()


def row_hash(*columns: str) -> Column:
    """sha256 of the row's JSON with its columns in name order, nulls kept."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def checksum(key: Column) -> Column:
    """Sum of 32 hash bits a row: partial sums add up in any order."""
    return F.sum(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint"))


def counts(assigned: DataFrame, content: Column | None = None) -> DataFrame:
    """Rows and checksum of ``content`` (the example id) by client and role."""
    return assigned.groupBy("client_id", "role").agg(F.count("*").alias("n_rows"), checksum(F.col("example_id") if content is None else content).alias("checksum"))


def content_counts(rows: DataFrame) -> DataFrame:
    """Rows and checksum of whole rows by client and role, whatever types the two have been read with."""
    plain = rows.withColumn("client_id", F.col("client_id").cast("int")).withColumn("role", F.col("role").cast("string"))
    return counts(plain, row_hash(*plain.columns))


def write_atomic(path: str, text: str) -> None:
    """Driver-side file by temporary name and rename."""
    folder = os.path.dirname(path) or "."
    os.makedirs(folder, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=folder)
    with os.fdopen(handle, "w", encoding="utf-8") as out:
        out.write(text)
        out.flush()
        os.fsync(out.fileno())
    os.replace(temporary, path)


def _marker(root: str) -> str:
    if ".." in root.split("/"):
        raise ValueError("manifest escapes root")
    return f"{root.rstrip('/')}/{MARKER}"


def materialize(items: DataFrame, assignments: DataFrame, root: str, *, config: dict) -> None:
    """Items with client and role as Parquet, then their manifest.

    ``assignments`` has example_id, client_id, role.  The manifest is a Spark
    table as well (``root/manifest``), so it can have any number of partitions.
    """
    from tessera.plans.staging import stage

    joined = stage(assignments.select("example_id", "client_id", "role").join(items, "example_id"), "partition")
    if joined.groupBy("client_id", "example_id").count().where("count > 1").limit(1).count():
        raise ValueError("an item is assigned to a client twice")
    joined.write.mode("overwrite").partitionBy("client_id", "role").parquet(f"{root}/rows")
    content_counts(joined).write.mode("overwrite").parquet(f"{root}/manifest")
    write_atomic(_marker(root), canonical_json({"config_hash": object_hash(config)}))


def differences(spark: SparkSession, root: str) -> DataFrame:
    """client_id, role, problem of partitions that are missing, extra or changed."""
    found = content_counts(spark.read.parquet(f"{root}/rows")).select(F.col("client_id").cast("int").alias("client_id"), "role", F.struct("n_rows", "checksum").alias("f"))
    stated = spark.read.parquet(f"{root}/manifest").select(F.col("client_id").cast("int").alias("client_id"), "role", F.struct("n_rows", "checksum").alias("s"))
    problem = F.when(F.col("f").isNull(), "missing").when(F.col("s").isNull(), "extra").when(F.col("f") != F.col("s"), "hash mismatch")
    return found.join(stated, ["client_id", "role"], "full_outer").select("client_id", "role", problem.alias("problem")).where("problem is not null")


def load(spark: SparkSession, root: str, *, config: dict) -> DataFrame:
    """The partitioned rows; a missing marker, another config or changed content is an error."""
    with open(_marker(root), encoding="utf-8") as marker:
        stated = json.load(marker)
    if stated.get("config_hash") != object_hash(config):
        raise ValueError("config hash mismatch")
    wrong = differences(spark, root).limit(5).collect()
    if wrong:
        raise ValueError("partition " + ", ".join(f"{r['client_id']}/{r['role']}: {r['problem']}" for r in wrong))
    return spark.read.parquet(f"{root}/rows")


def restamp(root: str, *, old: dict, new: dict, allowed: set[str], dry_run: bool = True) -> dict:
    """Bind a written table to another configuration that differs in allowed keys only.

    Returns the record of the change; without ``dry_run`` it is written beside
    the table, after the new marker.  No change, or one outside ``allowed``, is an error.
    """
    changed = sorted(k for k in set(old) | set(new) if old.get(k) != new.get(k))
    if not changed:
        raise ValueError("nothing to change")
    refused = [k for k in changed if k not in allowed]
    if refused:
        raise ValueError(f"not allowed to change {refused}")
    with open(_marker(root), encoding="utf-8") as marker:
        stated = json.load(marker)
    if stated.get("config_hash") != object_hash(old):
        raise ValueError("config hash mismatch")
    record = {"changed": changed, "from": object_hash(old), "to": object_hash(new)}
    if not dry_run:
        write_atomic(_marker(root), canonical_json(stated | {"config_hash": record["to"]}))
        write_atomic(f"{root.rstrip('/')}/migration.json", canonical_json(record))
    return record


def append_run(spark: SparkSession, root: str, run: dict) -> None:
    """One line of the append-only run log."""
    schema = "arm string, seed int, split string, status string, accuracy double, round int, seconds double, error string"
    fields = [f.split()[0] for f in schema.split(", ")]
    spark.createDataFrame([tuple(run.get(f) for f in fields)], schema).coalesce(1).write.mode("append").json(f"{root}/runs")


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema("arm string, seed int, split string, status string, accuracy double, round int, seconds double, error string").json(f"{root}/runs")


def write_priors(priors: DataFrame, path: str) -> None:
    """client_id and a JSON object subject -> weight, one line a client."""
    packed = priors.groupBy("client_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("subject", "weight")))).alias("weights"))
    packed.write.mode("overwrite").json(path)


def read_priors(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("client_id int, weights map<string,double>").json(path)
    return rows.select("client_id", F.explode("weights").alias("subject", "weight"))
