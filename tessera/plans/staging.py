"""Lineage cuts: tables written once into the folder all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir`` or set on the context.

    A temporary one is made only where none is named and the session is local
    (tests); on a cluster that is an error, since executors could not share it.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        own = context._jsc.sc().getCheckpointDir()
        named = own.get() if own.isDefined() else None
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = spark.conf.get("tessera.stage.dir", None)
    if not made:
        made = "file://" + tempfile.mkdtemp(prefix="tessera-stage-")
        spark.conf.set("tessera.stage.dir", made)
    return made


def stage(df: DataFrame, label: str, *, by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return a scan of it.

    The result has no lineage above the files, so a lost executor costs only the
    tasks it was running.  The files are removed when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if by:
        writer = writer.partitionBy(*by)
    writer.parquet(path)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _remove() -> None:
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001 - the session may be gone already
            return


atexit.register(_remove)
