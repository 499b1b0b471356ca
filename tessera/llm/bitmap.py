"""Fixed-size key filters.

A filter is a bit array whose size is a parameter with an upper bound, so what
is broadcast never grows past ``MAX_BITS``.  It has false positives and no
false negatives: a key it rejects has no partner, a key it lets through is
decided by the join behind it.  When the data outgrow the bound the filter lets
more keys through and the result stays the same.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_BITS, MAX_BITS = 1 << 16, 1 << 28
CHUNK = 8192  # bytes of one shuffled piece of the bit array


def bits_for(keys: int, per_key: int = 16) -> int:
    """Power of two with about ``per_key`` bits a key, within the bounds."""
    want = 1 << max(0, math.ceil(math.log2(max(1, keys * per_key))))
    return min(MAX_BITS, max(MIN_BITS, want))


def add(filled: np.ndarray, keys: np.ndarray) -> None:
    slot = keys & np.uint64(len(filled) * 8 - 1)
    np.bitwise_or.at(filled, (slot >> np.uint64(3)).astype(np.int64), np.uint8(1) << (slot & np.uint64(7)).astype(np.uint8))


def has(filled: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys & np.uint64(len(filled) * 8 - 1)
    return (filled[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def pieces(name: str, filled: np.ndarray):
    """Non-empty chunks of one bit array as (name, chunk, bytes) lists."""
    rows = filled.reshape(-1, min(CHUNK, len(filled)))
    used = np.flatnonzero(rows.any(axis=1))
    return [name] * len(used), used.astype(np.int32), [rows[i].tobytes() for i in used]


PIECES = "name string, chunk int, piece binary"


FOLDS = 64  # groups that the tasks' pieces are merged in before the last merge


def merge(pieces_: DataFrame, names: list[str], bits: int) -> dict:
    """OR the pieces of all tasks, in two levels; the driver receives ``bits / 8`` bytes a name at most."""

    def fold(key, table):
        import pyarrow as pa

        total = None
        for piece in table.column("piece").to_pylist():
            part = np.frombuffer(piece, np.uint8)
            total = part.copy() if total is None else np.bitwise_or(total, part, out=total)
        return pa.table({"name": pa.array([key[0].as_py()]), "chunk": pa.array([key[1].as_py()], pa.int32()), "piece": pa.array([total.tobytes()], pa.binary())})

    merged = {n: np.zeros(bits // 8, np.uint8) for n in names}
    some = pieces_.withColumn("fold", F.spark_partition_id() % FOLDS).groupBy("name", "chunk", "fold").applyInArrow(lambda key, t: fold(key, t), PIECES)
    for row in some.groupBy("name", "chunk").applyInArrow(fold, PIECES).collect():
        at = row["chunk"] * min(CHUNK, bits // 8)
        merged[row["name"]][at : at + len(row["piece"])] |= np.frombuffer(row["piece"], np.uint8)
    return merged


def of_column(df: DataFrame, column: str, keys: int) -> np.ndarray:
    """Filter of the 64-bit values of one column; ``keys`` sizes it."""
    bits = bits_for(keys)

    def build(batches):
        import pyarrow as pa

        filled = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            add(filled, batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        name, chunk, piece = pieces("k", filled)
        yield pa.RecordBatch.from_pydict({"name": pa.array(name, pa.string()), "chunk": chunk, "piece": pa.array(piece, pa.binary())})

    found = df.select(F.col(column).cast("bigint")).where(F.col(column).isNotNull())
    return merge(found.mapInArrow(build, PIECES), ["k"], bits)["k"]
