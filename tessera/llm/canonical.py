"""Problem 7: duplicates hidden by formatting differences.

A record's canonical form is its normalised question and its normalised options
in sorted order (so field order does not matter).  It is hashed to 128 bits,
with 64 more from another hash as collision check.  Groups are counted with
partial aggregation; no group is ever gathered in one task.

Rows without a non-blank question or with null options take no part; null
entries of options are skipped, blank ones are kept as empty.  A record
delivered again counts once.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import NON_WORD_RUN, fold
from tessera.llm.examples import GAP, taking_part
from tessera.plans.staging import stage

# A group is hot from this share of all records on, so there are at most 1,000 hot groups.
HOT_SHARE, SALTS = 0.001, 64


def fingerprints(examples: DataFrame) -> DataFrame:
    """Distinct example_id, h128 (16 bytes), h64 of the canonical form."""
    gap_free = F.transform(F.concat(F.array(F.col("question")), F.array_compact("options")), lambda x: F.translate(x, GAP, " "))
    # One pass over all fields: nothing composes across the gap, and the pattern leaves it in place.
    folded = F.regexp_replace(fold(F.array_join(gap_free, GAP)), NON_WORD_RUN.replace("_]", "_" + GAP + "]"), " ")
    # Three projections, each used more than once by the next, so none is computed twice.
    fields = taking_part(examples).select("example_id", F.split(folded, GAP).alias("f"))
    fields = fields.select("example_id", F.trim(F.col("f")[0]).alias("q"), F.transform(F.slice("f", F.lit(2), F.size("f")), lambda x: F.trim(x)).alias("o"))
    rows = fields.select("example_id", F.concat_ws(GAP, "q", F.array_join(F.array_sort("o"), GAP)).alias("c"))
    return rows.select("example_id", F.unhex(F.md5("c")).alias("h128"), F.xxhash64("c").alias("h64")).distinct()


def copy_groups(prints: DataFrame) -> DataFrame:
    """h128, h64, keep_id, copies (ids in the group) of all groups.

    Grouping by both hashes keeps two texts apart even if their 128 bits are equal.
    """
    return prints.groupBy("h128", "h64").agg(F.min("example_id").alias("keep_id"), F.count("*").alias("copies"))


def collapsed(examples: DataFrame) -> DataFrame:
    """One record a group: keep_id and its number of copies (1: no other)."""
    return copy_groups(fingerprints(examples)).select("keep_id", "copies")


def collisions(examples: DataFrame) -> DataFrame:
    """128-bit values that stand for more than one canonical text (expected: none)."""
    return copy_groups(fingerprints(examples)).groupBy("h128").agg(F.count("*").alias("texts")).where("texts > 1")


def copies(examples: DataFrame) -> DataFrame:
    """keep_id (smallest id of the group) and each other id of it as copy_id.

    Ids are joined with their group's smallest id.  Hot groups are spread: their
    rows get a salt by id and their group row is repeated for each salt.
    """
    prints = stage(fingerprints(examples), "p7-prints")
    groups = stage(copy_groups(prints).where("copies > 1"), "p7-groups")
    least = max(2.0, HOT_SHARE * prints.count())
    hot = F.broadcast(groups.where(F.col("copies") >= least).select("h128", "h64", F.lit(True).alias("hot")))  # at most 1 / HOT_SHARE rows
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("example_id"), F.lit(SALTS))).otherwise(0).cast("int")
    rows = prints.join(hot, ["h128", "h64"], "left").withColumn("salt", salt).drop("hot")
    spread = groups.withColumn("salt", F.explode(F.when(F.col("copies") >= least, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    both = rows.join(spread, ["h128", "h64", "salt"])
    return both.where(F.col("example_id") != F.col("keep_id")).select("keep_id", F.col("example_id").alias("copy_id"))
