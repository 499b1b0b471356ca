"""Problem 6: near-duplicate records with small edits.

Deletion-variant signatures (``setjoin``): a wide segment of each word set is
indexed by its words and by its words less any one, the rest by the grams of its
rarest words; pairs with an equal signature are verified.

Rows without a non-blank question or with null options take no part; null
entries of options are skipped.  Records delivered again count once.  A record
delivered with two contents under one id takes part with both.  Extra columns
are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import setjoin
from tessera.llm.examples import joined_text, taking_part, word_hashes
from tessera.plans.staging import stage

LIKENESS = (4, 5)


def _joined(examples: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(members: example_id, cls, chk; verified pairs of classes)."""
    rows = taking_part(examples)
    sets = setjoin.build_sets(rows, word_hashes(joined_text()), "p6-sets", [F.col("example_id"), F.lit(0).alias("role")])
    pairs = setjoin.class_pairs(sets, num, den, variants=1, step=1.5, label="p6")
    return sets.select("example_id", "cls", "chk").distinct(), pairs


def near_duplicate_pairs(examples: DataFrame, likeness: tuple[int, int] = LIKENESS) -> DataFrame:
    """example_id_a < example_id_b of all pairs with likeness of at least num / den."""
    members, pairs = _joined(examples, *likeness)
    members = stage(members, "p6-members")
    pairs = stage(pairs, "p6-pairs")
    x = members.select(F.col("example_id").alias("x"), F.col("cls").alias("cls_a"), F.col("chk").alias("chk_a"))
    y = members.select(F.col("example_id").alias("y"), F.col("cls").alias("cls_b"), F.col("chk").alias("chk_b"))
    across = pairs.join(x, ["cls_a", "chk_a"]).join(y, ["cls_b", "chk_b"]).select("x", "y")
    same = x.join(y, (F.col("cls_a") == F.col("cls_b")) & (F.col("chk_a") == F.col("chk_b")) & (F.col("x") < F.col("y"))).select("x", "y")
    named = across.where(F.col("x") != F.col("y")).select(F.least("x", "y").alias("example_id_a"), F.greatest("x", "y").alias("example_id_b"))
    return named.unionAll(same.toDF("example_id_a", "example_id_b")).distinct()


def near_duplicate_links(examples: DataFrame, likeness: tuple[int, int] = LIKENESS) -> DataFrame:
    """One row a record: example_id, class_id of its word set, records of the class, links to other classes.

    Copies are counted, not expanded, so a class that holds a third of all rows
    costs one row a record.
    """
    members, pairs = _joined(examples, *likeness)
    sizes = members.groupBy("cls", "chk").agg(F.count("*").alias("class_records"), F.min("example_id").alias("class_id"))
    ends = pairs.select("cls_a", "chk_a").toDF("cls", "chk").unionAll(pairs.select("cls_b", "chk_b").toDF("cls", "chk"))
    links = ends.groupBy("cls", "chk").agg(F.count("*").alias("linked_classes"))
    return (
        members.join(sizes.join(links, ["cls", "chk"], "left"), ["cls", "chk"])
        .select("example_id", "class_id", "class_records", F.coalesce("linked_classes", F.lit(0)).alias("linked_classes"))
    )
