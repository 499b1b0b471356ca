"""Problem 3: evaluation records that recur in the training split.

Word n-grams, with the borders set by the words.  Likeness is of word sets, so the
words of a record are put in the order of their hash, and a gram is a run of
consecutive words between two fixed borders of the hash range: about four words,
and a word that is added or left out changes one gram and not n of them.  Of the
grams of a record those of the rarest words are kept, as many as suffice for no
pair to be lost (``setjoin``).  Gram hashes of evaluation records are partitioned,
training records are scanned for hits, and each hit is decided by the exact
containment of the evaluation record in the training record and by their likeness.

Rows take part as in problem 6.  ``split`` is read without regard to case; dev,
valid and val are validation; rows of other or null splits take no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import canonical_split
from tessera.llm import setjoin
from tessera.llm.examples import joined_text, role, taking_part, word_hashes
from tessera.plans.staging import stage

LIKENESS = (4, 5)


def _joined(examples: DataFrame, likeness: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """(sets of the records of both roles; verified pairs of their classes)."""
    rows = taking_part(examples).withColumn("role", role()).where(F.col("role").isNotNull())
    sets = setjoin.build_sets(rows, word_hashes(joined_text()), "p3-sets", [F.col("example_id"), F.col("role")])
    return sets, setjoin.class_pairs(sets, *likeness, between_roles=True, label="p3")


def overlaps(examples: DataFrame, likeness: tuple[int, int] = LIKENESS) -> DataFrame:
    """train_id, eval_id, shared words, words of both, containment of the evaluation record; each pair once."""
    sets, pairs = _joined(examples, likeness)
    members = stage(sets.select("example_id", "role", "cls", "chk", F.size("words").alias("n")).distinct(), "p3-members")
    train = members.where("role = 1").select(F.col("example_id").alias("train_id"), F.col("cls").alias("cls_a"), F.col("chk").alias("chk_a"))
    held = members.where("role = 2").select(F.col("example_id").alias("eval_id"), F.col("cls").alias("cls_b"), F.col("chk").alias("chk_b"), "n")
    across = pairs.join(train, ["cls_a", "chk_a"]).join(held, ["cls_b", "chk_b"]).select("train_id", "eval_id", "shared", "total", "n")
    same = train.join(held, (F.col("cls_a") == F.col("cls_b")) & (F.col("chk_a") == F.col("chk_b"))).select("train_id", "eval_id", F.col("n").alias("shared"), F.col("n").alias("total"), "n")
    both = across.unionAll(same).where(F.col("train_id") != F.col("eval_id"))
    best = both.groupBy("train_id", "eval_id").agg(F.max(F.struct("shared", "total", "n")).alias("s"))
    return best.select("train_id", "eval_id", F.col("s.shared").alias("shared"), F.col("s.total").alias("total"), (F.col("s.shared") / F.col("s.n")).alias("containment"))


def overlap_pairs(examples: DataFrame, likeness: tuple[int, int] = LIKENESS) -> DataFrame:
    """example_id_a < example_id_b, one in train and the other in validation or test."""
    found = overlaps(examples, likeness)
    return found.select(F.least("train_id", "eval_id").alias("example_id_a"), F.greatest("train_id", "eval_id").alias("example_id_b")).distinct()


def overlap_links(examples: DataFrame, likeness: tuple[int, int] = LIKENESS) -> DataFrame:
    """One row a record and role (1 train, 2 evaluation): example_id, role, class_id of its word set, records of the class in the other role, classes of the other role that overlap it.

    The equal class counts among the latter if the other role has it.  Copies are
    counted, not expanded, so a class that holds a third of all rows costs one row
    a record.
    """
    sets, pairs = _joined(examples, likeness)
    members = stage(sets.select("example_id", "role", "cls", "chk").distinct(), "p3-members")
    sizes = members.groupBy("cls", "chk").agg(F.min("example_id").alias("class_id"), F.count_if(F.col("role") == 1).alias("n1"), F.count_if(F.col("role") == 2).alias("n2"))
    ends = pairs.select("cls_a", "chk_a", F.lit(1)).toDF("cls", "chk", "role").unionAll(pairs.select("cls_b", "chk_b", F.lit(2)).toDF("cls", "chk", "role"))
    links = ends.groupBy("cls", "chk", "role").agg(F.count("*").alias("n"))
    other = F.when(F.col("role") == 1, F.col("n2")).otherwise(F.col("n1"))
    # Class rows have at most one row a class and role; a class of many records meets them without being expanded.
    return members.join(sizes, ["cls", "chk"]).join(links, ["cls", "chk", "role"], "left").select(
        "example_id", "role", "class_id", other.alias("equal_records"), (F.coalesce("n", F.lit(0)) + (other > 0).cast("int")).alias("linked_classes")
    )


def overlap_report(examples: DataFrame, likeness: tuple[int, int] = LIKENESS) -> DataFrame:
    """Per evaluation split and provenance group: records, records with an overlap, pairs, highest containment.

    A null group is reported as null.  A record delivered several times counts
    once, with its smallest group.
    """
    found = stage(overlaps(examples, likeness), "p3-overlaps").groupBy("eval_id").agg(F.count("*").alias("pairs"), F.max("containment").alias("top"))
    held = taking_part(examples).where(role() == 2).groupBy("example_id", canonical_split(F.col("split")).alias("eval_split")).agg(F.min("provenance_group").alias("provenance_group"))
    joined = held.join(found, held["example_id"] == found["eval_id"], "left")
    return joined.groupBy("eval_split", "provenance_group").agg(
        F.count("*").alias("eval_records"), F.count("eval_id").alias("overlapping_records"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.round(F.max("top"), 6).alias("max_containment")
    )
