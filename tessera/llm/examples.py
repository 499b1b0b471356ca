"""Views of the exam items shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import canonical_split, fold, is_blank

GAP = "\u001e"  # control character: ends every composition and is no word character


def taking_part(examples: DataFrame) -> DataFrame:
    """Rows with a non-blank question and non-null options and id."""
    return examples.where(F.col("example_id").isNotNull() & F.col("options").isNotNull() & ~is_blank(F.col("question")))


def joined_text() -> Column:
    """Question and all options as one text; null options are left out."""
    return F.concat_ws("\n", F.col("question"), F.array_join(F.col("options"), "\n"))


def word_hashes(text: Column) -> Column:
    """Sorted distinct 64-bit hashes of the words of the normalised text."""
    words = F.filter(F.split(fold(text), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    return F.array_sort(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))))


def role() -> Column:
    """1 for train, 2 for validation and test, null for other splits."""
    split = canonical_split(F.col("split"))
    return F.when(split == "train", 1).when(split.isin("validation", "test"), 2)
