"""Text scalars on the JVM.

Two definitions of normalised text exist.  ``exact`` is NFKC, full case
folding, every character that is neither word character nor space to a space,
spaces collapsed and trimmed.  ``portable`` uses ``lower`` in place of the first
two steps, which other SQL engines can repeat.  A run of non-word characters
and spaces always ends as one space, so one pattern does both replacements.
Letters that are newer than the JVM's Unicode tables (Java 17: version 13) are
no word characters here; all others agree, code point by code point, with the
Unicode definition.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what is neither letter, number nor underscore.
NON_WORD_RUN = r"[^\p{L}\p{N}_]+"


def fold(text: Column) -> Column:
    """NFKC, then full case folding.  Null stays null.

    Pure ASCII needs neither, only ``lower``; the test is two length reads.
    """
    composed = F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(text, F.lit("")), F.lit(True))
    folded = F.call_function("reflect", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), composed, F.lit(True))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).when(text.isNotNull(), folded)


def normalize(text: Column, mode: str = "exact") -> Column:
    """Normalised text; null for null, empty for text without word characters."""
    if mode not in ("exact", "portable"):
        raise ValueError(f"unknown mode {mode!r}")
    folded = fold(text) if mode == "exact" else F.lower(text)
    return F.trim(F.regexp_replace(folded, NON_WORD_RUN, " "))


def word_array(text: Column, mode: str = "exact") -> Column:
    """Words of the normalised text in order; empty for empty or null text."""
    folded = fold(text) if mode == "exact" else F.lower(text)
    return F.filter(F.split(F.coalesce(folded, F.lit("")), NON_WORD_RUN), lambda w: w != "")


def word_set(text: Column, mode: str = "exact") -> Column:
    """Distinct words of the normalised text, first occurrence first."""
    return F.array_distinct(word_array(text, mode))


def is_blank(text: Column) -> Column:
    """True for null and for text of nothing but (Unicode) white space."""
    return F.coalesce(~text.rlike(r"[^\s\x1c-\x1f\x85\p{Z}]"), F.lit(True))


def optional_text(text: Column) -> Column:
    """Stripped text, or null where nothing is left."""
    stripped = F.regexp_replace(text, r"^[\s\x1c-\x1f\x85\p{Z}]+|[\s\x1c-\x1f\x85\p{Z}]+$", "")
    return F.when(stripped != "", stripped)


def canonical_split(split: Column) -> Column:
    """Lower-cased split with dev, valid and val read as validation."""
    low = F.lower(F.trim(split))
    return F.when(low.isin("dev", "valid", "val"), F.lit("validation")).otherwise(low)
