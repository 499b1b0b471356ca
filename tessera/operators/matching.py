"""Answers of free text: closing label, equal option, nearest option."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import normalize
from tessera.operators.retrieval import dot, unit

TERMINAL = r"(?i)Final\s+answer\s*:\s*([A-D])\s*[.)]?\s*$"  # fixed value
THRESHOLD, MARGIN = 0.82, 0.05


def terminal_label(text: Column) -> Column:
    """0..3 of a closing line at the very end; null without one."""
    found = F.upper(F.regexp_extract(text, TERMINAL, 1))
    return F.when(found != "", F.ascii(found) - 65)


def exact_option(text: Column, options: Column) -> Column:
    """Index of the only option whose normalised form equals the (already normalised) text; null for none or several."""
    hits = F.filter(F.transform(options, lambda o, i: F.when(o == text, i)), lambda i: i.isNotNull())
    return F.when(F.size(hits) == 1, hits[0])


def semantic_option(vector: Column, options: Column, *, threshold: float = THRESHOLD, margin: float = MARGIN) -> Column:
    """Struct label, confidence, margin of the option vector nearest to a text vector.

    The label is null below the threshold or the margin; confidence and margin stay.
    """
    v = unit(vector)
    scores = F.transform(options, lambda o, i: F.struct(dot(unit(o), v).alias("s"), (-i).alias("i")))
    order = F.sort_array(scores, asc=False)
    best, gap = order[0]["s"], order[0]["s"] - order[1]["s"]
    return F.struct(F.when((best >= threshold) & (gap >= margin), -order[0]["i"]).alias("label"), best.alias("confidence"), gap.alias("margin"))


def match(records: DataFrame, items: DataFrame, mode: str = "exact", *, encode=None, threshold: float = THRESHOLD, margin: float = MARGIN) -> DataFrame:
    """record_id, label, match_stage of every reply by its closing line, else by an equal option of its item, else by the nearest option.

    ``encode`` is a column function text -> vector; without it the third stage is
    left out.  A null or blank reply, or one of an unknown item, is unresolved.
    """
    options = items.select("example_id", F.transform("options", lambda o: normalize(o, mode)).alias("no"), "options")
    rows = records.select("record_id", "example_id", terminal_label(F.col("generated_text")).alias("t"), normalize(F.col("generated_text"), mode).alias("n"), "generated_text")
    joined = rows.join(options, "example_id", "left").select("record_id", "t", exact_option(F.col("n"), F.col("no")).alias("x"), "n", "generated_text", "options")
    near = F.lit(None).cast("int")
    if encode is not None:
        # Only what the first two stages leave open is encoded, and each reply and option once.
        open_ = joined.where(F.col("t").isNull() & F.col("x").isNull() & (F.col("n") != "") & F.col("options").isNotNull())
        own = open_.select("record_id", encode(F.col("generated_text")).alias("v"))
        each = open_.select("record_id", F.posexplode("options").alias("i", "o")).select("record_id", "i", encode(F.col("o")).alias("v"))
        vectors = each.groupBy("record_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda p: p["v"]).alias("vs"))  # four options
        found = own.join(vectors, "record_id").select("record_id", semantic_option(F.col("v"), F.col("vs"), threshold=threshold, margin=margin)["label"].alias("s"))
        joined, near = joined.join(found, "record_id", "left"), F.col("s")
    stage = F.when(F.col("t").isNotNull(), "terminal_label").when(F.col("x").isNotNull(), "exact_option").when(near.isNotNull(), "semantic_option").otherwise("unresolved")
    return joined.select("record_id", F.coalesce("t", "x", near).cast("int").alias("label"), stage.alias("match_stage"))


def softmax_choice(scores: Column) -> Column:
    """Struct label (first maximum), confidence of a softmax over option scores."""
    shifted = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    total = F.aggregate(shifted, F.lit(0.0), lambda a, x: a + x)
    return F.struct((F.array_position(scores, F.array_max(scores)) - 1).cast("int").alias("label"), (F.array_max(shifted) / total).alias("confidence"))
