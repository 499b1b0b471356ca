"""Problem 1: text cut off by field limits.

The form of some ends says all: a closing line with the letter, a bare letter, a
JSON value that parses or does not, a mark that stands in place of a missing rest.
About all others the corpus decides, by prefix joins and by what follows where the
same words occur elsewhere.

* A whole reply that is a strict prefix of another reply was cut, unless it is a
  whole option of its item.
* An end with a full stop is that of a sentence, unless its last word (with the
  stop) is a strict prefix of longer words and never stands before a new sentence
  (``38.`` of ``38.3``, ``i.`` of ``i.e.``), or goes on in the same sentence more
  often than not (``approx.``).
* Any other end is finished if it is a whole option, or if replies to at least two
  items end in its last three words and these words go on less often than they end
  (``no option fits``); not, however, if these words are a strict prefix of such
  with a longer last word, unless that is rare beside them (``of the st`` of ``of
  the stem``).  All else was cut.  So a statement that one item
  alone has is counted as cut.

The self-joins sort the distinct values: all values that begin with v stand
directly behind v, so v is a strict prefix exactly if its successor begins with
it.  That is linear in the values and no bucket of common prefixes arises.

Null and blank texts and rows without a record id are no cases.  A record delivered with several texts is a
case if one of them is.  Records of unknown items are judged without options.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import normalize, optional_text
from tessera.plans.staging import stage

# Forms of the ends.
PLACEHOLDER = r"(?:…|\.\.\.|‥|\x{FFFD})$|[\[<{(]\s*(?:…|\.{2,}|(?:output |text |reply )?(?:cut|truncated|continued|snip(?:ped)?|omitted|more)(?: off)?(?:\W.*)?)\s*[\])}>]$"
CLOSING_LINE = r"(?i)final\s+answer\s*:\s*[(\[*_]*[a-d][)\]*_]*\s*[.)]?[)\]*_]*$"
BARE_LETTER = r"(?i)^(?:(?:the\s+)?(?:correct\s+)?(?:answer|option|choice)\s*(?:is\b|:)?\s*)?[(\[*_]*[a-d][)\]*_]*[.:]?[*_]*$"
SENTENCE_END = r"[.!?。！？।؟][)\"'”’\]»*_]*$"
STOP = r"\.[)\"'”’\]»*_]*$"
TRAILING = r"[\s.。]+$"
CLOSERS = r"[)\"'”’\]»*_}]+$"
CONTEXT, RARE = 3, 50  # words of an end; a word is rare beside one that occurs so many times as often
VALUES_A_PART = 250_000


def end_state(text: Column) -> Column:
    """'finished' or 'cut' where the form says so, else 'stop' (ends with a full stop) or 'open', for a stripped text; null for null."""
    begins_json = text.rlike(r"^[{\[](?![A-Da-d][\])}])")
    return (
        F.when(text.isNull(), None)
        .when(text.rlike(PLACEHOLDER), "cut")
        .when(text.rlike(CLOSING_LINE) | text.rlike(BARE_LETTER), "finished")
        .when(begins_json, F.when(F.try_parse_json(text).isNotNull(), "finished").otherwise("cut"))
        .when(text.rlike(STOP), "stop")
        .when(text.rlike(SENTENCE_END), "finished")
        .otherwise("open")
    )


def strict_prefixes(values: DataFrame, column: str = "value", keep: str | None = None, weight: str | None = None) -> DataFrame:
    """Distinct values with ``copies`` (rows) and ``has_longer`` (a strict prefix of another value).

    Nulls and empty values are left out.  With ``keep`` (a Boolean column) only
    values with a true row are returned; all are searched.  ``weight`` is a column
    of copies to be added up.  ``next_copies``: those of the value directly behind.
    """
    wanted = F.bool_or(keep) if keep else F.lit(True)
    counted = stage(values.where(F.col(column) != "").groupBy(F.col(column).alias("value")).agg((F.sum(weight) if weight else F.count("*")).alias("copies"), wanted.alias("wanted")), "prefix-values")
    # As many parts as the values need; each is sorted by one task.
    shares = max(values.sparkSession.sparkContext.defaultParallelism, -(-counted.count() // VALUES_A_PART))
    ranged = stage(counted.repartitionByRange(shares, "value").withColumn("part", F.spark_partition_id()), "prefix-sorted")
    # The first value behind each part; one row a part.
    heads = ranged.groupBy("part").agg(F.min(F.struct("value", "copies")).alias("head"))
    heads = heads.select("part", F.lead("head").over(Window.orderBy("part")).alias("next_head"))
    inside = F.lead(F.struct("value", "copies")).over(Window.partitionBy("part").orderBy("value"))
    rows = ranged.withColumn("inside", inside).join(F.broadcast(heads), "part").withColumn("next", F.coalesce("inside", "next_head"))
    longer = F.coalesce(F.col("next.value").startswith(F.col("value")), F.lit(False))
    return rows.where("wanted").select("value", "copies", longer.alias("has_longer"), F.when(longer, F.col("next.copies")).alias("next_copies"))


def _words(text: Column) -> Column:
    """Words of a text without closing marks; a line break is a word of its own."""
    split = F.split(F.regexp_replace(text, r"[\s\x1c-\x1f\x85\p{Z}]*\n[\s\x1c-\x1f\x85\p{Z}]*", " \n "), r" +|[\t\r\x0b\x0c\x1c-\x1f\x85\p{Z}]+")
    return F.filter(F.transform(split, lambda w: F.when(w == "\n", w).otherwise(F.regexp_replace(w, CLOSERS, ""))), lambda w: w != "")


def _context(words: Column, at: Column) -> Column:
    """The ``CONTEXT`` words up to a place (1-based), fewer at the beginning."""
    first = F.greatest(F.lit(1), at - (CONTEXT - 1))
    return F.array_join(F.slice(words, first, at - first + 1), " ")


def word_facts(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What follows in all texts: (word, mid: places before a new sentence or, without a full stop, before a word; onward: a word with a full stop before a lower-case word or number; total) and (context, onward: places before a word of the same line; total).

    Counted with map-side combining; a word's count is spread over all tasks.
    """
    words = texts.select(_words(F.col("text")).alias("w")).select("w", F.transform("w", lambda w: F.lower(w)).alias("l"))
    place = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.struct(F.get("l", i - 1).alias("word"), F.get("w", i).alias("next"), _context(F.col("l"), i).alias("context")))).alias("p")).select("p.*").where(F.col("word") != "\n")
    stop = F.col("word").endswith(".")
    goes_on = F.col("next").isNotNull() & (F.col("next") != "\n")
    small = F.coalesce(F.col("next").rlike(r"^[^\p{Lu}\p{L}\p{N}]*[\p{Ll}\p{N}]"), F.lit(False))
    mid = F.when(stop, F.col("next").isNotNull() & ~small).otherwise(goes_on)
    vocabulary = place.groupBy("word").agg(F.count_if(mid).alias("mid"), F.count_if(stop & goes_on & small).alias("onward"), F.count("*").alias("total"))
    return vocabulary, place.groupBy("context").agg(F.count_if(goes_on).alias("onward"), F.count("*").alias("total"))


def judged(records: DataFrame, examples: DataFrame) -> DataFrame:
    """record_id, arm, state ('finished', 'cut'), has_longer of every record with a text, once each."""
    text = records.where(F.col("record_id").isNotNull()).select("record_id", "arm", "example_id", optional_text(F.col("generated_text")).alias("text")).where(F.col("text").isNotNull())
    state = stage(
        text.select("record_id", "arm", "example_id", end_state(F.col("text")).alias("state"), "text", F.regexp_replace(F.lower("text"), TRAILING, "").alias("value")).dropDuplicates(["record_id", "arm", "text"]),
        "p1-ends",
    )
    unsure = F.col("state").isin("open", "stop")
    prefixes = strict_prefixes(state.select("value", (F.col("state") == "open").alias("open")), keep="open")
    vocabulary, contexts = word_facts(state.select("example_id", "text").distinct())
    vocabulary = stage(vocabulary, "p1-words")
    l = F.transform(_words(F.col("text")), lambda w: F.lower(w))  # noqa: E741
    undecided = stage(state.where(unsure).withColumn("l", l).select("record_id", "arm", "example_id", "state", "text", "value", F.element_at("l", F.lit(-1)).alias("word"), _context(F.col("l"), F.size("l")).alias("context")), "p1-undecided")
    ends = undecided.where("state = 'open'").groupBy("context").agg(F.countDistinct("example_id").alias("items"))
    # Contexts of the texts and ends among them, sorted together: an end that a longer word goes on from is a strict prefix.
    contexts = stage(contexts, "p1-contexts")
    marked = contexts.select("context", "total", F.lit(False).alias("end")).unionAll(ends.select("context", F.lit(0).cast("bigint"), F.lit(True)))
    longer_context = strict_prefixes(marked, "context", keep="end", weight="total").select(F.col("value").alias("context"), F.col("next_copies").alias("longer_copies"))
    ends = ends.join(contexts.select("context", "onward"), "context", "left").join(longer_context, "context", "left").select("context", "items", F.coalesce("onward", F.lit(0)).alias("goes_on"), "longer_copies")
    longer = strict_prefixes(vocabulary.select(F.col("word").alias("value"), "total"), weight="total").select(F.col("value").alias("word"), F.col("has_longer").alias("word_longer"))
    facts = vocabulary.join(longer, "word")
    options = examples.where(F.col("options").isNotNull()).select("example_id", F.explode("options").alias("o")).where(F.col("o").isNotNull())
    # The shorter side is the open replies; Spark broadcasts it only below its own size threshold.
    mine = undecided.where("state = 'open'").select("record_id", "example_id", normalize(F.col("text")).alias("n")).distinct()
    whole = mine.join(options, "example_id").withColumn("o", normalize(F.col("o"))).where(F.col("o") == F.col("n")).select("record_id", "n").distinct().withColumn("whole", F.lit(True))
    known = undecided.withColumn("n", normalize(F.col("text"))).join(facts, "word", "left").join(prefixes.select("value", "has_longer"), "value", "left").join(whole, ["record_id", "n"], "left").join(ends, "context", "left")
    sentence = ~((F.col("word_longer") & (F.col("mid") == 0)) | (F.col("onward") > F.col("mid")))
    stub = F.col("longer_copies").isNotNull() & (F.col("items") <= RARE * F.col("longer_copies"))
    statement = ~F.col("has_longer") & (F.col("items") >= 2) & (F.col("items") > F.col("goes_on")) & ~stub
    fine = F.when(F.col("state") == "stop", F.coalesce(sentence, F.lit(True))).otherwise(F.coalesce("whole", F.lit(False)) | F.coalesce(statement, F.lit(False)))
    rest = known.select("record_id", "arm", F.when(fine, "finished").otherwise("cut").alias("state"), F.coalesce("has_longer", F.lit(False)).alias("has_longer"))
    decided = state.where(~unsure).select("record_id", "arm", "state", F.lit(False).alias("has_longer"))
    return decided.unionAll(rest).groupBy("record_id").agg(F.min("arm").alias("arm"), F.min("state").alias("state"), F.max("has_longer").alias("has_longer"))


def truncated(records: DataFrame, examples: DataFrame) -> DataFrame:
    """record_id of the visibly unfinished replies."""
    return judged(records, examples).where("state = 'cut'").select("record_id")


def truncation_report(records: DataFrame, examples: DataFrame) -> DataFrame:
    """Per arm: records with a text, truncated ones, their share, and those with a longer copy elsewhere."""
    cut = F.col("state") == "cut"
    return judged(records, examples).groupBy("arm").agg(F.count("*").alias("records"), F.count_if(cut).alias("truncated"), F.round(F.avg(cut.cast("int")), 6).alias("share"), F.count_if(cut & F.col("has_longer")).alias("with_longer_copy"))
