"""Exam items: adapters, row checks, and their latest delivery.

Adapters never raise for a bad row: what does not parse becomes null and shows
up in ``violations``.  ``strict`` turns violations into an error when the rows
are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import canonical_split, is_blank, optional_text

LETTERS = ("A", "B", "C", "D")  # fixed value
SPLITS = ("train", "validation", "test")  # fixed value

ITEM = T.StructType(
    [
        T.StructField("example_id", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("options", T.ArrayType(T.StringType())),
        T.StructField("label", T.IntegerType()),
        T.StructField("split", T.StringType()),
        T.StructField("subject", T.StringType()),
        T.StructField("topic", T.StringType()),
        T.StructField("provenance_group", T.StringType()),
        T.StructField("explanation", T.StringType()),
    ]
)


def label_index(value: Column, *, base: int = 0) -> Column:
    """0..3 from a letter (any case) or a number less ``base``; null for anything else."""
    text = F.upper(F.trim(value.cast("string")))
    letter = F.ascii(text) - 65
    number = F.try_to_number(text, F.lit("9")).cast("int") - base
    index = F.when(text.rlike("^[A-D]$"), letter).when(text.rlike("^[0-4]$"), number)
    return F.when(index.between(0, 3), index)


def options_from_map(options: Column) -> Column:
    """[A, B, C, D] of a map with letter keys in any case and spacing; null if one is missing."""
    keyed = F.transform_keys(options, lambda k, _: F.upper(F.trim(k)))
    found = F.array(*[F.try_element_at(keyed, F.lit(letter)) for letter in LETTERS])
    return F.when(~F.exists(found, lambda x: x.isNull()), found)


def stable_id(question: Column, options: Column) -> Column:
    """First 24 hex digits of the sha256 of the JSON list [question, options]."""
    body = F.concat(F.lit("["), _quoted(question), F.lit(", ["), F.array_join(F.transform(options, _quoted), ", "), F.lit("]]"))
    return F.substring(F.sha2(body, 256), 1, 24)


def _quoted(text: Column) -> Column:
    return F.regexp_replace(F.to_json(F.struct(text.alias("v")), {"ignoreNullFields": "false"}), r'^\{"v":|\}$', "")


def adapt_nested(rows: DataFrame, split: Column) -> DataFrame:
    """Items from rows {id, data: {question, options map, answer}, source, subject_name, topic_name}.

    Missing subject: medicine; missing topic: unknown.
    """
    data = F.col("data")
    options = options_from_map(data["options"])
    return rows.select(
        F.coalesce(F.col("id"), stable_id(data["question"], options)).alias("example_id"),
        data["question"].alias("question"),
        options.alias("options"),
        label_index(data["answer"]).alias("label"),
        canonical_split(split).alias("split"),
        F.coalesce(F.col("subject_name"), F.lit("medicine")).alias("subject"),
        F.coalesce(F.col("topic_name"), F.lit("unknown")).alias("topic"),
        optional_text(F.col("source")).alias("provenance_group"),
        optional_text(data["explanation"]).alias("explanation"),
    )


def adapt_flat(rows: DataFrame, split: Column) -> DataFrame:
    """Items from rows with opa..opd and a zero-based cop; provenance is source, else exam."""
    options = F.array("opa", "opb", "opc", "opd")
    return rows.select(
        F.coalesce(F.col("id"), stable_id(F.col("question"), options)).alias("example_id"),
        "question",
        options.alias("options"),
        label_index(F.col("cop")).alias("label"),
        canonical_split(split).alias("split"),
        F.coalesce(F.col("subject_name"), F.lit("unknown")).alias("subject"),
        F.coalesce(F.col("topic_name"), F.lit("unknown")).alias("topic"),
        optional_text(F.coalesce("source", "exam")).alias("provenance_group"),
        optional_text(F.col("exp")).alias("explanation"),
    )


def violations() -> Column:
    """Names of the row rules an item breaks, in a fixed order."""
    # The reader's rules: blank text or a wrong number of options never passes silently.
    rules = {
        "id": is_blank(F.col("example_id")),
        "question": is_blank(F.col("question")),
        "options": F.coalesce((F.size("options") != 4) | F.exists("options", is_blank), F.lit(True)) | F.col("options").isNull(),
        "label": ~F.coalesce(F.col("label").between(0, 3), F.lit(False)),
        "split": ~F.coalesce(canonical_split(F.col("split")).isin(*SPLITS), F.lit(False)),
    }
    return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]))


def latest(rows: DataFrame, key: str, at: str) -> DataFrame:
    """One row a key, that of the latest delivery; rows without key are left out.

    Partial aggregation keeps one row a key and task, so a key delivered
    endlessly is no hot spot.  Among equal times the greatest row wins.
    """
    columns = [c for c in rows.columns if c != key]
    rest = F.struct(F.coalesce(F.col(at), F.timestamp_seconds(F.lit(0)).cast(rows.schema[at].dataType)).alias("_at"), *columns)
    kept = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(rest).alias("r"))
    return kept.select(key, *[F.col("r")[c].alias(c) for c in columns])


def items(examples: DataFrame) -> DataFrame:
    """Latest delivery of every item that breaks no rule, with its canonical split."""
    return latest(examples, "example_id", "ingested_at").where(F.size(violations()) == 0).withColumn("split", canonical_split(F.col("split")))


def strict(rows: DataFrame) -> DataFrame:
    """The same rows; reading one that breaks a rule fails."""
    bad = violations()
    return rows.where(F.when(F.size(bad) == 0, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("item "), F.coalesce("example_id", F.lit("null")), F.lit(" breaks: "), F.array_join(bad, ", "))).isNull()))


def duplicate_ids(rows: DataFrame, key: str = "example_id") -> DataFrame:
    """Ids on more than one row, with their number of rows."""
    return rows.groupBy(key).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def head_per_split(rows: DataFrame, limits: dict[str, int], seed: int = 20260901) -> DataFrame:
    """Rows of each split with the smallest hash of their id, as many as its limit; splits without a limit stay whole.

    Only the hash bin at the cut is ranked, so no split is sorted in one task.
    """
    from tessera.operators import partition

    if any(n <= 0 for n in limits.values()):
        raise ValueError("limits must be positive")
    if not limits:
        return rows
    quota = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]), F.col("split")), F.lit(2**62))
    limited = F.coalesce(F.col("split").isin(*limits), F.lit(False))
    hashed = rows.where(limited).withColumn("_h", partition.hashed(seed, "limit", F.col("example_id")))
    return rows.where(~limited).unionByName(partition.smallest(hashed, ["split"], "_h", "example_id", quota).where("taken").select(*rows.columns))


def load_splits(sources: dict[str, DataFrame], adapter, *, limits: dict[str, int] | None = None, fraction: float | None = None, seed: int = 20260901) -> DataFrame:
    """Items of all sources (split name -> raw rows) through an adapter, with limits a split.

    Without ``fraction`` train, validation and test must all be given; others are
    left out.  With it only train and validation are read: placeholder subjects
    go, a part of train is held out by subject as validation, and the given
    validation becomes test.
    """
    from tessera.operators import partition, subjects

    canonical = {{"dev": "validation", "valid": "validation", "val": "validation"}.get(k.lower(), k.lower()): v for k, v in sources.items()}
    needed = ("train", "validation") if fraction else SPLITS
    missing = [s for s in needed if s not in canonical]
    if missing:
        raise ValueError(f"missing splits: {missing}")
    rows = {s: adapter(canonical[s], F.lit(s)) for s in needed}
    if fraction:
        native = {s: subjects.filter_native(df) for s, df in rows.items()}
        held = partition.development_holdout(native["train"].drop("split"), fraction=fraction, seed=seed).select(*rows["train"].columns)
        whole = held.unionByName(native["validation"].withColumn("split", F.lit("test")))
    else:
        whole = rows["train"].unionByName(rows["validation"]).unionByName(rows["test"])
    return head_per_split(whole, limits, seed) if limits else whole


def to_json(rows: DataFrame) -> DataFrame:
    """One column value: each item as a JSON object with its fields in name order, nulls kept."""
    fields = sorted(f.name for f in ITEM.fields)
    return rows.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))


def from_json(lines: DataFrame) -> DataFrame:
    """Items of JSON objects in column value; a line that is none has only nulls."""
    return lines.select(F.from_json("value", ITEM).alias("i")).select("i.*")


def write_jsonl(rows: DataFrame, path: str) -> None:
    """Items as JSON lines; Spark commits the folder as a whole."""
    to_json(rows).write.mode("overwrite").text(path)


def read_jsonl(spark, paths) -> DataFrame:
    """Items from JSON lines; blank lines are skipped, and reading a malformed one fails with its file and text."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path")).where(F.trim("value") != "")
    item = F.from_json("value", ITEM, {"mode": "PERMISSIVE"})
    parsed = lines.select(item.alias("i"), F.try_parse_json("value").isNull().alias("bad"), "value", "path")
    told = F.raise_error(F.concat(F.lit("invalid item in "), F.col("path"), F.lit(": "), F.substring("value", 1, 200)))
    return parsed.select(F.when(F.col("bad"), told.cast(ITEM)).otherwise(F.col("i")).alias("i")).select("i.*")
