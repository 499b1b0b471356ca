"""Subject labels: placeholder filter, histograms, coverage and skew of clients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACEHOLDERS = ("", "unknown", "general", "n/a", "none")  # fixed value


def is_placeholder(subject: Column) -> Column:
    """True for null and for a placeholder in any case and spacing."""
    return F.coalesce(F.lower(F.trim(subject)).isin(*PLACEHOLDERS), F.lit(True))


def filter_native(rows: DataFrame) -> DataFrame:
    """Rows with a subject of their own."""
    return rows.where(~is_placeholder(F.col("subject")))


def require_rows(rows: DataFrame, what: str) -> DataFrame:
    """The same rows; none is an error."""
    if not rows.limit(1).count():
        raise ValueError(f"no {what}")
    return rows


def filter_audit(rows: DataFrame) -> DataFrame:
    """Per split: input, retained and excluded rows."""
    out = is_placeholder(F.col("subject"))
    return rows.groupBy("split").agg(F.count("*").alias("input_rows"), F.count_if(~out).alias("retained_rows"), F.count_if(out).alias("excluded_rows"))


def excluded_histogram(rows: DataFrame) -> DataFrame:
    """Excluded rows by split and the subject as it was written."""
    return rows.where(is_placeholder(F.col("subject"))).groupBy("split", "subject").agg(F.count("*").alias("n_rows"))


def histogram(assigned: DataFrame) -> DataFrame:
    """Rows by client, role and subject."""
    return assigned.groupBy("client_id", "role", "subject").agg(F.count("*").alias("n_rows"))


def other_client_coverage(assigned: DataFrame) -> DataFrame:
    """For each subject in a client's support: validation rows of it at all other clients."""
    counts = assigned.where("role = 'validation'").groupBy("subject", "client_id").agg(F.count("*").alias("own"))
    totals = counts.groupBy("subject").agg(F.sum("own").alias("everywhere"))
    needed = assigned.where("role = 'support'").select("client_id", "subject").distinct()
    joined = needed.join(totals, "subject", "left").join(counts, ["subject", "client_id"], "left")
    return joined.select("client_id", "subject", (F.coalesce("everywhere", F.lit(0)) - F.coalesce("own", F.lit(0))).alias("other_rows"))


def fit_shares(assigned: DataFrame) -> DataFrame:
    """client_id, subject, share of the client's fit rows."""
    counts = assigned.where("role = 'fit'").groupBy("client_id", "subject").agg(F.count("*").alias("n"))
    sizes = counts.groupBy("client_id").agg(F.sum("n").alias("size"))
    return counts.join(sizes, "client_id").select("client_id", "subject", (F.col("n") / F.col("size")).alias("share"))


def total_variation(assigned: DataFrame) -> DataFrame:
    """client_a < client_b: total variation of every two clients with fit rows; 1 where they share no subject.

    A null subject is a subject here, as no row of a client may get lost.
    """
    shares = fit_shares(assigned).withColumn("subject", F.struct("subject"))
    a = shares.select(F.col("client_id").alias("client_a"), "subject", F.col("share").alias("share_a"))
    b = shares.select(F.col("client_id").alias("client_b"), "subject", F.col("share").alias("share_b"))
    common = a.join(b, "subject").where("client_a < client_b").groupBy("client_a", "client_b").agg(F.sum(F.least("share_a", "share_b")).alias("common"))
    # The result has a row for every two clients, so their product is no more than it.
    clients = shares.select("client_id").distinct()
    pairs = clients.select(F.col("client_id").alias("client_a")).join(clients.select(F.col("client_id").alias("client_b")), F.col("client_a") < F.col("client_b"))
    distance = F.round(1 - F.coalesce("common", F.lit(0.0)), 6)
    return pairs.join(common, ["client_a", "client_b"], "left").select("client_a", "client_b", distance.alias("total_variation"))


def subject_issues(assigned: DataFrame, *, min_rows: int) -> DataFrame:
    """client_id, rule, detail of every broken rule of the subject audit."""
    clients = assigned.select("client_id").distinct()
    present = assigned.select("client_id", "role").distinct()
    # Clients by four roles: a literal dimension, not data against data.
    wanted = clients.select("client_id", F.explode(F.array(*[F.lit(r) for r in ("fit", "support", "validation", "test")])).alias("role"))
    empty = wanted.join(present, ["client_id", "role"], "left_anti").select("client_id", F.lit("role_empty").alias("rule"), F.col("role").alias("detail"))
    placeholder = assigned.where(is_placeholder(F.col("subject"))).select("client_id", F.lit("placeholder_subject").alias("rule"), F.concat_ws("/", "role", F.coalesce("subject", F.lit("null"))).alias("detail")).distinct()
    narrow = assigned.where("role = 'support'").groupBy("client_id").agg(F.countDistinct("subject").alias("n")).where("n < 2").select("client_id", F.lit("one_support_subject").alias("rule"), F.col("n").cast("string").alias("detail"))
    thin = other_client_coverage(assigned).where(F.col("other_rows") < min_rows).select("client_id", F.lit("thin_coverage").alias("rule"), F.concat_ws("=", "subject", F.col("other_rows").cast("string")).alias("detail"))
    return empty.unionAll(placeholder).unionAll(narrow).unionAll(thin)
