"""Leakage between support and evaluation, and decontamination of splits.

Exact keys are one equi-join on (kind, value).  The lexical rule is a set
similarity join with a lossless prefix filter: two questions with Jaccard of at
least t share one of each other's n - ceil(t n) + 1 rarest words.  Rows of equal
question are joined once; size and word parity are part of the join condition,
so buckets of common words cost comparisons and no rows.  Every question's text
is shuffled once, with its ids; the similarity join moves hashes.  Thresholds are
fractions, compared in integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import normalize

THRESHOLD = (17, 20)
KINDS = ("id", "normalized_question", "question_options_hash", "provenance_group", "lexical_near_duplicate")  # fixed value: order of precedence
COUNTERS = 2**18  # of words
CHUNKS = 16  # a key's ids on either side; a pair of chunks is expanded by one task


def question_options_hash(question: Column, options: Column) -> Column:
    """sha256 of compact JSON of the normalised options in order and question; normalised text needs no escapes."""
    listed = F.array_join(F.transform(options, lambda o: F.concat(F.lit('"'), o, F.lit('"'))), ",")
    return F.sha2(F.concat(F.lit('{"options":['), listed, F.lit('],"question":"'), question, F.lit('"}')), 256)


def keyed(rows: DataFrame, mode: str = "exact") -> DataFrame:
    """example_id, split, provenance_group, question and options hash of items, ready to be joined."""
    base = rows.select("example_id", "split", "provenance_group", normalize(F.col("question"), mode).alias("nq"), F.transform("options", lambda o: normalize(o, mode)).alias("no"))
    return base.select("example_id", "split", "provenance_group", "nq", question_options_hash(F.col("nq"), F.col("no")).alias("qh"))


def _keys(rows: DataFrame, check_provenance: bool) -> DataFrame:
    kinds = [(0, "example_id"), (1, "nq"), (2, "qh")] + ([(3, "provenance_group")] if check_provenance else [])
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in kinds])
    exploded = rows.select("example_id", F.explode(pairs).alias("p")).select("example_id", F.col("p.kind").alias("kind"), F.col("p.value").alias("value"))
    return exploded.where(F.col("value").isNotNull() & ~((F.col("kind") == 3) & (F.col("value") == "")))


def _asked(rows: DataFrame, side: str) -> DataFrame:
    """{side}q, nq, others, chunk, rows: ids and options hashes of every question, in up to ``CHUNKS`` arrays, partitioned by q, the question's hash.

    others: all questions of ids that have more than one, else empty.  Two questions
    of one hash stay two.  All leaks but provenance come from this one shuffle.
    """
    sets = rows.groupBy("example_id").agg(F.collect_set(F.struct("nq", "qh")).alias("a"))
    several = F.array_sort(F.array_distinct(F.col("a.nq")))
    each = sets.select("example_id", F.when(F.size(several) > 1, several).otherwise(F.array().cast("array<string>")).alias("others"), F.inline("a")).where(F.col("nq").isNotNull())
    chunk = F.pmod(F.xxhash64("example_id"), F.lit(CHUNKS)).cast("int").alias(f"{side}chunk")
    dealt = each.select(F.xxhash64("nq").alias(f"{side}q"), F.col("nq").alias(f"{side}nq"), F.col("others").alias(f"{side}others"), chunk, F.struct("example_id", F.unhex("qh").alias("qh")).alias("r")).repartition(f"{side}q")
    return dealt.groupBy(f"{side}q", f"{side}nq", f"{side}others", f"{side}chunk").agg(F.collect_set("r").alias(f"{side}rows"))


def _expanded(pairs: DataFrame) -> DataFrame:
    """kind, support_id, evaluation_id, value: every id of sids with every id of eids."""
    one = pairs.select("kind", "value", "eids", F.inline("sids").alias("support_id"))
    return one.select("kind", "support_id", F.inline("eids").alias("evaluation_id"), "value")


def _ids(rows) -> Column:
    return F.array_distinct(F.transform(rows, lambda r: F.struct(r["example_id"])))


def _exact(s: DataFrame, e: DataFrame, support: DataFrame, evaluation: DataFrame) -> DataFrame:
    # Equality in both directions of contains: no key of the join, which needs no shuffle by the hash alone.
    same = s.join(e, F.col("sq") == F.col("eq")).where(F.contains("snq", "enq") & F.contains("enq", "snq"))
    job = lambda kind, value, a, b: F.struct(F.lit(kind).alias("kind"), value.alias("value"), _ids(a).alias("sids"), _ids(b).alias("eids"))
    # A hash holds the question, so rows of equal hashes are in the chunks of equal questions.
    hashes = F.filter(F.array_intersect("srows.qh", "erows.qh"), lambda h: h.isNotNull())
    of_hash = F.transform(hashes, lambda h: job(2, F.lower(F.hex(h)), F.filter("srows", lambda r: r["qh"] == h), F.filter("erows", lambda r: r["qh"] == h)))
    jobs = same.select("schunk", "echunk", F.inline(F.concat(F.array(job(1, F.col("snq"), F.col("srows"), F.col("erows"))), of_hash)))
    # Chunks are small and what they expand to is not: they are dealt to all tasks by hash first.
    parts = int(s.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = _expanded(jobs.repartition(parts, "kind", "value", "schunk", "echunk"))
    known = support.select("example_id").distinct().join(evaluation.select("example_id").distinct(), "example_id")
    return found.unionAll(known.select(F.lit(0).alias("kind"), F.col("example_id").alias("support_id"), F.col("example_id").alias("evaluation_id"), F.col("example_id").alias("value")))


def exact_issues(support: DataFrame, evaluation: DataFrame) -> DataFrame:
    """kind (number), support_id, evaluation_id, value of equal ids, questions and hashes.

    Every pair is a row, so a question with a share of all rows has as many as the
    square of them.  Each comes from one pair of chunks: nothing behind the join is
    shuffled or compared again.
    """
    return _exact(_asked(support, "s"), _asked(evaluation, "e"), support, evaluation)


def all_exact_issues(support: DataFrame, evaluation: DataFrame) -> DataFrame:
    """As ``exact_issues``, and the provenance leaks with one witness an evaluation row."""
    return exact_issues(support, evaluation).unionAll(_groups(support, evaluation))


def _groups(support: DataFrame, evaluation: DataFrame) -> DataFrame:
    return provenance_issues(support, evaluation).select(F.lit(3).alias("kind"), "support_id", "evaluation_id", "value")


def provenance_issues(support: DataFrame, evaluation: DataFrame) -> DataFrame:
    """kind, support_id, evaluation_id, value, n_support: every evaluation row whose provenance group has support rows.

    ``support_id`` is the smallest id of the ``n_support`` support rows of the
    group, so a group with a third of all rows costs a row an evaluation row.
    """
    groups = lambda rows: rows.where(F.col("provenance_group") != "").select(F.col("provenance_group").alias("value"), "example_id").distinct()
    known = groups(support).groupBy("value").agg(F.min("example_id").alias("support_id"), F.count("*").alias("n_support"))
    return groups(evaluation).withColumnRenamed("example_id", "evaluation_id").join(known, "value").select(F.lit(KINDS[3]).alias("kind"), "support_id", "evaluation_id", "value", "n_support")


def _questions(asked: DataFrame, side: str) -> DataFrame:
    """{side}q, nq: the questions.  The size keeps the rows in what is moved, so it is moved once for all readers."""
    return asked.where(F.size(f"{side}rows") > 0).select(f"{side}q", f"{side}nq").distinct()


def _words(question) -> Column:
    return F.array_distinct(F.filter(F.split(question, " "), lambda w: w != ""))


def _candidates(s: DataFrame, e: DataFrame, threshold: tuple[int, int], hot: int) -> DataFrame:
    """sq, eq: hashes of the questions in s (sq, snq) and e (eq, enq) that may reach the threshold, partitioned by sq.

    Words are counted in ``COUNTERS`` counters, a broadcast of fixed size, and their
    order in a question is that of their counter, then hash.  Any order that is the
    same on both sides loses no pair.  Only hashes and numbers are moved.
    """
    num, den = threshold
    counter = F.pmod(F.col("h"), F.lit(COUNTERS)).alias("counter")
    # Outer: the filter that Spark infers of an inner one splits every text a second time, below the shuffle.
    words = s.select(F.explode_outer(_words("snq")).alias("word")).select(F.when(F.col("word").isNotNull(), F.xxhash64("word")).alias("h"))
    frequency = F.broadcast(words.where(F.col("h").isNotNull()).groupBy(counter).agg(F.count("*").alias("df")))

    def prefix(rows: DataFrame, side: str) -> DataFrame:
        # t: the rarest words up to one more than the prefix; p: length of the prefix.
        # A second hash, so that two questions of one q stay two; the rows are partitioned by q already and stay where they are.
        sized = rows.select(f"{side}q", F.xxhash64(F.lit(1), f"{side}nq").alias("q2"), F.explode_outer(_words(f"{side}nq")).alias("word"))
        each = sized.where(F.col("word").isNotNull()).select(f"{side}q", "q2", F.xxhash64("word").alias("h")).withColumn("counter", counter).join(frequency, "counter", "left")
        bit = F.expr("shiftleft(1L, cast(pmod(shiftright(h, 20), 48) AS INT))")
        own = each.groupBy(f"{side}q", "q2").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "h"))).alias("t"), F.bit_xor(bit).alias("parity"))  # the words of one question
        own = own.withColumn("n", F.size("t")).withColumn("p", F.col("n") - F.ceil(F.col("n") * num / den).cast("int") + 1)
        # Sets that may share a single word keep it as a key besides.
        pairs = "transform(slice(t, i + 2, p - i), y -> xxhash64(x.h, y.h))"
        keys = F.expr(f"flatten(transform(slice(t, 1, p), (x, i) -> if(x.df <= {hot}, array(x.h), if(n - p + 1 < 2, array_append({pairs}, x.h), {pairs}))))")
        # Coalesced: else Spark infers a filter for it, which it moves below the shuffle, and then this shuffle isn't that of the other readers.
        return own.select(F.explode_outer(keys).alias("key"), f"{side}q", F.expr("coalesce(shiftleft(least(n, 32767) * 1L, 48) | parity, 0L)").alias(f"{side}p")).where(F.col("key").isNotNull())

    # 48 bits of parity and the number of words in one long; of 32,767 words or more both tests let everything of like size through.
    sn, en = F.shiftright("sp", 48), F.shiftright("ep", 48)
    odd = F.bit_count(F.col("sp").bitwiseXOR(F.col("ep")).bitwiseAND(F.lit(2**48 - 1)))
    near = (odd * (den + num) <= (sn + en) * (den - num)) & (F.least(sn, en) * den >= F.greatest(sn, en) * num)
    return prefix(s, "s").join(prefix(e, "e"), "key").where(near & (F.col("sq") != F.col("eq"))).select("sq", "eq").repartition("sq").distinct()


def _scored(found: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Rows with questions snq, enq that reach the threshold, with shared and total."""
    num, den = threshold
    sw, ew = _words("snq"), _words("enq")
    scored = found.where(F.col("snq") != F.col("enq")).select("*", F.size(F.array_intersect(sw, ew)).alias("shared"), F.size(F.array_union(sw, ew)).alias("total"))
    return scored.where(F.col("shared") * den >= F.col("total") * num)


def lexical_pairs(support: DataFrame, evaluation: DataFrame, threshold: tuple[int, int] = THRESHOLD, *, hot: int = 1000) -> DataFrame:
    """snq, enq, shared, total of different normalised questions with Jaccard of at least the threshold.

    The rarest word two such questions share is in both prefixes, the next one
    they share at most one place behind.  So a word of more than ``hot`` support
    questions is no key of its own: it is joined with each word up to there.
    """
    s, e = _questions(_asked(support, "s"), "s"), _questions(_asked(evaluation, "e"), "e")
    found = _candidates(s, e, threshold, hot).join(s, "sq").join(e, "eq")
    return _scored(found, threshold).select("snq", "enq", "shared", "total")


def _ratio(shared: Column, total: Column) -> Column:
    return F.format_string("%.6f", shared / total)


def _first(threshold: tuple[int, int]) -> Column:
    """False for a pair of questions whose ids also have a smaller pair with the same value: ids with several questions (``others``) name a pair once."""
    num, den = threshold
    at = F.struct(F.col("snq").alias("a"), F.col("enq").alias("b"))

    def before(a: Column, b: Column) -> Column:
        shared, total = F.size(F.array_intersect(_words(a), _words(b))), F.size(F.array_union(_words(a), _words(b)))
        return (F.struct(a.alias("a"), b.alias("b")) < at) & (a != b) & (shared * den >= total * num) & (_ratio(shared, total) == F.col("value"))

    questions = lambda side: F.when(F.size(f"{side}others") > 0, F.col(f"{side}others")).otherwise(F.array(f"{side}nq"))
    single = (F.size("sothers") == 0) & (F.size("eothers") == 0)
    return single | ~F.exists(questions("s"), lambda a: F.exists(questions("e"), lambda b: before(a, b)))


def issues(support: DataFrame, evaluation: DataFrame, *, threshold: tuple[int, int] = THRESHOLD, check_provenance: bool = True) -> DataFrame:
    """kind, support_id, evaluation_id, value of all leaks between two keyed sets.

    A provenance group is reported once an evaluation row, with its smallest support
    id (``provenance_issues`` has the number of the others).  Support rows outside
    train are issues of their own, without evaluation id.
    """
    s, e = _asked(support, "s"), _asked(evaluation, "e")
    exact = _exact(s, e, support, evaluation)
    if check_provenance:
        exact = exact.unionAll(_groups(support, evaluation))
    asking = lambda asked, side: asked.select(f"{side}q", f"{side}nq", f"{side}others", _ids(f"{side}rows").alias(f"{side}ids"))
    found = _candidates(_questions(s, "s"), _questions(e, "e"), threshold, 1000).join(asking(s, "s"), "sq").join(asking(e, "e"), "eq")
    near = _scored(found, threshold).select("snq", "sothers", "sids", "enq", "eothers", "eids", _ratio(F.col("shared"), F.col("total")).alias("value")).where(_first(threshold))
    lexical = _expanded(near.select(F.lit(4).alias("kind"), "value", "sids", "eids"))
    named = exact.unionAll(lexical)
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    wrong = support.where(F.col("split") != "train").select(F.lit("support_not_train").alias("kind"), F.col("example_id").alias("support_id"), F.lit("").alias("evaluation_id"), F.col("split").alias("value"))
    return named.select(kind.alias("kind"), "support_id", "evaluation_id", "value").unionAll(wrong)


def assert_no_leakage(found: DataFrame) -> None:
    """Raise with up to ten issues if there is any."""
    rows = found.limit(10).collect()
    if rows:
        raise ValueError("support leakage: " + ", ".join(f"{r['kind']}:{r['support_id']}->{r['evaluation_id']}" for r in rows))


def _witness(rows: DataFrame, protected: DataFrame, threshold) -> DataFrame:
    """example_id, matched_id, kind of the first match by kind and protected id of every row to drop."""
    # The smallest protected id of a key is its witness, so a group with a third of all rows costs one row.
    first_of = _keys(protected, True).groupBy("kind", "value").agg(F.min("example_id").alias("support_id"))
    exact = _keys(rows, True).join(first_of, ["kind", "value"]).select("kind", "support_id", F.col("example_id").alias("evaluation_id"))
    near = lexical_pairs(protected, rows, threshold)
    p = protected.select(F.col("example_id").alias("support_id"), F.col("nq").alias("snq"))
    r = rows.select(F.col("example_id").alias("evaluation_id"), F.col("nq").alias("enq"))
    # One witness a question is enough, so copies of a question are not expanded against each other.
    first = near.join(p.groupBy("snq").agg(F.min("support_id").alias("support_id")), "snq").groupBy("enq").agg(F.min("support_id").alias("support_id"))
    lexical = first.join(r, "enq").select(F.lit(4).alias("kind"), "support_id", "evaluation_id")
    best = exact.unionAll(lexical).groupBy("evaluation_id").agg(F.min(F.struct("kind", "support_id")).alias("m"))
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("m.kind") + 1)
    return best.select(F.col("evaluation_id").alias("example_id"), F.col("m.support_id").alias("matched_id"), kind.alias("kind"))


def decontaminate(rows: DataFrame, *, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """split, example_id, matched_id, kind of the rows to drop.

    Test stays whole.  Validation loses what overlaps test; train loses what
    overlaps test or the validation rows that stay.
    """
    from tessera.plans.staging import stage

    rows = stage(rows, "keyed")
    test, validation, train = (rows.where(F.col("split") == s) for s in ("test", "validation", "train"))
    out_v = stage(_witness(validation, test, threshold), "dropped-validation")
    kept_v = validation.join(out_v.select("example_id"), "example_id", "left_anti")
    out_t = _witness(train, test.unionByName(kept_v), threshold)
    return out_v.select(F.lit("validation").alias("split"), "example_id", "matched_id", "kind").unionAll(out_t.select(F.lit("train").alias("split"), "example_id", "matched_id", "kind"))


def require_splits(rows: DataFrame, *splits: str) -> DataFrame:
    """The same rows; a split (by default each of the three) without rows is an error."""
    there = {r[0] for r in rows.select("split").distinct().collect()}
    if lacking := [s for s in splits or ("train", "validation", "test") if s not in there]:
        raise ValueError(f"no rows are left in {lacking}")
    return rows


def drop_reasons(dropped: DataFrame) -> DataFrame:
    """Dropped rows by split and kind of the first match."""
    return dropped.groupBy("split", "kind").agg(F.count("*").alias("n_rows"))


def split_overlaps(rows: DataFrame) -> DataFrame:
    """left_split, right_split, kind, n_rows: rows of the right split that share a key with the left one, for all three pairs of splits.

    The kind is the first in the order of precedence.  Keys are reduced to one row a
    split first, so a group with a third of all rows is not expanded.
    """
    keys = rows.select("example_id", "split").join(_keys(rows, True), "example_id")
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("l"), F.lit(b).alias("r")) for a, b in (("train", "validation"), ("train", "test"), ("validation", "test"))]))
    known = keys.select(F.col("split").alias("l"), "kind", "value").distinct()
    asked = keys.select("example_id", "split", "kind", "value", pairs.alias("p")).where(F.col("split") == F.col("p.r")).select("example_id", F.col("p.l").alias("l"), F.col("split").alias("r"), "kind", "value")
    first = asked.join(known, ["l", "kind", "value"], "left_semi").groupBy("l", "r", "example_id").agg(F.min("kind").alias("kind"))
    return first.groupBy(F.col("l").alias("left_split"), F.col("r").alias("right_split"), F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1).alias("kind")).agg(F.count("*").alias("n_rows"))


def assert_disjoint(rows: DataFrame) -> None:
    """Raise if any two of the three splits share a key."""
    if found := split_overlaps(rows).limit(9).collect():
        raise ValueError("splits overlap: " + ", ".join(f"{r['left_split']}/{r['right_split']} {r['kind']}" for r in found))


def decontamination_counts(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """Per split: input, retained and dropped rows."""
    out = dropped.groupBy("split").agg(F.count("*").alias("dropped_rows"))
    return rows.groupBy("split").agg(F.count("*").alias("input_rows")).join(out, "split", "left").select("split", "input_rows", F.coalesce("dropped_rows", F.lit(0)).alias("dropped_rows"), (F.col("input_rows") - F.coalesce("dropped_rows", F.lit(0))).alias("retained_rows"))
