"""Problem 10: reading level of each document.

Interpolated n-gram models, one a level, are fitted on labelled texts, and their
weights on texts they had not seen.  A document's surprisal under each is averaged
over windows of all its words, the distribution of the windows gives its
difficulty, and isotonic regression on labelled texts the models had not seen maps
it to the graded scale 0 (primary) to 3 (specialist).
Words come from the normalised text, so layout, case and marks play no part.

Fit: whole labelled texts in the order of a hash of their id, up to ``MAX_FIT``
labels and ``MAX_FIT_CHARS`` characters in all.  Scores: every text, whole.

Rows with a null or unknown level are no labels; a text rated twice counts with
both levels.  Texts that are null, without words, or not in English (en, eng,
en-GB and the like) have a null level.  Without labels every level is null.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import normalize
from tessera.llm import ngrams

MAX_FIT, MAX_FIT_CHARS = 6000, 50_000_000
ENGLISH = 0.5  # share of known words from which a text without a language is English
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]+"


def _english():
    return F.coalesce(F.lower(F.trim("lang")).rlike(r"^en(?:g|glish)?(?:[-_].*)?$"), F.lit(False))


def _unnamed():
    return F.coalesce(F.lower(F.trim("lang")), F.lit("")).isin("", "und")


def fit(docs: DataFrame, labels: DataFrame, *, max_fit: int = MAX_FIT, max_chars: int = MAX_FIT_CHARS) -> dict | None:
    """Model and isotonic map from a bounded sample; None without labels."""
    known = labels.where(F.col("reading_level").isin(*ngrams.LEVELS)).select(F.col("doc_id").alias("label_id"), F.col("reading_level").alias("level")).distinct()
    sample = known.orderBy(F.xxhash64("label_id"), "label_id", "level").limit(max_fit)
    texts = docs.where(_english() & F.col("text").isNotNull()).select("doc_id", "text")
    # The sample has max_fit rows at most, whatever the size of the corpus, and its texts together max_chars characters.
    chosen = texts.join(F.broadcast(sample), F.col("doc_id") == F.col("label_id"))
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id", "level").rowsBetween(Window.unboundedPreceding, 0)
    within = chosen.select("doc_id", "level", F.length("text").alias("k")).withColumn("so_far", F.sum("k").over(order)).where(F.col("so_far") <= max_chars).select("doc_id", "level").distinct()
    rows = chosen.join(F.broadcast(within), ["doc_id", "level"]).select("doc_id", "level", normalize(F.col("text")).alias("n")).collect()
    rows = sorted(((r["doc_id"], r["level"], r["n"].split()) for r in rows if r["n"]), key=lambda r: r[:2])
    if not rows:
        return None
    words, level = [r[2] for r in rows], [ngrams.LEVELS.index(r[1]) for r in rows]
    # Each half is scored by the model of the other half; all levels of a text stay together.
    half = np.array([(r[0] * 0x9E3779B97F4A7C15 >> 40) & 1 for r in rows])
    x, weights = np.zeros(len(rows)), []
    for side in (0, 1):
        other = [i for i in range(len(rows)) if half[i] != side] or list(range(len(rows)))
        mine = np.flatnonzero(half == side)
        model = ngrams.fit([words[i] for i in other], [level[i] for i in other])
        model["weights"] = ngrams.held_out_weights(model, [words[i] for i in mine], [level[i] for i in mine])
        weights.append(model["weights"])
        for i in mine:
            x[i] = ngrams.grade(model, words[i])[0]
    model = ngrams.fit(words, level)
    model["weights"] = np.mean(weights, axis=0)
    model["knots"], model["values"] = ngrams.isotonic(x, np.array(level))
    return model


def graded(docs: DataFrame, labels: DataFrame, *, max_fit: int = MAX_FIT, unnamed: bool = False) -> DataFrame:
    """doc_id, lang, source, n_words (by white space), difficulty (0..3), reading_level, surprisal of every document."""
    return score(docs, fit(docs, labels, max_fit=max_fit), unnamed=unnamed)


def score(docs: DataFrame, fitted: dict | None, *, unnamed: bool = False) -> DataFrame:
    """As ``graded``, with a fitted model.  Its size is bounded by the sample it was fitted on."""
    model = docs.sparkSession.sparkContext.broadcast(fitted)
    n_words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), SPACE), lambda w: w != ""))
    rows = docs.select("doc_id", "lang", "source", n_words.alias("n_words"), F.when(_english() | (_unnamed() & F.lit(unnamed)), normalize(F.col("text"))).alias("n"), _english().alias("named"))

    def run(batches):
        import pyarrow as pa

        m = model.value
        for batch in batches:
            texts = zip(batch.column("n").to_pylist(), batch.column("named").to_pylist())
            found = [ngrams.grade(m, t.split()) if m and t and (named or ngrams.known_share(m, t.split()) >= ENGLISH) else (np.nan, np.nan, np.nan) for t, named in texts]
            raw = np.array(found, float).reshape(-1, 3)
            value = np.interp(raw[:, 0], m["knots"], m["values"]) if m else raw[:, 0]
            none = np.isnan(raw[:, 0])
            name = [None if no else ngrams.LEVELS[min(3, int(v + 0.5))] for v, no in zip(value, none)]
            columns = [batch.column(c) for c in ("doc_id", "lang", "source", "n_words")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(value, mask=none), pa.array(name, pa.string()), pa.array(raw[:, 2], mask=none)], names=["doc_id", "lang", "source", "n_words", "difficulty", "reading_level", "surprisal"])

    return rows.mapInArrow(run, "doc_id bigint, lang string, source string, n_words int, difficulty double, reading_level string, surprisal double")


def demanding(docs: DataFrame, labels: DataFrame, *, lang: str = "en", min_words: int = 50, level: str = "specialist") -> DataFrame:
    """doc_id of the texts of one language and length at one level."""
    # The labels are those of the whole corpus, the scores those of the texts asked for.
    scored = score(docs.where(F.col("lang") == lang), fit(docs, labels))
    return scored.where((F.col("n_words") >= min_words) & (F.col("reading_level") == level)).select("doc_id")


def profile(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per source and level: texts, words, mean difficulty and mean surprisal."""
    return graded(docs, labels, unnamed=True).groupBy("source", "reading_level").agg(F.count("*").alias("texts"), F.sum("n_words").alias("words"), F.round(F.avg("difficulty"), 4).alias("difficulty"), F.round(F.avg("surprisal"), 4).alias("surprisal"))
