"""Prompt texts and token budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: the instruction that fixes the form of an answer.
SYSTEM = "You are answering a medical multiple-choice question. Reason briefly, state the answer text, and end with exactly `Final answer: X`, where X is A, B, C, or D."


def question_block(question: Column, options: Column) -> Column:
    return F.concat(F.lit("Question: "), question, F.lit("\n"), F.array_join(F.transform(options, lambda o, i: F.concat(F.char(65 + i), F.lit(". "), o)), "\n"))


def demonstration(question: Column, options: Column, label: Column) -> Column:
    return F.concat(question_block(question, options), F.lit("\nAnswer: "), F.get(options, label), F.lit("\nFinal answer: "), F.char(65 + label))


def completion(options: Column, label: Column) -> Column:
    """The text a model is trained to continue with."""
    return F.concat(F.lit(" "), F.get(options, label), F.lit("\nFinal answer: "), F.char(65 + label))


def stand_in_tokens(text: Column) -> Column:
    """Characters over four: the token count where no tokenizer is given."""
    return F.floor(F.length(text) / 4).cast("int")


def prompts(items: DataFrame, chosen: DataFrame) -> DataFrame:
    """query_id, n_exemplars, user: exemplars in order, then the question.  Queries without exemplars have the bare question."""
    q = items.select(F.col("example_id").alias("query_id"), question_block(F.col("question"), F.col("options")).alias("q"))
    shown = items.select("example_id", demonstration(F.col("question"), F.col("options"), F.col("label")).alias("demo"))
    # k exemplars a query at most.
    blocks = chosen.join(shown, "example_id").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("position", "demo"))).alias("e"))
    numbered = F.transform("e", lambda x, i: F.concat(F.lit("Example "), (i + 1).cast("string"), F.lit(":\n"), x["demo"]))
    closing = F.array(F.concat(F.lit("Now answer this item:\n"), F.col("q"), F.lit("\nAnswer:")))
    user = F.array_join(F.concat(F.coalesce(numbered, F.array().cast("array<string>")), closing), "\n\n")
    return q.join(blocks, "query_id", "left").select("query_id", F.greatest(F.lit(0), F.coalesce(F.size("e"), F.lit(0))).alias("n_exemplars"), user.alias("user"))


def over_budget(texts: DataFrame, *, limit: int, reserve: int) -> DataFrame:
    """query_id, tokens of prompts that leave fewer than ``reserve`` tokens of ``limit``."""
    tokens = stand_in_tokens(F.concat(F.lit(SYSTEM), "user"))
    return texts.select("query_id", tokens.alias("tokens")).where(F.col("tokens") + reserve > limit)


def longest_of_pool(pool: DataFrame, items: DataFrame, *, k: int = 5) -> DataFrame:
    """The worst case a pool can make of a prompt: its k longest demonstrations, shortest of them first; ties keep the later rank."""
    size = items.select("example_id", F.length(demonstration(F.col("question"), F.col("options"), F.col("label"))).alias("len"))
    w = Window.partitionBy("query_id")
    ranked = pool.join(size, "example_id").withColumn("r", F.row_number().over(w.orderBy(F.desc("len"), F.desc("pool_rank"), F.desc("vec_id")))).where(F.col("r") <= k)
    return ranked.withColumn("position", F.row_number().over(w.orderBy(F.desc("r")))).select("query_id", "position", "example_id", "len")


def training_plan(items: DataFrame, chosen: DataFrame, *, limit: int, k: int = 5) -> DataFrame:
    """query_id, tokens_k0, tokens_kn, reason: null if the row may be trained on, else capacity or context_budget.

    The completion counts with its longest label, so the plan does not depend on the answer.
    """
    longest = F.array_max(F.transform("options", lambda o: F.length(o))) + F.length(F.lit(" \nFinal answer: X"))
    bare = items.select(F.col("example_id").alias("query_id"), (F.floor(longest / 4) + 1).cast("int").alias("completion"), stand_in_tokens(F.concat(F.lit(SYSTEM), F.lit("Now answer this item:\n"), question_block(F.col("question"), F.col("options")), F.lit("\nAnswer:"))).alias("bare"))
    full = prompts(items, chosen).select("query_id", "n_exemplars", stand_in_tokens(F.concat(F.lit(SYSTEM), "user")).alias("full"))
    pad = lambda c: (F.ceil(c / 8) * 8).cast("int")
    joined = bare.join(full, "query_id").select("query_id", "n_exemplars", pad(F.col("bare") + F.col("completion")).alias("tokens_k0"), pad(F.col("full") + F.col("completion")).alias("tokens_kn"))
    reason = F.when(F.col("n_exemplars") < k, "capacity").when(F.greatest("tokens_k0", "tokens_kn") > limit, "context_budget")
    return joined.select("query_id", "tokens_k0", "tokens_kn", reason.alias("reason"))


def plan_issues(chosen: DataFrame, support: DataFrame, excluded: DataFrame, fit: DataFrame, *, k: int = 5) -> DataFrame:
    """query_id, rule of every broken rule of an exemplar plan.

    ``chosen``: query_id, client_id, example_id; ``support``: client_id,
    example_id; ``excluded`` and ``fit``: query_id.
    """
    tag = lambda df, rule: df.select("query_id", F.lit(rule).alias("rule")).distinct()
    few = chosen.groupBy("query_id").agg(F.countDistinct("example_id").alias("n")).where(F.col("n") != k)
    own = chosen.where(F.col("query_id") == F.col("example_id"))
    foreign = chosen.join(support.select("client_id", "example_id").distinct(), ["client_id", "example_id"], "left_anti")
    included = chosen.select("query_id").distinct()
    both = included.join(excluded.select("query_id").distinct(), "query_id", "left_semi")
    covered = included.unionAll(excluded.select("query_id"))
    missing = fit.select("query_id").join(covered, "query_id", "left_anti")
    extra = covered.join(fit.select("query_id"), "query_id", "left_anti")
    return tag(few, "wrong_number").unionAll(tag(own, "own_row")).unionAll(tag(foreign, "not_in_support")).unionAll(tag(both, "also_excluded")).unionAll(tag(missing, "not_covered")).unionAll(tag(extra, "not_fit"))
