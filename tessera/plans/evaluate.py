"""One arm's evaluation as one plan: pools, choice, prompts, injected model, match, records, summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.models import bag_of_hashes, generate
from tessera.operators import arms, leakage, matching, prompts, retrieval


def _judged(queries: DataFrame, support: DataFrame, encode, *, lexical, semantic) -> DataFrame:
    """Every query with the support of its client: relevance, rank and the reason that keeps a row out."""

    def side(rows: DataFrame, p: str) -> DataFrame:
        keyed = leakage.keyed(rows).select("example_id", "provenance_group", "nq", "qh")
        texts = rows.select("example_id", "client_id", "subject", retrieval.unit(encode(prompts.question_block(F.col("question"), F.col("options")))).alias("rel"), retrieval.unit(encode(F.col("question"))).alias("dup"))
        joined = texts.join(keyed, "example_id").withColumn("words", F.array_distinct(F.filter(F.split("nq", " "), lambda w: w != "")))
        return joined.select("client_id", *[F.col(c).alias(f"{p}_{c}") for c in joined.columns if c != "client_id"])

    both = side(queries, "q").join(side(support, "s"), "client_id")
    col = lambda p: {"id": F.col(f"{p}_example_id"), "nq": F.col(f"{p}_nq"), "qh": F.col(f"{p}_qh"), "provenance": F.col(f"{p}_provenance_group"), "words": F.col(f"{p}_words")}
    reason = retrieval.ineligibility(col("q"), col("s") | {"duplicate": retrieval.dot(F.col("q_dup"), F.col("s_dup"))}, lexical=lexical, semantic=semantic)
    scored = both.select("client_id", F.col("q_example_id").alias("query_id"), F.col("s_example_id").alias("support_id"), F.col("s_subject").alias("subject"), F.col("s_rel").alias("vector"), retrieval.dot(F.col("q_rel"), F.col("s_rel")).alias("relevance"), reason.alias("reason"))
    return retrieval.ranked(scored)


def pools(items: DataFrame, assigned: DataFrame, split: str, config, encode=bag_of_hashes) -> DataFrame:
    """Progressive pools of one split's queries in their client's support.

    ``items`` are valid items, ``assigned`` has example_id, client_id, role.
    """
    placed = items.join(assigned.select("example_id", "client_id", "role"), "example_id")
    judged = _judged(placed.where(F.col("role") == split), placed.where("role = 'support'"), encode, lexical=config.retrieval.lexical, semantic=config.retrieval.semantic)
    return retrieval.progressive_pool(judged, minimum=config.retrieval.top_k, sizes=config.retrieval.pools)


def eligible(pool: DataFrame) -> DataFrame:
    """Pools in the shape the choice of exemplars takes; numbers stand in for vector ids."""
    w = Window.partitionBy("query_id").orderBy("pool_rank")
    return pool.where("reason IS NULL AND NOT capacity_failure").select("query_id", "client_id", F.row_number().over(w).cast("bigint").alias("vec_id"), F.col("support_id").alias("example_id"), "subject", "pool_rank", "relevance", "vector")


def evaluate_arm(items: DataFrame, assigned: DataFrame, arm: str, split: str, config, generator, *, weights: DataFrame | None = None, encode=bag_of_hashes) -> DataFrame:
    """record rows of one arm: query, client, gold, predicted, stage, reply, prompt tokens, exemplars.

    ``generator`` is a factory of batch functions prompt -> reply.  A query whose
    pool stays too small has a bare prompt and no exemplars.
    """
    r = config.retrieval
    found = pools(items, assigned, split, config, encode)
    table = arms.arms(items.sparkSession, train_icl=True).where(F.col("arm") == arm)
    chosen = arms.chosen(eligible(found), table, k=r.top_k, alpha=r.alpha, beta=r.beta, gamma=r.gamma, weights=weights).drop("arm")
    asked = assigned.where(F.col("role") == split).select(F.col("example_id").alias("query_id"), "client_id")
    texts = prompts.prompts(items, chosen).join(asked, "query_id")
    replies = generate(texts.select("query_id", F.concat(F.lit(prompts.SYSTEM), F.lit("\n\n"), "user").alias("user")), generator)
    shown = chosen.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "example_id"))), lambda x: x["example_id"]).alias("exemplar_ids"))
    rows = replies.select(F.col("query_id").alias("record_id"), F.col("query_id").alias("example_id"), "generated_text")
    matched = matching.match(rows, items).withColumnRenamed("record_id", "query_id")
    tokens = prompts.stand_in_tokens(F.concat(F.lit(prompts.SYSTEM), "user"))
    facts = items.select(F.col("example_id").alias("query_id"), "subject", F.col("label").alias("gold"))
    out = texts.select("query_id", "client_id", tokens.alias("prompt_tokens")).join(facts, "query_id").join(replies, "query_id").join(matched, "query_id").join(shown, "query_id", "left")
    return out.select(F.lit(arm).alias("arm"), F.lit(split).alias("split"), F.col("query_id").alias("example_id"), "client_id", "subject", "gold", F.col("label").alias("predicted"), F.col("match_stage").alias("stage"), "generated_text", "prompt_tokens", F.coalesce("exemplar_ids", F.array().cast("array<string>")).alias("exemplar_ids"))


def cohort_audit(items: DataFrame, assigned: DataFrame, split: str, config, encode=bag_of_hashes) -> DataFrame:
    """query_id, searched, eligible, expanded, worst-case tokens of the longest exemplars of its pool, over_budget."""
    found = pools(items, assigned, split, config, encode)
    worst = prompts.longest_of_pool(eligible(found), items, k=config.retrieval.top_k)
    texts = prompts.prompts(items, worst.select("query_id", "position", "example_id"))
    tokens = prompts.stand_in_tokens(F.concat(F.lit(prompts.SYSTEM), "user"))
    limit = config.evaluation.max_tokens - config.evaluation.new_tokens
    return retrieval.pool_diagnostics(found).join(texts.select("query_id", tokens.alias("tokens")), "query_id").withColumn("over_budget", F.col("tokens") > limit)
