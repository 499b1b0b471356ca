"""Queries on pools, prompts, partitions, training steps and manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import assigned as A
from tessera.operators import leakage, partition, priors, prompts, retrieval, training
from tessera.plans import sql
from tessera.plans.catalog_eval import records
from tessera.sources import items as I
from tessera.sources import manifest
from tessera.sources.tables import table


def _pool(s, d):
    return retrieval.clean_pool(table(s, d, "retrieved_examples"), table(s, d, "query_vectors"))


def _items(s, d):
    return I.items(table(s, d, "examples"))


def _judged(s, d):
    """Pool rows whose query and exemplar are valid items, re-ranked, with the reason that keeps a row out."""
    keyed = leakage.keyed(_items(s, d), "portable").withColumn("words", F.array_distinct(F.filter(F.split("nq", " "), lambda w: w != "")))
    side = lambda p: keyed.select(*[F.col(c).alias(f"{p}_{n}") for c, n in (("example_id", "id"), ("nq", "nq"), ("qh", "qh"), ("provenance_group", "provenance"), ("words", "words"))])
    rows = _pool(s, d).select("query_id", "vec_id", "example_id", "relevance").join(side("q"), F.col("query_id") == F.col("q_id")).join(side("s"), F.col("example_id") == F.col("s_id"))
    col = lambda p: {n: F.col(f"{p}_{n}") for n in ("id", "nq", "qh", "provenance", "words")}
    reason = retrieval.ineligibility(col("q"), col("s") | {"duplicate": F.col("relevance")}, semantic=0.4)
    scored = rows.select("query_id", F.col("vec_id").alias("support_id"), "relevance", reason.alias("reason"))
    return retrieval.ranked(scored)


def _progressive(s, d):
    return retrieval.progressive_pool(_judged(s, d), minimum=3, sizes=(3, 6))


def _weights(s, d):
    return priors.weakness(records(s, d).where("split = 'validation' AND subject IS NOT NULL"))


def _reranked(s, d, beta, gamma, weights=None):
    return retrieval.rerank(_pool(s, d), beta=beta, gamma=gamma, weights=weights)


def _vectors(s, d):
    e = table(s, d, "embeddings").select("vec_id", (F.col("vec_id") % 3).cast("int").alias("client_id"), F.col("embedding").alias("vector"), "label")
    return e.where("vec_id % 5 = 0").withColumnRenamed("vec_id", "query_id"), e.where("vec_id % 5 <> 0").withColumnRenamed("vec_id", "support_id")


def _checkpoints(s, d):
    return records(s, d).where("client_id IS NOT NULL").select("arm", F.col("client_id").alias("round"), F.col("prompt_tokens").alias("step"), F.col("gold").alias("epoch"), F.concat_ws("-", F.lit("ck"), "record_id").alias("name"), F.col("likelihood_confidence").alias("loss"), F.col("generated_at").alias("mtime"), (F.col("gold") > 0).alias("is_step"), (F.col("predicted") == 3).alias("protected"))


def _batches(s, d):
    return records(s, d).select((F.col("record_id") % 50).alias("batch"), F.floor(F.col("record_id") / 50).alias("at"), F.col("prompt_tokens").alias("n_tokens"), F.greatest(F.lit(0), F.col("prompt_tokens") - 200).alias("supervised"))


def _assigned(s, d):
    return A.assigned(_items(s, d), table(s, d, "assignments"))


def _partition(s, d):
    items = _items(s, d)
    weights = partition.subject_weights(items)
    return partition.roles(partition.rebalance(partition.assign_clients(items, weights)))


def queries():
    out = {
        "clean_pool": lambda s, d: _pool(s, d).select("query_id", "vec_id", "example_id", "subject", "pool_rank", F.round("relevance", 6).alias("relevance"), F.round(retrieval.dot(F.col("vector"), F.col("vector")), 6).alias("norm2")),
        "topk_relevance": lambda s, d: retrieval.ranked(_pool(s, d).select("query_id", F.col("vec_id").alias("support_id"), "relevance"), limit=5).select("query_id", "support_id", "pool_rank"),
        "client_score_top": lambda s, d: retrieval.ranked(retrieval.score_pairs(*_vectors(s, d)), limit=5).select("query_id", "support_id", "pool_rank", F.round("relevance", 5).alias("relevance")),
        "eligibility_reasons": lambda s, d: _judged(s, d).select("query_id", "support_id", "pool_rank", "reason"),
        "progressive_pool": lambda s, d: _progressive(s, d).where("reason IS NULL").select("query_id", "support_id", "pool_rank", "pool_size", "expanded", "capacity_failure"),
        "pool_diagnostics": lambda s, d: retrieval.pool_diagnostics(_progressive(s, d)),
        "pool_exclusions": lambda s, d: retrieval.exclusion_counts(_progressive(s, d)),
        "rerank_relevance": lambda s, d: retrieval.first_of_pool(_pool(s, d)),
        "rerank_diversity": lambda s, d: _reranked(s, d, 0.15, 0.0).select("query_id", "position", "vec_id"),
        "rerank_prior": lambda s, d: _reranked(s, d, 0.0, 0.2, _weights(s, d)).select("query_id", "position", "vec_id"),
        "rerank_full": lambda s, d: _reranked(s, d, 0.15, 0.2, _weights(s, d)).select("query_id", "position", "vec_id"),
        "rerank_placebo": lambda s, d: _reranked(s, d, 0.15, 0.2, priors.shuffled(_weights(s, d), seed=7)).select("query_id", "position", "vec_id"),
        "rerank_activity": lambda s, d: retrieval.rerank_activity(_pool(s, d), retrieval.first_of_pool(_pool(s, d)), _reranked(s, d, 0.15, 0.2, _weights(s, d)), _reranked(s, d, 0.15, 0.0), _weights(s, d)),
        "prompt_build": lambda s, d: prompts.prompts(_items(s, d), _shown(s, d)).select("query_id", "n_exemplars", F.md5("user").alias("user_md5"), F.length("user").alias("n_chars")),
        "prompt_budget": lambda s, d: prompts.over_budget(prompts.prompts(_items(s, d), _shown(s, d)), limit=640, reserve=64),
        "worst_case_prompt": lambda s, d: prompts.longest_of_pool(_pool(s, d), _items(s, d)).select("query_id", "position", "example_id", "len"),
        "training_completions": lambda s, d: _items(s, d).select("example_id", prompts.completion(F.col("options"), F.col("label")).alias("completion")),
        "training_plan": lambda s, d: prompts.training_plan(_items(s, d), _shown(s, d), limit=600),
        "plan_issues": lambda s, d: _plan_issues(s, d),
        "development_holdout": lambda s, d: partition.development_holdout(_items(s, d).where("split = 'train'").select("example_id", "subject")).select("example_id", "subject", "split"),
        "support_roles": lambda s, d: partition.roles(_assigned(s, d).select("example_id", "client_id", F.col("original_split").alias("split"), "subject")),
        "partition_roles": lambda s, d: _partition(s, d),
        "partition_manifest": lambda s, d: manifest.counts(_assigned(s, d)),
        "client_seeds": lambda s, d: _assigned(s, d).select("client_id").distinct().select("client_id", training.client_seed(F.lit(42), F.lit(6), F.col("client_id")).alias("seed")),
        "weighted_vector_mean": lambda s, d: training.weighted_vector_mean(table(s, d, "embeddings").select((F.col("label") % 2).alias("part"), (F.col("label") + 1).alias("weight"), F.col("embedding").alias("vector")), "part"),
        "communication": lambda s, d: training.communication(table(s, d, "embeddings").select(F.col("embedding").alias("vector")), clients=5),
        "token_weighted_loss": lambda s, d: training.token_weighted_loss(records(s, d).where("likelihood_confidence IS NOT NULL").select("arm", (1 - F.col("likelihood_confidence")).alias("loss"), F.col("prompt_tokens").alias("tokens")), "arm"),
        "pad_width": lambda s, d: training.pad_width(_batches(s, d)),
        "chunk_weights": lambda s, d: training.chunk_weights(_batches(s, d), size=4),
        "accumulation_groups": lambda s, d: training.accumulation_groups(_batches(s, d).select("batch").distinct().select(F.lit(1).alias("epoch"), "batch"), every=8),
        "label_mask": lambda s, d: records(s, d).select("record_id", F.array_join(training.masked_labels(F.sequence(F.lit(1), F.col("gold") + 1), F.array(F.col("prompt_tokens"), F.lit(0))), ",").alias("labels")),
        "best_checkpoint": lambda s, d: training.best_checkpoint(_checkpoints(s, d), "arm"),
        "latest_checkpoint": lambda s, d: training.latest_checkpoint(_checkpoints(s, d), "arm"),
        "prunable_checkpoints": lambda s, d: training.prunable(_checkpoints(s, d).where("protected IS NOT NULL"), "arm", keep=3),
        "select_round": lambda s, d: training.best_round(records(s, d).where("seed IS NOT NULL").groupBy((F.col("client_id") % 9).alias("round"), "seed").agg(F.avg(F.coalesce(F.col("predicted") == F.col("gold"), F.lit(False)).cast("double")).alias("accuracy"))),
        "throughput": lambda s, d: training.throughput(records(s, d).select("arm", F.col("prompt_tokens").alias("exposures"), ((F.col("gold") + 1) * 2).alias("seconds")), "arm"),
        "last_summaries": lambda s, d: training.last_summaries(records(s, d).where("likelihood_confidence IS NOT NULL").select("arm", "seed", F.concat_ws("-", "split", "record_id").alias("folder"), F.col("likelihood_confidence").alias("accuracy"))),
        "split_identity": lambda s, d: training.ordered_identity(leakage.keyed(_items(s, d), "portable"), "split"),
        "fit_overlap": lambda s, d: _fit_overlap(s, d),
    }
    return out


def _fit_overlap(s, d):
    keyed = leakage.keyed(_items(s, d), "portable").join(_assigned(s, d).select("example_id", "role"), "example_id")
    return training.fit_overlap(keyed.where("role = 'fit'").select("example_id", "qh"), keyed.where("role = 'validation'").select("example_id", "qh"))


def _shown(s, d):
    """The first five of each pool that are valid items."""
    valid = _items(s, d).select("example_id")
    return retrieval.first_of_pool(_pool(s, d).join(valid, "example_id"))


def _plan_issues(s, d):
    chosen = retrieval.first_of_pool(_pool(s, d)).join(_pool(s, d).select("vec_id", "client_id"), "vec_id")
    support = _assigned(s, d).where("role = 'support'")
    fit = _assigned(s, d).where("role = 'validation'").select(F.col("example_id").alias("query_id"))
    return prompts.plan_issues(chosen, support, fit.where("query_id < '1'"), fit)


_UNIT = "list_transform(vector, lambda x: CAST(x AS DOUBLE) / greatest(sqrt(list_dot_product(CAST(vector AS DOUBLE[]), CAST(vector AS DOUBLE[]))), 1e-12))"
POOL = f"""usable AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY query_id DESC, client_id DESC, pool_rank DESC, example_id DESC, subject DESC NULLS LAST, relevance DESC NULLS LAST) AS rn FROM retrieved_examples
    WHERE vec_id IS NOT NULL AND len(vector) = 64 AND len(list_filter(vector, lambda x: x <> 0)) > 0 AND len(list_filter(vector, lambda x: x IS NULL)) = 0) WHERE rn = 1),
  pool AS (SELECT u.query_id, u.client_id, vec_id, example_id, subject, pool_rank, u.v AS vector, coalesce(CASE WHEN abs(relevance) > 1 THEN relevance / 100 ELSE relevance END, round(list_dot_product(u.v, CAST(q.vector AS DOUBLE[])), 6)) AS relevance
    FROM (SELECT *, {_UNIT} AS v FROM usable) u LEFT JOIN query_vectors q ON u.query_id = q.query_id)"""
_SHOWN = f"""{POOL}, shown AS (SELECT * FROM (SELECT p.query_id, p.example_id, p.vec_id, row_number() OVER (PARTITION BY p.query_id ORDER BY pool_rank, vec_id) AS position FROM pool p JOIN items i ON p.example_id = i.example_id) WHERE position <= 5)"""
_BLOCK = "'Question: ' || question || chr(10) || 'A. ' || options[1] || chr(10) || 'B. ' || options[2] || chr(10) || 'C. ' || options[3] || chr(10) || 'D. ' || options[4]"
_DEMO = f"{_BLOCK} || chr(10) || 'Answer: ' || options[label + 1] || chr(10) || 'Final answer: ' || chr(65 + label)"
_PROMPTS = f"""{_SHOWN}, demos AS (SELECT example_id, {_DEMO} AS demo FROM items),
  blocks AS (SELECT query_id, count(*) AS k, string_agg('Example ' || CAST(position AS VARCHAR) || ':' || chr(10) || demo, chr(10) || chr(10) ORDER BY position) AS e FROM shown JOIN demos ON shown.example_id = demos.example_id GROUP BY 1),
  prompts AS (SELECT i.example_id AS query_id, CAST(coalesce(k, 0) AS INTEGER) AS n_exemplars, coalesce(e || chr(10) || chr(10), '') || 'Now answer this item:' || chr(10) || {_BLOCK} || chr(10) || 'Answer:' AS "user", options FROM items i LEFT JOIN blocks b ON i.example_id = b.query_id)"""
_LEN = len(prompts.SYSTEM)
_W = "list_distinct(list_filter(string_split({0}.nq, ' '), lambda w: w <> ''))"
_JUDGED = f"""{POOL}, w AS (SELECT *, {_W.format("keyed")} AS words FROM keyed),
  judged AS (SELECT p.query_id, p.vec_id AS support_id, p.relevance, CAST(row_number() OVER (PARTITION BY p.query_id ORDER BY round_even(p.relevance, 6) DESC, p.vec_id) AS INTEGER) AS pool_rank,
    CASE WHEN q.example_id = s.example_id THEN 'example_id' WHEN q.nq = s.nq THEN 'normalized_question' WHEN q.qh = s.qh THEN 'question_options_hash' WHEN q.provenance_group <> '' AND q.provenance_group = s.provenance_group THEN 'provenance_group'
      WHEN len(q.words) + len(s.words) = 0 OR len(list_intersect(q.words, s.words)) * 20 >= (len(q.words) + len(s.words) - len(list_intersect(q.words, s.words))) * 17 THEN 'lexical_near_duplicate' WHEN p.relevance >= 0.4 THEN 'semantic_near_duplicate' END AS reason
    FROM pool p JOIN w q ON p.query_id = q.example_id JOIN w s ON p.example_id = s.example_id)"""
_PROGRESSIVE = f"""{_JUDGED}, z AS (SELECT query_id, max(pool_rank) AS n, count(*) FILTER (WHERE reason IS NULL AND pool_rank <= 3) AS e3, count(*) FILTER (WHERE reason IS NULL AND pool_rank <= 6) AS e6, count(*) FILTER (WHERE reason IS NULL) AS en FROM judged GROUP BY 1),
  z2 AS (SELECT query_id, n, CASE WHEN e3 >= 3 THEN least(3, n) WHEN e6 >= 3 THEN least(6, n) ELSE n END AS pool_size, en < 3 AS capacity_failure FROM z),
  progressive AS (SELECT j.*, pool_size, pool_size > least(3, n) AS expanded, capacity_failure FROM judged j JOIN z2 ON j.query_id = z2.query_id WHERE pool_rank <= pool_size)"""
_CHECKPOINTS = """ck AS (SELECT arm, client_id AS round, prompt_tokens AS step, gold AS epoch, 'ck-' || CAST(record_id AS VARCHAR) AS name, likelihood_confidence AS loss, generated_at AS mtime, gold > 0 AS is_step, predicted = 3 AS protected FROM records WHERE client_id IS NOT NULL)"""
_BATCHES = "b AS (SELECT record_id % 50 AS batch, record_id // 50 AS pos, prompt_tokens AS n_tokens, greatest(0, prompt_tokens - 200) AS supervised FROM records)"


def _prior_sql():
    from tessera.plans import catalog_eval

    return catalog_eval._PRIOR.replace("WHERE split = 'validation'", "WHERE split = 'validation' AND subject IS NOT NULL")


def _rerank_sql(beta, weighted, name="r"):
    """Five unrolled greedy steps; each drops the chosen row and raises the redundancy of the rest."""
    base = f"relevance + coalesce((SELECT weight FROM prior w WHERE w.client_id = pool.client_id AND w.subject = pool.subject), 0.0) * {weighted}" if weighted else "relevance"
    parts = [f"{name}c0 AS (SELECT query_id, vec_id, pool_rank, vector, {base} AS base, 0.0::DOUBLE AS red FROM pool)"]
    for k in range(1, 6):
        parts.append(f"{name}p{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY base - red * {beta} DESC, pool_rank, vec_id) AS rn FROM {name}c{k - 1}) WHERE rn = 1)")
        parts.append(f"{name}c{k} AS (SELECT c.query_id, c.vec_id, c.pool_rank, c.vector, c.base, greatest(c.red, list_dot_product(c.vector, p.vector)) AS red FROM {name}c{k - 1} c JOIN {name}p{k} p ON c.query_id = p.query_id AND c.vec_id <> p.vec_id)")
    union = " UNION ALL ".join(f"SELECT query_id, {k} AS position, vec_id FROM {name}p{k}" for k in range(1, 6))
    return ", ".join(parts) + f", {name} AS ({union})"


def oracle_sql():
    prior = f"{sql.RECORDS}, {_prior_sql()}"
    full = f"WITH {prior}, {POOL}, {_rerank_sql(0.15, 0.2)}"
    part = lambda a: f"CAST(CAST(sum(CAST('0x' || substr(m, {a}, 8) AS BIGINT)) AS BIGINT) AS VARCHAR)"
    role_hash = "CAST('0x' || substr(md5('20260901:role:' || example_id), 1, 8) AS BIGINT)"
    dev_hash = "CAST('0x' || substr(md5('20260901:dev:' || example_id), 1, 8) AS BIGINT)"
    return {
        "clean_pool": f"WITH {POOL} SELECT query_id, vec_id, example_id, subject, pool_rank, round(relevance, 6) AS relevance, round(list_dot_product(vector, vector), 6) AS norm2 FROM pool",
        "topk_relevance": f"WITH {POOL} SELECT * FROM (SELECT query_id, vec_id AS support_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round_even(relevance, 6) DESC, vec_id) AS INTEGER) AS pool_rank FROM pool) WHERE pool_rank <= 5",
        "client_score_top": """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, s.vec_id AS support_id, list_dot_product(q.v, s.v) AS r FROM e q JOIN e s ON q.vec_id % 3 = s.vec_id % 3 AND q.vec_id % 5 = 0 AND s.vec_id % 5 <> 0)
            SELECT query_id, support_id, pool_rank, round(r, 5) AS relevance FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round_even(r, 6) DESC, support_id) AS INTEGER) AS pool_rank FROM s) WHERE pool_rank <= 5""",
        "eligibility_reasons": f"WITH {sql.KEYED}, {_JUDGED} SELECT query_id, support_id, pool_rank, reason FROM judged",
        "progressive_pool": f"WITH {sql.KEYED}, {_PROGRESSIVE} SELECT query_id, support_id, pool_rank, pool_size, expanded, capacity_failure FROM progressive WHERE reason IS NULL",
        "pool_diagnostics": f"WITH {sql.KEYED}, {_PROGRESSIVE} SELECT query_id, max(pool_size) AS searched, count(*) FILTER (WHERE reason IS NULL) AS eligible, bool_or(expanded) AS expanded, bool_or(capacity_failure) AS capacity_failure FROM progressive GROUP BY 1",
        "pool_exclusions": f"WITH {sql.KEYED}, {_PROGRESSIVE} SELECT reason, count(*) AS n_rows FROM progressive WHERE reason IS NOT NULL GROUP BY 1",
        "rerank_relevance": f"WITH {POOL} SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY pool_rank, vec_id) AS INTEGER) AS position, vec_id, example_id FROM pool) WHERE position <= 5",
        "rerank_diversity": f"WITH {POOL}, {_rerank_sql(0.15, 0)} SELECT query_id, CAST(position AS INTEGER) AS position, vec_id FROM r",
        "rerank_prior": f"WITH {prior}, {POOL}, {_rerank_sql(0.0, 0.2)} SELECT query_id, CAST(position AS INTEGER) AS position, vec_id FROM r",
        "rerank_full": f"{full} SELECT query_id, CAST(position AS INTEGER) AS position, vec_id FROM r",
        "rerank_placebo": f"""WITH {prior.replace("prior AS (", "prior0 AS (")}, r0 AS (SELECT client_id, subject, weight, row_number() OVER (PARTITION BY client_id ORDER BY subject) AS pos, row_number() OVER (PARTITION BY client_id ORDER BY md5('7:' || CAST(client_id AS VARCHAR) || ':' || subject), subject) AS to_ FROM prior0),
            m0 AS (SELECT a.client_id, a.subject, a.pos, a.weight AS old, b.weight AS new FROM r0 a JOIN r0 b ON a.client_id = b.client_id AND a.pos = b.to_),
            prior AS (SELECT client_id, subject, CASE WHEN min(CAST(old = new AS INTEGER)) OVER (PARTITION BY client_id) = 1 THEN coalesce(lead(old) OVER (PARTITION BY client_id ORDER BY pos), first_value(old) OVER (PARTITION BY client_id ORDER BY pos)) ELSE new END AS weight FROM m0),
            {POOL}, {_rerank_sql(0.15, 0.2)} SELECT query_id, CAST(position AS INTEGER) AS position, vec_id FROM r""",
        "rerank_activity": f"""{full}, {_rerank_sql(0.15, 0, "n")}, plain AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY pool_rank, vec_id) AS position FROM pool),
            l AS (SELECT query_id, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY position) AS c FROM r GROUP BY 1), ln AS (SELECT query_id, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY position) AS w FROM n GROUP BY 1), lp AS (SELECT query_id, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY position) AS p FROM plain WHERE position <= 5 GROUP BY 1),
            v AS (SELECT query_id, max(coalesce(weight, 0)) > min(coalesce(weight, 0)) AS varying FROM pool LEFT JOIN prior ON pool.client_id = prior.client_id AND pool.subject = prior.subject GROUP BY 1)
            SELECT count(*) AS queries, count(*) FILTER (WHERE c <> p) AS changed_from_top, count(*) FILTER (WHERE c <> w) AS changed_by_prior, count(*) FILTER (WHERE varying) AS varying_prior FROM l JOIN ln ON l.query_id = ln.query_id JOIN lp ON l.query_id = lp.query_id JOIN v ON l.query_id = v.query_id""",
        "prompt_build": f'WITH {sql.ITEMS}, {_PROMPTS} SELECT query_id, n_exemplars, md5("user") AS user_md5, CAST(length("user") AS INTEGER) AS n_chars FROM prompts',
        "prompt_budget": f'WITH {sql.ITEMS}, {_PROMPTS} SELECT query_id, CAST(({_LEN} + length("user")) // 4 AS INTEGER) AS tokens FROM prompts WHERE ({_LEN} + length("user")) // 4 + 64 > 640',
        "worst_case_prompt": f"""WITH {sql.ITEMS}, {POOL}, r AS (SELECT p.query_id, p.example_id, CAST(length({_DEMO}) AS INTEGER) AS len, row_number() OVER (PARTITION BY p.query_id ORDER BY length({_DEMO}) DESC, pool_rank DESC, vec_id DESC) AS r FROM pool p JOIN items i ON p.example_id = i.example_id)
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY r DESC) AS INTEGER) AS position, example_id, len FROM r WHERE r <= 5""",
        "training_completions": f"WITH {sql.ITEMS} SELECT example_id, ' ' || options[label + 1] || chr(10) || 'Final answer: ' || chr(65 + label) AS completion FROM items",
        "training_plan": f"""WITH {sql.ITEMS}, {_PROMPTS}, c AS (SELECT p.query_id, n_exemplars, (greatest(length(options[1]), length(options[2]), length(options[3]), length(options[4])) + 17) // 4 + 1 AS c, ({_LEN} + length('Now answer this item:' || chr(10) || b || chr(10) || 'Answer:')) // 4 AS bare, ({_LEN} + length("user")) // 4 AS f
            FROM prompts p JOIN (SELECT example_id, {_BLOCK} AS b FROM items) i ON p.query_id = i.example_id), t AS (SELECT query_id, n_exemplars, CAST(ceil((bare + c) / 8.0) * 8 AS INTEGER) AS tokens_k0, CAST(ceil((f + c) / 8.0) * 8 AS INTEGER) AS tokens_kn FROM c)
            SELECT query_id, tokens_k0, tokens_kn, CASE WHEN n_exemplars < 5 THEN 'capacity' WHEN greatest(tokens_k0, tokens_kn) > 600 THEN 'context_budget' END AS reason FROM t""",
        "plan_issues": f"""WITH {sql.ASSIGNED}, {POOL}, c AS (SELECT * FROM (SELECT query_id, client_id, example_id, row_number() OVER (PARTITION BY query_id ORDER BY pool_rank, vec_id) AS rn FROM pool) WHERE rn <= 5), f AS (SELECT DISTINCT example_id AS query_id FROM assigned WHERE role = 'validation')
            SELECT query_id, 'wrong_number' AS rule FROM c GROUP BY 1 HAVING count(DISTINCT example_id) <> 5 UNION ALL SELECT DISTINCT query_id, 'own_row' FROM c WHERE query_id = example_id
            UNION ALL SELECT DISTINCT query_id, 'not_in_support' FROM c WHERE NOT EXISTS (SELECT 1 FROM assigned a WHERE a.role = 'support' AND a.client_id = c.client_id AND a.example_id = c.example_id)
            UNION ALL SELECT DISTINCT query_id, 'also_excluded' FROM c WHERE query_id IN (SELECT query_id FROM f WHERE query_id < '1') UNION ALL SELECT query_id, 'not_covered' FROM f WHERE query_id >= '1' AND query_id NOT IN (SELECT query_id FROM c)
            UNION ALL SELECT DISTINCT query_id, 'not_fit' FROM c WHERE query_id NOT IN (SELECT query_id FROM f)""",
        "development_holdout": f"""WITH {sql.ITEMS}, r AS (SELECT example_id, subject, row_number() OVER w AS r, count(*) OVER (PARTITION BY subject) AS n FROM items WHERE split = 'train' AND subject IS NOT NULL WINDOW w AS (PARTITION BY subject ORDER BY {dev_hash}, example_id))
            SELECT example_id, subject, CASE WHEN r <= greatest(least(1, n - 1), least(n - 1, round_even(n * 0.1, 0))) THEN 'validation' ELSE 'train' END AS split FROM r""",
        "support_roles": f"""WITH {sql.ASSIGNED}, r AS (SELECT example_id, client_id, row_number() OVER (PARTITION BY client_id ORDER BY {role_hash}, example_id) AS r, count(*) OVER (PARTITION BY client_id) AS n FROM assigned WHERE original_split = 'train')
            SELECT example_id, client_id, 'train' AS original_split, CASE WHEN r <= least(greatest(5, round_even(n * (1.0::DOUBLE - 0.8::DOUBLE), 0)), n - 1) THEN 'support' ELSE 'fit' END AS role FROM r UNION ALL SELECT example_id, client_id, original_split, original_split FROM assigned WHERE original_split <> 'train'""",
        "partition_manifest": f"WITH {sql.ASSIGNED} SELECT client_id, role, count(*) AS n_rows, CAST(sum(CAST('0x' || substr(md5(example_id), 1, 8) AS BIGINT)) AS BIGINT) AS checksum FROM assigned GROUP BY 1, 2",
        "client_seeds": f"WITH {sql.ASSIGNED} SELECT DISTINCT client_id, 42006000 + client_id AS seed FROM assigned",
        "split_identity": f"WITH {sql.KEYED}, h AS (SELECT split, md5(example_id || ':' || qh) AS m FROM keyed) SELECT split, count(*) AS n_rows, md5({part(1)} || '-' || {part(9)} || '-' || {part(17)} || '-' || {part(25)}) AS identity FROM h GROUP BY 1",
        "fit_overlap": f"WITH {sql.KEYED}, a AS (SELECT DISTINCT k.example_id, k.qh, x.role FROM keyed k JOIN assignments x ON k.example_id = x.example_id WHERE x.client_id IS NOT NULL) SELECT DISTINCT f.example_id FROM a f JOIN a v ON f.role = 'fit' AND v.role = 'validation' AND (f.example_id = v.example_id OR f.qh = v.qh)",
        "weighted_vector_mean": "SELECT part, CAST(i - 1 AS INTEGER) AS pos, round(sum(x * weight) / sum(weight), 6) AS value FROM (SELECT label % 2 AS part, label + 1 AS weight, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY 1, 2",
        "communication": "SELECT CAST(sum(len(embedding)) * 4 AS BIGINT) AS bytes_up, CAST(max(len(embedding)) * 20 AS BIGINT) AS bytes_down FROM embeddings",
        "token_weighted_loss": f"WITH {sql.RECORDS} SELECT arm, round(sum((1 - likelihood_confidence) * prompt_tokens) / sum(prompt_tokens), 6) AS loss, CAST(sum(prompt_tokens) AS BIGINT) AS tokens FROM records WHERE likelihood_confidence IS NOT NULL GROUP BY 1",
        "pad_width": f"WITH {sql.RECORDS}, {_BATCHES} SELECT batch, CAST(ceil(max(n_tokens) / 8.0) * 8 AS BIGINT) AS width FROM b GROUP BY 1",
        "chunk_weights": f"WITH {sql.RECORDS}, {_BATCHES}, c AS (SELECT batch, pos // 4 AS chunk, sum(supervised) AS t FROM b GROUP BY 1, 2) SELECT batch, chunk, round(CAST(t AS DOUBLE) / w, 6) AS weight FROM (SELECT *, sum(t) OVER (PARTITION BY batch) AS w FROM c) WHERE t > 0",
        "accumulation_groups": f"WITH {sql.RECORDS}, {_BATCHES}, g AS (SELECT DISTINCT 1 AS epoch, batch, batch // 8 AS step FROM b) SELECT epoch, batch, step, count(*) OVER w AS group_size, batch = max(batch) OVER w AS is_step FROM g WINDOW w AS (PARTITION BY epoch, step)",
        "label_mask": f"WITH {sql.RECORDS} SELECT record_id, repeat('-100,', gold + 1) || CAST(prompt_tokens AS VARCHAR) || ',0' AS labels FROM records",
        "best_checkpoint": f"WITH {sql.RECORDS}, {_CHECKPOINTS} SELECT arm, name, round(loss, 6) AS loss FROM (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY loss, round, step, epoch, name) AS rn FROM ck WHERE loss IS NOT NULL AND round > 0) WHERE rn = 1",
        "latest_checkpoint": f"WITH {sql.RECORDS}, {_CHECKPOINTS} SELECT arm, name FROM (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY round DESC, epoch DESC, step DESC, mtime DESC, name DESC) AS rn FROM ck) WHERE rn = 1",
        "prunable_checkpoints": f"WITH {sql.RECORDS}, {_CHECKPOINTS} SELECT arm, name FROM (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY mtime DESC, name) AS rn FROM ck WHERE protected IS NOT NULL AND is_step AND NOT protected) WHERE rn > 3",
        "select_round": f"WITH {sql.RECORDS}, s AS (SELECT client_id % 9 AS round, seed, avg(CAST(coalesce(predicted = gold, false) AS DOUBLE)) AS a FROM records WHERE seed IS NOT NULL GROUP BY 1, 2), m AS (SELECT round, round(avg(a), 9) AS a FROM s GROUP BY 1) SELECT round, round(a, 6) AS accuracy FROM m ORDER BY a DESC, round LIMIT 1",
        "throughput": f"WITH {sql.RECORDS} SELECT arm, round(CAST(sum(prompt_tokens) AS DOUBLE) / sum((gold + 1) * 2), 6) AS exposures_per_s FROM records GROUP BY 1",
        "last_summaries": f"WITH {sql.RECORDS} SELECT arm, seed, likelihood_confidence AS accuracy, folder FROM (SELECT arm, seed, likelihood_confidence, split || '-' || CAST(record_id AS VARCHAR) AS folder, row_number() OVER (PARTITION BY arm, seed ORDER BY split || '-' || CAST(record_id AS VARCHAR) DESC) AS rn FROM records WHERE likelihood_confidence IS NOT NULL) WHERE rn = 1",
    }
