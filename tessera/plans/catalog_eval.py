"""Queries on evaluation records: metrics, priors, contrasts, matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.models import bag_of_hashes
from tessera.operators import assigned as A
from tessera.operators import contrasts, matching, metrics, priors, statistics
from tessera.plans import sql
from tessera.sources import items as I
from tessera.sources.tables import table


def records(s, d):
    """Latest delivery of each record."""
    return I.latest(table(s, d, "evaluation_records"), "record_id", "recorded_at")


def _test(s, d):
    return records(s, d).where("split = 'test'")


def _pairs(s, d):
    p = A.paired_predictions(table(s, d, "events"))
    return p.where("arm = 'left'"), p.where("arm = 'right'")


def _differences(s, d):
    left, right = _pairs(s, d)
    return statistics.paired_differences(left, right, ["seed", "subject", "example_id"])


def _priors(s, d):
    return priors.weakness(records(s, d).where("split = 'validation'"))


def queries():
    return {
        "accuracy": lambda s, d: metrics.accuracy(records(s, d), "arm", "split"),
        "accuracy_by_client": lambda s, d: metrics.accuracy(records(s, d), "arm", "client_id"),
        "accuracy_by_subject": lambda s, d: metrics.accuracy(records(s, d), "arm", "subject"),
        "macro_f1": lambda s, d: metrics.macro_f1(records(s, d), "arm", "split"),
        "stage_rates": lambda s, d: metrics.stage_rates(records(s, d), "arm"),
        "eval_summary": lambda s, d: metrics.summary_cube(_test(s, d)),
        "client_spread": lambda s, d: metrics.client_spread(records(s, d), "arm"),
        "calibration_error": lambda s, d: metrics.expected_calibration_error(records(s, d), "arm"),
        "calibration_bins": lambda s, d: metrics.calibration_bins(records(s, d), "arm").select("arm", "bin", "n_records", F.round("accuracy", 6).alias("accuracy"), F.round("confidence", 6).alias("confidence")),
        "agreement_matrix": lambda s, d: metrics.agreement_matrix(records(s, d), "arm"),
        "evaluator_agreement": lambda s, d: metrics.evaluator_agreement(records(s, d), "arm"),
        "likelihood_choice": lambda s, d: records(s, d).where(F.size("likelihood_probabilities") == 4).select("record_id", matching.softmax_choice(F.col("likelihood_probabilities")).alias("c")).select("record_id", F.col("c.label").alias("label"), F.round("c.confidence", 6).alias("confidence")),
        "token_percentiles": lambda s, d: metrics.token_percentiles(records(s, d), "arm"),
        "token_nearest_rank": lambda s, d: metrics.nearest_rank(records(s, d), "arm"),
        "over_budget": lambda s, d: records(s, d).where(F.col("prompt_tokens") + 64 > 1400).select("record_id", "prompt_tokens"),
        "exemplar_usage": lambda s, d: metrics.exemplar_usage(records(s, d)),
        "arm_comparison": lambda s, d: metrics.arm_comparison(_test(s, d)),
        "comparison_table": lambda s, d: metrics.comparison_table(metrics.arm_comparison(_test(s, d))),
        "likelihood_view": lambda s, d: metrics.accuracy(records(s, d).select("arm", F.col("likelihood_predicted").alias("predicted"), "gold"), "arm"),
        "cohort_mismatches": lambda s, d: metrics.cohort_mismatches(records(s, d).groupBy("example_id").agg(F.max("gold").alias("label")), I.items(table(s, d, "examples")).select("example_id", "label"), "example_id", ["label"]),
        "match_answers": lambda s, d: matching.match(records(s, d), I.items(table(s, d, "examples")), "portable"),
        "match_stage_counts": lambda s, d: matching.match(records(s, d), I.items(table(s, d, "examples")), "portable").groupBy("match_stage").agg(F.count("*").alias("n_records")),
        "loco_minmax_prior": lambda s, d: _priors(s, d),
        "loco_beta_prior": lambda s, d: _beta(s, d),
        "match_semantic": lambda s, d: matching.match(records(s, d), I.items(table(s, d, "examples")), "portable", encode=bag_of_hashes, threshold=0.3, margin=0.02),
        "prior_variation": lambda s, d: priors.variation_issues(_beta(s, d)),
        "placebo_prior": lambda s, d: priors.shuffled(_priors(s, d), seed=7),
        "paired_effect": lambda s, d: statistics.effects(_differences(s, d), "subject", "seed"),
        "pairing_issues": lambda s, d: statistics.pairing_issues(_arm(s, d, "B0"), _arm(s, d, "B1"), ["split", "example_id"], ["gold", "client_id", "subject"]),
        "hash_bootstrap": lambda s, d: statistics.interval(statistics.item_draws(_differences(s, d), "subject", "seed", samples=50, seed=3), "subject", "seed"),
        "bootstrap_fast": lambda s, d: statistics.interval(statistics.fast_draws(_differences(s, d), "subject", samples=10_000), "subject"),
        "bootstrap_hierarchical": lambda s, d: statistics.interval(statistics.hierarchical_draws(_differences(s, d), "subject", samples=10_000), "subject"),
        "holm": lambda s, d: statistics.holm(statistics.effects(_differences(s, d), "subject", "seed").select(F.concat_ws("-", "subject", "seed").alias("name"), F.round(F.abs("effect") / 3, 6).alias("p_value"))),
        "contrast_effects": lambda s, d: contrasts.seed_effects(_contrast_rows(s, d), contrasts.selected(s)),
        "contrast_report": lambda s, d: contrasts.report(_contrast_rows(s, d), contrasts.selected(s), samples=10_000),
    }


def _arm(s, d, arm):
    """All deliveries of an arm's records, repeated ones too."""
    return table(s, d, "evaluation_records").where(F.col("arm") == arm)


def _beta(s, d):
    support = A.assigned(I.items(table(s, d, "examples")), table(s, d, "assignments")).where("role = 'support'")
    return priors.controlled_weakness(records(s, d).where("split = 'validation'"), support, min_count=10)


def _contrast_rows(s, d):
    """The two paired arms under names of the declared contrasts; B0 and B1 have no training seed."""
    p = A.paired_predictions(table(s, d, "events"))
    name = F.when(F.col("arm") == "left", F.array(F.lit("B0"), F.lit("L0"), F.lit("F0"))).otherwise(F.array(F.lit("B1"), F.lit("L1"), F.lit("F1")))
    rows = p.withColumn("arm", F.explode(name))
    return rows.withColumn("seed", F.when(~F.col("arm").isin("B0", "B1"), F.col("seed")))


_C = "coalesce(predicted = gold, false)"
_L = "coalesce(likelihood_predicted = gold, false)"
_EXACT = "coalesce(stage IN ('terminal_label', 'exact_option'), false)"


def _avg(x):
    return f"round(avg(CAST({x} AS DOUBLE)), 6)"


def _acc(keys, where="true", predicted="predicted"):
    return f"WITH {sql.RECORDS} SELECT {keys}, count(*) AS n_records, {_avg(f'coalesce({predicted} = gold, false)')} AS accuracy FROM records WHERE {where} GROUP BY {keys}"


_BIN = "CASE " + " ".join(f"WHEN likelihood_confidence >= CAST({i} AS DOUBLE) / 10 AND likelihood_confidence {'<=' if i == 9 else '<'} CAST({i + 1} AS DOUBLE) / 10 THEN {i}" for i in range(10)) + " ELSE -1 END"
_BINS = f"""bins AS (SELECT arm, {_BIN} AS bin, count(*) AS n_records, CAST(count(*) FILTER (WHERE {_L}) AS DOUBLE) / count(*) AS accuracy, CAST(sum(CAST(likelihood_confidence AS DECIMAL(20,12))) AS DOUBLE) / count(*) AS confidence
  FROM records WHERE likelihood_confidence IS NOT NULL AND likelihood_predicted IS NOT NULL GROUP BY 1, 2)"""
_COUNTS = f"c AS (SELECT client_id, subject, count(*) AS n, sum(CAST({_C} AS INTEGER)) AS c FROM records WHERE split = 'validation' GROUP BY 1, 2)"
_PRIOR = f"""{_COUNTS}, g AS (SELECT k.client_id, t.subject, t.tn - coalesce(c.n, 0) AS n, t.tc - coalesce(c.c, 0) AS c FROM (SELECT DISTINCT client_id FROM c) k CROSS JOIN (SELECT subject, sum(n) AS tn, sum(c) AS tc FROM c GROUP BY 1) t
    LEFT JOIN c ON c.client_id = k.client_id AND c.subject IS NOT DISTINCT FROM t.subject),
  e AS (SELECT client_id, subject, CASE WHEN n > 0 THEN 1 - CAST(c AS DOUBLE) / n ELSE 0.0 END AS e FROM g),
  prior AS (SELECT client_id, subject, round(CASE WHEN max(e) OVER w > min(e) OVER w THEN (e - min(e) OVER w) / (max(e) OVER w - min(e) OVER w) ELSE 0.0 END, 6) AS weight FROM e WINDOW w AS (PARTITION BY client_id))"""
_D = f"""{sql.PREDICTIONS}, d AS (SELECT a.seed, a.subject, a.example_id, CAST(coalesce(b.predicted = b.gold, false) AS INTEGER) - CAST(coalesce(a.predicted = a.gold, false) AS INTEGER) AS d
  FROM predictions a JOIN predictions b ON a.example_id = b.example_id AND a.arm = 'left' AND b.arm = 'right')"""

_BETA = f"""WITH {sql.RECORDS}, {sql.ASSIGNED}, {_COUNTS}, w AS (SELECT DISTINCT client_id, subject FROM assigned WHERE role = 'support'), t AS (SELECT subject, sum(n) AS tn, sum(c) AS tc FROM c GROUP BY 1),
            j AS (SELECT w.client_id, w.subject, coalesce(t.tn, 0) - coalesce(c.n, 0) AS n, coalesce(t.tc, 0) - coalesce(c.c, 0) AS k FROM w LEFT JOIN t ON w.subject = t.subject LEFT JOIN c ON c.client_id = w.client_id AND c.subject = w.subject)
            SELECT client_id, subject, CAST(n AS BIGINT) AS n_other, CASE WHEN n >= 10 THEN round(CAST(n - k + 1 AS DOUBLE) / (n + 2), 6) END AS weight FROM j"""


def oracle_sql():
    n = sql.norm
    match = f"""WITH {sql.ITEMS}, {sql.RECORDS}, r AS (SELECT r.record_id, upper(regexp_extract(generated_text, '(?i)Final\\s+answer\\s*:\\s*([A-D])\\s*[.)]?\\s*$', 1)) AS t, {n('generated_text')} AS n, generated_text, i.options FROM records r LEFT JOIN items i ON r.example_id = i.example_id),
        m AS (SELECT record_id, CASE WHEN t <> '' THEN ascii(t) - 65 END AS t, list_filter([CASE WHEN {n('options[1]')} = n THEN 0 END, CASE WHEN {n('options[2]')} = n THEN 1 END, CASE WHEN {n('options[3]')} = n THEN 2 END, CASE WHEN {n('options[4]')} = n THEN 3 END], lambda x: x IS NOT NULL) AS x FROM r),
        matched AS (SELECT record_id, CAST(coalesce(t, CASE WHEN len(x) = 1 THEN x[1] END) AS INTEGER) AS label, CASE WHEN t IS NOT NULL THEN 'terminal_label' WHEN len(x) = 1 THEN 'exact_option' ELSE 'unresolved' END AS match_stage FROM m)"""
    f1 = " + ".join(f"coalesce(2.0 * count(*) FILTER (WHERE predicted = {k} AND gold = {k}) / nullif(count(*) FILTER (WHERE predicted = {k}) + count(*) FILTER (WHERE gold = {k}), 0), 0)" for k in range(4))
    per_bin = f"SELECT arm, coalesce(seed, -1) AS s, {_BIN} AS bin, count(*) AS n, CAST(count(*) FILTER (WHERE {_L}) AS DOUBLE) / count(*) AS a, CAST(sum(CAST(likelihood_confidence AS DECIMAL(20,12))) AS DOUBLE) / count(*) AS c FROM records WHERE split = 'test' AND likelihood_confidence IS NOT NULL AND likelihood_predicted IS NOT NULL GROUP BY 1, 2, 3"
    runs = f"""e AS (SELECT arm, s, round(sum(CASE WHEN bin >= 0 THEN n * abs(a - c) ELSE 0 END) / sum(n), 6) AS ece FROM ({per_bin}) GROUP BY 1, 2),
        runs AS (SELECT r.*, e.ece FROM (SELECT arm, coalesce(seed, -1) AS s, avg(CAST({_C} AS DOUBLE)) AS pipeline_accuracy, round(({f1}) / 4, 6) AS macro_f1, avg(CAST({_EXACT} AS DOUBLE)) AS exact_match_coverage, avg(CAST(coalesce(stage = 'semantic_option', false) AS DOUBLE)) AS semantic_fallback_rate, avg(CAST({_L} AS DOUBLE)) AS likelihood_accuracy FROM records WHERE split = 'test' GROUP BY 1, 2) r LEFT JOIN e ON r.arm = e.arm AND r.s = e.s),
        comparison AS (SELECT arm, metric, count(x) AS runs, round(avg(x), 6) AS mean, round(coalesce(stddev_samp(x), 0), 6) AS std FROM ({" UNION ALL ".join(f"SELECT arm, '{m}' AS metric, {m} AS x FROM runs" for m in metrics.METRICS)}) GROUP BY 1, 2)"""
    slice_ = lambda name, col, where="true": f"SELECT arm, '{name}' AS slice, CAST({col} AS VARCHAR) AS value, count(*) AS n_records, {_avg(_C)} AS accuracy FROM records WHERE split = 'test' AND {where} GROUP BY 1, 2, 3"
    draws = f"""{_D}, s AS (SELECT subject, seed, d, CAST(row_number() OVER (PARTITION BY subject, seed ORDER BY md5('item:' || CAST(seed AS VARCHAR) || ':' || subject || ':' || CAST(example_id AS VARCHAR)), seed, subject, example_id) AS BIGINT) - 1 AS pos, count(*) OVER (PARTITION BY subject, seed) AS n FROM d),
        c AS (SELECT subject, seed, k AS draw, CAST(floor(CAST(CAST('0x' || substr(md5('3:' || subject || ':' || CAST(seed AS VARCHAR) || ':' || CAST(k AS VARCHAR) || ':' || CAST(pos AS VARCHAR)), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 * n) AS BIGINT) AS pos FROM s CROSS JOIN (SELECT unnest(range(50)) AS k)),
        x AS (SELECT c.subject, c.seed, draw, avg(s.d) AS x FROM c JOIN s ON c.pos = s.pos AND c.subject = s.subject AND c.seed = s.seed GROUP BY 1, 2, 3)"""
    return {
        "accuracy": _acc("arm, split"),
        "accuracy_by_client": _acc("arm, client_id"),
        "accuracy_by_subject": _acc("arm, subject"),
        "macro_f1": f"WITH {sql.RECORDS} SELECT arm, split, round(({f1}) / 4, 6) AS macro_f1 FROM records GROUP BY 1, 2",
        "stage_rates": f"WITH {sql.RECORDS} SELECT arm, count(*) AS n_records, {_avg(_EXACT)} AS exact_match_coverage, {_avg('coalesce(stage = $$semantic_option$$, false)')} AS semantic_fallback_rate, {_avg('predicted IS NULL')} AS unresolved_rate FROM records GROUP BY 1".replace("$$", "'"),
        "eval_summary": f"WITH {sql.RECORDS} SELECT arm, 'all' AS slice, NULL AS value, count(*) AS n_records, {_avg(_C)} AS accuracy FROM records WHERE split = 'test' GROUP BY 1 UNION ALL " + " UNION ALL ".join([slice_("client", "client_id"), slice_("subject", "subject"), slice_("gold", "gold"), slice_("predicted", "predicted", "predicted IS NOT NULL")]),
        "client_spread": f"WITH {sql.RECORDS}, p AS (SELECT arm, client_id, avg(CAST({_C} AS DOUBLE)) AS a FROM records GROUP BY 1, 2) SELECT arm, count(*) AS n_clients, round(avg(a), 6) AS mean_client_accuracy, round(min(a), 6) AS min_client_accuracy FROM p GROUP BY 1",
        "calibration_error": f"WITH {sql.RECORDS}, {_BINS} SELECT arm, CAST(sum(n_records) AS BIGINT) AS n_records, round(sum(CASE WHEN bin >= 0 THEN n_records * abs(accuracy - confidence) ELSE 0 END) / sum(n_records), 6) AS ece FROM bins GROUP BY 1",
        "calibration_bins": f"WITH {sql.RECORDS}, {_BINS} SELECT arm, bin, n_records, round(accuracy, 6) AS accuracy, round(confidence, 6) AS confidence FROM bins",
        "agreement_matrix": f"WITH {sql.RECORDS} SELECT arm, count(*) FILTER (WHERE {_C} AND {_L}) AS both, count(*) FILTER (WHERE {_C} AND NOT {_L}) AS pipeline_only, count(*) FILTER (WHERE NOT {_C} AND {_L}) AS likelihood_only, count(*) FILTER (WHERE NOT {_C} AND NOT {_L}) AS neither FROM records GROUP BY 1",
        "evaluator_agreement": f"WITH {sql.RECORDS} SELECT arm, {_avg(_L)} AS likelihood_accuracy, {_avg('predicted IS NOT DISTINCT FROM likelihood_predicted')} AS agreement, {_avg('predicted IS DISTINCT FROM likelihood_predicted')} AS disagreement FROM records GROUP BY 1",
        "likelihood_choice": f"""WITH {sql.RECORDS} SELECT record_id, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS label, round(1 / (exp(p[1] - list_max(p)) + exp(p[2] - list_max(p)) + exp(p[3] - list_max(p)) + exp(p[4] - list_max(p))), 6) AS confidence
            FROM (SELECT record_id, likelihood_probabilities AS p FROM records WHERE len(likelihood_probabilities) = 4)""",
        "token_percentiles": f"WITH {sql.RECORDS} SELECT arm, round(quantile_cont(prompt_tokens, 0.5), 6) AS p50, round(quantile_cont(prompt_tokens, 0.95), 6) AS p95, max(prompt_tokens) AS max_tokens FROM records GROUP BY 1",
        "token_nearest_rank": f"WITH {sql.RECORDS}, l AS (SELECT arm, list_sort(list(prompt_tokens)) AS t FROM records WHERE prompt_tokens IS NOT NULL GROUP BY 1) SELECT arm, t[len(t) // 2 + 1] AS median_tokens, t[CAST(floor(len(t) * 0.95) AS INTEGER) + 1] AS p95_tokens, t[len(t)] AS max_tokens FROM l",
        "over_budget": f"WITH {sql.RECORDS} SELECT record_id, prompt_tokens FROM records WHERE prompt_tokens + 64 > 1400",
        "exemplar_usage": f"WITH {sql.RECORDS} SELECT arm, exemplar_id, count(*) AS n_shown FROM (SELECT arm, unnest(exemplar_ids) AS exemplar_id FROM records) GROUP BY 1, 2",
        "arm_comparison": f"WITH {sql.RECORDS}, {runs} SELECT * FROM comparison",
        "comparison_table": f"""WITH {sql.RECORDS}, {runs}, cell AS (SELECT *, CASE WHEN runs > 1 THEN printf('%.4f ± %.4f', mean, std) WHEN runs = 1 THEN printf('%.4f', mean) END AS cell FROM comparison),
            w AS (SELECT arm, max(mean) FILTER (WHERE metric = 'pipeline_accuracy') AS score, {", ".join(f"coalesce(max(cell) FILTER (WHERE metric = '{m}'), '-') AS {m}" for m in metrics.METRICS)} FROM cell GROUP BY 1)
            SELECT CAST(row_number() OVER (ORDER BY score DESC NULLS LAST, arm) AS INTEGER) AS position, '| ' || arm || ' | ' || {" || ' | ' || ".join(metrics.METRICS)} || ' |' AS line FROM w""",
        "likelihood_view": _acc("arm", predicted="likelihood_predicted"),
        "cohort_mismatches": f"""WITH {sql.RECORDS}, {sql.ITEMS}, a AS (SELECT example_id, max(gold) AS label FROM records GROUP BY 1) SELECT coalesce(a.example_id, i.example_id) AS example_id, CASE WHEN i.example_id IS NULL THEN 'missing_right' WHEN a.example_id IS NULL THEN 'missing_left' ELSE 'different' END AS problem
            FROM a FULL JOIN items i ON a.example_id = i.example_id WHERE i.example_id IS NULL OR a.example_id IS NULL OR a.label IS DISTINCT FROM i.label""",
        "match_answers": match + " SELECT * FROM matched",
        "match_stage_counts": match + " SELECT match_stage, count(*) AS n_records FROM matched GROUP BY 1",
        "match_semantic": match
        + f""", w AS (SELECT record_id, 9 AS i, generated_text AS t FROM r WHERE options IS NOT NULL AND n <> '' UNION ALL SELECT record_id, i, options[i + 1] FROM r CROSS JOIN (SELECT unnest(range(4)) AS i) WHERE options IS NOT NULL AND n <> ''),
        v AS (SELECT record_id, i, list_transform(range(16), lambda b: CAST(len(list_filter(h, lambda x: x = b)) AS DOUBLE)) AS v FROM (SELECT record_id, i, list_transform(list_filter(regexp_split_to_array(lower(t), '\\s+'), lambda x: x <> ''), lambda x: CAST('0x' || right(sha256(x), 1) AS BIGINT)) AS h FROM w)),
        u AS (SELECT record_id, i, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS v FROM v),
        c AS (SELECT a.record_id, b.i, list_dot_product(b.v, a.v) AS s, row_number() OVER (PARTITION BY a.record_id ORDER BY list_dot_product(b.v, a.v) DESC, b.i) AS k FROM u a JOIN u b ON a.record_id = b.record_id AND a.i = 9 AND b.i < 9),
        z AS (SELECT record_id, max(i) FILTER (WHERE k = 1) AS i FROM c GROUP BY 1 HAVING max(s) FILTER (WHERE k = 1) >= 0.3 AND max(s) FILTER (WHERE k = 1) - max(s) FILTER (WHERE k = 2) >= 0.02)
        SELECT matched.record_id, CAST(CASE WHEN match_stage = 'unresolved' THEN z.i ELSE label END AS INTEGER) AS label, CASE WHEN match_stage = 'unresolved' AND z.i IS NOT NULL THEN 'semantic_option' ELSE match_stage END AS match_stage FROM matched LEFT JOIN z ON matched.record_id = z.record_id""",
        "loco_minmax_prior": f"WITH {sql.RECORDS}, {_PRIOR} SELECT * FROM prior",
        "loco_beta_prior": _BETA,

        "prior_variation": f"""SELECT client_id, CASE WHEN bad > 0 THEN 'out_of_range' WHEN n < 2 THEN 'one_subject' ELSE 'constant' END AS rule
            FROM (SELECT client_id, count(*) AS n, max(weight) - min(weight) AS r, count(*) FILTER (WHERE weight IS NULL OR weight NOT BETWEEN 0 AND 1) AS bad FROM ({_BETA}) GROUP BY 1) WHERE bad > 0 OR n < 2 OR r <= 1e-12""",
        "placebo_prior": f"""WITH {sql.RECORDS}, {_PRIOR}, r AS (SELECT client_id, subject, weight, row_number() OVER (PARTITION BY client_id ORDER BY subject) AS pos, row_number() OVER (PARTITION BY client_id ORDER BY md5('7:' || CAST(client_id AS VARCHAR) || ':' || subject), subject) AS to_ FROM prior),
            m AS (SELECT a.client_id, a.subject, a.pos, a.weight AS old, b.weight AS new FROM r a JOIN r b ON a.client_id = b.client_id AND a.pos = b.to_)
            SELECT client_id, subject, CASE WHEN min(CAST(old = new AS INTEGER)) OVER (PARTITION BY client_id) = 1 THEN coalesce(lead(old) OVER (PARTITION BY client_id ORDER BY pos), first_value(old) OVER (PARTITION BY client_id ORDER BY pos)) ELSE new END AS weight FROM m""",
        "paired_effect": f"WITH {_D} SELECT subject, seed, count(*) AS n_items, round(avg(d), 6) AS effect FROM d GROUP BY 1, 2",
        "pairing_issues": """WITH a AS (SELECT split, example_id, row(gold, client_id, subject) AS f FROM evaluation_records WHERE arm = 'B0'), b AS (SELECT split, example_id, row(gold, client_id, subject) AS f FROM evaluation_records WHERE arm = 'B1'),
            j AS (SELECT CASE WHEN b.example_id IS NULL THEN 'missing_right' WHEN a.example_id IS NULL THEN 'missing_left' WHEN a.f IS DISTINCT FROM b.f THEN 'inconsistent' END AS problem FROM a FULL JOIN b ON a.split = b.split AND a.example_id = b.example_id)
            SELECT problem, count(*) AS n FROM j WHERE problem IS NOT NULL GROUP BY 1
            UNION ALL SELECT 'duplicate_left', count(*) FROM (SELECT 1 FROM a GROUP BY split, example_id HAVING count(*) > 1) HAVING count(*) > 0 UNION ALL SELECT 'duplicate_right', count(*) FROM (SELECT 1 FROM b GROUP BY split, example_id HAVING count(*) > 1) HAVING count(*) > 0""",
        "hash_bootstrap": f"WITH {draws} SELECT subject, seed, round(quantile_cont(x, 0.025), 6) AS ci_low, round(quantile_cont(x, 0.975), 6) AS ci_high, round(least(1.0, 2 * least(avg(CAST(x <= 0 AS DOUBLE)), avg(CAST(x >= 0 AS DOUBLE)))), 6) AS p_value FROM x GROUP BY 1, 2",
        "holm": f"""WITH {_D}, t AS (SELECT subject || '-' || CAST(seed AS VARCHAR) AS name, round(abs(round(avg(d), 6)) / 3, 6) AS p_value FROM d GROUP BY subject, seed),
            c AS (SELECT name, p_value, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p_value, name) + 1) * p_value) AS c FROM t)
            SELECT name, p_value, round(max(c) OVER (ORDER BY p_value, name ROWS UNBOUNDED PRECEDING), 6) AS holm_adjusted FROM c""",
        "contrast_effects": f"""WITH {_D}, e AS (SELECT seed, avg(d) AS e, count(*) AS n FROM d GROUP BY 1)
            SELECT 'base_icl' AS name, 'primary' AS family, 'B0' AS left_arm, 'B1' AS right_arm, count(*) AS n_pairs, CAST(0 AS BIGINT) AS n_seeds, round(avg(d), 6) AS effect FROM d
            UNION ALL SELECT name, family, l, r, CAST(n AS BIGINT), CAST(k AS BIGINT), round(x, 6) FROM (SELECT sum(n) AS n, count(*) AS k, avg(e) AS x FROM e) CROSS JOIN (SELECT 'local_icl' AS name, 'primary' AS family, 'L0' AS l, 'L1' AS r UNION ALL SELECT 'fl_icl', 'primary', 'F0', 'F1')
            UNION ALL SELECT 'fl', 'primary', 'L0', 'F0', CAST(n AS BIGINT), CAST(k AS BIGINT), 0.0 FROM (SELECT sum(n) AS n, count(*) AS k FROM e)""",
    }
