import pytest
from pyspark.sql import functions as F

from tessera.operators import contrasts, metrics, priors, statistics

SCHEMA = "arm string, seed int, example_id string, client_id int, subject string, gold int, predicted int, stage string, likelihood_predicted int, likelihood_confidence double, prompt_tokens int"


def frame(spark, rows):
    base = ("A", 42, "e", 0, "S", 0, 0, "terminal_label", 0, 0.5, 10)
    return spark.createDataFrame([tuple(r) + base[len(r) :] for r in rows], SCHEMA)


def test_unresolved_is_wrong(spark):
    df = frame(spark, [("A", 42, "a", 0, "S", 1, 1), ("A", 42, "b", 0, "S", 1, None)])
    assert metrics.accuracy(df, "arm").first().accuracy == 0.5
    assert metrics.stage_rates(df, "arm").first().unresolved_rate == 0.5
    assert metrics.macro_f1(df, "arm").first().macro_f1 == round(2 / 3 / 4, 6)
    assert metrics.accuracy(df.where("false"), "arm").count() == 0


def test_calibration_edges(spark):
    rows = [("A", 42, str(i), 0, "S", 0, 0, "x", 0, c) for i, c in enumerate([0.0, 0.1, 0.3, 0.7, 1.0, 1.2, None])]
    bins = {r.bin: r.n_records for r in metrics.calibration_bins(frame(spark, rows), "arm").collect()}
    assert bins == {0: 1, 1: 1, 3: 1, 7: 1, 9: 1, -1: 1}
    ece = metrics.expected_calibration_error(frame(spark, rows), "arm").first()
    assert ece.n_records == 6 and ece.ece == pytest.approx((1 + 0.9 + 0.7 + 0.3 + 0) / 6, abs=1e-6)


def test_agreement_counts_null_as_equal(spark):
    df = frame(spark, [("A", 42, "a", 0, "S", 0, None, "x", None, None), ("A", 42, "b", 0, "S", 0, 0, "x", 1, 0.2)])
    row = metrics.evaluator_agreement(df, "arm").first()
    assert (row.agreement, row.likelihood_accuracy) == (0.5, 0.0)
    m = metrics.agreement_matrix(df, "arm").first()
    assert (m.both, m.pipeline_only, m.likelihood_only, m.neither) == (0, 1, 0, 1)


def test_percentile_conventions(spark):
    df = frame(spark, [("A", 42, str(i), 0, "S", 0, 0, "x", 0, 0.5, i) for i in range(10)])
    p = metrics.token_percentiles(df, "arm").first()
    assert (p.p50, p.p95, p.max_tokens) == (4.5, 8.55, 9)
    n = metrics.nearest_rank(df, "arm").first()
    assert (n.median_tokens, n.p95_tokens) == (5, 9)


def test_comparison(spark):
    rows = [("F0", s, f"{s}{i}", 0, "S", 0, 0 if i < k else 1) for s, k in ((42, 50), (43, 52), (44, 54)) for i in range(100)]
    rows += [("B1", None, f"b{i}", 0, "S", 0, 0 if i < 40 else 1) for i in range(100)]
    table = metrics.arm_comparison(frame(spark, rows))
    got = {(r.arm, r.metric): (r.runs, r["mean"], r["std"]) for r in table.collect()}
    assert got[("B1", "pipeline_accuracy")][1:] == (0.4, 0.0)
    assert got[("F0", "pipeline_accuracy")] == (3, 0.52, 0.02)
    lines = [r.line for r in metrics.comparison_table(table).orderBy("position").collect()]
    assert lines[0].startswith("| F0 | 0.5200 ± 0.0200 |") and lines[1].startswith("| B1 | 0.4000 |")


def test_loco(spark):
    df = frame(spark, [("A", 42, "a", 0, "cardio", 0, 0), ("A", 42, "b", 1, "cardio", 0, 1), ("A", 42, "c", 1, "neuro", 0, 0)])
    got = {(r.client_id, r.subject): r.weight for r in priors.weakness(df).collect()}
    assert got[(0, "cardio")] == 1.0 and got[(0, "neuro")] == 0.0 and len(got) == 4
    rows = [("A", 42, f"{c}{s}{i}", c, s, 0, 1 if i < (c + 1 if s == "Anatomy" else 8 - c) else 0) for c in range(5) for s in ("Anatomy", "Pathology") for i in range(10)]
    df = frame(spark, rows)
    support = df.select("client_id", "subject")
    beta = {(r.client_id, r.subject): (r.n_other, r.weight) for r in priors.controlled_weakness(df, support, min_count=10).collect()}
    assert beta[(0, "Anatomy")] == (40, round(15 / 42, 6))
    assert priors.controlled_weakness(df, support, min_count=41).where("weight is not null").count() == 0


def test_shuffle_keeps_weights(spark):
    df = spark.createDataFrame([(c, f"s{i}", float(i) / 9) for c in range(6) for i in range(2 if c == 5 else 10)], "client_id int, subject string, weight double")
    got = priors.shuffled(df, seed=7)
    a = sorted((r.client_id, r.weight) for r in df.collect())
    b = sorted((r.client_id, r.weight) for r in got.collect())
    assert a == b
    changed = df.alias("x").join(got.alias("y"), ["client_id", "subject"]).where("x.weight <> y.weight").select("client_id").distinct().count()
    assert changed == 6
    constant = spark.createDataFrame([(0, "a", 0.5), (0, "b", 0.5), (1, "a", 0.1)], "client_id int, subject string, weight double")
    assert {(r.client_id, r.rule) for r in priors.variation_issues(constant).collect()} == {(0, "constant"), (1, "one_subject")}


def test_holm(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "name string, p_value double")
    assert {r.name: r.holm_adjusted for r in statistics.holm(df).collect()} == {"a": 0.03, "b": 0.06, "c": 0.06}


def test_bootstrap(spark):
    left = frame(spark, [("L", 42, str(i), 0, "S", 0, None) for i in range(8)])
    right = frame(spark, [("R", 42, str(i), 0, "S", 0, 0) for i in range(8)])
    d = statistics.paired_differences(left, right, ["example_id"])
    assert statistics.effects(d).first().effect == 1.0
    row = statistics.interval(statistics.item_draws(d, samples=20)).first()
    assert (row.ci_low, row.ci_high, row.p_value) == (1.0, 1.0, 0.0)
    issues = {r.problem: r.n for r in statistics.pairing_issues(left.union(left.where("example_id = '3'")), right.where("example_id <> '5'").withColumn("gold", F.when(F.col("example_id") == "1", 2).otherwise(F.col("gold"))), ["example_id"], ["gold"]).collect()}
    assert issues == {"missing_right": 1, "inconsistent": 1, "duplicate_left": 1}


def test_fast_and_item_draws_agree(spark):
    d = spark.createDataFrame([("x", str(i), [1, 1, 0, -1][i % 4]) for i in range(400)], "g string, example_id string, d int")
    slow = statistics.item_draws(d, "g", samples=300).agg(F.avg("x"), F.stddev("x")).first()
    fast = statistics.fast_draws(d, "g", samples=3000).agg(F.avg("x"), F.stddev("x")).first()
    assert slow[0] == pytest.approx(0.25, abs=0.02) and fast[0] == pytest.approx(0.25, abs=0.01)
    assert slow[1] == pytest.approx(fast[1], rel=0.2)


def test_group_draws_of_every_group(spark):
    rows = [(g, k, str(i), [1, 1, 0, -1][i % 4] if g == "x" else -1) for g in "xy" for k in (42, 43) for i in range(400)]
    d = spark.createDataFrame(rows, "g string, seed int, example_id string, d int")
    draws = statistics.group_draws(d, "g", "seed", samples=500, seed=3)
    got = {(r.g, r.seed): r for r in draws.groupBy("g", "seed").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.stddev("x").alias("sd")).collect()}
    assert set(got) == {(g, k) for g in "xy" for k in (42, 43)} and all(r.n == 500 for r in got.values())
    assert got[("x", 42)].m == pytest.approx(0.25, abs=0.01) and got[("x", 42)].sd == pytest.approx((11 / 16 / 400) ** 0.5, rel=0.15)
    assert got[("y", 43)].m == -1.0 and got[("x", 42)].m != got[("x", 43)].m
    assert sorted(draws.collect()) == sorted(statistics.group_draws(d.orderBy(F.desc("example_id")).repartition(3), "g", "seed", samples=500, seed=3).collect())


def test_pairing_issues_of_every_kind(spark):
    left = frame(spark, [("L", 42, str(i), 0, "S", 0, 0) for i in range(21)])
    right = frame(spark, [("R", 42, str(i), 0, "S", 0, 0) for i in range(21)])
    assert statistics.pairing_issues(left, right, ["example_id"], ["gold"]).count() == 0
    a = left.where("example_id % 7 > 0").unionAll(left.where("example_id = '1'"))
    b = right.where("example_id <> '5'").withColumn("gold", F.when(F.col("example_id") == "2", 1).otherwise(F.col("gold")))
    b = b.unionAll(b.where("example_id = '3'"))
    got = {r.problem: r.n for r in statistics.pairing_issues(a, b, ["example_id"], ["gold"]).collect()}
    assert got == {"missing_left": 3, "missing_right": 1, "inconsistent": 1, "duplicate_left": 1, "duplicate_right": 1}


def test_contrast_report(spark):
    rows = []
    for arm, ok, lik in (("B0", 30, 60), ("B1", 60, 30)):
        rows += [(arm, None, str(i), 0, "S", 0, 0 if i < ok else 1, "x", 0 if i < lik else 1, 0.5) for i in range(100)]
    for arm, ok in (("F0", 40), ("F1", 45)):
        rows += [(arm, s, str(i), 0, "S", 0, 0 if i < ok else 1, "x", 0 if i < ok else 1, 0.5) for s in (42, 43) for i in range(100)]
    got = {r.name: r for r in contrasts.report(frame(spark, rows), contrasts.selected(spark, present=frame(spark, rows)), samples=500).collect()}
    assert set(got) == {"base_icl", "fl_icl"}
    assert got["base_icl"].effect == 0.3 and got["base_icl"].evaluator_dependent and not got["fl_icl"].evaluator_dependent
    assert got["fl_icl"].effect == pytest.approx(0.05) and got["fl_icl"].ci_low <= 0.05 <= got["fl_icl"].ci_high
    assert got["base_icl"].holm_adjusted >= got["base_icl"].p_value
    assert contrasts.selected(spark, train_icl=True, present=spark.createDataFrame([("F0",), ("LT1",)], "arm string")).count() == 0
    assert contrasts.selected(spark, controlled=True, train_icl=True, descriptive=False).count() == 22
    gaps = {(r.arm, r.problem) for r in contrasts.arm_gaps(contrasts.selected(spark), frame(spark, rows).unionAll(frame(spark, rows[:1]).withColumn("arm", F.lit("ZZ")))).collect()}
    assert gaps == {("L0", "absent"), ("L1", "absent"), ("F2", "absent"), ("ZZ", "undeclared")}
    seedless = contrasts.aligned(frame(spark, rows).where("arm in ('B0', 'F1')").withColumn("arm", F.when(F.col("arm") == "B0", "F0").otherwise(F.col("arm"))), contrasts.selected(spark))
    assert seedless.count() == 200


def test_unpaired_arms_are_refused(spark):
    def rows(**change):
        out = [(arm, s, str(i), 0, "S", 0, 0, "x", 0, 0.5) for arm in ("F0", "F1") for s in (42, 43) for i in range(10)]
        return frame(spark, [r for r in out if change.get("keep", lambda r: True)(r)] + change.get("more", []))

    table = contrasts.selected(spark)
    assert contrasts.unpaired(rows(), table).count() == 0 and contrasts.report(rows(), table, samples=50).count() == 1
    cases = {
        "missing_right": rows(keep=lambda r: r[:3] != ("F1", 42, "3")),
        "missing_left": rows(keep=lambda r: r[:3] != ("F0", 42, "3")),
        "seed_on_one_side": rows(keep=lambda r: r[:2] != ("F1", 43)),
        "repeated": rows(more=[("F1", 42, "3", 0, "S", 0, 0, "x", 0, 0.5)]),
        "inconsistent": rows(keep=lambda r: r[:3] != ("F1", 42, "3"), more=[("F1", 42, "3", 0, "S", 2, 0, "x", 0, 0.5)]),
    }
    for problem, df in cases.items():
        assert [(r.name, r.problem) for r in contrasts.unpaired(df, table).collect()] == [("fl_icl", problem)]
        with pytest.raises(ValueError, match=problem):
            contrasts.report(df, table, samples=50)
