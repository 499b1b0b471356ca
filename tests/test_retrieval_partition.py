import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import arms, key_chunks, matching, partition, prompts, retrieval, training

POOL = "query_id string, client_id int, vec_id bigint, example_id string, subject string, pool_rank int, relevance double, vector array<double>"


def pool(spark):
    rows = [("q", 0, i, f"e{i}", "Pathology" if i == 5 else "Anatomy", i + 1, 0.9 - 0.02 * i, [0.0, 1.0] if i == 5 else [1.0, 0.0]) for i in range(6)]
    return spark.createDataFrame(rows, POOL)


def order(df):
    return [r.vec_id for r in df.orderBy("position").collect()]


def pick(spark, p, arm, **more):
    return arms.chosen(p, arms.arms(spark, train_icl=True).where(F.col("arm") == arm), **more)


def test_all_arms_in_one_plan(spark):
    p = pool(spark)
    w = spark.createDataFrame([(0, "Pathology", 1.0)], "client_id int, subject string, weight double")
    table = arms.arms(spark, train_icl=True)
    rows = arms.chosen(p, table, k=2, weights=w).collect()
    assert {r.arm for r in rows} == {r.arm for r in table.where("uses_exemplars").collect()}
    for arm in ("B1", "FD", "F2", "FS"):
        assert [r.vec_id for r in sorted((r for r in rows if r.arm == arm), key=lambda r: r.position)] == order(pick(spark, p, arm, k=2, weights=w))
    assert len(order(pick(spark, p, "B1", k=50))) == 6


def test_rerank_arms(spark):
    p = pool(spark)
    w = spark.createDataFrame([(0, "Anatomy", 0.0), (0, "Pathology", 1.0)], "client_id int, subject string, weight double")
    assert order(pick(spark, p, "F1")) == [0, 1, 2, 3, 4]
    assert 5 in order(pick(spark, p, "FD"))
    assert order(pick(spark, p, "FP", weights=w))[0] == 5
    assert order(retrieval.rerank(p, beta=0.0, weights=w)) == order(pick(spark, p, "FP", weights=w))
    assert order(retrieval.rerank(p, beta=0.0, gamma=0.0)) == [0, 1, 2, 3, 4]
    assert pick(spark, p, "B0").count() == 0
    with pytest.raises(ValueError):
        pick(spark, p, "F2")


def test_arm_table(spark):
    assert [arms.arms(spark, **k).count() for k in ({}, {"controlled": True}, {"train_icl": True})] == [8, 13, 20]
    assert arms.runs(arms.arms(spark), [42, 43, 44]).count() == 2 + 6 * 3


def test_progressive_pool(spark):
    rows = [("a", r, None if r in (4, 5, 6) else "example_id") for r in range(1, 8)] + [("b", r, None) for r in range(1, 8)] + [("c", r, "x") for r in range(1, 4)]
    df = spark.createDataFrame(rows, "query_id string, pool_rank int, reason string")
    d = {r.query_id: r for r in retrieval.pool_diagnostics(retrieval.progressive_pool(df, minimum=3, sizes=(3, 6))).collect()}
    assert (d["a"].searched, d["a"].eligible, d["a"].expanded, d["a"].capacity_failure) == (6, 3, True, False)
    assert (d["b"].searched, d["b"].expanded) == (3, False)
    assert (d["c"].eligible, d["c"].capacity_failure) == (0, True)


def test_reason_order_and_empty_words(spark):
    df = spark.sql("select 'a' i, 'a' j, array() w, array('x') v")
    side = lambda i, w, p="": {"id": F.col(i), "nq": F.lit(i), "qh": F.lit(i), "provenance": F.lit(p), "words": F.col(w)}
    first = lambda q, s, d: df.select(retrieval.ineligibility(q, s | {"duplicate": F.lit(d)})).first()[0]
    assert first(side("i", "w"), side("j", "v"), 0.99) == "example_id"
    other = side("j", "v") | {"id": F.lit("b")}
    assert first(side("i", "v", "p"), other | {"provenance": F.lit("p")}, 0.99) == "provenance_group"
    assert first(side("i", "w"), other | {"words": F.col("w")}, 0.0) == "lexical_near_duplicate"
    assert first(side("i", "w"), other, 0.92) == "semantic_near_duplicate"
    assert first(side("i", "w"), other, 0.91) is None


def test_zero_vector_and_ties(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<float>")
    assert [r[0] for r in df.select(retrieval.unit(F.col("v"))).collect()] == [[0.0, 0.0], [0.6, 0.8]]
    scores = spark.createDataFrame([("q", 2, 0.1234564), ("q", 1, 0.1234561), ("q", 3, 0.2)], "query_id string, support_id int, relevance double")
    assert [r.support_id for r in retrieval.ranked(scores).orderBy("pool_rank").collect()] == [3, 1, 2]


def test_prompts(spark, make_items):
    items = make_items([("q", "Why?", ["a", "b", "c", "d"], "test"), ("x", "How?", ["e", "f", "g", "h"], "train", 2)])
    chosen = spark.createDataFrame([("q", 1, "x")], "query_id string, position int, example_id string")
    got = {r.query_id: r for r in prompts.prompts(items, chosen).collect()}
    assert got["q"].user == "Example 1:\nQuestion: How?\nA. e\nB. f\nC. g\nD. h\nAnswer: g\nFinal answer: C\n\nNow answer this item:\nQuestion: Why?\nA. a\nB. b\nC. c\nD. d\nAnswer:"
    assert got["x"].n_exemplars == 0 and got["x"].user.startswith("Now answer")
    plan = {r.query_id: r.reason for r in prompts.training_plan(items, chosen, limit=10_000, k=1).collect()}
    assert plan == {"q": None, "x": "capacity"}
    assert {r.reason for r in prompts.training_plan(items, chosen, limit=8, k=1).collect()} == {"context_budget", "capacity"}
    assert prompts.over_budget(prompts.prompts(items, chosen), limit=10, reserve=1).count() == 2


def test_matching(spark, make_items):
    items = make_items([("i", "q", ["Vitamin A", "Vitamin B", "Vitamin C", "Vitamin C "], "test"), ("j", "q", ["Vitamin A", "Vitamin B", "Vitamin C", "x"], "test")])
    texts = [(1, "i", "so.\nFinal answer: C"), (2, "j", " vitamin-c! "), (3, "i", "vitamin c"), (4, "j", "I am unsure"), (5, "j", None), (6, "j", "Final answer: B is wrong"), (7, "zz", "FINAL ANSWER : d)")]
    records = spark.createDataFrame(texts, "record_id bigint, example_id string, generated_text string")
    got = {r.record_id: (r.label, r.match_stage) for r in matching.match(records, items).collect()}
    assert got == {1: (2, "terminal_label"), 2: (2, "exact_option"), 3: (None, "unresolved"), 4: (None, "unresolved"), 5: (None, "unresolved"), 6: (None, "unresolved"), 7: (3, "terminal_label")}
    v = spark.sql("select array(1.0, 0.0) v, array(array(0.0,1.0), array(0.9,0.1), array(-1.0,0.0), array(0.5,0.5)) o")
    hit = v.select(matching.semantic_option(F.col("v"), F.col("o")).alias("m")).first().m
    assert hit.label == 1 and hit.confidence > 0.99
    near = v.select(matching.semantic_option(F.col("v"), F.array(F.col("v"), F.col("v"), F.col("o")[0], F.col("o")[2])).alias("m")).first().m
    assert near.label is None and near.margin == pytest.approx(0)
    soft = spark.sql("select array(1.0D, 3.0D, 3.0D, 0.0D) s").select(matching.softmax_choice(F.col("s")).alias("c")).first().c
    assert soft.label == 1 and soft.confidence == pytest.approx(math.exp(3) / (math.exp(1) + 2 * math.exp(3) + 1))


def test_holdout(spark):
    df = spark.createDataFrame([(f"{s}{i}", s) for s, n in (("Anatomy", 30), ("Pathology", 30), ("One", 1), ("Two", 2)) for i in range(n)], "example_id string, subject string")
    got = partition.development_holdout(df, fraction=0.2)
    counts = Counter((r.subject, r.split) for r in got.collect())
    assert counts == {("Anatomy", "validation"): 6, ("Anatomy", "train"): 24, ("Pathology", "validation"): 6, ("Pathology", "train"): 24, ("One", "train"): 1, ("Two", "validation"): 1, ("Two", "train"): 1}
    again = {(r.example_id, r.split) for r in partition.development_holdout(df.repartition(7), fraction=0.2).collect()}
    assert again == {(r.example_id, r.split) for r in got.collect()}


def test_partition_keeps_minimums(spark):
    rows = [(f"{sp}{i}", sp, f"s{i % 4}") for sp, n in (("train", 120), ("validation", 20), ("test", 20)) for i in range(n)]
    items = spark.createDataFrame(rows, "example_id string, split string, subject string")
    weights = spark.createDataFrame(partition.dirichlet_weights(["s0", "s1", "s2", "s3"], seed=42), "subject string, client int, weight double, cumulative double")
    first = partition.roles(partition.rebalance(partition.assign_clients(items, weights)))
    rows = first.collect()
    counts = Counter((r.client_id, r.role) for r in rows)
    assert len(rows) == 160 and len({r.example_id for r in rows}) == 160
    for c in range(5):
        assert counts[(c, "support")] >= 5 and counts[(c, "fit")] >= 1 and counts[(c, "validation")] >= 1 and counts[(c, "test")] >= 1
    assert partition.transfers({0: 10, 1: 0, 2: 3}, 2) == [(0, 1), (0, 1)]
    with pytest.raises(ValueError):
        partition.transfers({0: 1, 1: 0}, 1 + 1)
    with pytest.raises(ValueError):
        partition.dirichlet_weights(["a"], alpha=0)


def test_training_steps(spark):
    states = spark.createDataFrame([("k", 1.0, [1.0, 2.0]), ("k", 3.0, [5.0, 6.0])], "key string, weight double, vector array<double>")
    assert [r.value for r in training.weighted_vector_mean(states, "key").orderBy("pos").collect()] == [4.0, 5.0]
    assert training.shape_issues(states.union(states.selectExpr("key", "0.0D", "array(1.0D)")), "key").count() == 1
    assert training.communication(states, clients=5).first().asDict() == {"bytes_up": 16, "bytes_down": 40}
    ck = spark.createDataFrame([("a", 0, 1, 1, "r0", 0.1), ("a", 1, 1, 1, "x", 0.5), ("a", 1, 2, 1, "y", 0.5), ("a", 2, 1, 1, "z", None)], "arm string, round int, step int, epoch int, name string, loss double")
    assert training.best_checkpoint(ck, "arm").first().name == "x"
    assert training.latest_checkpoint(ck.withColumn("mtime", F.col("loss")), "arm").first().name == "z"
    rounds = spark.createDataFrame([(4, 42, 0.5), (6, 42, 0.5), (8, 42, 0.4)], "round int, seed int, accuracy double")
    assert training.best_round(rounds).first().round == 4
    mask = spark.sql("select array(7, 8) p, array(1, 2) a").select(training.masked_labels(F.col("p"), F.col("a"))).first()[0]
    assert mask == [-100, -100, 1, 2]
    zero = spark.createDataFrame([("a", 5, 0.0)], "arm string, exposures int, seconds double")
    assert training.throughput(zero, "arm").first().exposures_per_s == 0.0


def test_history_and_identity(spark):
    history, saved = spark.createDataFrame([(1,), (5,)], "round int"), spark.createDataFrame([(2,)], "round int")
    assert {(r.round, r.problem) for r in training.history_gaps(history, saved, completed=3).collect()} == {(2, "rebuild"), (3, "lost"), (5, "ahead")}
    ck = spark.createDataFrame([("a", 1, 0, "x"), ("a", 1, 4, "y"), ("b", 1, 0, "z"), ("b", 1, 0, "w")], "arm string, epoch int, batch_in_epoch int, name string")
    assert {(r.arm, r.name, r.n_matches) for r in training.epoch_checkpoints(ck, "arm", epoch=1).collect()} == {("a", "x", 1), ("b", "w", 2)}
    rows = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "example_id string, qh string")
    other = spark.createDataFrame([("a", "9"), ("z", "3")], "example_id string, qh string")
    assert {r.example_id for r in training.fit_overlap(rows, other).collect()} == {"a", "c"}
    same = lambda df: training.ordered_identity(df).first().identity
    assert same(rows) == same(rows.repartition(3)) and same(rows) != same(other) and same(rows) != same(rows.union(rows))


def test_load_splits(spark):
    from tessera.sources import items as I

    def raw(prefix, n):
        return spark.createDataFrame([(f"{prefix}{i}", "q", "a", "b", "c", "d", 1, "Unknown" if i == 0 else f"S{i % 2}", None, None, None, None) for i in range(n)], "id string, question string, opa string, opb string, opc string, opd string, cop int, subject_name string, topic_name string, source string, exam string, exp string")

    sources = {"train": raw("t", 21), "Dev": raw("v", 21), "test": raw("x", 21), "other": raw("o", 2)}
    plain = I.load_splits(sources, I.adapt_flat, limits={"train": 5})
    assert Counter(r.split for r in plain.collect()) == {"train": 5, "validation": 21, "test": 21}
    held = I.load_splits(sources, I.adapt_flat, limits={"train": 5, "test": 3}, fraction=0.2)
    assert Counter(r.split for r in held.collect()) == {"train": 5, "validation": 4, "test": 3}
    assert {r.example_id[0] for r in held.where("split = 'test'").collect()} == {"v"}
    with pytest.raises(ValueError, match="missing"):
        I.load_splits({"train": sources["train"]}, I.adapt_flat)


def test_key_chunks(spark):
    rows = [("hot", f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", f"e{i}") for i in range(0, 300, 3)] + [("b", "2024-01-02 00:00:00", "x"), ("b", None, "y"), ("b", "2024-01-02 01:00:00", "z"), (None, "2024-01-01 00:00:00", "n")]
    df = spark.createDataFrame(rows, "k string, t string, i string").withColumn("t", F.col("t").cast("timestamp")).repartition(6)
    numbers = key_chunks.numbered(df, F.col("k"), F.col("t"), F.col("i"), chunk_rows=7)
    assert sorted(r.rn for r in numbers.where("key = 'hot'").collect()) == list(range(1, 101))
    assert numbers.where("key = 'hot'").groupBy("chunk").count().agg(F.max("count")).first()[0] == 7
    got = {r.key: r for r in key_chunks.profile(df, F.col("k"), F.col("t"), F.col("i"), chunk_rows=7).collect()}
    assert set(got) == {"hot", "b"}
    assert (got["hot"].n_rows, got["hot"].max_gap_s) == (100, 3.0) and (got["b"].n_rows, got["b"].max_gap_s) == (3, 3600.0)
    heavy = key_chunks.heavy_keys(df, "k", F.col("k"), F.col("t"), F.col("i"))
    assert [(r.field, r.key_value) for r in heavy.collect()] == [("k", "hot")]
    assert key_chunks.heavy_keys(df.where("false"), "k", F.col("k"), F.col("t"), F.col("i")).count() == 0
