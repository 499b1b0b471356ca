import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import leakage, subjects
from tests.conftest import ITEM

O = ["one", "two", "three", "four"]


def rows_for(seed):
    r = random.Random(seed)
    words = "which nerve lifts the upper eyelid in older people near a long lake after early winter rain".split()
    out = []
    for i in range(90):
        q = " ".join(r.choice(words) for _ in range(r.choice([0, 1, 3, 5, 8])))
        out.append((f"e{i:02d}", q or " ?", O, r.choice(["train", "validation", "test"])))
    return out


def jaccard(a, b):
    a, b = set(a.split()), set(b.split())
    return (len(a & b), len(a | b))


@pytest.mark.parametrize("hot", [1000, 5, 0])
@pytest.mark.parametrize("t", [(1, 10), (1, 2), (3, 4), (17, 20), (1, 1)])
def test_lexical_equals_brute(spark, make_items, t, hot):
    rows = rows_for(1)
    keyed = leakage.keyed(make_items(rows))
    s, e = keyed.where("split = 'train'"), keyed.where("split <> 'train'")
    got = {(r.snq, r.enq) for r in leakage.lexical_pairs(s, e, t, hot=hot).collect()}
    norm = {i: " ".join(q.replace("?", " ").split()) for i, q, _, _ in rows}
    want = set()
    for a, _, _, sa in rows:
        for b, _, _, sb in rows:
            if sa == "train" and sb != "train" and norm[a] != norm[b] and norm[a] and norm[b]:
                x, y = jaccard(norm[a], norm[b])
                if x * t[1] >= y * t[0]:
                    want.add((norm[a], norm[b]))
    assert got == want


def test_issues(spark, make_items):
    support = leakage.keyed(make_items([("s1", "Which nerve lifts the eyelid?", O, "train"), ("s2", "x", O, "test")]))
    evaluation = leakage.keyed(make_items([("e1", "WHICH nerve: lifts the eyelid", O, "test"), ("e2", "Which nerve lifts the upper eyelid?", O, "test")]))
    got = {(r.kind, r.support_id, r.evaluation_id, r.value) for r in leakage.issues(support, evaluation, threshold=(3, 4)).collect()}
    kinds = {g[0] for g in got}
    assert kinds == {"normalized_question", "question_options_hash", "lexical_near_duplicate", "support_not_train"}
    assert ("lexical_near_duplicate", "s1", "e2", "0.833333") in got
    with pytest.raises(ValueError, match="leakage"):
        leakage.assert_no_leakage(leakage.issues(support, evaluation))
    leakage.assert_no_leakage(leakage.issues(support.where("false"), evaluation))


def test_pairs_of_a_hot_question_are_made_by_all_tasks(spark, make_items):
    def hot(split, n):
        return [(f"{split}{i}", "Which is TRUE?" if i % 2 else "which, is true", O, split) for i in range(n)]

    keyed = leakage.keyed(make_items(hot("train", 150) + hot("test", 120) + [("t", "other", O, "train"), ("x", "lonely", O, "test"), ("t", "other", O, "test")]))
    s, e = keyed.where("split = 'train'"), keyed.where("split = 'test'")
    found = leakage.exact_issues(s.unionAll(s), e)
    got = [tuple(r) for r in found.select("kind", "support_id", "evaluation_id").collect()]
    assert len(got) == len(set(got)) and set(got) == {(k, f"train{i}", f"test{j}") for k in (1, 2) for i in range(150) for j in range(120)} | {(k, "t", "t") for k in (0, 1, 2)}
    # Behind the pairs nothing is joined, shuffled or compared: there are as many as the square of the rows.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not {"Aggregate", "Join", "Repartition"} & set(plan[: plan.index("Generate")].replace("(", " ").split())
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4" and found.groupBy(F.spark_partition_id()).count().where("count > 6000").count() == 4


def test_near_pairs_are_named_once_without_a_shuffle_of_them(spark, make_items):
    q = ["one two three four five six seven", "one two three four five six seven eight", "six seven one two three four five", "nine one two three four five six seven"]
    train = [(f"t{i}", q[i % 2], [str(i)] + O[1:], "train") for i in range(60)] + [("t0", q[3], O, "train"), ("t1", q[2], O, "train"), ("u", "???", O, "train")]
    test = [(f"e{i}", q[2], [f"x{i}"] + O[1:], "test") for i in range(50)] + [("e0", q[3], O, "test"), ("e1", q[0], O, "test"), ("w", "!", ["z"] + O[1:], "test")]
    keyed = leakage.keyed(make_items(train + test))
    found = leakage.issues(keyed.where("split = 'train'"), keyed.where("split = 'test'"))
    got = [tuple(r) for r in found.collect()]
    want = {("lexical_near_duplicate", s, e, f"{x / y:.6f}") for s, a, _, _ in train for e, b, _, _ in test if a != b and a != "???" and b != "!" for x, y in [jaccard(a, b)] if x * 20 >= y * 17}
    assert len(got) == len(set(got)) and {g for g in got if g[0] == "lexical_near_duplicate"} == want and len(want) > 2900
    assert {g for g in got if g[0] == "normalized_question"} == {("normalized_question", s, e, "" if a == "???" else a) for s, a, _, _ in train for e, b, _, _ in test if a == b or (a, b) == ("???", "!")}
    plan = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert not [x for x in plan if "Aggregate [" in x and "support_id" in x and "evaluation_id" in x]


def test_decontaminate_is_sequential(spark, make_items):
    df = make_items(
        [
            ("t", "one two three four five six seven", O, "test"),
            ("v1", "One, two three four five six SEVEN!", O, "validation"),
            ("v2", "alpha beta gamma delta epsilon zeta eta", ["a", "b", "c", "d"], "validation"),
            ("r1", "one two three four five six seven", ["w", "x", "y", "z"], "train"),
            ("r2", "alpha beta gamma delta epsilon zeta eta theta", ["p", "q", "r", "s"], "train"),
            ("r3", "unrelated", ["k", "l", "m", "n"], "train"),
        ]
    )
    got = {(r.split, r.example_id, r.matched_id, r.kind) for r in leakage.decontaminate(leakage.keyed(df)).collect()}
    assert got == {("validation", "v1", "t", "normalized_question"), ("train", "r1", "t", "normalized_question"), ("train", "r2", "v2", "lexical_near_duplicate")}


def test_decontaminate_ignores_dropped_validation_and_uses_provenance(spark):
    full = [("t", "aa bb", O, 0, "test", "S", "u", "g1", None, None), ("v", "cc dd", ["5", "6", "7", "8"], 0, "validation", "S", "u", "g1", None, None), ("r", "cc dd", ["9", "6", "7", "8"], 0, "train", "S", "u", None, None, None)]
    got = {(r.example_id, r.kind) for r in leakage.decontaminate(leakage.keyed(spark.createDataFrame(full, ITEM))).collect()}
    assert got == {("v", "provenance_group")}
    assert leakage.decontaminate(leakage.keyed(spark.createDataFrame([], ITEM))).count() == 0


def test_subject_filter(spark):
    values = ["Unknown", " unknown ", "", "General", "N/A", "None", "Medicine", "Anatomy", None]
    df = spark.createDataFrame([(v, "train") for v in values], "subject string, split string")
    assert sorted(r.subject for r in subjects.filter_native(df).collect()) == ["Anatomy", "Medicine"]
    a = subjects.filter_audit(df).first()
    assert (a.input_rows, a.retained_rows, a.excluded_rows) == (9, 2, 7)


def assigned(spark):
    rows = []
    for c in range(5):
        for role in ("fit", "support", "validation", "test"):
            for s, n in (("Anatomy", 20 + c), ("Pathology", 25 - c)):
                rows += [(f"{c}{role}{s}{i}", c, role, s) for i in range(n)]
    return spark.createDataFrame(rows, "example_id string, client_id int, role string, subject string")


def test_coverage_and_variation(spark):
    df = assigned(spark)
    cover = {(r.client_id, r.subject): r.other_rows for r in subjects.other_client_coverage(df).collect()}
    assert cover[(0, "Anatomy")] == 90
    top = subjects.total_variation(df).agg(F.max("total_variation")).first()[0]
    assert top == pytest.approx(4 / 45, abs=1e-6)
    assert subjects.subject_issues(df, min_rows=10).count() == 0
    thin = subjects.subject_issues(df.where("NOT (client_id = 1 AND role = 'support' AND subject = 'Anatomy') AND NOT (client_id = 2 AND role = 'test')"), min_rows=1000)
    assert {r.rule for r in thin.collect()} == {"thin_coverage", "one_support_subject", "role_empty"}


def test_variation_of_every_pair(spark):
    rows = [(f"{c}-{i}", c, "fit", s) for c, subjects_ in {1: "AABB", 2: "AB", 3: "CC", 4: "C", 5: ["A", None]}.items() for i, s in enumerate(subjects_)]
    rows += [(f"o{c}", c, "fit", "A") for c in range(100, 150)] + [("x", 9, "test", "A")]
    df = spark.createDataFrame(rows, "example_id string, client_id int, role string, subject string")
    got = {(r.client_a, r.client_b): r.total_variation for r in subjects.total_variation(df).collect()}
    assert len(got) == 55 * 54 // 2
    assert [got[p] for p in ((1, 2), (1, 3), (3, 4), (1, 5), (3, 5), (1, 100), (3, 149), (100, 149))] == [0.0, 1.0, 0.0, 0.5, 1.0, 0.5, 1.0, 0.0]
    one = df.where("client_id in (5, 6)").unionAll(spark.createDataFrame([("n", 6, "fit", None)], df.schema))
    assert [r.total_variation for r in subjects.total_variation(one).collect()] == [0.5]


def test_provenance_issues(spark, make_items):
    def item(i, split, group):
        return (i, f"question of {i}", [i + o for o in O], split, 0, "S", group)

    rows = [item(f"t{i}", "train", "big") for i in range(30)] + [item(f"e{i}", "test", "big") for i in range(4)]
    rows += [item("t90", "train", "g"), item("v1", "validation", "g"), item("e90", "test", "alone"), item("t91", "train", None), item("e91", "test", None), item("t92", "train", ""), item("e92", "test", "")]
    keyed = leakage.keyed(make_items(rows))
    s, e = keyed.where("split = 'train'"), keyed.where("split <> 'train'")
    got = {tuple(r) for r in leakage.provenance_issues(s.unionAll(s.where("example_id = 't0'")), e).collect()}
    assert got == {("provenance_group", "t0", f"e{i}", "big", 30) for i in range(4)} | {("provenance_group", "t90", "v1", "g", 1)}
    assert leakage.all_exact_issues(s, e).where("kind = 3").count() == len(got)


def test_registered_leak_reports_name_provenance(spark):
    from tessera.plans import catalog

    assert "provenance_issues" in catalog.queries()


def test_split_overlaps_name_all_three_pairs(spark, make_items):
    df = make_items(
        [
            ("a", "one", O, "train", 0, "S", "g1"),
            ("b", "ONE!", ["w", "x", "y", "z"], "validation", 0, "S", None),
            ("c", "two", ["k", "l", "m", "n"], "validation", 0, "S", "g2"),
            ("d", "three", ["p", "q", "r", "s"], "test", 0, "S", "g2"),
            ("e", "four", ["5", "6", "7", "8"], "test", 0, "S", "g1"),
            ("f", "five", ["5", "6", "7", "9"], "test", 0, "S", ""),
        ]
    )
    keyed = leakage.keyed(df)
    got = {tuple(r) for r in leakage.split_overlaps(keyed).collect()}
    assert got == {("train", "validation", "normalized_question", 1), ("train", "test", "provenance_group", 1), ("validation", "test", "provenance_group", 1)}
    with pytest.raises(ValueError, match="overlap"):
        leakage.assert_disjoint(keyed)
    kept = keyed.join(leakage.decontaminate(keyed).select("example_id"), "example_id", "left_anti")
    leakage.assert_disjoint(kept)
    with pytest.raises(ValueError, match="no rows"):
        leakage.require_splits(kept.where("split <> 'train'"))
    issues = {(r.kind, r.support_id, r.evaluation_id) for r in leakage.issues(keyed.where("split = 'train'"), keyed.where("split <> 'train'")).collect()}
    assert ("provenance_group", "a", "e") in issues and ("normalized_question", "a", "b") in issues
