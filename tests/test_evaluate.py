from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tessera.functions import models
from tessera.plans import evaluate
from tessera.plans.config import Config


def study(make_items, spark):
    words = "fever cough liver kidney heart lung bone skin brain blood nerve joint".split()
    rows, places = [], []
    for c in range(3):
        for i in range(7):
            rows.append((f"s{c}{i}", f"{words[i]} {words[(i + c) % 12]} case {c} {i} of {words[(3 * i + c) % 12]}", [f"{words[i]} a", "b", "c", f"d{i}"], "train", i % 4, f"sub{i % 2}"))
            places.append((f"s{c}{i}", c, "support"))
        rows.append((f"t{c}", f"{words[c]} new question {c}", ["yes", "no", "may", "be"], "test", 1))
        places.append((f"t{c}", c, "test"))
    rows.append(("copy", "fever NEW question 0!", ["yes", "no", "may", "be"], "train", 1))
    places.append(("copy", 0, "support"))
    return make_items(rows), spark.createDataFrame(places, "example_id string, client_id int, role string")


@pytest.mark.parametrize("arm", ["B0", "F1", "FD"])
def test_arm_flow(spark, make_items, arm):
    def echo():
        return lambda prompts: ["Final answer: B" if p.startswith("You are") and p.endswith("Answer:") else "?" for p in prompts]

    items, assigned = study(make_items, spark)
    rows = {r.example_id: r for r in evaluate.evaluate_arm(items, assigned, arm, "test", Config(), echo).collect()}
    assert set(rows) == {"t0", "t1", "t2"}
    for r in rows.values():
        assert (r.predicted, r.gold, r.stage) == (1, 1, "terminal_label")
        assert len(r.exemplar_ids) == (0 if arm == "B0" else 5)
        assert all(e.startswith(f"s{r.client_id}") for e in r.exemplar_ids) and "copy" not in r.exemplar_ids


def test_cohort_audit(spark, make_items):
    items, assigned = study(make_items, spark)
    config = Config()
    rows = evaluate.cohort_audit(items, assigned, "test", config).collect()
    assert len(rows) == 3 and not any(r.over_budget or r.capacity_failure for r in rows)
    tight = replace(config, evaluation=replace(config.evaluation, max_tokens=100, new_tokens=60))
    assert all(r.over_budget for r in evaluate.cohort_audit(items, assigned, "test", tight).collect())


def test_encoder_hook(spark):
    df = spark.createDataFrame([("ab",), (None,), ("",)], "t string")
    udf = models.encoder(lambda: lambda texts: [[float(len(t)), 1.0] for t in texts])
    assert [r[0] for r in df.select(udf(F.col("t"))).collect()] == [[2.0, 1.0], None, [0.0, 1.0]]
    counts = df.select(models.bag_of_hashes(F.col("t"))).first()[0]
    assert len(counts) == 16 and sum(counts) == 1.0
