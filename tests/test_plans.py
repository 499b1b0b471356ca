import json

import pytest
from pyspark.sql import functions as F

from tessera.plans import catalog, pipeline
from tessera.plans.config import Config
from tessera.sources import manifest
from tessera.streaming import predictions


def test_config(tmp_path):
    c = Config.of({"data": {"clients": 7}, "retrieval": {"pools": [10, 20]}})
    c.check()
    assert c.data.clients == 7 and c.retrieval.pools == (10, 20) and c.hash() != Config().hash()
    with pytest.raises(ValueError, match="unknown"):
        Config.of({"data": {"nope": 1}})
    with pytest.raises(ValueError, match="confidence"):
        Config.of({"evaluation": {"confidence": 1.5}}).check()
    (tmp_path / "c.json").write_text('{"data": {"alpha": 2}}')
    assert Config.read(str(tmp_path / "c.json")).data.alpha == 2


def test_execute_resumes(tmp_path):
    ran, log = [], str(tmp_path / "log.jsonl")

    def fail():
        raise RuntimeError("no")

    first = pipeline.Step("a", lambda: ran.append("a"))
    with pytest.raises(RuntimeError):
        pipeline.execute([first, pipeline.Step("b", fail), pipeline.Step("c", lambda: ran.append("c"))], log)
    assert pipeline.states(log) == {"a": "done", "b": "failed"}
    with open(log, "a") as torn:
        torn.write('{"step": "c", "ev')
    assert pipeline.states(log) == {"a": "done", "b": "failed"}
    with open(log, "a") as torn:
        torn.write('ent": "begun"}\n')
    states = pipeline.execute([first, pipeline.Step("b", lambda: ran.append("b"), lambda: True), pipeline.Step("c", lambda: ran.append("c"))], log)
    assert ran == ["a", "c"] and states == {"a": "kept", "b": "kept", "c": "done"}
    pipeline.execute([first], log, force=True)
    assert ran == ["a", "c", "a"]


def test_changed_content_is_refused(spark, make_items, tmp_path):
    items = make_items([(f"e{i}", f"q{i}", ["1", "2", "3", "4"], "train") for i in range(8)])
    assignments = items.select("example_id", F.lit(3).alias("client_id"), F.lit("fit").alias("role"))
    for n, change in enumerate([("question", F.lit("other")), ("label", F.lit(2)), ("options", F.array(F.lit("x")))]):
        root = str(tmp_path / f"t{n}")
        manifest.materialize(items, assignments, root, config={})
        assert manifest.load(spark, root, config={}).count() == 8
        changed = items.withColumn(change[0], F.when(F.col("example_id") == "e3", change[1].cast(items.schema[change[0]].dataType)).otherwise(F.col(change[0])))
        assignments.join(changed, "example_id").write.mode("overwrite").partitionBy("client_id", "role").parquet(f"{root}/rows")
        with pytest.raises(ValueError, match="hash mismatch"):
            manifest.load(spark, root, config={})
    with pytest.raises(ValueError, match="twice"):
        manifest.materialize(items, assignments.unionAll(assignments), str(tmp_path / "twice"), config={})


def test_predictions_with_their_summary(spark, tmp_path):
    from tessera.sources import predictions as P

    rows = spark.createDataFrame([("F1", None, "test", "e1", 0, "S", 1, None, "unresolved", None, 0.5, "a\n\"b\"", 9, ["x"]), ("F1", 42, "test", "e2", 1, "S", 1, 1, "terminal_label", 1, None, None, 7, None)], P.FIELDS)
    root = str(tmp_path / "run")
    with pytest.raises(ValueError, match="summary"):
        P.load(spark, root)
    P.write(rows, root, rows.groupBy("arm").agg(F.count("*").alias("n")))
    assert sorted(map(str, P.load(spark, root).collect())) == sorted(map(str, rows.collect()))
    (tmp_path / "more.jsonl").write_text('{"prediction": {"arm": "F2", "gold": 3}, "extra": 1}\n\n{"arm": "F3", "gold": 2}\n')
    assert {(r.arm, r.gold) for r in P.read(spark, str(tmp_path / "more.jsonl")).collect()} == {("F2", 3), ("F3", 2)}
    spark.createDataFrame([('{"arm": "F9"}',)], "value string").write.mode("append").text(f"{root}/predictions")
    with pytest.raises(ValueError, match="not those"):
        P.load(spark, root)


def test_manifest_round_trip(spark, make_items, tmp_path):
    items = make_items([(f"e{i}", "q", ["1", "2", "3", "4"], "train") for i in range(20)])
    assignments = items.select("example_id", (F.length("example_id") % 2).alias("client_id"), F.lit("fit").alias("role"))
    root = str(tmp_path / "part")
    manifest.materialize(items, assignments, root, config={"a": 1})
    assert manifest.load(spark, root, config={"a": 1}).count() == 20
    with pytest.raises(ValueError, match="config"):
        manifest.load(spark, root, config={"a": 2})
    with pytest.raises(ValueError, match="allowed"):
        manifest.restamp(root, old={"a": 1}, new={"a": 2}, allowed={"b"})
    with pytest.raises(ValueError, match="nothing"):
        manifest.restamp(root, old={"a": 1}, new={"a": 1}, allowed={"a"})
    assert manifest.restamp(root, old={"a": 1}, new={"a": 2}, allowed={"a"})["changed"] == ["a"]
    manifest.restamp(root, old={"a": 1}, new={"a": 2}, allowed={"a"}, dry_run=False)
    assert manifest.load(spark, root, config={"a": 2}).count() == 20
    manifest.restamp(root, old={"a": 2}, new={"a": 1}, allowed={"a"}, dry_run=False)
    items.limit(1).withColumn("client_id", F.lit(1)).withColumn("role", F.lit("fit")).write.mode("append").partitionBy("client_id", "role").parquet(f"{root}/rows")
    with pytest.raises(ValueError, match="hash mismatch"):
        manifest.load(spark, root, config={"a": 1})
    with pytest.raises(ValueError, match="escapes"):
        manifest._marker("a/../b")


def test_prior_and_run_files(spark, tmp_path):
    priors = spark.createDataFrame([(0, "a", 0.5), (0, "b", 1.0), (1, "a", 0.0)], "client_id int, subject string, weight double")
    manifest.write_priors(priors, str(tmp_path / "p"))
    assert sorted(map(tuple, manifest.read_priors(spark, str(tmp_path / "p")).collect())) == sorted(map(tuple, priors.collect()))
    for status in ("completed", "failed"):
        manifest.append_run(spark, str(tmp_path), {"arm": "F0", "seed": 42, "status": status})
    assert manifest.read_runs(spark, str(tmp_path)).count() == 2
    assert manifest.object_hash({"b": 1, "a": "é"}) == manifest.object_hash({"a": "é", "b": 1})


def test_prepare_steps(spark, make_items, tmp_path):
    import random

    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    rows = [(f"{sp}{i}", " ".join(word() for _ in range(6)), [word() for _ in range(4)], sp, 1, f"s{i % 3}") for sp, n in (("train", 90), ("validation", 20), ("test", 20)) for i in range(n)]
    root = str(tmp_path / "out")
    pipeline.execute(pipeline.prepare_steps(spark, make_items(rows), root, Config()), str(tmp_path / "s.jsonl"))
    assert spark.read.parquet(f"{root}/rows").count() == 130


def test_streaming_accuracy(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    lines = [(1, "A", 0, 0, "00:10"), (1, "A", 0, 0, "00:20"), (2, "A", 1, 0, "00:30"), (3, "A", 1, None, "01:30")]
    (folder / "a.json").write_text("\n".join(json.dumps({"record_id": i, "arm": a, "gold": g, "predicted": p, "recorded_at": f"2024-01-01T{t}:00Z"}) for i, a, g, p, t in lines))
    stream = predictions.windowed_accuracy(predictions.read_predictions(spark, str(folder)))
    query = stream.writeStream.format("memory").queryName("acc").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    got = {r.start.strftime("%H"): (r.n_records, r.accuracy) for r in spark.table("acc").collect()}
    assert sorted(got.values()) == [(1, 0.0), (2, 0.5)]


def test_catalog_has_sql_for_known_queries():
    queries, sql = catalog.queries(), catalog.oracle_sql()
    assert set(sql) <= set(queries)
    assert set(queries) - set(sql) <= {"normalize_exact_questions", "stable_ids", "bootstrap_fast", "bootstrap_hierarchical", "contrast_report", "rerank_placebo", "partition_roles"}
