from tessera.plans import staging


def test_stage_round_trip(spark):
    df = spark.range(10).withColumnRenamed("id", "x")
    assert sorted(r.x for r in staging.stage(df, "t").collect()) == list(range(10))
    assert staging.shared_dir(spark) == staging.shared_dir(spark)


def test_stage_writes_below_the_shared_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(staging, "shared_dir", lambda _: f"file://{tmp_path}")
    df = spark.range(3)
    staged = staging.stage(df.where("id < 0"), "empty")
    assert staged.count() == 0 and staged.schema.simpleString() == df.schema.simpleString()
    assert list((tmp_path / "tessera").iterdir())
