import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import target_sample, vectors

SCHEMA = "vec_id bigint, vector array<float>, relevance double"


def clusters(n, seed=0, noise=0.02):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(n // 4, 64))
    x = np.repeat(centres, 4, axis=0) + noise * 4 * r.normal(size=(n // 4 * 4, 64))
    return x * r.uniform(0.1, 9, size=(len(x), 1))


def truth(x, ids, cosine=0.9, k=5):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    out = set()
    for i in range(len(x)):
        for j in np.argsort(-s[i], kind="stable")[:k]:
            if s[i, j] >= cosine:
                out.add((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return out


@pytest.mark.parametrize("array", [1536, 30, 6])
def test_pairs_against_brute_force(spark, array):
    x = clusters(600)
    ids = list(range(len(x)))
    df = spark.createDataFrame([(i, v.astype(np.float32).tolist(), None) for i, v in zip(ids, x)], SCHEMA)
    want = truth(x, ids)
    got = {tuple(r) for r in vectors.similar_pairs(df, array=array).collect()}
    assert len(got & want) / len(want) > 0.98 and len(got - want) <= 0.005 * len(want)


def test_unusable_repeated_and_tied(spark):
    one = [1.0] + [0.0] * 63
    rows = [(1, one, None), (1, one, 3.0), (2, [2.0] + [0.0] * 63, None), (3, [0.0] * 64, None), (4, [1.0] * 48, None), (5, None, None), (6, [None] + one[1:], None), (None, one, None), (7, [float("nan")] + one[1:], None)]
    rows += [(i, one, None) for i in range(10, 17)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as a", "2 as code", "3 as bucket")
    got = {(r.vec_id, r["rank"]): r.neighbour_id for r in vectors.neighbours(df).collect()}
    assert {got[(1, k)] for k in range(1, 6)} == {2, 10, 11, 12, 13} and got[(1, 1)] == 2 and got[(16, 1)] == 1
    assert {v for v, _ in got} == {1, 2, *range(10, 17)}
    assert vectors.neighbours(df.where("false")).count() == 0
    assert vectors.search(df.where("false")).count() == 0


def test_large_array_is_split(spark):
    x = clusters(600, seed=4)
    df = spark.createDataFrame([(i, v.astype(np.float32).tolist(), None) for i, v in enumerate(x)], SCHEMA)
    # Arrays of more than 40 vectors are compared in pairs of blocks.
    got = {tuple(r) for r in vectors.similar_pairs(df, large=40).collect()}
    want = truth(x, list(range(len(x))))
    assert len(got & want) / len(want) > 0.99


def test_copies_of_a_direction_cost_their_rows(spark):
    x = np.concatenate([clusters(120, seed=6), np.tile(clusters(4, seed=8)[:1], (200, 1)) * np.random.default_rng(1).uniform(1, 3, (200, 1))])
    ids = list(range(len(x)))
    df = spark.createDataFrame([(i, v.astype(np.float32).tolist(), None) for i, v in zip(ids, x)], SCHEMA).repartition(3)
    got = {}
    for r in vectors.near(df).collect():
        got.setdefault(r.vec_id, {})[r["rank"]] = r.neighbour_id
    for i in range(120, 320):
        assert [got[i][k] for k in range(1, 6)] == [j for j in range(120, 126) if j != i][:5]
    plain = {(r.vec_id, r.neighbour_id) for r in vectors.near(df, hot=10**9).collect()}
    assert {(a, b) for a in got for b in got[a].values()} == plain


@pytest.mark.parametrize("cosine,k,noise", [(0.9, 5, 0.02), (0.9, 3, 0.006), (0.8, 5, 0.1), (0.97, 5, 0.05)])
def test_windows_find_what_products_find(cosine, k, noise):
    r = np.random.default_rng(5)
    centres = r.normal(size=(30, 64))
    x = np.repeat(centres, 20, axis=0) + noise * 8 * r.normal(size=(600, 64))
    unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    ids = np.arange(600)
    i, j, c = vectors.near_pairs(ids, unit, None, cosine, k)
    s = unit @ unit.T
    np.fill_diagonal(s, -2)
    want = {(a, b) for a in range(600) for b in np.argsort(-s[a], kind="stable")[:k] if s[a, b] >= cosine}
    got = set(zip(i.tolist(), j.tolist()))
    assert len(got & want) >= 0.999 * len(want) and len(got) == len(i) <= len(want) + 3
    assert np.allclose(c, s[i, j], atol=1e-6)
    # Most pairs are never multiplied.
    windows = vectors.Windows(unit)
    q, _ = windows.collide(ids, windows.edges(np.float32(vectors.SPREAD * np.sqrt(0.2) / 8)))
    assert len(q) < 0.2 * 600 * 600 or noise < 0.01


def test_counts_in_bit_slices():
    r = np.random.default_rng(2)
    for n in (3, 7, 24, 32):
        bits = r.random((n, 5, 128)) < 0.7
        for least in (1, n // 2, n - 1, n):
            planes = []
            for b in bits:
                vectors._add(planes, np.packbits(b, axis=1, bitorder="little").view(np.uint64))
            hit = np.unpackbits(vectors._at_least(planes, least).view(np.uint8), axis=1, bitorder="little")
            assert (hit.reshape(5, 128) == (bits.sum(axis=0) >= least)).all()


def test_tables_do_not_grow():
    assert [vectors.plan(n, 64) for n in (0, 2000, 10**5, 10**6, 10**8, 10**12)] == sorted(vectors.plan(n, 64) for n in (0, 2000, 10**5, 10**6, 10**8, 10**12))
    assert vectors.plan(10**12, 64) == 64 and vectors.plan(0, 64) == 4
    for m in (4, 16, 64):
        assert vectors.arrays_of(np.random.default_rng(0).normal(size=(50, 64)), [vectors.projections(7, t, 64, m) for t in range(3)]).shape == (50, 9)


@pytest.mark.parametrize("block", [32768, 150])
def test_every_vector_has_its_neighbours(spark, block):
    # Unlike vectors: hardly a pair reaches the cosine of p4_found.
    x = np.random.default_rng(9).normal(size=(500, 64))
    rows = [(i, v.astype(np.float32).tolist(), None) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows + rows[:40] + [(7, rows[8][1], None)], SCHEMA)
    got = {}
    for r in vectors.neighbours(df, block=block).collect():
        got.setdefault(r.vec_id, {})[r["rank"]] = r.neighbour_id
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    s[7], s[:, 7] = np.maximum(s[7], s[8]), np.maximum(s[:, 7], s[:, 8])  # id 7 has the vector of 8 too
    np.fill_diagonal(s, -2)
    assert set(got) == set(range(500)) and all(set(g) == {1, 2, 3, 4, 5} for g in got.values())
    hits = sum(len(set(got[q].values()) & set(np.argsort(-s[q])[:5])) for q in got)
    assert hits >= 5 * len(got) - 3


def test_search_is_exact(spark):
    x = clusters(500, seed=2, noise=0.5)
    df = spark.createDataFrame([(i, v.astype(np.float32).tolist(), None) for i, v in enumerate(x)] + [(0, x[0].astype(np.float32).tolist(), 1.0)], SCHEMA).repartition(5)
    got = {}
    for r in vectors.search(df, every=10, block=16).collect():
        got.setdefault(r.vec_id, {})[r["rank"]] = r.neighbour_id
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    assert set(got) == set(range(0, 500, 10))
    hits = sum(len(set(got[q].values()) & set(np.argsort(-s[q])[:5])) for q in got)
    assert hits >= 5 * len(got) - 1


TARGET = "split string, subject string, target_share double, min_rows bigint, sample_size bigint"


def items(spark):
    rows = [(f"t{i}", "Train" if i % 2 else "TRAIN", "Big") for i in range(900)] + [(f"s{i}", "train", "Small") for i in range(7)] + [(f"v{i}", "dev", "Big") for i in range(50)]
    rows += [("t0", "train", "Big"), (None, "train", "Big"), ("n", None, "Big"), ("m", "train", None)]
    return spark.createDataFrame(rows, "example_id string, split string, subject string").selectExpr("*", "1 as quota", "2 as u", "3 as bin")


def test_targets(spark):
    targets = spark.createDataFrame([("train", "Big", 0.9, 1, 100), ("train", "Small", 0.01, 10, 100), ("train", "Missing", 0.09, 0, 100), ("train", "big", 0.0, 0, 100), ("validation", "Big", 0.1000000000001, 0, 100), ("test", "Big", None, None, 100)], TARGET)
    report = {(r.split, r.subject): (r.quota, r.available, r.deficit) for r in target_sample.target_report(items(spark), targets).collect()}
    assert report == {("train", "Big"): (90, 900, 0), ("train", "Small"): (10, 7, 3), ("train", "Missing"): (9, 0, 9), ("train", "big"): (0, 0, 0), ("validation", "Big"): (10, 50, 0), ("test", "Big"): (0, 0, 0)}
    assert {tuple(r) for r in target_sample.unmet(items(spark), targets).collect()} == {("train", "Small"), ("train", "Missing")}
    for seed in range(3):
        rows = target_sample.draw(items(spark), targets, seed=seed).collect()
        assert len({(r.split, r.example_id) for r in rows}) == len(rows)
        counts = {}
        for r in rows:
            counts[(r.split, r.subject)] = counts.get((r.split, r.subject), 0) + 1
        assert counts == {("train", "Big"): 90, ("train", "Small"): 7, ("validation", "Big"): 10}
    assert target_sample.draw(items(spark).where("false"), targets).count() == 0
    assert target_sample.target_report(items(spark), targets.where("false")).count() == 0


def test_deficits_are_those_of_the_sample(spark, monkeypatch):
    targets = spark.createDataFrame([("train", "Big", 0.9, 1, 100), ("train", "Small", 0.01, 5, 100)], TARGET)
    assert target_sample.unmet(items(spark), targets).count() == 0
    draw = target_sample.draw
    monkeypatch.setattr(target_sample, "draw", lambda *a, **k: draw(*a, **k).where("example_id <> 's1' AND example_id <> 's2' AND example_id <> 's3'"))
    assert {tuple(r) for r in target_sample.unmet(items(spark), targets).collect()} == {("train", "Small")}
    assert {(r.subject, r.available) for r in target_sample.target_report(items(spark), targets).where("deficit > 0").collect()} == {("Small", 7)}


def test_draw_is_even(spark):
    targets = spark.createDataFrame([("train", "Big", 1.0, 0, 300)], TARGET)
    taken = [{r.example_id for r in target_sample.draw(items(spark), targets, seed=s).collect()} for s in range(6)]
    assert all(len(t) == 300 for t in taken) and len(set.union(*taken)) > 700
