import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bitmap, canonical, cross_split, near_duplicates, setjoin
from tests.conftest import ITEM


def words(*texts):
    return frozenset(w for t in texts if t is not None for w in re.sub(r"[^\w\s]", " ", unicodedata.normalize("NFKC", t).casefold()).split())


def corpus(n, seed, vocabulary=60, size=(4, 40)):
    r = random.Random(seed)
    names = [f"w{i}" for i in range(vocabulary)]
    rows = []
    for i in range(n):
        if rows and r.random() < 0.5:
            q = r.choice(rows)[1].split()
            for _ in range(r.randint(0, max(1, len(q) // 8))):
                k = r.randrange(len(q) + 1)
                q[k : k + r.randint(0, 1)] = [r.choice(names)] * r.randint(0, 1)
            r.shuffle(q)
        else:
            q = [r.choice(names) for _ in range(r.randint(*size))]
        rows.append((f"id{i:04d}", " ".join(q) or "w0", [r.choice(names) for _ in range(r.choice([0, 4, 4]))], r.choice(["train", "Dev", "TEST"])))
    return rows


def brute(rows, num, den):
    sets = [(i, words(q, *(o or [])), s) for i, q, o, s in rows]
    out = {}
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and len(x & y) * den >= len(x | y) * num:
                out[tuple(sorted((sets[a][0], sets[b][0])))] = (sets[a][2] == "train") != (sets[b][2] == "train")
    return out


@pytest.mark.parametrize("seed,vocabulary,threshold", [(1, 60, (4, 5)), (2, 12, (4, 5)), (3, 300, (3, 5)), (4, 40, (9, 10)), (5, 200, (1, 1))])
def test_joins_equal_brute_force(spark, make_items, seed, vocabulary, threshold):
    rows = corpus(160, seed, vocabulary)
    want = brute(rows, *threshold)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "23")
    df = make_items(rows)
    got = {tuple(r) for r in near_duplicates.near_duplicate_pairs(df, threshold).collect()}
    assert got == set(want)
    across = {tuple(r) for r in cross_split.overlap_pairs(df, threshold).collect()}
    assert across == {p for p, other in want.items() if other}


@pytest.mark.parametrize("variants,step", [(0, 1.25), (1, 1.5), (2, 2.0), (0, 3.0)])
def test_signatures_always_share_a_key(variants, step):
    r = np.random.default_rng(0)
    rarity = r.integers(0, 200, setjoin.RARITY).astype(np.int16)
    tried = 0
    for _ in range(1500):
        a = r.choice(2**40, size=r.integers(1, 70), replace=False).astype(np.uint64)
        keep = a[r.random(len(a)) > r.choice([0.0, 0.05, 0.12])]
        b = np.unique(np.concatenate([keep, r.choice(2**40, size=r.integers(0, 8)).astype(np.uint64)]))
        shared = len(np.intersect1d(a, b))
        if not len(b) or shared * 5 < (len(a) + len(b) - shared) * 4:
            continue
        tried += 1
        flat, offsets = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
        for deal in (0, 1):
            sig, owner, gap = setjoin.signatures(flat, offsets, 4, 5, variants=variants, step=step, rarity=rarity, deal=deal)
            one, two = {(s, g) for s, o, g in zip(sig, owner, gap) if o == 0}, {(s, g) for s, o, g in zip(sig, owner, gap) if o == 1}
            assert any((s, False) in two or (not g and (s, True) in two) for s, g in one)
        p = setjoin.parities(flat, offsets)
        assert int(p[0] ^ p[1]).bit_count() * 9 <= len(a) + len(b)
    assert tried > 300


def test_signatures_a_set_do_not_grow_with_the_data():
    r = np.random.default_rng(1)
    per = []
    for n in (200, 4000):
        offsets = np.arange(n + 1) * 42
        sig, _, _ = setjoin.signatures(r.choice(2**60, size=42 * n).astype(np.uint64), offsets, 4, 5, variants=1, step=1.5)
        per.append(len(sig) / n)
    assert abs(per[0] - per[1]) < 0.5 and per[1] < 32


def test_entries_survive_packing():
    r = np.random.default_rng(3)
    n = 5000
    sig, cls, parity = (r.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(3))
    size, flags = r.integers(1, 20000, n), r.integers(0, 6, n).astype(np.uint8)
    sent = list(setjoin.packed(sig, cls, parity, size, flags, 7))
    assert {p for p, _ in sent} <= set(range(7))
    got = setjoin.unpacked([d for _, d in sent])
    want = (sig >> np.uint64(24), cls >> np.uint64(24), parity, np.minimum(size, setjoin.WIDEST), flags)
    assert sorted(zip(*(x.tolist() for x in got))) == sorted(zip(*(x.tolist() for x in want)))
    assert sum(len(d) for _, d in sent) < 20.5 * n


@pytest.mark.parametrize("between", [False, True])
def test_compare_equals_all_pairs(between):
    r = np.random.default_rng(4)
    n = 900
    sig, cls = r.choice([5] * 80 + [9] * 80 + [11] * 80 + [*range(100, 300)], n).astype(np.uint64), r.integers(0, 120, n).astype(np.uint64)
    parity = r.choice(np.array([0, 1, 3, 2**40, 2**64 - 1], np.uint64), 120)[cls.astype(int)]
    size, flags = r.choice([20, 22, 40, setjoin.WIDEST], 120)[cls.astype(int)], (r.choice([2, 4], n) if between else r.integers(0, 2, n)).astype(np.uint8)
    pairs, (over, _, _) = setjoin.compare(sig, cls, parity, size.astype(np.uint16), flags, 4, 5, between_roles=between, hot=10**6)
    want = set()
    for i in range(n):
        for j in range(n):
            if sig[i] == sig[j] and cls[i] != cls[j] and int(parity[i] ^ parity[j]).bit_count() * 9 <= int(size[i] + size[j]):
                if max(size[i], size[j]) == setjoin.WIDEST or min(size[i], size[j]) * 5 >= max(size[i], size[j]) * 4:
                    if between and flags[i] == 2 and flags[j] == 4:
                        want.add((int(cls[i]), int(cls[j])))
                    if not between and not (flags[i] & flags[j] & 1):
                        want.add((int(min(cls[i], cls[j])), int(max(cls[i], cls[j]))))
    assert set(zip(*pairs.tolist())) == want and not len(over)
    _, (over, signature, role) = setjoin.compare(sig, cls, parity, size.astype(np.uint16), flags, 4, 5, between_roles=between, hot=50)
    assert len(over) > 50 and set((signature.view(np.uint64) >> np.uint64(24)).tolist()) <= {5, 9, 11}


@pytest.mark.parametrize("hot", [1, 6])
@pytest.mark.parametrize("roles", [False, True])
def test_hot_buckets_lose_nothing(spark, make_items, monkeypatch, hot, roles):
    rows = corpus(220, 8, vocabulary=25, size=(8, 45))
    want = brute(rows, 4, 5)
    plain = setjoin.class_pairs
    monkeypatch.setattr(setjoin, "class_pairs", lambda *a, **k: plain(*a, **k, hot=hot))
    df = make_items(rows)
    if roles:
        assert {tuple(r) for r in cross_split.overlap_pairs(df).collect()} == {p for p, other in want.items() if other}
    else:
        assert {tuple(r) for r in near_duplicates.near_duplicate_pairs(df).collect()} == set(want)


def test_buckets_that_stay_large_are_joined(spark, make_items, monkeypatch):
    # One template with one word that differs: every signing keeps them together.
    rows = [(f"t{i:02d}", "always the same twelve words in each of these questions but for " + f"x{i}", [], "train" if i % 3 else "dev") for i in range(24)]
    plain = setjoin.class_pairs
    monkeypatch.setattr(setjoin, "class_pairs", lambda *a, **k: plain(*a, **k, hot=3))
    df = make_items(rows)
    assert near_duplicates.near_duplicate_pairs(df).count() == 24 * 23 // 2
    assert cross_split.overlap_pairs(df).count() == 8 * 16


def test_bitmap_has_no_false_negatives():
    keys = np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64)
    filled = np.zeros(bitmap.bits_for(5000) // 8, np.uint8)
    bitmap.add(filled, keys)
    assert bitmap.has(filled, keys).all() and bitmap.has(filled, keys + np.uint64(1)).mean() < 0.15
    assert bitmap.bits_for(10**15) == bitmap.MAX_BITS


EDGE = [
    ("a", "Hello,  world one two three four five six", ["x", None, "y"], 0, "train", "S", "t", None, None, None),
    ("a", "Hello,  world one two three four five six", ["x", None, "y"], 0, "train", "S", "t", None, None, None),
    ("b", "hello WORLD one two three four five six!", ["y", "x"], None, "val", None, None, None, None, None),
    ("c", "Hello world one two three four five seven six", ["X", "y"], 9, "test", "S", "t", "g", None, None),
    ("d", None, ["x"], 0, "train", "S", "t", None, None, None),
    ("e", "   ", ["x"], 0, "train", "S", "t", None, None, None),
    ("f", "hello", None, 0, "train", "S", "t", None, None, None),
    ("g", "?!", [], 0, "train", "S", "t", None, None, None),
    ("h", "!!!", [], 0, "test", "S", "t", None, None, None),
    (None, "hello", ["x"], 0, "train", "S", "t", None, None, None),
    ("i", "long " * 30000, ["x"], 0, "odd", "S", "t", None, None, None),
]


def test_edges_and_clashing_columns(spark):
    df = spark.createDataFrame(EDGE, ITEM).selectExpr("*", "1 as cls", "'z' as words", "2 as role", "3 as h64", "4 as eval_split")
    assert {tuple(r) for r in near_duplicates.near_duplicate_pairs(df).collect()} == {("a", "b"), ("a", "c"), ("b", "c")}
    assert {tuple(r) for r in cross_split.overlap_pairs(df).collect()} == {("a", "b"), ("a", "c")}
    assert {tuple(r) for r in canonical.copies(df).collect()} == {("a", "b"), ("g", "h")}
    assert {tuple(r) for r in canonical.collapsed(df).collect()} == {("a", 2), ("c", 1), ("g", 2), ("i", 1)}
    assert canonical.collisions(df).count() == 0
    links = {r.example_id: (r.class_id, r.class_records, r.linked_classes) for r in near_duplicates.near_duplicate_links(df).collect()}
    assert links["a"] == ("a", 2, 1) and links["b"] == ("a", 2, 1) and links["c"] == ("c", 1, 1)
    across = {(r.example_id, r.role): (r.class_id, r.equal_records, r.linked_classes) for r in cross_split.overlap_links(df).collect()}
    assert across[("a", 1)] == ("a", 1, 2) and across[("b", 2)] == ("a", 1, 1) and across[("c", 2)] == ("c", 0, 1)
    report = {(r.eval_split, r.provenance_group): (r.eval_records, r.overlapping_records, r.pairs) for r in cross_split.overlap_report(df).collect()}
    assert report == {("validation", None): (1, 1, 1), ("test", "g"): (1, 1, 1), ("test", None): (1, 0, 0)}


def test_empty_tables(spark):
    df = spark.createDataFrame([], ITEM)
    for found in (near_duplicates.near_duplicate_pairs(df), near_duplicates.near_duplicate_links(df), cross_split.overlap_pairs(df), cross_split.overlap_links(df), cross_split.overlap_report(df), canonical.copies(df), canonical.collapsed(df)):
        assert found.count() == 0


def test_hot_group_of_copies(spark, make_items):
    rows = [(f"h{i:03d}", "The same question, always." if i % 2 else "the SAME question always", ["a", "b", "c", "d"], "train") for i in range(120)] + corpus(60, 9)
    df = make_items(rows)
    keep = canonical.copies(df).where("keep_id = 'h000'")
    assert keep.count() == 119
    assert near_duplicates.near_duplicate_links(df).where("example_id = 'h007'").first().class_records == 120
    assert near_duplicates.near_duplicate_pairs(df).where(F.col("example_id_a").startswith("h")).count() == 120 * 119 // 2
