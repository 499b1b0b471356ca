import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import ngrams, packing, reading_level, tokens, truncation

RECORD = "record_id bigint, arm string, example_id string, generated_text string"
FINISHED = ["A", "**B**", "(C)", "Answer D", "Final answer: B", "x y.\nFINAL ANSWER : c)", "It follows.", 'He said "stop."', "Vitamin C 5 mg", "No option fits", "none of the above.", '{"answer": "A"}', "Is it so?", "これで終わり。", "1. first\n2. second."]
CUT = ["It follows that the", "A value of approx.", "compare zinc, i.e.", "Fever above 38.", '{"answer": ', '{"answer": "A", "reason": "So', "The end…", "The end...", "The end. [...]", "The end. [cut]", "Reason.\nFinal answer:", "Vitamin C 5", "Because of (not ", "Reason.\nFinal ans"]

# What other replies of the corpus say about approx., i.e., 38. and a short statement.
EVIDENCE = ["A value of approx. 4 mg supports this.", "Compare zinc, i.e. look at it.", "Fever above 38.5 is high. It rose.", "No option fits"]


def test_ends(spark, make_items):
    items = make_items([("i", "q", ["Vitamin C 5 mg", "b", None, "d"], "test"), ("j", None, None, "test")])
    rows = [(n, "F", "i", t) for n, t in enumerate(FINISHED)] + [(100 + n, "C", "i", t) for n, t in enumerate(CUT)] + [(200, "N", "i", None), (201, "N", "i", " \n"), (202, "N", "zz", "Vitamin"), (203, None, None, "Ends well."), (100, "C", "i", CUT[0])]
    rows += [(300 + n, "E", "j", t) for n, t in enumerate(EVIDENCE)]
    df = spark.createDataFrame(rows, RECORD).selectExpr("*", "1 as state", "'v' as value", "2 as text")
    got = {r.record_id for r in truncation.truncated(df, items).collect()}
    assert got == {100 + n for n in range(len(CUT))} | {202}
    report = {r.arm: (r.records, r.truncated) for r in truncation.truncation_report(df, items).collect()}
    assert report["F"] == (len(FINISHED), 0) and report["C"] == (len(CUT), len(CUT)) and report["N"] == (1, 1)
    assert truncation.truncated(df.where("false"), items).count() == 0
    assert {r.record_id for r in truncation.truncated(df, items.where("false")).collect()} == got | {8}


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_strict_prefixes(spark, parts, monkeypatch):
    r = random.Random(parts)
    values = ["".join(r.choice("ab ") for _ in range(r.randint(0, 7))) for _ in range(200)] + ["é", "é1", None]
    monkeypatch.setattr(truncation, "VALUES_A_PART", 200 // parts)
    got = {x.value: x.has_longer for x in truncation.strict_prefixes(spark.createDataFrame([(v,) for v in values], "value string")).collect()}
    distinct = {v for v in values if v}
    assert got == {v: any(o != v and o.startswith(v) for o in distinct) for v in distinct}


def cuts(spark, rows, items):
    df = spark.createDataFrame([(n, "a", i, t) for n, (i, t) in enumerate(rows)], RECORD)
    return {rows[r.record_id][1] for r in truncation.truncated(df, items).collect()}


def test_the_corpus_decides(spark, make_items):
    rows = [("i", "Not enough data"), ("j", "Not enough data"), ("k", "One item alone says so")]
    rows += [("i", "Fever above"), ("j", "Fever above"), ("k", "Fever above all else is odd.")]  # a strict prefix, at any number of items
    rows += [("i", "It hurts. Could this b"), ("j", "It swells. Could this b"), ("k", "Could this be so? Option b is odd.")]  # a strict prefix of its last words
    rows += [("i", "No option fi"), ("j", "No option fits"), ("k", "No option fits")]
    rows += [("i", "Ends in the middle of"), ("j", "Is in the middle of"), ("k", "Look in the middle of it. See the middle of it. Or the middle of that.")]  # goes on more often
    assert cuts(spark, rows, make_items([])) == {"One item alone says so", "Fever above", "It hurts. Could this b", "It swells. Could this b", "No option fi", "Ends in the middle of", "Is in the middle of"}


def test_a_cut_that_recurs_is_a_cut(spark, make_items):
    # One option cut at a field limit over several seeds, however many.
    items = make_items([("i", "q", ["Vitamin C 5 mg", "b", "c", "d"], "test")])
    for n in (2, 3, 30):
        rows = [("i", "Vitamin C 5 m")] * n + [("i", "No option fits"), ("j", "No option fits")] * n
        assert cuts(spark, rows, items) == {"Vitamin C 5 m"}


def test_broken_characters_and_very_long_words(spark, make_items):
    assert cuts(spark, [("i", "Above 38 \ufffd"), ("i", "x" * 200_000), ("j", "y" * 100_000 + "."), ("k", "\n\n.\n")], make_items([])) == {"Above 38 \ufffd", "x" * 200_000}


def test_token_ids_equal_direct_encoding(spark):
    enc = tokens.encoder()
    r = random.Random(2)
    texts = [None, "", " ", "plain text", "<|endoftext|>", "a" * 9000, "漢字" * 3000, "é" * 7, "word " * 4000, "".join(r.choice("ab c1.\n'’é漢 ") for _ in range(20000)), "".join(r.choice("abcdefgh") for _ in range(20000))]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(3, "plain text", "x")], "doc_id bigint, text string, ids string")
    for long in (1 << 14, 1000):
        got = tokens.token_ids(df, long=long).collect()
        assert len(got) == len(texts) + 1
        for row in got:
            assert row.ids == (enc.encode_ordinary(texts[row.doc_id]) if texts[row.doc_id] else []), row.doc_id
    assert tokens.token_ids(df.where("false")).count() == 0


def test_long_rows_with_equal_or_null_ids(spark):
    enc = tokens.encoder()
    r = random.Random(4)
    a, b, c = ("".join(r.choice("ab c1.é漢 ") for _ in range(n)) for n in (2500, 3300, 4000))
    rows = [(1, a), (1, a), (2, a), (2, b), (None, b), (None, c), (None, c), (None, "short"), (3, c)]
    got = tokens.token_ids(spark.createDataFrame(rows, "doc_id bigint, text string"), long=1000).collect()
    assert sorted((x.doc_id or 0, x.ids) for x in got) == sorted((i or 0, enc.encode_ordinary(t)) for i, t in rows)


def test_join_halves_random():
    enc = tokens.encoder()
    r = random.Random(7)
    pieces = ["a", "B", "é", " ", "  ", "\n", "'s", "'ll", "12", ".", "!!", "🙂", "word", " the"]
    for _ in range(3000):
        text = "".join(r.choice(pieces) for _ in range(r.randint(1, 300)))
        k = r.randint(0, len(text))
        assert tokens.join_halves(enc, text[:k], enc.encode_ordinary(text[:k]), text[k:], enc.encode_ordinary(text[k:])) == enc.encode_ordinary(text)
    # Runs that the pattern does not split: each kind is joined by its tokens.
    for unit in ("a", "abc", "é", "漢", "7", "31", " ", "\n", "!", "-=", "\u200d", "🙂", "\t "):
        for n in (700, 1501):
            text = r.choice(["", "x ", "9"]) + unit * n + r.choice(["", " y", "3", "\n"])
            k = r.randint(1, len(text) - 1)
            assert tokens.join_halves(enc, text[:k], enc.encode_ordinary(text[:k]), text[k:], enc.encode_ordinary(text[k:])) == enc.encode_ordinary(text), (unit, n, k)


def test_packing_is_whole(spark):
    r = random.Random(5)
    docs = [(i, " ".join(r.choice(["one", "two", "three", "paracetamol"]) for _ in range(r.choice([3, 30, 200, 700]))), r.choice(["big", "big", "s", None])) for i in range(300)]
    docs += [(900, None, "s"), (901, "", "s"), (902, "word " * 5000, "big")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string").selectExpr("*", "1 as piece", "2 as tokens", "3 as block")
    enc = tokens.encoder()
    n = {i: len(enc.encode_ordinary(t)) for i, t, _ in docs if t}
    for block in (512, 2):
        rows = packing.pack(df, capacity=1000, block=block).collect()
        per = {}
        for x in rows:
            per.setdefault(x.container_id, []).append(x)
        assert max(sum(x.tokens for x in c) for c in per.values()) <= 1000
        placed = {}
        for x in rows:
            placed[x.doc_id] = placed.get(x.doc_id, 0) + x.tokens
            assert x.n_tokens == n[x.doc_id] and (x.n_tokens > 1000 or x.tokens == x.n_tokens)
        assert placed == n
        assert sum(n.values()) / (len(per) * 1000) > 0.95
    assert {x.doc_id for x in packing.oversized(df, capacity=1000).collect()} == {i for i, k in n.items() if k > 1000}
    assert packing.pack(df.where("false")).count() == 0
    assert packing.fill_report(df.where("false")).first().containers == 0


def test_packing_follows_given_targets(spark):
    r = random.Random(8)
    docs = [(i, " ".join(r.choice(["one", "two", "three"]) for _ in range(r.choice([20, 40, 60]))), "ab"[i % 2] if i % 10 else None) for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 0.6), ("b", 0.2), ("b", 0.3), (None, 0.1), ("c", 0.0)], "source string, target_share double")
    rows = packing.pack(df, targets=targets, capacity=600, block=64).where("sequence LIKE '0-%' AND slot < 20").collect()
    t = {s: sum(x.tokens for x in rows if x.source == s) for s in ("a", "b", None)}
    assert abs(t["a"] / sum(t.values()) - 0.6) < 0.03 and abs(t["b"] / sum(t.values()) - 0.3) < 0.03
    report = {x.source: x for x in packing.mixture_report(df, capacity=600, run=8).collect()}
    assert set(report) == {"a", "b", None} and all(x.mean_drift < 0.05 and x.runs > 5 for x in report.values())
    assert packing.mixture_report(df.where("false")).count() == 0


def test_deficits_follow_shares():
    items = [(100, "a")] * 300 + [(100, "b")] * 100
    containers = packing.fill_block(items, {"a": 0.75, "b": 0.25}, {}, 800)
    first = [sum(items[i][1] == "a" for i in c) for c in containers[:40]]
    assert set(first) == {6} and sum(map(len, containers)) == 400


LEVEL_WORDS = {"primary": "put the cream on your arm and rest".split(), "secondary": "the kidney filters blood when a patient had dizziness".split(), "undergraduate": "renal flow falls since membrane potential rises in the affected organ".split(), "specialist": "notwithstanding pharmacokinetic seroconversion attenuated phosphorylation thereby implicating bioavailability".split()}


def documents(spark, n=120, seed=3):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        level = ngrams.LEVELS[i % 4]
        text = " ".join(r.choice(LEVEL_WORDS[level]) for _ in range(60))
        docs.append((i, text.upper() if i % 3 else text, ["en", "en", "EN", "de", None][i % 5], "s"))
        if i % 2 == 0 or i < 40:
            labels.append((i, level if r.random() > 0.04 else "primary", "p"))
    docs += [(900, None, "en", "s"), (901, "", "en", "s"), (902, "short", "en", None), (903, "!!! " * 60, "en", "s")]
    labels += [(900, "specialist", "p"), (4, None, "p"), (8, "expert", "p"), (7777, "primary", "p")]
    return spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id bigint, reading_level string, rater string")


def test_reading_levels(spark):
    docs, labels = documents(spark)
    rows = {r.doc_id: r for r in reading_level.graded(docs.selectExpr("*", "1 as n", "2 as difficulty"), labels).collect()}
    assert len(rows) == 124
    judged = [r for r in rows.values() if r.doc_id < 120 and r.lang in ("en", "EN")]
    assert sum(r.reading_level == ngrams.LEVELS[r.doc_id % 4] for r in judged) / len(judged) > 0.95
    assert all(rows[i].reading_level is None for i in (900, 901, 903)) and all(r.reading_level is None for r in rows.values() if r.lang not in ("en", "EN"))
    found = {r.doc_id for r in reading_level.demanding(docs, labels).collect()}
    assert found == {r.doc_id for r in judged if r.lang == "en" and r.doc_id % 4 == 3}
    assert reading_level.demanding(docs, labels.where("false")).count() == 0
    assert reading_level.graded(docs.where("false"), labels).count() == 0
    assert reading_level.profile(docs, labels).agg(F.sum("texts")).first()[0] == 124


def test_texts_without_a_language_are_graded(spark):
    docs, labels = documents(spark)
    german = " ".join(["die niere filtert das blut wenn ein patient schwindel hatte"] * 6)
    more = spark.createDataFrame([(950, german, None, "g"), (951, german, "und", "g"), (952, "the kidney filters blood when a patient had dizziness", " UND ", "g"), (953, "put the cream on your arm and rest", "", "g"), (954, german, "de", "g")], docs.schema)
    rows = {r.doc_id: r for r in reading_level.graded(docs.unionAll(more), labels, unnamed=True).collect()}
    unnamed = [r for r in rows.values() if r.doc_id < 120 and r.lang is None]
    assert len(unnamed) == 24 and sum(r.reading_level == ngrams.LEVELS[r.doc_id % 4] for r in unnamed) >= 22
    assert [rows[i].reading_level for i in (950, 951, 952, 953, 954)] == [None, None, "secondary", "primary", None]
    none = {r.source: r.texts for r in reading_level.profile(docs.unionAll(more), labels).where("reading_level is null").collect()}
    assert none["g"] == 3 and none["s"] == 24 + 3


def test_isotonic_is_monotone_and_optimal():
    import numpy as np

    x, y = np.array([3.0, 1, 2, 2, 4]), np.array([1.0, 0, 3, 1, 2])
    knots, values = ngrams.isotonic(x, y)
    assert list(knots) == [1, 2, 3, 4] and list(values) == [0, 5 / 3, 5 / 3, 2]
