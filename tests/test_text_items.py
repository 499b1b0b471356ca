import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.sources import items


def plain(value):
    value = unicodedata.normalize("NFKC", value).casefold()
    return " ".join(re.sub(r"[^\w\s]", " ", value).split())


CASES = ["  Vitamin-C?! ", "", "   ", "ﬁne ½ Ǆ", "Straße  İstanbul", "a_b—c d", "é", "😀 x", "①②", "\u001ca\u0085b", "TAB\there", "ΑΣ ς"]


def test_normalize_matches_definition(spark):
    df = spark.createDataFrame([(c,) for c in CASES] + [(None,)], "x string")
    got = [r[0] for r in df.select(text.normalize(F.col("x"))).collect()]
    assert got == [plain(c) for c in CASES] + [None]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(st.characters(min_codepoint=1, max_codepoint=0x85F, exclude_categories=["Cs", "Cn"]), max_size=30), min_size=1, max_size=40))
def test_normalize_random(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    got = dict(df.select("i", text.normalize(F.col("x"))).collect())
    assert got == {i: plain(v) for i, v in enumerate(values)}


def test_words_blank_optional_split(spark):
    df = spark.createDataFrame([("A a  b", "dev"), ("", "VAL"), (None, None), ("  ", "Train")], "x string, s string")
    rows = df.select(text.word_array(F.col("x")).alias("w"), text.word_set(F.col("x")).alias("d"), text.is_blank(F.col("x")).alias("b"), text.optional_text(F.col("x")).alias("o"), text.canonical_split(F.col("s")).alias("s")).collect()
    assert [r.w for r in rows] == [["a", "a", "b"], [], [], []]
    assert [r.d for r in rows] == [["a", "b"], [], [], []]
    assert [r.b for r in rows] == [False, True, True, True]
    assert [r.o for r in rows] == ["A a  b", None, None, None]
    assert [r.s for r in rows] == ["validation", "validation", None, "train"]


def test_labels(spark):
    df = spark.createDataFrame([("D",), (" b ",), ("3",), ("4",), ("x",), (None,), ("10",)], "v string")
    rows = df.select(items.label_index(F.col("v")).alias("a"), items.label_index(F.col("v"), base=1).alias("b")).collect()
    assert [r.a for r in rows] == [3, 1, 3, None, None, None, None]
    assert [r.b for r in rows] == [3, 1, 2, 3, None, None, None]


def test_adapters(spark):
    nested = spark.sql("select 'q1' id, named_struct('question','Q','options',map(' a','1','B','2','c','3','D','4'),'answer','C','explanation',' ') data, ' s ' source, cast(null as string) subject_name, cast(null as string) topic_name, 'dev' split")
    row = items.adapt_nested(nested, F.col("split")).first()
    assert (row.example_id, row.options, row.label, row.split, row.subject, row.topic, row.provenance_group, row.explanation) == ("q1", ["1", "2", "3", "4"], 2, "validation", "medicine", "unknown", "s", None)
    flat = spark.sql("select cast(null as string) id, 'Q \"x\"' question, 'a' opa, 'b' opb, 'c' opc, 'd' opd, 1 cop, 'S' subject_name, cast(null as string) topic_name, cast(null as string) source, 'ex' exam, cast(null as string) exp")
    row = items.adapt_flat(flat, F.lit("train")).first()
    import hashlib
    import json

    assert row.example_id == hashlib.sha256(json.dumps(['Q "x"', ["a", "b", "c", "d"]]).encode()).hexdigest()[:24]
    assert (row.label, row.provenance_group) == (1, "ex")


def test_rules_and_latest(spark, make_items):
    df = make_items([("a", "q", ["1", "2", "3", "4"], "train"), ("b", " ", ["1", "2", "3"], "x", 7), (None, None, None, None, None), ("c", "q", ["1", None, "3", "4"], "test")])
    broken = {r.example_id: r.v for r in df.select("example_id", items.violations().alias("v")).collect()}
    assert broken == {"a": [], "b": ["question", "options", "label", "split"], None: ["id", "question", "options", "label", "split"], "c": ["options"]}
    assert [r.example_id for r in items.items(df).collect()] == ["a"]
    assert items.items(df.where("false")).count() == 0
    with pytest.raises(Exception, match="breaks"):
        items.strict(df).collect()
    twice = spark.sql("select 'a' k, timestamp'2020-01-01' t, 1 v union all select 'a', timestamp'2021-01-01', 2 union all select 'a', null, 3")
    assert items.latest(twice, "k", "t").collect()[0].v == 2


def test_head_and_duplicates(spark, make_items):
    df = make_items([(f"i{i}", "q", ["1", "2", "3", "4"], "train" if i < 6 else "test") for i in range(9)])
    import hashlib

    first = sorted((f"i{i}" for i in range(6)), key=lambda i: hashlib.md5(f"20260901:limit:{i}".encode()).hexdigest()[:8])[:2]
    assert sorted(r.example_id for r in items.head_per_split(df, {"train": 2}).collect()) == sorted(first) + ["i6", "i7", "i8"]
    assert items.duplicate_ids(df.union(df.where("example_id = 'i3'"))).collect()[0].n_rows == 2
    with pytest.raises(ValueError):
        items.head_per_split(df, {"train": 0})


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"example_id":"x","question":"q","options":["1","2","3","4"],"label":1,"split":"train"}\n\n')
    assert items.read_jsonl(spark, str(tmp_path / "a.jsonl")).first().label == 1
    (tmp_path / "b.jsonl").write_text("{broken\n")
    with pytest.raises(Exception):
        items.read_jsonl(spark, str(tmp_path / "b.jsonl")).collect()


def test_items_as_json_lines(spark, make_items, tmp_path):
    df = make_items([("a", 'say "é"\n', ["1", None, "3", "4"], "train"), ("b", None, None, "test")])
    items.write_jsonl(df, str(tmp_path / "items"))
    assert sorted(map(str, items.read_jsonl(spark, str(tmp_path / "items")).collect())) == sorted(map(str, df.select(*[f.name for f in items.ITEM.fields]).collect()))
    (tmp_path / "bad.jsonl").write_text('{"example_id": "x"}\n\n{"example_id": \n')
    with pytest.raises(Exception, match="bad.jsonl"):
        items.read_jsonl(spark, str(tmp_path / "bad.jsonl")).collect()
