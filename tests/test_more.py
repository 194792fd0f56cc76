"""Tokenization, edit programs, passages and other late additions."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import adapters, evaluate, tokenize, vocab

FILE = "/opt/tokenizers/byte_bpe_50k.json"


@pytest.mark.skipif(not Path(FILE).exists(), reason="no tokenizer file")
def test_tokenize_reuses(spark):
    docs = spark.createDataFrame([("a", "hello world"), ("b", None), ("c", "天地<|endoftext|>")], "doc_id string, text string")
    none = spark.createDataFrame([], "doc_id string, text_hash string, tokenizer_sha256 string, plan int, input_ids array<bigint>, token_count bigint")
    one = tokenize.tokenize_with_reuse(docs, none, FILE, "h")
    assert not one.where("reused").count() and {r.doc_id: r.token_count for r in one.collect()}["b"] == 0
    old = one.select("doc_id", "text_hash", F.lit("h").alias("tokenizer_sha256"), F.lit(1).alias("plan"), "input_ids", "token_count")
    two = tokenize.tokenize_with_reuse(docs.withColumn("text", F.when(F.col("doc_id") == "a", "new").otherwise(F.col("text"))), old, FILE, "h")
    assert {r.doc_id for r in two.where("reused").collect()} == {"b", "c"}
    assert {r.doc_id for r in tokenize.round_trip(docs, FILE).where("exact").collect()} == {"a", "b", "c"}


def test_end_marks(spark):
    x = spark.createDataFrame([([1, 9], [1, 9]), ([1, 9], [1, -100]), ([1, 2], [1, 2]), ([9] + [1] * 9, [9] + [1] * 9)], "i array<int>, l array<int>")
    assert [r[0] for r in x.select(tokenize.end_mark_evidence(F.col("i"), F.col("l"), 9)).collect()] == [None, "not_supervised", "no_end_mark", "far_from_tail"]


def test_edit_programs(spark):
    ops = {"Delete": [0], "Insert": [{"pos": 2, "label": ["丁", "戊"]}], "Modify": [{"pos": 1, "label": ["己", "庚"]}]}
    x = spark.createDataFrame([(1, "甲乙丙", json.dumps(ops)), (2, "甲乙", json.dumps({"Switch": [1, 0]})), (3, "甲", "broken"), (4, None, None)], "id long, src string, operations string")
    got = {r.id: list(r.references) for r in adapters.edit_programs(x).collect()}
    assert got == {1: ["己丙丁", "庚丙丁", "己丙戊", "庚丙戊"], 2: ["乙甲"], 3: [], 4: [""]}


def test_passages_and_owners(spark):
    t = "一二三四五。六七八九十。" * 3 + "\n\n短"
    got = adapters.split_passages(spark.createDataFrame([(1, t), (2, None)], "id long, text string"), 5, 14).collect()
    assert all(5 <= len(r.text) <= 14 and r.text.endswith("。") for r in got) and "".join(r.text for r in got) == "一二三四五。六七八九十。" * 3
    hits = spark.createDataFrame([("a", "c1", "x"), ("b", "c1", "x"), ("b", "c2", "y"), ("c", "c1", "x"), ("c", "c2", "x")], "row_id string, chapter_id string, book string")
    own = spark.createDataFrame([("a", None), ("b", "y"), ("c", "x"), ("d", "x")], "row_id string, book string")
    assert {r.row_id: (r.resolution, r.chapter_id) for r in adapters.chapter_owners(hits, own).collect()} == {"a": ("unique", "c1"), "b": ("same_book", "c2"), "c": ("ambiguous", None), "d": ("none", None)}
    s = spark.createDataFrame([("漢",), ("汉",), ("漢汉",), ("一",), (None,)], "t string").select(adapters.script_class(F.col("t"), "漢", "汉"))
    assert [r[0] for r in s.collect()] == ["traditional", "simplified", "mixed_or_ambiguous", "shared_or_unknown", None]


def test_homophones_and_features(spark):
    rows = spark.createDataFrame([("k", "在甲", "再乙"), ("k", "x", "xy")], "k string, src string, tgt string")
    r = evaluate.homophone_shares(rows, spark.createDataFrame([("在", "zai"), ("再", "zai"), ("甲", "jia")], "char string, reading string"), ["k"]).first()
    assert (r.edits, r.homophones) == (2, 1)
    f = vocab.feature_pairs(spark.createDataFrame([("甲", [3, 1, 4], [True, True, False], "p")], "char string, ids array<int>, mask array<boolean>, field string"))
    assert [tuple(x) for x in f.collect()] == [("甲", "p:3")]
