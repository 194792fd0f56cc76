"""Whole results where a cut once stood: more groups, strings, positions and messages than it let through."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from corpusloom import queries as core
from corpusloom import session
from corpusloom.functions import text as T
from corpusloom.operators import clean, decontaminate, dedup
from corpusloom.operators import select as sel


def test_holdout_sees_all_groups(spark, tmp_path):
    n = 110_000
    name = F.format_string("d%06d", F.col("id"))
    spark.range(n).select(F.col("id").cast("string").alias("id"), name.alias("doc"), F.concat(F.lit("b"), name).alias("book"), F.lit("c2m").alias("task")).write.parquet(str(tmp_path / "eligible.parquet"))
    got = {r.doc for r in core.queries()["sta8_dev_holdout"](spark, str(tmp_path)).collect()}
    assert got == {f"d{i:06}" for i in range(200)}


def test_holdout_matches_greedy(spark):
    r = random.Random(4)
    for docs, books, most in ((40, 6, 3), (15, 30, 2), (200, 3, 9)):
        rows = {(f"d{r.randrange(docs)}", f"b{r.randrange(books)}", r.choice("xyz")): r.randint(1, most) for _ in range(300)}
        groups = [{"doc": d, "book": b, "task": t, "n": n} for (d, b, t), n in rows.items()]
        frame = spark.createDataFrame([tuple(g.values()) for g in groups], "doc string, book string, task string, n long")
        for capacity in ({"x": 9, "y": 12, "none": 5}, {"x": 30, "y": 4, "z": 500}):
            assert sel.holdout(frame, capacity) == sel.holdout_groups(groups, capacity)


BOUNDARY = "row_id string, chapter string, book string, near_group string, translation string, text string"


def test_shared_span_off_the_stride(spark):
    text = "".join(chr(0x4E00 + i) for i in range(100))
    dev = spark.createDataFrame([("d", None, None, None, None, text)], BOUNDARY)
    train = spark.createDataFrame([(f"t{n}_{i}", None, None, None, None, "鿿" + text[i : i + n] + "鿾") for n in (23, 24, 34) for i in (1, 5, 11, 30)], BOUNDARY)
    got = dict(decontaminate.boundary_conflicts(train, dev).collect())
    assert got == {f"t{n}_{i}": "shared_24_char_span" for n in (24, 34) for i in (1, 5, 11, 30)}


def test_boundary_by_book_and_modern(spark):
    shape = BOUNDARY + ", modern string"
    own = {k: "".join(chr(0x4E00 + 200 * j + i) for i in range(60)) for j, k in enumerate("abcdefgh")}
    dev = [("d1", "c1", "b1", None, None, own["a"], own["b"]), ("d2", None, "b2", None, None, "短句也", None)]
    train = [("loose", None, "b1", None, None, "甲", None), ("back", "c9", "b2", None, None, "甲", None), ("apart", "c9", "b1", None, None, "甲", None)]
    train += [("holds", "c9", None, None, None, own["c"], own["d"] + own["b"]), ("within", "c9", None, None, None, own["c"], own["a"][3:20]), ("span", "c9", None, None, None, own["e"] + own["b"][5:30], own["f"])]
    train += [("first", "c9", None, None, None, own["a"][7:40] + own["g"], own["b"]), ("short", "c9", None, None, None, "前短，句也後", None), ("free", "c9", None, None, None, own["h"], own["a"][:7])]
    got = dict(decontaminate.boundary_conflicts(spark.createDataFrame(train, shape), spark.createDataFrame(dev, shape)).collect())
    assert got == {"loose": "book", "back": "book", "holds": "dev_text_in_train", "within": "train_text_in_dev", "span": "shared_24_char_span", "first": "shared_24_char_span", "short": "dev_text_in_train"}


def test_boundary_query_passes_book_and_modern(spark, tmp_path):
    text = {k: "".join(chr(0x4E00 + 200 * j + i) for i in range(60)) for j, k in enumerate("abcdefghij")}
    rows = [("d1", "c2m", "dev", "《書一》", "g1", "a", "b"), ("d2", "C2M", "dev", "書二", "unresolved:d2", "c", "d")]
    rows += [("t1", "c2m", "train", "書一 卷三", None, "e", "f"), ("t2", "c2m", "train", "書二", "g2", "g", "h"), ("t3", "punctuate", "train", "佚名", "g3", "i", "j"), ("t4", "m2c", "train", None, None, "i", "bj"), ("t5", "m2c", "train", "書一", "g5", "i", "j")]
    payload = lambda a, m: json.dumps({"ancient": text[a], "modern": "".join(text[c] for c in m)})
    frame = spark.createDataFrame([(i, t, s, b, g, None, payload(a, m)) for i, t, s, b, g, a, m in rows], "id string, task string, split string, book string, doc string, cluster string, payload string")
    frame.write.parquet(str(tmp_path / "eligible.parquet"))
    assert dict(core.queries()["dup22_boundary_conflicts"](spark, str(tmp_path)).collect()) == {"t1": "book", "t2": "book", "t4": "dev_text_in_train"}


def test_contained_passages_in_every_message(spark, tmp_path):
    item = [chr(0x4E00 + 100 * i) * 3 + "".join(chr(0x5000 + 60 * i + j) for j in range(40)) for i in range(5)]
    say = lambda *x: json.dumps({"messages": [{"role": r, "content": c} for r, c in x]})
    rows = [("first", "q" + item[0], say(("user", "q" + item[0]), ("assistant", "a"))), ("system", "q", say(("system", item[1]), ("user", "q"), ("assistant", "a"))), ("answer", "q", say(("user", "q"), ("assistant", "see " + item[2])))]
    rows += [("later", "q", say(("user", "q"), ("assistant", "a"), ("user", item[3] + "?"), ("assistant", "b " + item[4] + item[4]))), ("broken", item[0], '{"messages": ['), ("split", "q", say(("user", item[0][:20]), ("assistant", item[0][20:]))), ("none", None, None)]
    spark.createDataFrame(rows, "pool_id string, prompt string, payload string").write.parquet(str(tmp_path / "pool.parquet"))
    spark.createDataFrame(list(enumerate(item)), "item_id long, question string").write.parquet(str(tmp_path / "benchmark_items.parquet"))
    got = sorted(tuple(r) for r in core.queries()["dup19_contained_passages"](spark, str(tmp_path)).collect())
    assert got == [("answer", 2), ("broken", 0), ("first", 0), ("later", 3), ("later", 4), ("system", 1)]


def test_components_by_short_titles(spark, tmp_path):
    r = random.Random(8)
    edges = [(r.choice(["書", "短題", "四字之書", "五字的書名", f"長長的書名{i}"]) + r.choice(["", str(r.randrange(20))]), f"d{r.randrange(90)}") for i in range(120)]
    spark.createDataFrame([*edges, (None, "x"), ("x", None)], "book string, doc string").write.parquet(str(tmp_path / "eligible.parquet"))
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for b, d in edges:
        a, z = sorted((find("b:" + b), find("d:" + d)))
        parent[z] = a
    assert dict(core.queries()["dup15_components"](spark, str(tmp_path)).collect()) == {n: find(n) for n in parent}


def test_choices_by_every_way(spark):
    cases = {"B. 因为": "B", "答案是：C": "C", "我认为答案是选项 D": "D", "故选择：A": "A", "所以 C 选项正确": "C", "正确的选项是 B": "B", "答案应该为D": "D", "C符合题意": "C", "答案选项为（其中）B": "B", "content=x D y": "D", "先看A，再看B，C当选": "C", "先说A不对\n由此B 与 C 正确": "C", "应当是：D": "D", "不是：D": "D", "不是：D，是 A": "A", "（C）": "C", "没有": "Z", "": "Z", None: "Z"}
    got = [r[0] for r in spark.createDataFrame([(k,) for k in cases], "t string").select(T.choice(F.col("t"))).collect()]
    assert got == list(cases.values())


def test_overlength_and_audit(spark):
    rows = [(1, 5, 2), (2, 11, 2), (3, 5, 0), (4, None, None), (5, 10, 1)]
    got = dict(spark.createDataFrame(rows, "k int, n int, t int").select("k", clean.overlength(F.col("n"), F.col("t"), 10)).collect())
    assert got == {1: None, 2: "too_long", 3: "no_target", 4: "no_target", 5: None}
    m = lambda a, b: [("user", a), ("assistant", b)]
    cases = [
        (1, "c2m", "古文", "白话文", m("译：古文", "白话文"), []), (2, "c2m", "古文", "古文。", m("古文", "古文。"), ["translation_copies_source_review"]), (3, "punctuate", "古文也", "，古文", m("古文也", "，古文"), ["punctuation_changes_characters", "leading_punctuation_review"]),
        (4, "c2m", "古", "很长的白话文", m("古", "别的"), ["metadata_message_mismatch", "length_ratio_review"]), (5, None, None, " ", None, ["unexpected_message_roles", "metadata_message_mismatch", "empty_pair", "translation_copies_source_review"]),
    ]
    x = spark.createDataFrame([c[:5] for c in cases], "k int, task string, s string, t string, m array<struct<role:string,content:string>>")
    got = dict(x.select("k", clean.audit_flags(F.col("task"), F.col("s"), F.col("t"), F.col("m"))).collect())
    assert got == {c[0]: c[5] for c in cases}


def test_hot_content_and_rounds(spark, monkeypatch):
    monkeypatch.setattr(dedup, "HOT", 20)
    rows = [(f"d{i:03}", "same" if i % 3 == 0 else f"text {i % 50}", "a", i / 100) for i in range(150)] + [("null", None, "a", 1.0)]
    t = spark.createDataFrame(rows, "doc_id string, text string, source string, quality_prior double")
    best = {}
    for d, x, _, q in rows:
        if x is not None:
            best[x] = min(best.get(x, (9, "")), (-q, d))
    want = {d: best[x][1] for d, x, _, _ in rows if x is not None}
    assert {r.doc_id: r.kept_doc_id for r in dedup.exact_representatives(t, F.lit(0)).collect()} == want
    gone = {r.doc_id for r in dedup.rounds_removals([t.where("doc_id < 'd070'"), t.where("doc_id >= 'd070'").withColumn("extra", F.lit(1))], F.lit(0)).collect()}
    assert gone == {d for d, k in want.items() if d != k}
    y = spark.createDataFrame([("a", "x y z w v u t s r q", "en"), ("b", "x y z w v u t s r q", "en"), ("c", "x y z w v u t s r q", "zh"), ("d", "x y", None)], "doc_id string, text string, profile string")
    got = dict(dedup.near_clusters(y, ("zh",)).collect())
    assert got["a"] == got["b"] == "a" and got["c"] == "c" and got["d"] == "d"


def test_greedy_ties_do_not_follow_partitions(spark):
    rows = [(f"r{i}", "g", f"a{i % 3}", f"b{i % 4}", 1) for i in range(12)]
    one = spark.createDataFrame(rows, "id string, g string, a string, b string, o int")
    takes = {tuple(sorted(r.id for r in dedup.two_key_greedy(x, "g", "a", "b", ["o"]).collect())) for x in (one.repartition(1), one.repartition(5), spark.createDataFrame(rows[::-1], one.schema))}
    assert len(takes) == 1


def test_normalisation_is_done_once(spark, tmp_path):
    raw = ["a \u3000\r\nb\u200b\x00 ", "é\u0301 x\t\n\n", "", None, "\u2003\nplain\r"]
    t = spark.createDataFrame([(x,) for x in raw], "text string")
    want = [r[0] or "" for r in t.select(T.normalize_text(F.col("text"))).collect()]
    assert [r[0] for r in clean.normalized(t).collect()] == want
    t = spark.createDataFrame([("a", "字" * 30, "hanweb_hq", "x", "MIT", "zh", "general")], "doc_id string, text string, source string, source_path string, license string, language string, domain string")
    plan = clean.clean_and_tag(t, {"hanweb_hq": "curated_zh"}).where("reject_reason is null")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan


def test_long_texts_are_found_without_copies(spark):
    long = "".join(chr(0x4E00 + (i * 7919) % 20000) for i in range(100_000))
    texts = spark.createDataFrame([("long", long), ("none", "短文"), ("null", None)], "row_id string, text string")
    items = spark.createDataFrame([(1, long[40_000:40_100]), (2, long[99_950:]), (3, long[5:30] + "不"), (4, None)], "item_id int, text string")
    assert {tuple(r) for r in decontaminate.contained_passages(texts, items).collect()} == {("long", 1), ("long", 2)}
    where = decontaminate.locate(spark.createDataFrame([("p", long[7:90]), ("q", long[500:503]), ("r", "短")], "row_id string, text string"), texts.withColumnRenamed("row_id", "chapter_id"))
    assert {tuple(r) for r in where.collect()} >= {("p", "long"), ("q", "long")} and where.where("row_id = 'r'").isEmpty()


def test_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://far:7077"

        class _jsc:
            class sc:
                def getCheckpointDir(self):
                    return self

                def isDefined(self):
                    return False

    class Session:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_dir(Session)
