"""Core operators on small fixtures: edge cases and brute force."""

import gzip
import io
import itertools
import json
import random
import tarfile

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import adapters, aggregates, clean, decontaminate, dedup, evaluate, graph, vocab
from corpusloom.operators import select as sel
from corpusloom.operators.prefix import prefix_sum
from corpusloom.plans import config, run_plan
from corpusloom.sources import readers, sinks
from corpusloom.streaming import ingest


def df(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def values(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_normalize(spark):
    raw = ["繁體\r\n中文​\x00", "  a \t\n b　\n\n", "", None, "é"]
    got = [r[0] for r in df(spark, [(x,) for x in raw], "t string").select(T.normalize_text(F.col("t"))).collect()]
    assert got == ["繁體\n中文", "a\n b", "", None, "é"]


def test_grams_are_linear_and_guarded(spark):
    x = df(spark, [("ab",), ("abcd",), ("",), (None,), ("𠀀字字",)], "t string").select(T.char_grams(F.col("t"), 3).alias("g"))
    assert [r[0] for r in x.collect()] == [[], ["abc", "bcd"], [], [], ["𠀀字字"]]
    long = df(spark, [("字" * 200_000,)], "t string").select(F.size(T.char_grams(F.col("t"), 5)))
    assert long.first()[0] == 199_996


def test_stable_key_is_uniform(spark):
    f = [r[0] for r in spark.range(2000).select(T.stable_fraction(1, "x", F.col("id"))).collect()]
    assert 0 <= min(f) and max(f) < 1 and abs(sum(f) / len(f) - 0.5) < 0.03


def test_small_parsers(spark):
    x = df(spark, [("答案：B",), ("C. because",), ("(A)",), ("none",), ("A or B",)], "t string").select(T.choice(F.col("t")))
    assert [r[0] for r in x.collect()] == ["B", "C", "A", "Z", "A"]
    v = df(spark, [("well\nY\n",), ("n",), ("maybe",), (None,)], "t string").select(T.verdict(F.col("t")))
    assert [r[0] for r in v.collect()] == ["Y", "N", None, None]
    loops = df(spark, [("ab" * 30,), ("normal text",), ("x" * 20,), ("",), (None,)], "t string").select(T.ends_in_loop("t"))
    assert [r[0] for r in loops.collect()] == [True, False, True, False, False]
    assert T.pinyin_parts("zhōng") == ("zh", "ong", 1) and T.pinyin_parts("lv4") == ("l", "ü", 4)
    assert len(set(T.byte_alphabet().values())) == 256
    s = df(spark, [('{"a": ["x", {"b": "y"}], "c": 1}',), ("broken",), (None,)], "t string").select(T.json_strings("t"))
    assert [r[0] for r in s.collect()] == [["x", "y"], [], []]


def test_sequence_f1_against_brute_force(spark):
    r = random.Random(1)
    pairs = [("".join(r.choice("abc天 ") for _ in range(9)), "".join(r.choice("abc天 ") for _ in range(9))) for _ in range(40)]

    def lcs(a, b):
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            d[i + 1][j + 1] = d[i][j] + 1 if a[i] == b[j] else max(d[i][j + 1], d[i + 1][j])
        return d[-1][-1]

    got = [x[0] for x in df(spark, pairs, "p string, r string").select(T.sequence_f1("p", "r")).collect()]
    for (p, q), g in zip(pairs, got, strict=True):
        a, b = T.mixed_tokens(p), T.mixed_tokens(q)
        assert g == pytest.approx(2 * lcs(a, b) / (len(a) + len(b)) if a and b else float(a == b))


def test_clean_reasons(spark):
    rows = [("a", "字" * 30, "hq", "x.txt", "MIT", None, "general"), ("b", "字", "hq", "x.py", "MIT", "", None), ("c", "word " * 20, "hq", None, None, "EN", "general"), ("d", None, "hq", "x", "MIT", None, None), ("e", "" * 40, "hq", "x", "MIT", None, None)]
    got = clean.clean_and_tag(df(spark, rows, "doc_id string, text string, source string, source_path string, license string, language string, domain string"), {"hq": "curated_zh"})
    out = {r.doc_id: (r.reject_reason, r.language, r.domain) for r in got.collect()}
    assert out["a"] == (None, "zh", "general") and out["b"] == ("too_short", "zh", "code") and out["c"] == ("missing_license", "en", "general")
    assert out["d"][0] == "too_short" and out["e"][0] == "low_printable_ratio"
    with pytest.raises(KeyError):
        clean.selector("unheard")


def test_conversation_rejects(spark):
    good = [("user", "q"), ("assistant", "a")]
    cases = {"ok": good, "sys": [("system", "s"), *good], "order": [("assistant", "a"), ("user", "q")], "empty": [("user", " "), ("assistant", "a")], "tpl": [("user", "<|im_start|>"), ("assistant", "a")], "bad": [("user", "\x00"), ("assistant", "a")], "open": [("user", "q")], "long": [("user", "x" * 100_001), ("assistant", "a")], "none": None}
    got = dict(df(spark, list(cases.items()), "k string, m array<struct<role:string,content:string>>").select("k", clean.message_reject(F.col("m"))).collect())
    assert got == {"ok": None, "sys": None, "order": "bad_roles", "empty": "empty_content", "tpl": "template_tokens", "bad": "corrupt_text", "open": "missing_assistant", "long": "too_long", "none": "bad_messages"}


def test_exact_representative_choice(spark):
    rows = [("d1", "t \r\n", "a", 0.5), ("d2", "t", "b", 0.9), ("d3", "t", "a", None), ("d4", "t", "a", 0.5), ("d5", None, "a", 1.0)]
    got = dedup.exact_representatives(df(spark, rows, "doc_id string, text string, source string, quality_prior double"), dedup.source_rank(F.col("source"), {"a": "curated_zh", "b": "web_zh"}))
    assert {r.kept_doc_id for r in got.collect()} == {"d1"} and got.count() == 4
    assert dedup.lsh_dimensions(14, 0.8) == (14, 12) and dedup.lsh_dimensions(14, 0.85) == (14, 16)
    empty = df(spark, [], "doc_id string, text string, source string, quality_prior double")
    assert dedup.exact_removals(empty, F.lit(0)).count() == 0


def test_near_duplicates_match_brute_force(spark):
    r = random.Random(3)
    base = ["".join(r.choice("天地玄黃宇宙洪荒日月盈昃辰宿列張") for _ in range(120)) for _ in range(6)]
    docs = [(f"d{i}", b) for i, b in enumerate(base)] + [(f"e{i}", b[:60] + "一" + b[61:]) for i, b in enumerate(base)] + [("copy", base[0]), ("short", "短文"), ("null", None), ("empty", "")]
    pairs, classes = dedup.near_duplicates(df(spark, docs, "doc_id string, text string"), 0.8)

    def grams(t):
        return {t[i : i + 5] for i in range(len(t) - 4)}

    own = {k: grams(t) for k, t in docs if t and len(t) >= 16 and k != "copy"}
    want = {(a, b) for a, b in itertools.combinations(sorted(own), 2) if len(own[a] & own[b]) / len(own[a] | own[b]) >= 0.8}
    rep = {"d0": "copy"}  # the least id of equal texts stands for them
    want = {tuple(sorted((rep.get(a, a), rep.get(b, b)))) for a, b in want}
    assert {(x.id_a, x.id_b) for x in pairs.collect()} == want
    cls = dict(classes.collect())
    assert cls["d0"] == cls["e0"] == cls["copy"] and cls["short"] == "short" and len(cls) == len(docs)


def test_minhash_clusters_join_copies(spark):
    t = "a sentence of some fifteen different words that is long enough to have many shingles in it"
    rows = [("a", t, "en"), ("b", t, "en"), ("c", "another text that says something else about rivers mountains and old roads", "en"), ("d", "x", "en")]
    got = dict(dedup.minhash_clusters(df(spark, rows, "doc_id string, text string, profile string")).collect())
    assert got["a"] == got["b"] == "a" and got["c"] == "c" and got["d"] == "d"


def test_two_key_greedy_matches_loop(spark):
    r = random.Random(5)
    rows = [(i, r.choice("pq"), r.choice(["a", "b", "c", "d", None]), r.choice(["x", "y", "z", None]), r.random()) for i in range(60)]
    taken, ka, kb = set(), set(), set()
    for i, g, a, b, _ in sorted(rows, key=lambda x: (x[1], x[4])):
        if (a is None or (g, a) not in ka) and (b is None or (g, b) not in kb):
            taken.add(i)
            ka.add((g, a))
            kb.add((g, b))
    got = dedup.two_key_greedy(df(spark, rows, "id int, g string, a string, b string, o double"), "g", "a", "b", ["o"])
    assert {x.id for x in got.collect()} == taken


def test_components_match_union_find(spark):
    r = random.Random(7)
    edges = [(f"n{r.randrange(60)}", f"n{r.randrange(60)}") for _ in range(45)] + [("hub", f"h{i}") for i in range(50)] + [(None, "x"), ("self", "self")]
    p = {}

    def find(x):
        while p.setdefault(x, x) != x:
            x = p[x]
        return x

    for a, b in edges:
        if a and b:
            a, b = sorted((find(a), find(b)))
            p[b] = a
    got = dict(graph.components(df(spark, edges, "u string, v string")).collect())
    assert got == {n: find(n) for n in p}
    forest, _ = graph.spanning_forest(df(spark, edges, "u string, v string"))
    assert forest.count() == len(p) - len({find(n) for n in p})
    assert graph.components(df(spark, [], "u string, v string")).count() == 0


def test_prefix_sum_matches_loop(spark):
    r = random.Random(2)
    rows = [(i, r.choice(["a", "b", None]), r.choice([1, 2, None])) for i in range(300)]
    got = {x.id: x.prefix for x in prefix_sum(df(spark, rows, "id long, g string, v long"), F.col("v"), F.xxhash64("id"), ["g"], buckets=8).collect()}
    keys = {x[0]: x[1] for x in spark.range(300).select("id", F.xxhash64("id")).collect()}
    sums = {}
    for i, g, v in sorted(rows, key=lambda x: keys[x[0]]):
        assert got[i] == sums.get(g, 0)
        sums[g] = sums.get(g, 0) + (v or 0)


def test_packing_fixture(spark):
    docs = df(spark, [("a", [1, 2, 3]), ("b", [4, 5, 6, 7, 8])], "doc_id string, input_ids array<bigint>")
    order = F.when(F.col("doc_id") == "a", F.lit(-1)).otherwise(F.lit(1)).cast("bigint")
    got = sel.sequences(docs, 4, 99, order).orderBy("sequence").collect()
    assert [list(r.input_ids) for r in got] == [[1, 2, 3, 99], [4, 5, 6, 7], [8, 99]]
    assert [list(r.document_ids) for r in got] == [["a"], ["b"], ["b"]]


def test_budgets_and_masks(spark):
    x = df(spark, [(i, 10) for i in range(10)], "id long, n long")
    assert sel.budget(x, "n", 35, F.col("id")).count() == 4
    assert sel.budget(x, "n", 35, F.col("id"), clip=True).agg(F.sum("taken")).first()[0] == 35
    m = df(spark, [([-100, 5, -100, 6, 7],)], "l array<int>").select(sel.mask_labels(F.col("l"), F.lit(1), F.lit(2)))
    assert m.first()[0] == [-100, -100, -100, 6, -100]
    assert sel.padding(x, 8, {"id": -1, "n": 0}).count() == 16
    n = sel.nested_quota(df(spark, [(i, "ab"[i % 2], 10) for i in range(20)], "id long, source string, n long"), 50, {"a": 0.5, "b": 0.5}, "n", F.col("id"))
    assert n.agg(F.sum("taken")).first()[0] == 50
    held = sel.holdout_groups([{"doc": f"d{i}", "book": f"b{i % 3}", "task": "t", "n": 5} for i in range(20)], {"t": 20})
    assert len(held) == 4
    assert sel.coverage_pick([{"id": "a", "source": "s", "tokens": 5, "chars": "罕", "score": 1.0}, {"id": "b", "source": "s", "tokens": 5, "chars": "見", "score": 0.5}], (1,), {"罕": 1, "見": 2}, 10, 10) == ["a", "b"]


def test_decontamination_positions(spark):
    long = "".join(chr(0x4E00 + i) for i in range(33))
    items = df(spark, [(long,), ("one two three four five six seven eight nine ten eleven twelve thirteen",)], "text string")
    docs = df(spark, [("two", "前" + long, "zh"), ("one", long[:32], "zh"), ("en", "x one two three four five six seven eight nine ten eleven twelve Thirteen y", "en"), ("exact", long + " \n", "zh"), ("null", None, "zh"), ("none", "clean", "en")], "doc_id string, text string, language string")
    assert dict(decontaminate.contamination(docs, items).collect()) == {"two": "chars", "en": "words", "exact": "exact"}
    assert decontaminate.decontaminated(docs, items).count() == 3
    p = "Ａ" * 10 + "b" * 20
    t = df(spark, [("r", "see: " + "a" * 10 + " B" * 20), ("s", "nothing")], "row_id string, text string")
    assert values(decontaminate.contained_passages(t, df(spark, [(1, p)], "item_id long, text string"))) == [("r", 1)]


def test_boundary_reasons(spark):
    shape = "row_id string, chapter string, book string, near_group string, translation string, text string"
    dev = df(spark, [("d", "c1", "b1", "n1", "t1", "天地玄黃宇宙洪荒，日月盈昃")], shape)
    train = df(spark, [("a", "c1", None, None, None, "甲"), ("b", None, "b1", None, None, "乙"), ("c", None, None, None, None, "前天地玄黃宇宙洪荒日月盈昃後"), ("e", None, None, None, None, "宇宙洪荒日月盈昃"), ("f", None, None, None, None, "無關")], shape)
    assert dict(decontaminate.boundary_conflicts(train, dev).collect()) == {"a": "chapter", "b": "book", "c": "dev_text_in_train", "e": "train_text_in_dev"}


def test_evaluation(spark):
    rows = [("a", "甲乙丙", "甲乙丁", "甲乙丁"), ("a", "甲乙", "甲乙", "甲丙"), ("a", "甲", "乙", None), ("a", "甲", "甲乙", "甲")]
    m = evaluate.spelling_metrics(df(spark, rows, "k string, src string, tgt string, prediction string"), ["k"]).first()
    assert m.n == 3 and m.sentence_correction_p == pytest.approx(100 / 3) and m.char_correction_r == 100 and m.false_positive_rate == 100
    e = evaluate.edit_metrics(df(spark, [("a", "abc", ["abd", "xbc"], "xbc"), ("a", "abc", ["abc"], "abc"), ("a", "abc", None, None)], "k string, src string, references array<string>, prediction string"), ["k"]).first()
    assert e.exact == pytest.approx(200 / 3) and e.edit_r == 100
    b = evaluate.corpus_bleu(df(spark, [("a", 1, "今天天气很好啊", "今天天气很好啊"), ("b", 1, "甲乙丙丁戊", "")], "k string, id long, gold string, prediction string"), ["k"])
    assert {k: round(v) for k, v in b.collect()} == {"a": 100, "b": 0}
    p = evaluate.punctuation_f1(df(spark, [("a", "甲，乙。", "甲，乙。"), ("b", "甲，乙。", "甲，丙。")], "k string, gold string, prediction string"), ["k"])
    assert {r.k: r.punctuation_f for r in p.collect()} == {"a": 100, "b": 0}
    w = evaluate.scoring_windows(df(spark, [(1, 10), (2, 1), (3, None)], "doc_id long, n int"), "n", 4, 2).collect()
    scored = [t for r in w for t in range(r.scored_from, r.end)]
    assert sorted(scored) == list(range(1, 10))
    boot = evaluate.paired_bootstrap(df(spark, [(i, 1.0, 1.0, 2.0, 1.0) for i in range(50)], "id long, a_sum double, a_count double, b_sum double, b_count double"), 100).first()
    assert boot.delta == pytest.approx(1) and boot.low <= 1 <= boot.high
    h = evaluate.health(df(spark, [("t", "stop", "fine"), ("t", "length", "ab" * 40), ("u", None, None)], "task string, finish_reason string, prediction string")).where("all = 1").first()
    assert h.n == 3 and h.loop == pytest.approx(1 / 3) and h.empty == pytest.approx(1 / 3)


def test_adapters(spark):
    r = df(spark, [("x", "", "body", 0.0, 0.7, "/d/Exam/a.jsonl", 1)], "id string, text string, content string, quality_score double, score double, _path string, _row int")
    a = adapters.adapt(r, "src", "MIT").first()
    assert (a.doc_id, a.text, a.quality_prior, a.subset, a.license) == ("src:x", "body", 0.7, "Exam", "MIT")
    e = df(spark, [("问", None, "甲", " ", "A")], "q_main string, q_mean string, option_a string, option_b string, std_ans string")
    assert e.select(adapters.exam_text(e)).first()[0] == "问\nA. 甲\n答案：A"
    files = [("c1", "code", "a.py", "Python", False, "permissive", ["MIT"]), ("c2", "code", "b.py", "Python", True, "permissive", ["MIT"]), ("c3", "code", "c.py", "Python", False, "", [])]
    repo = df(spark, [("r", 1, "sha", files)], "repo_path string, repo_id long, commit_id string, files array<struct<content_id:string,content:string,file_path:string,language:string,is_vendor:boolean,license_type:string,detected_licenses:array<string>>>")
    assert [x.reject_reason for x in adapters.repository_files(repo, "s").orderBy("source_path").collect()] == [None, "vendor_file", "missing_license"]
    c = adapters.cloze(df(spark, [("i", "a #idiom1# b #idiom2# c", ["x", "y"])], "id string, text string, answers array<string>")).orderBy("pos").collect()
    assert [(x.answer, x.text) for x in c] == [("x", "a #idiom1# b ____ c"), ("y", "a ____ b #idiom2# c")]
    u = df(spark, [("P:xS",), ("x",), ("P:",)], "t string").select(adapters.unwrap(F.col("t"), "P:", "S"))
    assert [x[0] for x in u.collect()] == ["x", "x", "P:"]
    t = adapters.training_pair(df(spark, [("c2m", "甲", "乙"), ("m2c", "甲", "乙")], "task string, source string, target string"), {"c2m": "译："}, ("m2c",)).orderBy("task").collect()
    assert t[0].messages[0].content == "译：甲" and t[1].messages[0].content == "乙"


def test_vocabulary(spark):
    assert vocab.range_characters(spark, ((0x20000, 0x20003),)).count() == 3
    v = vocab.feature_vocabulary(df(spark, [("b",), ("a",), (None,), ("a",)], "value string"))
    assert dict(v.collect()) == {"<pad>": 0, "<none>": 1, "<unk>": 2, "a": 3, "b": 4}
    f = vocab.feature_rows(df(spark, [("甲",), ("乙",)], "char string"), df(spark, [("甲", "b"), ("甲", "a"), ("甲", "zz")], "char string, value string"), v, 2)
    out = {r.char: (list(r.ids), list(r.mask), r.missing) for r in f.collect()}
    assert out == {"甲": ([3, 4], [True, True], 1), "乙": ([1, 1], [False, False], 0)}
    tokens, merges = vocab.prune_merges(df(spark, [("a", 0), ("b", 1), ("ab", 2), ("abab", 3)], "token string, id long"), [("a", "b"), ("ab", "ab")], {"ab", "abab"}, {"ab"})
    assert dict(tokens.collect()) == {"a": 0, "b": 1, "ab": 2} and merges == [("a", "b")]
    p = vocab.property_table(df(spark, [("# c",), ("U+4E00\tkX\t1",), ("U+4E00\tkY\t2",)], "value string"), ("kX", "kZ")).first()
    assert (p.char, p.kX, p.kZ) == ("一", "1", None)


def test_aggregates_on_empty_tables(spark):
    assert aggregates.perplexity(df(spark, [], "domain string, nll double, token_count long, char_count long, byte_count long")).count() == 0
    z = aggregates.perplexity(df(spark, [("d", 0.0, 0, 0, 0)], "domain string, nll double, token_count long, char_count long, byte_count long")).first()
    assert z.ppl is None and z.bpc is None


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "x"}\n\nbroken\n[1]\n', encoding="utf-8")
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write('{"text": "y"}\n')
    rows, bad = readers.read(spark, "jsonl", str(tmp_path))
    assert rows.count() == 2 and sorted(r.reject_reason for r in bad.collect()) == ["malformed", "not_an_object"]
    data = b'{"text": "z"}\n'
    with tarfile.open(tmp_path / "t.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("m.jsonl")
        info.size = len(data)
        t.addfile(info, io.BytesIO(data))
    rows, _ = readers.read(spark, "tar_jsonl", str(tmp_path / "t.tar.gz"))
    assert [(r.member, r.value) for r in rows.collect()] == [("m.jsonl", '{"text": "z"}')]
    import zstandard

    (tmp_path / "q.jsonl.zst").write_bytes(zstandard.compress(data * 3))
    assert readers.read(spark, "zstd_jsonl", str(tmp_path / "q.jsonl.zst"))[0].count() == 3
    (tmp_path / "w.txt").write_text("整\n文", encoding="utf-8")
    assert readers.whole_text(spark, str(tmp_path)).first().text == "整\n文"
    (tmp_path / "n.json").write_text(json.dumps({"s1": {"sentence": "x"}, "deep": [{"sentence": "y", "id": 7}]}), encoding="utf-8")
    assert {r.id for r in readers.nested_records(spark, str(tmp_path / "n.json"), ("sentence",)).collect()} == {"s1", "7"}
    (tmp_path / "p.para").write_text("1\tsrc\tt1\tt2\n2\tsrc\n", encoding="utf-8")
    assert [r.targets for r in readers.tsv_pairs(spark, str(tmp_path / "p.para"), "cgec").orderBy("id").collect()] == [["t1", "t2"], None]
    pairs = readers.repaired_pairs(df(spark, [("a\t\tb",), ("1\ta\t1\tb",), ("only",)], "value string"))
    assert values(pairs) == [("a", "b"), ("a", "b")]
    (tmp_path / "m2").write_text("S a\nT0 x\nA 0 1\nT1 y\nA 1 2\n\nS b\nT0 z\n", encoding="utf-8")
    assert [list(r.edits) for r in readers.m2_edits(spark, [str(tmp_path / "m2")]).orderBy("sentence").collect()] == [["0 1"], []]
    with pytest.raises(ValueError):
        readers.expand("$NOPE_X/a", "text")
    with pytest.raises(FileNotFoundError):
        readers.expand(str(tmp_path / "none*"), "text")


def test_sinks(spark, tmp_path):
    x = df(spark, [("train", 1, [("user", "q")]), ("dev", 2, [("user", "r")])], "split string, row_number long, messages array<struct<role:string,content:string>>")
    sinks.training_set(x, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/messages")).count() == 2
    sinks.messages(df(spark, [("a",), (None,), ("",)], "text string"), str(tmp_path / "msg"))
    assert spark.read.json(str(tmp_path / "msg")).first().messages[0].role == "assistant"
    sinks.report(str(tmp_path / "r.json"), {"b": 1, "a": "字"})
    assert json.loads((tmp_path / "r.json").read_text(encoding="utf-8")) == {"a": "字", "b": 1}
    assert sinks.run_directory(str(tmp_path / "runs")).endswith("v1") and sinks.run_directory(str(tmp_path / "runs")).endswith("v2")


def test_plan():
    s = (config.Source("a", "jsonl", "/x", "curated_zh"),)
    p = config.Pipeline(s, (config.Bucket("b", "zh_general", 1000, {"a": 1.0}),), ("b",)).validate()
    files = [run_plan.FileInfo(f"f{i}", "a", 100) for i in range(10)]
    got = run_plan.plan(p, {("a", "b"): {"doc_rate": 0.5, "tokens_per_doc": 10}}, files)
    assert got["passed"] and len(got["files"]) == 3 and 0 < got["rates"]["b/a"] <= 1
    more = run_plan.plan(p, {("a", "b"): {"doc_rate": 0.5, "tokens_per_doc": 10}}, files, frozenset(got["files"]), {("b", "a"): 100})
    assert not set(more["files"]) & set(got["files"])
    with pytest.raises(ValueError):
        run_plan.plan(p, {}, files, deficits={})
    with pytest.raises(ValueError):
        config.Pipeline(s, (config.Bucket("b", "zh_general", 1, {"zz": 1.0}),), ("b",)).validate()
    with pytest.raises(ValueError):
        config.check_identity({"a": 1}, {"a": 2})
    assert run_plan.quota_targets(10, {"x": 0.5, "y": 0.5}, {"x": 3, "y": 100}) == {"x": 3, "y": 3}
    assert run_plan.evenly_spaced(list("abcde"), 3) == ["a", "c", "e"]


def test_streaming(spark, tmp_path):
    shape = "doc_id string, text string, source string, source_path string, license string, language string, domain string, loaded_at timestamp"
    row = ("字" * 30, "hq", "x", "MIT", "zh", "general")
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    df(spark, [("a", *row, t), ("b", *row, t), ("c", "short", *row[1:], t)], shape).write.parquet(str(tmp_path / "in"))
    s = ingest.unique_documents(ingest.documents(spark, str(tmp_path / "in"), shape), {"hq": "curated_zh"})
    ingest.write(s, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    q = ingest.arrivals(ingest.documents(spark, str(tmp_path / "in"), shape)).writeStream.format("memory").queryName("arrivals").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(docs) from arrivals").first()[0] == 3
