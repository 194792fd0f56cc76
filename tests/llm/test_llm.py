"""Training-text operators: brute force, exact round trips, skew, nulls, empty and repeated rows."""

import itertools
import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import _sums, _text, crosssplit, leakage, lookalike, mixing, packing, quality, splits, subjects, tokens

R = random.Random(11)
HAN = "天地玄黃宇宙洪荒日月盈昃辰宿列張寒來暑往秋收冬藏閏餘成歲律呂調陽雲騰致雨露結為霜金生麗水玉出崑岡"


def df(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def han(n, seed):
    r = random.Random(seed)
    return "".join(r.choice(HAN) for _ in range(n))


TEXTS = "src_table string, row_id string, text string, extra int"


def texts(spark, rows):
    """With a column whose name clashes with ones used inside."""
    return df(spark, [(*r, 1) for r in rows], TEXTS)


# ---------------------------------------------------------------- primitives


def test_kgrams_and_winnowing_guarantee():
    r = random.Random(1)
    docs = ["".join(r.choice("abcd") for _ in range(r.randrange(0, 60))) for _ in range(50)]
    points, ends = _text.letters(pa.array(docs))
    for k in (3, 7, 16):
        h, valid = _text.kgrams(points, ends, k)
        seen = {}
        for d, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            for i in range(a, b):
                assert valid[i] == (i + k <= b)
                if valid[i]:
                    seen.setdefault(docs[d][i - a : i - a + k], set()).add(int(h[i]))
        assert all(len(x) == 1 for x in seen.values()) and len(set().union(*seen.values())) == len(seen)
    k, w = 5, 4
    h, valid = _text.kgrams(points, ends, k)
    kept = set(_text.winnow(h, valid, w).tolist())
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        for i in range(a, b - (w + k - 1) + 1):
            assert kept & set(range(i, i + w))


def test_letters_and_base_forms():
    got = _text.to_strings(*_text.letters(pa.array(["Ｆull ﬁne сор—É", None, "", "é 不​①"])))
    assert got == ["fullfinecope", "", "", "e不1"]
    assert [s for _, x in lookalike.tabled_strings(pa.array(["Ａé　x²①，", "é"])) for s in x] == ["Aé x²①，", "é"]


def test_sums_in_steps(spark, monkeypatch):
    monkeypatch.setattr(_sums, "FAN", 3)
    monkeypatch.setattr(_sums, "_partitions", lambda frame: 20)

    def run(parts):
        total = np.zeros(2 * _sums.PIECE, np.int64)
        for b in parts:
            np.add.at(total, b.column(0).to_numpy() * 37 % len(total), 2**33)
        yield from _sums.emit(total)

    got = _sums.summed(spark.range(0, 5000, 1, 20), run, "<i8", 2 * _sums.PIECE)
    want = np.bincount(np.arange(5000) * 37 % (2 * _sums.PIECE), minlength=2 * _sums.PIECE) * 2**33
    assert (got == want).all()
    assert not _sums.summed(spark.range(0), run, "<i8", 2 * _sums.PIECE).any()


# ---------------------------------------------------------------- 1


def leak_rows():
    q = han(80, 1) + "。" + han(60, 2)
    e = "No compiler follows the lantern without help from the harbour, and the visitor of Velmora often keeps a narrow notebook by the window."
    items = [(1, q), (2, q), (3, "请选出最恰当的答案。" + han(70, 3)), (4, "请选出最恰当的答案。" + han(70, 4)), (5, "请选出最恰当的答案。" + han(70, 5)), (6, "短问题？"), (7, None), (8, e)]
    edited = "".join("一" if i % 17 == 9 else c for i, c in enumerate(q[:90]))
    rows = [
        ("t", "whole", "前文" + q + "後文"), ("t", "edited", han(50, 9) + edited + han(50, 8)), ("t", "third", han(40, 7) + q[:40]), ("t", "stock", "请选出最恰当的答案。" + han(60, 6)), ("t", "spread", "\n".join(q[:100])),
        ("t", "short", "短问题？"), ("t", "null", None), ("t", "empty", ""), ("t", "caps", "xx " + e.upper().replace(",", "") + " yy"), ("t", "clause", "No compiler follows the lantern today."), ("u", "whole", q), ("t", "whole", "前文" + q + "後文"),
    ]
    want = {("t", x, i) for x in ("whole", "edited", "spread") for i in (1, 2)} | {("u", "whole", 1), ("u", "whole", 2), ("t", "caps", 8)}
    return items, rows, want


@pytest.mark.parametrize("block", [leakage.BLOCK_LETTERS, 200])
def test_leaks(spark, block):
    items, rows, want = leak_rows()
    got = leakage.leaks(texts(spark, rows), df(spark, items, "item_id long, question string"), block_letters=block).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_half_of_an_item_of_any_length_is_found():
    r = random.Random(12)
    for alphabet in ("abcdefghijklmnopqrstuvwxyz", HAN):
        draw = lambda n, a=alphabet: "".join(r.choice(a) for _ in range(n))
        items = {n: draw(n) for n in [*range(16, 64), 100, 201]}
        index = leakage.Index(list(items.values()), [set()] * len(items), leakage.Params())
        for i, (n, q) in enumerate(items.items()):
            for begin in (0, n // 4, n // 2):
                half = q[begin : begin + -(-n // 2)]
                points, ends = _text.letters(pa.array([draw(150) + half + draw(150)]))
                hits = [x for x in index.candidates(points, ends).tolist() if x[1] == i]
                assert hits, (n, begin)
                assert len(half) < n / 2 or any(index.holds(i, index.window(points, 0, ends[1], i, x[2], x[3])) for x in hits), (n, begin)


def test_leaks_of_nothing(spark):
    none = texts(spark, []).where("false")
    assert leakage.leaks(none, df(spark, [(1, han(60, 1))], "item_id long, question string")).count() == 0
    assert leakage.leaks(texts(spark, [("t", "a", han(50, 1))]), df(spark, [], "item_id long, question string")).count() == 0


# ---------------------------------------------------------------- 2


@pytest.mark.parametrize("most", [lookalike.BROADCAST_WORDS, 0])
def test_looks(spark, most):
    a = "The façade of 3 ﬁne 不 mirrors"
    same = [a, unicodedata.normalize("NFD", a), a.replace("3", "３").replace("T", "Ｔ"), a.replace("o", "о"), a.replace("不", "不"), a.replace(" ", " "), "The​ façade of 3 fine 不 mirrors", a.replace("a", "а")]
    other = [a.lower(), a.replace("3", "³"), a + ".", a.replace(" ", "  "), "Кремль стоит", "Крeмль стоит", "", None, "Кремль стоит"]
    rows = [("t", f"s{i}", x) for i, x in enumerate(same)] + [("t", f"o{i}", x) for i, x in enumerate(other)] + [("u", "s0", a), ("t", "s0", a)]
    got = lookalike.look_pairs(texts(spark, rows), most_words=most).collect()
    want = {("t", x, y) for x, y in itertools.combinations([f"s{i}" for i in range(len(same))], 2)} | {("t", "o4", "o5"), ("t", "o5", "o8")}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    canon = {(r.src_table, r.row_id): r.canonical for r in lookalike.normalize(texts(spark, rows), most_words=most).collect()}
    assert len({canon["t", f"s{i}"] for i in range(len(same))}) == 1
    assert canon["t", "o4"] == canon["t", "o5"] == "Кремль стоит" and canon["t", "o7"] is None


def test_tries_decide_letters_of_other_alphabets(spark):
    rows = [("t", "a", "a cope with"), ("t", "b", "a сope with"), ("t", "c", "a cоpe with"), ("t", "d", "сор и вор"), ("t", "e", "сoр и вор"), ("t", "f", "naïve Ｎote"), ("t", "g", "naïve Note"), ("t", "h", "ab​c"), ("t", "i", "abc")]
    got = {tuple(r)[1:] for r in lookalike.look_pairs(texts(spark, rows)).collect()}
    assert got == {("a", "b"), ("a", "c"), ("b", "c"), ("d", "e"), ("f", "g"), ("h", "i")}
    table = {tuple(r)[1:] for r in lookalike.look_pairs(texts(spark, rows), tries=False).collect()}
    assert table == {("f", "g"), ("h", "i")}
    canon = {r.row_id: r.canonical for r in lookalike.normalize(texts(spark, rows)).collect()}
    assert canon["b"] == canon["c"] == "a cope with" and canon["e"] == "сор и вор"


def test_every_pair_of_a_large_class_can_be_rebuilt(spark):
    rows = [("t", f"a{i:04}", "same") for i in range(3000)] + [("t", f"b{i:04}", "sаme") for i in range(1900)] + [("t", f"c{i:03}", "sam​" + "​" * i + "e") for i in range(100)]
    t = texts(spark, rows)
    m = lookalike.look_members(t).collect()
    assert len(m) == 5000 and len({x.look_id for x in m}) == 1
    of = {x.row_id: x.string_id for x in m}
    size = {s: sum(v == s for v in of.values()) for s in set(of.values())}
    assert len(size) == 102 and all(x.links == 5000 - size[x.string_id] for x in m)
    linked = {tuple(sorted((of[x.id_a], of[x.id_b]))) for x in lookalike.look_pairs(t).collect()}
    assert linked == set(itertools.combinations(sorted(size), 2))


def test_edit_automaton_matches_brute_force():
    t = lookalike.Trie(["café", "cafe", "сор", "fine", "ab​c"])
    assert t.find("сafé") == {"café": 0} and set(t.find("cop")) == {"сор"} and set(t.find("ﬁne")) == {"fine"} and set(t.find("abc")) == {"ab​c"}

    def distance(a, b):
        d = {(0, 0): 0}
        for i, j in itertools.product(range(len(a) + 1), range(len(b) + 1)):
            if i or j:
                d[i, j] = min(d.get((i - 1, j), 99) + 1, d.get((i, j - 1), 99) + 1, d.get((i - 1, j - 1), 99) + (a[i - 1 : i] != b[j - 1 : j]))
        return d[len(a), len(b)]

    words = ["".join(p) for p in itertools.product("xyz", repeat=3)]
    t = lookalike.Trie(words)
    for q in ("xyz", "xx", "zzzz"):
        assert t.find(q, 1) == {w: distance(q, w) for w in words if distance(q, w) <= 1}


def test_hot_look_stays_linear(spark):
    rows = [("t", f"{i:04}", "same" + "​" * i) for i in range(120)] + [("t", f"z{i:04}", "same") for i in range(2000)]
    got = {tuple(r)[1:] for r in lookalike.look_pairs(texts(spark, rows)).collect()}
    assert len(got) < 10_000 and {x for p in got for x in p} == {r[1] for r in rows}


def test_looks_of_many_strings(spark):
    rows = [("t", f"{i:03}", "twelve" + "\u200b" * i) for i in range(12)] + [("t", f"a{i:03}{c}", "twice" + "\u200b" * i) for i in range(12) for c in "xy"]
    rows += [("u", f"{i:03}", "blocks" + "\u200b" * i) for i in range(lookalike.BLOCK + 44)] + [("v", f"{i:04}", "copies" + "\u200b" * (i % 12)) for i in range(12 * 40)]
    got = [tuple(r) for r in lookalike.look_pairs(spark.createDataFrame(rows, "src_table string, row_id string, text string")).collect()]
    want = {(s, x, y) for (s, x, a), (t, y, b) in itertools.combinations(sorted(rows), 2) if s == t and s != "v" and a != b and a.rstrip("\u200b") == b.rstrip("\u200b")}
    text = {r[:2]: r[2] for r in rows}
    assert len(got) == len(set(got)) and {p for p in got if p[0] != "v"} == want
    copies = [p for p in got if p[0] == "v"]  # 40 x 40 members: the strings are paired each with each, copies linked
    assert {tuple(sorted((text["v", x], text["v", y]))) for _, x, y in copies} == set(itertools.combinations(sorted({r[2] for r in rows if r[0] == "v"}), 2))
    assert {x for _, *p in copies for x in p} == {r[1] for r in rows if r[0] == "v"} and len(copies) < 12 * 40 + 66


# ---------------------------------------------------------------- 3


def test_quality_kinds(spark):
    prose = "谁都知道院子里的梅树是去年种下的，因为雨水不足，它长得很慢。不过到了春天，枝头还是开了花。"
    rows = [(f"p{i}", prose + f"第{i}次提到这件事的人，多半是从车站走来的。" * (i % 5 + 1), 0.5) for i in range(40)]
    rows += [(f"l{i}", "\n".join(f"- {w}" for w in random.Random(i).sample(["灯笼", "车站", "合同", "晶体", "果园", "利率", "函数", "古墓"], 8)), 7.0) for i in range(20)]
    rows += [(f"t{i}", "\n".join(f"{i * j % 97},{j}.5,{i + j}%" for j in range(12)), None) for i in range(20)]
    rows += [(f"c{i}", f"def load_{i}(path):\n    \"\"\"The reader opens the file.\"\"\"\n    return [x * {i} for x in path]\n" * 3, None) for i in range(20)]
    rows += [("null", None, 0.1), ("empty", "", None), ("blank", " \n ", None), ("p0", rows[0][1], 0.5)]
    got = {r.doc_id: r for r in quality.mark(df(spark, rows, "doc_id string, text string, quality_prior double")).collect()}
    assert len(got) == 103 and all(got[f"p{i}"].natural > 0.5 for i in range(40)) and all(got[f"c{i}"].natural > 0.5 for i in range(20))
    assert all(got[f"l{i}"].natural < 0.5 for i in range(20)) and all(got[f"t{i}"].natural < 0.5 for i in range(20))
    assert got["null"].kind == got["empty"].kind == got["blank"].kind == "empty" and got["null"].natural is None
    assert got["p0"].prior == 0.5 and got["l0"].prior is None
    none = df(spark, [("x", None, None)], "doc_id string, text string, quality_prior double")
    assert quality.unnatural(none).count() == 0 and quality.unnatural(none.where("false")).count() == 0


def test_features_match_plain_python():
    t = "Nobody in the village,\n- saw 12 such things.\n\n甲乙的。"
    x = dict(zip(quality.NAMES, quality.features(pa.array([t, None, ""]))[0], strict=True))
    solid = [c for c in t if not c.isspace()]
    assert x["digits"] == pytest.approx(2 / len(solid)) and x["line_ends"] == pytest.approx(2 / 3) and x["bullets"] == pytest.approx(1 / 3)
    assert x["common"] == pytest.approx((3 + 1) / (7 + 3)) and not quality.features(pa.array([None, ""])).any()


def test_quality_on_forms_without_an_example(spark):
    r = random.Random(5)
    words = "harvest engine violin customs orchard pilot velvet glacier ribbon copper".split()
    prose = ["When the ferry left the island, most of the fishermen were still asleep in their small houses.", "She kept a diary for many years, but nobody in the family had ever seen a single page of it.", "The committee met again on Monday and agreed that the road should be finished before winter.", "他们沿着河岸走了很久，直到太阳下山才回到村子里，大家都觉得这一天过得很快。", "这本书的作者年轻时在海边住过几年，所以书里常常提到渔船和风浪。"]
    roman = ["i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x"]
    some = lambda n: [r.choice(words) for _ in range(n)]
    text = {}
    for i in range(30):
        text[f"p{i}"] = " ".join(r.sample(prose[:3], 3) + r.sample(prose[:3], 2)) if i % 2 else "".join(r.choice(prose[3:]) for _ in range(4))
        text[f"m{i}"] = " ".join(r.choice(prose[:3]) for _ in range(6)) + "\n- " + "\n- ".join(some(3)) + "\n" + " ".join(r.choice(prose[:3]) for _ in range(4))
        text[f"l{i}"] = "\n".join(f"{roman[j]}) {w} {r.choice(words)}" for j, w in enumerate(some(10)))
        text[f"t{i}"] = "\n".join("\t|\t".join([w, str(r.randrange(900)), f"{r.random():.3f}"]) for w in some(12))
        text[f"j{i}"] = "".join(r.choice("qzxkj#%&@~^0987") for _ in range(240))
    got = {x.doc_id: x.natural for x in quality.mark(df(spark, [(k, v, None) for k, v in text.items()], "doc_id string, text string, quality_prior double")).collect()}
    marked = {k for k, v in got.items() if v < 0.5}
    true = {k for k in text if k[0] in "ltj"}
    assert len(marked & true) / len(marked) > 0.95
    assert {k for k in text if k[0] in "lt"} <= marked  # unbroken strings of letters and signs, the form j, can pass as code


# ---------------------------------------------------------------- 4


def records():
    import json

    a, b = han(60, 21), han(60, 22)
    rec = lambda anc, *msgs: json.dumps({"ancient": anc, "messages": [{"role": "user", "content": m} for m in msgs]}, ensure_ascii=bool(len(msgs) % 2))
    edited = "".join("一" if i % 19 == 7 else c for i, c in enumerate(a))
    rows = [
        ("e1", True, rec(a)), ("e2", True, rec(b, "m")), ("e3", True, rec(han(5, 23))), ("e4", True, None), ("e5", True, "{broken"), ("e6", True, rec(a)),
        ("t1", False, rec(han(50, 30), "译：" + a)), ("t2", False, rec(edited, "x")), ("t3", False, rec(a[:30] + han(40, 31))), ("t4", False, rec("", "，".join(b))), ("t5", False, rec(han(60, 32), a)[:-9]), ("t6", False, None), ("x", None, rec(a)),
        ("t7", False, rec(a[:52], "y")), ("t1", False, rec(han(50, 30), "译：" + a)),
    ]
    want = {(e, t) for e in ("e1", "e6") for t in ("t1", "t2", "t5", "t7")} | {("e2", "t4")}
    return rows, want


def test_overlaps(spark):
    rows, want = records()
    got = crosssplit.overlaps(df(spark, rows, "row_id string, evaluation boolean, payload string")).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert crosssplit.overlaps(df(spark, [], "row_id string, evaluation boolean, payload string")).count() == 0


def test_overlaps_of_many_copies(spark):
    import json

    a = json.dumps({"ancient": han(60, 40)})
    rows = [(f"e{i:03}", True, a) for i in range(60)] + [(f"t{i:03}", False, a) for i in range(60)]
    got = {tuple(r) for r in crosssplit.overlaps(df(spark, rows, "row_id string, evaluation boolean, payload string")).collect()}
    assert {e for e, _ in got} == {f"e{i:03}" for i in range(60)} and {t for _, t in got} == {f"t{i:03}" for i in range(60)} and len(got) < 200


def test_overlap_members_rebuild_every_pair(spark):
    import json

    rows = [(f"e{i:03}", True, json.dumps({"ancient": han(60, 40 + i % 2)})) for i in range(60)] + [(f"t{i:03}", False, json.dumps({"ancient": han(60, 40 + i % 3)})) for i in range(60)]
    t = df(spark, rows, "row_id string, evaluation boolean, payload string")
    m, pairs = crosssplit.overlap_members(t).collect(), crosssplit.overlap_passages(t).collect()
    own = {side: {} for side in (True, False)}
    for x in m:
        own[x.evaluation].setdefault(x.passage, set()).add(x.row_id)
    assert {(e, t) for p in pairs for e in own[True][p.eval_passage] for t in own[False][p.train_passage]} == {(f"e{i:03}", f"t{j:03}") for i in range(60) for j in range(60) if i % 2 == j % 3}
    assert all(x.links == 1 for x in m)


def test_hot_shingles_are_split_without_loss(spark, monkeypatch):
    rows, want = records()
    monkeypatch.setattr(crosssplit, "_splits", lambda counts: np.full(len(counts), 3, np.int32))
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(crosssplit)
    try:
        got = {tuple(r) for r in crosssplit.overlaps(df(spark, rows, "row_id string, evaluation boolean, payload string")).collect()}
    finally:
        cloudpickle.unregister_pickle_by_value(crosssplit)
    assert got == want


def test_cut_json_keeps_its_passages():
    assert crosssplit.passages('{"messages": [{"role": "user", "content": "a\\u4e00b"}, {"content": "c\\u4e', True) == ["a一b", "c"]
    assert crosssplit.passages('{"ancient": "x", "messages": 3}', True) in (["x"], ["x", ]) and crosssplit.passages("", True) == []


def test_overlaps_in_a_prompt_whose_payload_is_cut(spark):
    import json

    from corpusloom.llm import queries as q

    a, b = han(60, 50), han(60, 51)
    tables = {
        "eligible": df(spark, [("e1", "dev", "s", json.dumps({"ancient": a})), ("e2", "test", "s", json.dumps({"ancient": b}))], "id string, split string, source string, payload string"),
        "pool": df(spark, [("t1", "译：" + a, "f", json.dumps({"messages": [{"role": "user", "content": "译：" + a}]})[:90]), ("t2", b, "f", None), ("t3", None, "f", None), ("t4", "x", "f", json.dumps({"messages": [{"role": "user", "content": a + "😀"}]})[:-10])], "pool_id string, prompt string, family string, payload string"),
    }
    assert tables["pool"].where("pool_id = 't4' and endswith(payload, 'ud83d')").count() == 1  # cut inside a pair
    old, q.table = q.table, lambda spark, d, name: tables[name]
    try:
        got = [tuple(r) for r in q.p4_found(spark, "").collect()]
    finally:
        q.table = old
    assert sorted(got) == [("e1", "t1"), ("e1", "t4"), ("e2", "t2")]


# ---------------------------------------------------------------- 5


def test_ledger(spark):
    shape = "doc_id string, text string, source string, language string, domain string, loaded_at timestamp"
    import datetime as dt

    t0, t1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)
    first = [("a", "hello world", "s", "EN", " General ", t0), ("b", "天地玄黃", "s", "zho", None, t0), ("c", "hello world", "t", "klingon", "", t0), ("d", None, "s", None, "x", t0), ("a", "hello world", "s", "EN", " General ", t1)]
    count = lambda x: tokens.Counter(spark)(x) if x else 0
    one = tokens.update(df(spark, first, shape), tokens.empty_ledger(spark))
    cube = {tuple(r)[:3]: (r.docs, r.tokens) for r in one.cube.collect()}
    assert cube == {("s", "en", "general"): (1, count("hello world")), ("s", "zh", "unknown"): (1, count("天地玄黃")), ("t", "unknown", "unknown"): (1, count("hello world")), ("s", "unknown", "x"): (1, 0)}
    second = [("a", "hello brave new world", "s", "en", "general", t1), ("c", "hello world", "t", "fr", "", t1), ("e", "天地玄黃", "s", "zh", None, t1)]
    two = tokens.update(df(spark, second, shape), one)
    fresh = tokens.update(df(spark, second, shape), tokens.empty_ledger(spark))
    key = lambda x: sorted(tuple(r) for r in x.cube.collect())
    assert key(two) == key(fresh)
    assert two.counts.count() == one.counts.count() + 1  # only the new content was encoded
    assert tokens.rollup(two.cube).where("level = ''").first().docs == 3
    assert tokens.update(df(spark, [], shape), two).cube.count() == 0
    x = tokens.count_tokens(df(spark, [(1, "hello"), (2, None), (3, ""), (4, "字" * 30_000)], "k long, text string"), ["k"])
    assert {r.k: r.tokens for r in x.collect()} == {1: count("hello"), 2: 0, 3: 0, 4: count("字" * 30_000)}


def test_kept_ledger_encodes_only_new_texts(spark, tmp_path, monkeypatch):
    import datetime as dt

    shape, t = "doc_id string, text string, source string, language string, domain string, loaded_at timestamp", dt.datetime(2024, 1, 1)
    rows = [(c, f"text number {c}", "s", "en", "x", t) for c in "abcd"]
    path = str(tmp_path / "ledger")
    tokens.save(tokens.update(df(spark, rows, shape), tokens.load(spark, path)), path)
    kept = tokens.load(spark, path)
    later = df(spark, [*rows[1:], ("e", "something new", "s", "en", "x", t)], shape)
    two = tokens.update(later, kept)
    assert two.counts.count() == kept.counts.count() + 1
    assert tokens.save(two, path) == 2
    fresh = tokens.update(later, tokens.empty_ledger(spark))
    assert sorted(map(tuple, tokens.load(spark, path).cube.collect())) == sorted(map(tuple, fresh.cube.collect()))


# ---------------------------------------------------------------- 6


def test_titles(spark):
    titles = {"《岚集》": "岚集", " 岚​集 ": "岚集", "岚集·卷三": "岚集", "《岚集》卷上": "岚集", "岚集 第十二卷": "岚集", "岚集续": "岚集续", "佚名": None, "": None, "Unknown": None, "卷一": "卷一", None: None, "嵐集": "嵐集"}
    got = df(spark, [(t,) for t in titles], "t string").select("t", splits.book_key(F.col("t")).alias("k")).collect()
    assert {r.t: r.k for r in got} == titles


def test_torn_and_assigned(spark):
    r = random.Random(4)
    rows = [(f"r{i}", r.choice([f"书{r.randrange(40)}", "佚名", None]), r.choice([f"g{r.randrange(60)}", "unresolved:1", None]), r.choice(["train", "dev", "test", None])) for i in range(400)]
    rows += [(f"h{i}", "大书", None, "train") for i in range(150)] + [rows[0], (None, "书1", None, "dev")]
    p = {}

    def find(x):
        while p.setdefault(x, x) != x:
            x = p[x]
        return x

    for i, b, d, _ in rows:
        if i:
            for k in (("b", b) if b and b != "佚名" else None, ("d", d) if d and not d.startswith("un") else None):
                if k:
                    p[find(i)] = find(k)
    by = {}
    for i, _, _, s in rows:
        if i:
            by.setdefault(find(i), {}).setdefault(s, set()).add(i)
    want = {i for g in by.values() if len(g.keys() - {None}) > 1 for ids in g.values() for i in ids}
    table = df(spark, rows, "id string, book string, doc string, split string")
    assert {x.id for x in splits.torn(table).collect()} == want
    got = splits.assign(table, {"train": 0.8, "dev": 0.1, "test": 0.1}).collect()
    assert len(got) == 550 and {x.id for x in got if x.torn} == want
    home = {}
    for x in got:
        assert home.setdefault(find(x.id), x.new_split) == x.new_split
    empty = table.where("false")
    assert splits.torn(empty).count() == 0 and splits.assign(empty, {"train": 0.9, "dev": 0.1}).count() == 0


def test_kept_forest_ties_later_deliveries(spark, tmp_path):
    shape, path = "id string, book string, doc string, split string", str(tmp_path / "forest")
    splits.tied(df(spark, [("1", "甲", "g1", None), ("2", "乙", "g1", None)], shape), path)
    got = {r.id: r.root for r in splits.tied(df(spark, [("3", "甲", None, None), ("4", "乙", "g2", None), ("5", None, "g2", None), ("6", "丙", "g3", None)], shape), path).collect()}
    assert got["3"] == got["4"] == got["5"] != got["6"]


def test_share_report(spark):
    rows = [(f"r{i}", f"book{i // 3}", None, "train") for i in range(3000)]
    rep = {r.new_split: r for r in splits.share_report(splits.assign(df(spark, rows, "id string, book string, doc string, split string"), {"train": 0.8, "dev": 0.1, "test": 0.1}), {"train": 0.8, "dev": 0.1, "test": 0.1}).collect()}
    assert sum(r.records for r in rep.values()) == 3000 and sum(r.sets for r in rep.values()) == 1000 and all(abs(r.share - r.target) < 0.02 and r.torn_sets == 0 for r in rep.values())


def test_proportions(spark):
    rows = [(f"r{i}", f"book{i // 3}", None, "train") for i in range(6000)]
    got = splits.assign(df(spark, rows, "id string, book string, doc string, split string"), {"train": 0.9, "dev": 0.05, "test": 0.05}).groupBy("new_split").count().collect()
    share = {r.new_split: r["count"] / 6000 for r in got}
    assert abs(share["dev"] - 0.05) < 0.01 and abs(share["test"] - 0.05) < 0.01


# ---------------------------------------------------------------- 7


def test_packing_round_trip(spark):
    r = random.Random(6)
    sizes = [(i, r.choice([0, 5, 17, 100, 511, 512, 513, 3000, r.randrange(1, 400)])) for i in range(900)] + [(1000, None), (7, 30)]
    kinds = df(spark, [("s", 512), ("l", 2048), ("bad", None), ("zero", 0), ("s", 512)], "container_kind string, capacity_tokens int")
    limits = packing.Limits(block=200)
    got = packing.pack(df(spark, sizes, "doc_id long, tokens long"), kinds, limits).toPandas()
    for kind, c in (("s", 512), ("l", 2048)):
        x = got[got.container_kind == kind]
        assert (x.groupby("container_id").tokens.sum() <= c).all() and (x.groupby("container_id").size() <= max(8, c // 32)).all()
        assert x.tokens.sum() == sum(n or 0 for _, n in sizes)
        for doc, n in sizes:
            if n and doc != 7:
                own = x[x.doc_id == doc].sort_values("first_token")
                assert (own.first_token + own.tokens).tolist()[-1] == n and len(own) == -(-n // c)
    assert set(got.container_kind) == {"s", "l"}
    fill = {r.container_kind: r.fill for r in packing.fill_report(packing.pack(df(spark, [(i, r.randrange(20, 300)) for i in range(3000)], "doc_id long, tokens long"), kinds), kinds).collect()}
    assert min(fill.values()) > 0.97
    assert packing.pack(df(spark, [], "doc_id long, tokens long"), kinds).count() == 0


def test_attention_binds_and_long_repeats_stay_apart(spark):
    r = random.Random(7)
    kinds = df(spark, [("s", 512)], "container_kind string, capacity_tokens int")
    items = df(spark, [(i, r.randrange(20, 500)) for i in range(2000)] + [(9999, 1200), (9999, 1200)], "doc_id long, tokens long")
    got = packing.pack(items, kinds)
    assert packing.fill_report(got, kinds).first().over == 0
    free = packing.fill_report(packing.pack(items, kinds, packing.Limits(attention=9.0)), kinds).first()
    assert free.over > 0  # without the limit some containers cost more


def test_best_fit_respects_every_limit():
    limits = packing.Limits(attention=0.5)
    sizes = np.array([300, 300, 200, 100, 100, 50, 512])
    b = packing.best_fit(sizes, 512, limits)
    for k in set(b):
        own = sizes[b == k]
        assert own.sum() <= 512 and (len(own) == 1 or (own / 512 * own / 512).sum() <= 0.5 + 1e-9)


# ---------------------------------------------------------------- 8


def test_mixing(spark):
    r = random.Random(8)
    docs = [(i, s, r.randrange(10, 200)) for i, s in enumerate(["big"] * 3000 + ["mid"] * 600 + ["tiny"] * 20)] + [(9000, None, 10), (9001, "other", 10), (9002, "big", 0), (9003, "big", None)]
    targets = [("big", 0.5, 1), ("mid", 0.4, 3), ("tiny", 0.05, 4), ("gone", 0.05, 2)]
    sel, rep = mixing.mix(df(spark, docs, "doc_id long, source string, tokens long"), df(spark, targets, "source string, target_share double, max_repeats int"))
    s = sel.toPandas()
    most = s.groupby(["source", "doc_id"])["copy"].max()
    assert most["big"].max() <= 1 and most["mid"].max() <= 3 and most["tiny"].max() <= 4 and set(s.source) == {"big", "mid", "tiny"}
    share = {x.source: x.actual_share for x in rep.collect()}
    assert abs(share["big"] / share["mid"] - 0.5 / 0.4) < 0.05 and share["gone"] == 0 and share["other"] == 0
    spread = s.groupby(["source", "doc_id"]).size()
    assert spread["mid"].max() - spread["mid"].min() <= 1
    total = mixing.mix(df(spark, docs, "doc_id long, source string, tokens long"), df(spark, targets[:2], "source string, target_share double, max_repeats int"), total=50_000)[0]
    assert abs(total.agg(F.sum("tokens")).first()[0] - 50_000) < 1500
    none = mixing.mix(df(spark, [], "doc_id long, source string, tokens long"), df(spark, targets, "source string, target_share double, max_repeats int"))
    assert none[0].count() == 0 and none[1].count() == 4


# ---------------------------------------------------------------- 9


def test_pursuit_is_exact_and_explains_mixtures():
    r, p = np.random.default_rng(2), subjects.Params()
    a = r.standard_normal((300, 64)).astype(np.float32)
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    x = np.concatenate([a[:50] + 0.3 * r.standard_normal((50, 64)) / 8, 0.7 * a[:50] + 0.4 * a[100:150]]).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    at, w = subjects.pursue(x, np.full(len(x), -1), a, a @ a.T, p)
    c = x @ a.T
    assert (at[:, 0] == c.argmax(1)).all() and np.allclose(w[:, 0], c.max(1), atol=1e-5)
    assert np.mean([{i, 100 + i} <= set(at[50 + i, :2].tolist()) for i in range(50)]) > 0.9
    own, _ = subjects.pursue(a[:5], np.arange(5), a, a @ a.T, p)
    assert all(i not in own[i] for i in range(5))


def test_without_a_graph_no_document_has_a_subject(spark):
    docs = [(i, f"the match of team {i} and the coach of the league. the goal of the stadium number {i}.") for i in range(40)]
    d, s = df(spark, docs, "doc_id long, text string"), df(spark, [("sport", "")], "subject string, about string")
    seeds = df(spark, [(i, "sport") for i in range(10)], "doc_id long, subject string")
    p = dict(rare=0.0, common=1.0, evidence=-1.0)
    assert subjects.document_subjects(d, seeds, s, subjects.Params(**p, anchors=1, links=1, rounds=0)).where("doc_id >= 10").isEmpty()


def test_subjects_on_held_out_labels(spark):
    words = {"sport": "match team coach goal league stadium referee sprint".split(), "law": "court judge plaintiff statute appeal verdict lawyer contract".split(), "music": "chord tempo violin opera rhythm melody choir sonata".split()}
    filler = "window garden morning street letter kitchen basket visitor harbour weather".split()
    r = random.Random(9)

    def sentence(s):
        w = words.get(s, filler)
        return f"the {r.choice(w)} of the {r.choice(filler)} often keeps some {r.choice(w)}"

    truth, docs = {}, []
    for i in range(400):
        own = r.sample(list(words), r.choice([0, 1, 1, 1, 2]))
        parts = [sentence(s) for s in own for _ in range(5)] + [sentence("none") for _ in range(3 if own else 6)]
        r.shuffle(parts)
        truth[i] = set(own)
        docs.append((i, ". ".join(parts) + "."))
    docs += [(900, None), (901, ""), (0, docs[0][1])]
    labels = [(i, s) for i in range(120) for s in (truth[i] or {"none"})] + [(5, "unheard"), (777, "law"), (3, None)]
    got = subjects.document_subjects(df(spark, docs, "doc_id long, text string"), df(spark, labels, "doc_id long, subject string"), df(spark, [(s, "") for s in words], "subject string, about string"), subjects.Params(rare=0.001, common=0.4))
    found = {}
    for x in got.collect():
        found.setdefault(x.doc_id, set()).add(x.subject)
    held = range(120, 400)
    right = sum(found.get(i, set()) == truth[i] for i in held)
    assert right / len(held) > 0.9 and not {900, 901} & found.keys()
    none = subjects.document_subjects(df(spark, [], "doc_id long, text string"), df(spark, labels, "doc_id long, subject string"), df(spark, [("law", "")], "subject string, about string"))
    assert none.count() == 0


def test_every_document_takes_part_in_the_graph(spark):
    words = ["".join(chr(97 + g // 26**i % 26) for i in range(3)) for g in range(900)]
    docs = [(3 * g + j, f"{w}x {w}y {w}z. " * 3 + f"{w}x {w}y. " * j) for g, w in enumerate(words) for j in range(3)]
    labels = [(3 * g, f"s{g % 9}") for g in range(900)]
    got = subjects.document_subjects(df(spark, docs, "doc_id long, text string"), df(spark, labels, "doc_id long, subject string"), df(spark, [(f"s{i}", "") for i in range(9)], "subject string, about string"), subjects.Params(rare=0.0))
    assert {(x.doc_id, x.subject) for x in got.collect()} == {(i, f"s{i // 3 % 9}") for i, _ in docs}  # more documents than any sample of anchors held


def test_shares_spread_over_all_pairs(spark):
    r, n, k, m = np.random.default_rng(3), 60, 3, 25
    v = np.where(r.random((n, m)) < 0.2, r.random((n, m)), 0).astype("<f4")
    own = np.zeros((n, k))
    own[np.arange(15), np.arange(15) % k] = 1
    p = subjects.Params(rounds=4)
    rows = [(np.flatnonzero(x).astype("<i4").tobytes(), x[x > 0].tobytes(), o.tolist() if o.any() else None) for x, o in zip(v, own, strict=True)]
    graph = df(spark, rows, "terms binary, parts binary, own array<double>")
    places = np.zeros(1 << subjects.TERM_BITS, np.int32)
    places[:m] = np.arange(m)
    last, half = subjects.propagate(graph, places, k, p)

    def step(now, fixed):
        out = np.zeros((n, k))
        for i in range(n):
            w = v.astype(float) * (now.sum(1) > 0)[:, None]
            if fixed[i].any():
                w[i] = 0  # no seed is linked to itself
            walk = v[i] * w / np.maximum(w.sum(0), 1e-12)
            out[i] = walk.sum(1) @ now
        out = (out / np.maximum(out.sum(1, keepdims=True), 1e-12)) ** p.power
        return out / np.maximum(out.sum(1, keepdims=True), 1e-12)

    fixed, got = own, np.zeros((n, k))
    for i in range(p.rounds):
        if i == 2:
            fixed = np.where(((got.sum(1) > 0.5) & ((got * (own > 0)).sum(1) < 0.1))[:, None], 0, own)
        now = np.where(fixed.sum(1, keepdims=True) > 0, fixed, got)
        got = step(now, fixed)
    row, at = np.nonzero(v)
    links = row, at, v[row, at].astype(float)
    assert np.array_equal(subjects.trusted(links, own, half, p), fixed) and np.allclose(subjects.near(links, fixed, last, p), got, atol=1e-9)


# ---------------------------------------------------------------- registered queries


#: Queries that find nothing in the smallest tables.
MAY_BE_EMPTY = {"p4_found", "p4_members", "p4_passages", "p4_split_report"}


def test_registered_queries_run(spark):
    from pathlib import Path

    from corpusloom.llm import queries as q

    d = Path("/root/testdata/sf0.001")
    if not d.exists():
        pytest.skip("no test tables")
    for name, f in q.queries().items():
        got = f(spark, str(d))
        assert got.columns and (got.count() > 0 or name in MAY_BE_EMPTY), name
