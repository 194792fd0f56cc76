"""Inspected examples of natural text, code, lists, tables and junk; each group starts one component of the mixture."""

from __future__ import annotations

import random

_ZH = (
    "谁都知道院子里的梅树是去年冬天种下的。因为雨水不足，它长得很慢；不过到了春天，枝头还是开了花，邻居们都很高兴。",
    "所谓仲裁，就是让双方把证据放在一起看，再由第三方作出裁定。若没有完整的合同，便难以说明损失的原因。",
    "第12页提到这座桥的修建过程，大约有300个工人参加。一旦河水上涨，材料就难以运到，所以工期比原来的计划更长。",
    "这里的温度比山下更低，关于土壤的记录也很少见。总的来说，农户往往依靠经验决定什么时候播种，什么时候施肥。",
    "编号AB-204的样品被放在显微镜下，晶体的结构逐渐清楚。然而，谁也没料到电压的变化会影响结果！",
    "傍晚车站的旧照片又被人提起，大家先后谈到那一年的计划。没有信件，也就没有新的消息，这件事因此慢慢被忘记了？",
)
_EN = (
    "The bridge behind the station was finished before the rain came. Nobody in the village had seen such a thing, and they often walked there in the evening.",
    "On page 41 the author says that the court rejected the claim, because there was no evidence of damage. What they call a precedent is only one more opinion.",
    "It was 12 days before the laboratory had its answer. About 30 in a hundred samples contained the enzyme, while the others slowly lost their colour.",
    "Every player describes some difficult match. With the coach gone, the team explains nothing but the score; in the first week they almost left the league.",
    "No theorem follows the lemma without help from the axiom, and one proof of it clearly covers the general case. You would think the rest is easy.",
)
_FR = ("Le pont derrière la gare était fini avant la pluie. Personne dans le village ne disait que la rivière est dangereuse, mais les enfants y vont avec leur père.", "Selon le rapport, la moitié des champs ne sont pas irrigués; ce qui reste dans les greniers est pour les animaux, et il n'y a plus de grain.")
_GU = (
    "夫水者柔之至也，是以能入於石。昔智者觀於深河，知其不可渡也，故不爭其先。",
    "未聞其名焉知其志，友之於道猶舟之於江。春來而花盛，秋去則葉薄！",
    "昔農耕於南野，行路者問之曰：何不歸乎？對曰：田未治而日已暮，故不敢息也。",
    "月出於東山之上，白露橫江，清風徐來。哀吾生之短，樂萬物之無窮；臨高樓而望遠客。",
)
_NOUNS_ZH = "车站 灯笼 材料 茶馆 计划 合同 法院 晶体 温度 围巾 桥梁 早市 音阶 观众 种子 果园 股票 利率 药物 疫苗 函数 矩阵 古墓 王朝 线程 缓存 旧照片 石板路 投资组合 显微镜 微分方程 单元测试".split()
_NOUNS_EN = "lantern bridge kitchen window report crystal electron market statute plaintiff vaccine kidney theorem matrix tractor barn dynasty fortress thread compiler chord soprano referee stadium café résumé".split()


def _pick(seed: int, words: list[str], n: int) -> list[str]:
    r = random.Random(seed)
    return [r.choice(words) for _ in range(n)]


def _pairs(seed: int, words: list[str], n: int, join: str) -> list[str]:
    r = random.Random(seed)
    return [join.join(r.choice(words) for _ in range(r.choice((1, 2, 2, 3) if join else (2, 2)))) for _ in range(n)]


def _cells(seed: int, words: list[str], rows: int, cols: int) -> list[list[str]]:
    r = random.Random(seed)
    return [[r.choice(words), *(r.choice((f"{r.random() * 100:.2f}", str(r.randrange(9999)), f"{r.random() * 100:.1f}%", "-", r.choice(words))) for _ in range(cols - 1))] for _ in range(rows)]


def _junk(seed: int, chars: str, n: int) -> str:
    r = random.Random(seed)
    return "".join(r.choice(chars) for _ in range(n))


def _shuffled(seed: int, text: str) -> str:
    r, c = random.Random(seed), list(text)
    r.shuffle(c)
    return "".join(c)


def _broken(text: str) -> str:
    return "".join(c if ord(c) > 0x9F or c.isascii() else "▒" for c in text.encode().decode("latin-1"))


def _lists(mark) -> list[str]:
    return ["\n".join(mark(i, x) for i, x in enumerate(_pairs(s, w, n, j))) for s, w, n, j in ((1, _NOUNS_ZH, 9, ""), (2, _NOUNS_EN, 12, " "), (3, _NOUNS_ZH, 24, ""), (4, _NOUNS_EN, 26, " "))]


def _items(mark) -> list[str]:
    zh = [x.strip("。！？") for t in _ZH for x in t.split("，")]
    en = [x.strip(". ").lower() for t in _EN for x in t.replace(";", ".").split(". ")]
    return ["\n".join(mark(i, x) for i, x in enumerate(part)) for part in (zh[:9], zh, en[:7], en)]


def _tables(row) -> list[str]:
    return ["\n".join(row(c) for c in _cells(s, w, n, k)) for s, w, n, k in ((1, _NOUNS_ZH, 9, 3), (2, _NOUNS_EN, 14, 5), (3, _NOUNS_ZH, 16, 7), (4, _NOUNS_EN, 12, 4))]


def _run(sep: str, fit) -> list[str]:
    return [sep.join(fit(i, x) for i, x in enumerate(_pairs(s, w, n, j))) for s, w, n, j in ((5, _NOUNS_ZH, 20, ""), (6, _NOUNS_EN, 20, " "), (7, _NOUNS_ZH, 45, ""), (8, _NOUNS_EN, 40, " "))]


_BULLETS = ("-", "•", "○", "◆", "►", "*")
_PY = 'def load_table(path_name, row_limit=20):\n    """The reader opens the file and returns its rows."""\n    if row_limit > 5:\n        path_name = path_name + str(row_limit)\n    rows = [x * 3 for x in range(row_limit)]\n    return rows\n'
_JS = "function mergeRows(left_part) {\n  const right_part = left_part.map(x => x + 12);\n  // The last row is often empty.\n  return right_part.filter(y => y % 3 === 0);\n}\n"
_SQL = "SELECT user_name, COUNT(*) AS order_count\nFROM order_table\nWHERE price_total >= 100 AND city_name IS NOT NULL\nGROUP BY user_name; -- It is only one more report.\n"

#: Common words of page navigation.
_BOILERPLATE = ["home", "about us", "contact", "log in", "next page", "首页", "关于我们", "登录", "下一页", "版权所有"]


def _crumbs(sep: str) -> list[str]:
    """Rows of navigation: link words, counters and titles between separators."""
    out = []
    for s, words, n in ((11, _NOUNS_ZH, 24), (12, _NOUNS_EN, 20), (13, _NOUNS_ZH, 60), (14, _NOUNS_EN, 50)):
        r, own = random.Random(s), [x for x in _BOILERPLATE if x.isascii() == words[0].isascii()]
        out.append(sep.join(f"{r.choice(own)} {r.choice(('[{}]', '({})', '{}')).format(r.randrange(99))} {r.choice(words)}" for _ in range(n)))
    return out


EXAMPLES: list[tuple[str, list[str]]] = [
    ("prose", [*_ZH, "".join(_ZH[:3]), "\n\n".join(_ZH)]),
    ("prose", [*_EN, " ".join(_EN[:3]), "\n\n".join(_EN)]),
    ("prose", [*_FR, "\n".join(_FR)]),
    ("prose", [_ZH[0] + _EN[0], "共有 12 个 theorem 说明矩阵，这个 compiler 仍然接近线程。" + _ZH[3], _EN[2] + _ZH[4], "参见 RX-12 里的 codex 与典籍，共有 30 个 stanza 保留下来。"]),
    ("prose", [*_GU, "".join(_GU), "".join(_GU[1:3])]),
    ("prose", ["".join(c for c in x if c.isalpha()) for x in (*_GU, "".join(_GU), "".join(_GU[:2]), "".join(_GU[2:]))]),
    ("prose", ["\n".join(x.replace("，", "，\n").replace("。", "。\n").split("\n")) for x in _GU] + ["\n".join(_GU)]),
    ("prose", ["\n".join(t[i : i + 26] for i in range(0, len(t), 26)) for t in ("".join(_ZH[:3]), "".join(_ZH))]),
    ("prose", [" ".join(w + ("\n" if i % 9 == 8 else "") for i, w in enumerate(" ".join(t).split())) for t in (_EN[:2], _EN)]),
    ("prose", ["甲：" + _ZH[0] + "\n乙：" + _ZH[1] + "\n甲：" + _ZH[3], "A: " + _EN[0] + "\nB: " + _EN[1] + "\nA: " + _EN[3], "“" + _ZH[5] + "”\n“" + _ZH[2] + "”"]),
    ("code", [_PY, _PY * 3, _PY.replace("table", "index").replace("row", "node")]),
    ("code", [_JS, _JS * 3, _JS.replace("Rows", "Parts").replace("left", "first")]),
    ("code", [_SQL, _SQL * 4, _SQL.replace("user", "store").replace("city", "town")]),
    ("list", [x for b in _BULLETS for x in _lists(lambda i, x, b=b: f"{b} {x}")]),
    ("list", _lists(lambda i, x: f"{i + 1}. {x}") + _lists(lambda i, x: f"({i + 1}) {x}") + _lists(lambda i, x: f"{i + 1}、{x}") + _lists(lambda i, x: f"第{i + 1}项 {x}。")),
    ("list", _lists(lambda i, x: f"- {x};") + _lists(lambda i, x: f"· {x}。") + _lists(lambda i, x: f"({i + 1}) {x};")),
    ("list", [x for b in ("-", "►", "[ ]", "+") for x in _items(lambda i, x, b=b: f"{b} {x}")]),
    ("list", _items(lambda i, x: f"{i + 1}. {x}")),
    ("list", _lists(lambda i, x: x)),
    ("list", _lists(lambda i, x: f"{x}：{_NOUNS_ZH[i % 9]}{_NOUNS_ZH[(i + 5) % 11]}" if x[0] > "z" else f"{x}: {_NOUNS_EN[i % 7]} {_NOUNS_EN[(i + 4) % 9]}")),
    ("list", _lists(lambda i, x: f"{x} ({1990 + i})")),
    ("list", _run(", ", lambda i, x: f"{x} ({1990 + i})") + _run(". ", lambda i, x: x) + _run("  ", lambda i, x: x)),
    ("table", _tables(lambda c: "| " + " | ".join(c) + " |") + _tables(lambda c: "  |  ".join(c))),
    ("table", _tables(",".join)),
    ("table", _tables("\t".join)),
    ("table", _tables(lambda c: "".join(x.ljust(12) for x in c))),
    ("table", _tables(lambda c: "; ".join(f"key{i}={x}" for i, x in enumerate(c)))),
    ("table", _lists(lambda i, x: f"{x} {'.' * (6 + i % 9)} {i * 37 % 400}")),
    ("junk", [_junk(s, "abcdefghijkmnopqrstuvwxyz0123456789ABDEF+/=", n) for s, n in ((1, 200), (2, 500), (3, 300))]),
    ("junk", [_junk(s, "<>#;※★_-=~}{&@!?:|/%^$*()+◇■→abeinorstuL", n) for s, n in ((1, 200), (2, 500), (3, 300))]),
    ("junk", [_broken("".join(_ZH[a:b])) for a, b in ((0, 2), (1, 5), (3, 6))]),
    ("junk", [_shuffled(1, " ".join(_EN[:2])), _shuffled(2, " ".join(_EN)), _shuffled(3, _EN[3] + _EN[1])]),
    ("junk", [x for s in (" > ", " >> ", " » ") for x in _crumbs(s)]),
    ("junk", [x for s in (" / ", " | ", " · ") for x in _run(s, lambda i, x: x)]),
    ("junk", [m.join([x] * 30) for x, m in (("灯笼药物", "! "), ("buy lantern", "! "), ("旧照片利率", "！"), ("free window offer", " * "), ("茶馆", "\n"))]),
    ("junk", [s.join(_pick(k, w, 40)) for k, w, s in ((1, _NOUNS_ZH, "、"), (2, _NOUNS_EN, "，"), (3, _NOUNS_ZH, ", "), (4, _NOUNS_EN, " "), (5, _NOUNS_EN, " > "), (6, _NOUNS_ZH, " | "))]),
]
