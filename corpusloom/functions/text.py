"""Column functions over text: normalisation, character classes, hashes, n-grams and small parsers.

All of them are built-in expressions that stay in code generation, except the Unicode forms, edit-like measures
and parsers at the end, which are Arrow-batched pandas UDFs because Spark has no built-in for them.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StringType

#: White space of Unicode besides line ends, Han ranges, classical particles, structure signals.
BLANKS = r"\t\x{0B}\x{0C} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
CONTROL = r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}]"
HIDDEN = CONTROL[:-1] + r"\x{200B}-\x{200D}\x{2060}\x{FEFF}]"
HANZI = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{20000}-\x{323AF}]"
PARTICLES = "[兮矣焉哉曰於者也其之乎乃遂]"
MATH = r"\\(frac|sum|prod|int|sqrt|begin)\b|\$\$|[∑∏√∞∫∂∇≈≠≤≥]"
#: Printable: not a control, format, surrogate, private, unassigned or separator character, but blank, tab and line end are.
UNPRINTABLE = r"[\p{C}\p{Z}&&[^ \n\t]]"


@pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode NFC; null stays null."""
    return s.map(lambda x: x if x is None or unicodedata.is_normalized("NFC", x) else unicodedata.normalize("NFC", x))


@pandas_udf(StringType())
def nfkc_casefold(s: pd.Series) -> pd.Series:
    """NFKC and case folding; null stays null."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


def lines_normal(text: Column) -> Column:
    """CRLF and CR as LF, no blanks at line ends, none around the text."""
    t = F.regexp_replace(text, r"\r\n?", "\n")
    t = F.regexp_replace(t, rf"[{BLANKS}]+(\n|\z)", "$1")
    return F.regexp_replace(t, rf"\A[{BLANKS}\n]+|[{BLANKS}\n]+\z", "")


def normalize_text(text: Column) -> Column:
    """NFC, unified line ends, no control or zero-width characters, no blanks at line ends or around the text."""
    t = F.regexp_replace(nfc(text), r"\r\n?", "\n")
    return lines_normal(F.regexp_replace(t, HIDDEN + "+", ""))


def content_hash(text: Column) -> Column:
    """SHA-256 of the text with unified line ends and no trailing blanks."""
    return F.sha2(lines_normal(text), 256)


def class_count(text: Column, inside: str) -> Column:
    """Characters of a class, as the length of what is left without the runs outside it; no array of matches is built."""
    return F.length(F.regexp_replace(text, f"[^{inside}]+", ""))


def hanzi_count(text: Column) -> Column:
    return class_count(text, HANZI[1:-1])


def latin_count(text: Column) -> Column:
    return class_count(text, "A-Za-z")


def digit_count(text: Column) -> Column:
    return class_count(text, r"\p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨")


def printable_ratio(text: Column) -> Column:
    return F.try_divide(F.length(F.regexp_replace(text, UNPRINTABLE + "+", "")), F.length(text))


def compact(text: Column) -> Column:
    """Text without any white space."""
    return F.regexp_replace(text, rf"[{BLANKS}\r\n\x{{1C}}-\x{{1F}}]+", "")


def unpunctuated(text: Column) -> Column:
    """Text without punctuation and white space."""
    return F.regexp_replace(compact(text), r"\p{P}+", "")


def stable_key(seed: int, namespace: str, value: Column) -> Column:
    """A 60-bit key of (seed, namespace, value), the same on any engine with SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit(namespace), value.cast("string")), 256), 1, 15), 16, 10).cast("bigint")


def stable_fraction(seed: int, namespace: str, value: Column) -> Column:
    """The stable key as a fraction in [0, 1)."""
    return stable_key(seed, namespace, value) / F.lit(float(1 << 60))


@pandas_udf(StringType())
def blake_key(s: pd.Series) -> pd.Series:
    """BLAKE2b-64 of a string as 16 hex digits, big endian."""
    return s.map(lambda x: None if x is None else hashlib.blake2b(x.encode(), digest_size=8).hexdigest())


def let(value: Column, f) -> Column:
    """``f`` applied to a value that is computed once, also where ``f`` uses it inside another lambda."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _slices(parts: Column, k: int, mark: str) -> Column:
    return let(parts, lambda t: F.when(F.size(t) >= k, F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(t, i, k), mark))).otherwise(F.array().cast("array<string>")))


def char_grams(text: Column, k: int) -> Column:
    """All windows of ``k`` characters; none where the text is shorter. Linear in the text, which is split once."""
    return F.when(F.length(text) >= k, _slices(F.split(text, ""), k, "")).otherwise(F.array().cast("array<string>"))


def words(text: Column) -> Column:
    """Lower-case runs of letters, digits, marks and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}\p{M}_]+"), F.lit(0))


def code_tokens(text: Column) -> Column:
    """Identifiers, numbers and single other signs."""
    return F.regexp_extract_all(text, F.lit(r"[A-Za-z_][A-Za-z_0-9]*|\d+(?:\.\d+)?|[^\s]"), F.lit(0))


def windows(tokens: Column, k: int) -> Column:
    """All runs of ``k`` tokens joined by a blank; none where there are fewer."""
    return _slices(tokens, k, " ")


def book_parts(title: Column) -> Column:
    """A catalogue title split at its level marks."""
    return F.transform(F.split(F.regexp_replace(title, "[·/‧]", "·"), "·"), lambda x: F.regexp_replace(x, rf"\A[{BLANKS}]+|[{BLANKS}]+\z", ""))


#: Titles that name no book.
NO_BOOK = ("", "unknown", "佚名", "未详", "未詳", "不详", "不詳", "未知", "无名", "無名", "失名", "缺名", "阙名", "闕名", "无", "無", "无题", "無題", "anonymous", "anon", "untitled", "none", "null", "nil", "n/a", "na", "tbd", "-", "--", "—", "?", "？")
BOOK_NUMBER = "[一二三四五六七八九十百千零〇两兩廿卅0-9０-９]+"
BOOK_VOLUME = rf"[·•・．.:：,，、—_(（\[-]*(?:第{BOOK_NUMBER}[卷巻册冊回章篇部]|[卷巻册冊][之第]?(?:{BOOK_NUMBER}[上中下]?|[上中下首末前後后终終]))[)）\]]*$"
BOOK_HIDDEN = r"[\p{Cf}\x{34F}\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}]|[\p{Z}\s\x{85}]"
BOOK_MARKS = "[《》〈〉「」『』【】﹁﹂﹃﹄“”‘’\"']"


def book_key(title: Column) -> Column:
    """The book that a title names, or null: title marks, blanks, characters without width and a volume mark after it do not matter."""
    bare = F.regexp_replace(F.regexp_replace(title, BOOK_HIDDEN, ""), BOOK_MARKS, "")
    cut = F.regexp_replace(bare, BOOK_VOLUME, "")
    name = F.when(cut == "", bare).otherwise(cut)
    return F.when(~F.lower(name).isin(*NO_BOOK), name)


def doc_key(doc: Column) -> Column:
    """The document group, or null where it is empty or unresolved."""
    return F.when((F.trim(doc) != "") & ~F.trim(doc).startswith("unresolved:"), F.trim(doc))


def path_suffix(path: Column) -> Column:
    """Lower-case suffix of a path's last part, with its dot; empty if it has none."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]+)\z", 1))


def path_parent(path: Column) -> Column:
    """Name of the directory that holds a path."""
    return F.regexp_extract(path, r"([^/]+)/[^/]*\z", 1)


def verdict(text: Column) -> Column:
    """Y or N of the last line that is not blank, null if it is neither."""
    last = F.upper(F.trim(F.regexp_extract(text, rf"([^\n]*[^\n{BLANKS}])[{BLANKS}\n]*\z", 1)))
    return F.when(last.isin("Y", "N"), last)


#: How an answer states its option, in the order in which they are tried, with the group that names it.
CHOICE_STATED = (
    (r"答案(选项)?(是|为)：? ?([ABCD])", 3),
    (r"答案(是|为)选项 ?([ABCD])", 2),
    (r"故?选择?：? ?([ABCD])", 1),
    (r"([ABCD]) ?选?项(是|为)?正确", 1),
    (r"正确的?选项(是|为) ?([ABCD])", 2),
    (r"答案(应该)?(是|为)([ABCD])", 3),
    (r"选项 ?([ABCD]) ?(是|为)?正确", 1),
    (r"选择答案 ?([ABCD])", 1),
    (r"答案?：?([ABCD])", 1),
    (r"([ABCD])(选?项)?是?符合题意", 1),
    (r"答案选项：? ?([ABCD])", 1),
    (r"答案(选项)?为(.*?)([ABCD])", 3),
    (r"content=(.*?)([ABCD])(.*?)", 2),
)
CHOICE_AFTER = ("当选", "正确")
CHOICE_WEAK = r"[^不]是：? ?([ABCD])"


def choice(text: Column) -> Column:
    """The option A to D that an answer names, Z if none, also for null.

    In falling order: a letter that opens the text; the stated patterns; the last letter before a word that
    picks it, from the first letter that such a word follows on its line; the weak pattern; the only letter
    in the text. A line ends with a line feed only.
    """
    found = lambda pattern, group: F.nullif(F.regexp_extract(text, "(?d)" + pattern, group), F.lit(""))
    tried = [found(r"\A([ABCD])", 1), *(found(p, g) for p, g in CHOICE_STATED)]
    tried += [F.nullif(F.regexp_extract(F.regexp_extract(text, f"(?d)[ABCD].*?{word}", 0), "(?d).*([ABCD])", 1), F.lit("")) for word in CHOICE_AFTER]
    letters = F.regexp_replace(text, "[^ABCD]+", "")
    return F.coalesce(*tried, found(CHOICE_WEAK, 1), F.when(F.length(letters) == 1, letters), F.lit("Z"))


def repeated_gram_share(tokens: Column, k: int = 4) -> Column:
    """Share of k-grams that repeat an earlier one; 0 where there is none."""
    return let(windows(tokens, k), lambda g: F.when(F.size(g) > 0, 1 - F.try_divide(F.size(F.array_distinct(g)), F.size(g))).otherwise(0.0))


def _loops(text: str) -> bool:
    for width in range(1, 65):
        unit, n = text[-width:], 0
        if len(unit) < width or not any(c.isalnum() for c in unit):
            continue
        while text.endswith(unit, 0, len(text) - n * width):
            n += 1
        if n >= (16 if width == 1 else 4) and n * width * 2 >= len(text):
            return True
    return False


@pandas_udf(BooleanType())
def ends_in_loop(s: pd.Series) -> pd.Series:
    """Whether a text ends in a unit of 1 to 64 characters repeated over at least half of it (16 times for one character, else 4)."""
    return s.map(lambda x: bool(x) and _loops(x.rstrip())).astype(bool)


_MIXED = re.compile(r"[㐀-䶿一-鿿]|[^\W㐀-䶿一-鿿]+")


def mixed_tokens(text: str) -> list[str]:
    """Ideographs one by one and other word runs, in NFKC and lower case."""
    return _MIXED.findall(unicodedata.normalize("NFKC", text or "").lower())


def _common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, with one bit per token of ``a``."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    whole = (1 << len(a)) - 1
    row = whole
    for y in b:
        hit = row & at.get(y, 0)
        row = (row + hit | row - hit) & whole
    return len(a) - row.bit_count()


@pandas_udf(DoubleType())
def sequence_f1(prediction: pd.Series, reference: pd.Series) -> pd.Series:
    """F1 of the longest common subsequence over mixed tokens; 1 if both are empty."""

    def one(p: str, r: str) -> float:
        a, b = mixed_tokens(p), mixed_tokens(r)
        if not a or not b:
            return float(a == b)
        n = _common_subsequence(a, b)
        return 2 * n / (len(a) + len(b)) if n else 0.0

    return pd.Series([one(p, r) for p, r in zip(prediction, reference, strict=True)], dtype=float)


@pandas_udf(ArrayType(StringType()))
def json_strings(s: pd.Series) -> pd.Series:
    """All string leaves of a JSON text in document order; none where it is not JSON."""

    def leaves(x) -> list[str]:
        if isinstance(x, str):
            return [x]
        if isinstance(x, dict):
            x = list(x.values())
        return [y for v in x for y in leaves(v)] if isinstance(x, list) else []

    def one(x):
        try:
            return leaves(json.loads(x)) if x else []
        except ValueError:
            return []

    return s.map(one)


def byte_alphabet() -> dict[int, str]:
    """Byte-level vocabularies write each byte as a visible character: printable Latin-1 ones stand for themselves, the others follow from U+0100 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(hidden)}


#: Tone marks.
TONES = {"̄": 1, "́": 2, "̌": 3, "̀": 4}
INITIALS = ("zh", "ch", "sh", *"bpmfdtnlgkhjqxrzcsyw")


def pinyin_parts(syllable: str) -> tuple[str, str, int]:
    """(initial, final, tone) of a syllable with a tone mark or number; tone 5 if it has none."""
    x = unicodedata.normalize("NFD", syllable.strip().lower())
    tone = next((TONES[c] for c in x if c in TONES), 5)
    x = unicodedata.normalize("NFC", "".join(c for c in x if c not in TONES)).replace("u:", "ü").replace("v", "ü")
    if x and x[-1].isdigit():
        tone, x = int(x[-1]) or 5, x[:-1]
    initial = next((i for i in INITIALS if x.startswith(i)), "")
    return initial, x[len(initial) :], tone


def nearest_rank(values: Column, q: float) -> Column:
    """The value of rank ceil(q * n) of an array column; null if it is empty."""
    return F.get(F.array_sort(values), F.ceil(F.lit(q) * F.size(values)).cast("int") - 1)


