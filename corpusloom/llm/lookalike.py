"""Problem 2: one form for texts that look the same but are stored in different characters.

Words that are not plain ASCII, and the ASCII words they may stand for, are gathered into a corpus vocabulary. Per
shard a trie of the vocabulary is walked with a weighted edit automaton in which look-alike letters of other
alphabets, widths, composed accents and characters without width cost nothing and all else costs something; of the
spellings reached at no cost one becomes canonical. What the vocabulary does not settle (words without another
spelling, ideographs, blanks) is normalised by a table of code points, which knows no other alphabets: whether a
letter stands for one of another alphabet is decided by the words of the corpus, never by the table.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import _text
from corpusloom.llm._sums import hash_filter, holds
from corpusloom.session import materialize

#: Spellings up to this many travel to the workers with the code; more are joined (``normalize``).
BROADCAST_WORDS = 200_000
#: Words per trie; a shard is chosen by the hash of the base form, so no shard grows with the data.
SHARD_WORDS = 2_000
WORD = regex.compile(r"(?V1)[[\p{L}\p{M}\p{N}\p{Cf}͏︀-️]--[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]]+")
ASCII_WORD = regex.compile(r"[A-Za-z0-9]+")


@lru_cache
def _marks() -> np.ndarray:
    """Code points that may compose with the one before, and those by which a word may have another spelling."""
    out = np.zeros((2, _text.SIZE), bool)
    for a, b in ((0x80, 0x2E80), (0xA640, 0xABF0), (0xFB00, 0x12000), (0x1D400, 0x1D800), (0xE0000, 0xE0200)):
        for cp in range(a, b):
            kind = unicodedata.category(chr(cp))
            out[0, cp] = kind[0] == "M"
            out[1, cp] = kind[0] in "LM" or kind in ("Nd", "Cf")
    return out


@lru_cache(maxsize=1 << 16)
def _base(char: str) -> str:
    return _text.base_form(char)


@lru_cache(maxsize=1 << 16)
def word_base(word: str) -> str:
    """The base form of one word: what all spellings of its look share."""
    return unicodedata.normalize("NFC", "".join(map(_base, word)))


@lru_cache(maxsize=1 << 16)
def tabled(word: str) -> str:
    """One word normalised by the table alone: its alphabet stays."""
    return unicodedata.normalize("NFC", "".join(map(_text.code_form, word)))


def tabled_strings(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts normalised by the table) of parts of a column."""
    table, marks = _text.code_table(), _marks()
    for first, part in _text.batches(column):
        points, ends = table.apply(*_text.codepoints(part))
        strings = _text.to_strings(points, ends)
        for i in np.flatnonzero(_held(marks[0], points, ends)):
            strings[i] = unicodedata.normalize("NFC", strings[i])
        yield first, strings


def _held(mask: np.ndarray, points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows that hold a code point of the mask."""
    return np.diff(np.concatenate([[0], np.cumsum(mask[points])])[ends]) > 0


def _wordy(column: pa.Array) -> Iterator[tuple[int, str]]:
    """(row, text) of the rows whose words may have other spellings."""
    marks = _marks()
    for first, part in _text.batches(column):
        points, ends = _text.codepoints(part)
        for i in np.flatnonzero(_held(marks[1], points, ends)).tolist():
            yield first + i, part[i].as_py()


# ---------------------------------------------------------------- vocabulary


def _count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts:
        seen: Counter = Counter()
        for _, text in _wordy(batch.column(0)):
            seen.update(w for w in WORD.findall(text) if not w.isascii())
        yield pa.RecordBatch.from_arrays([pa.array([f(w) for w in seen], pa.string()) for f in (word_base, str)] + [pa.array(list(seen.values()), pa.int64())], ["base", "spelling", "n"])


def _hashes(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w.encode()) for w in words], np.uint64).view(np.int64)


def vocabulary(texts: DataFrame) -> DataFrame:
    """(base, spelling, n): every word of ``text`` that is not plain ASCII, and every ASCII word that looks like one of them.

    ASCII words are looked up in a filter of fixed size first, so of the many of them only candidates are counted.
    """
    texts = texts.select("text").where("text is not null and text <> ''")
    found = materialize(texts.mapInArrow(_count, "base string, spelling string, n bigint").groupBy("base", "spelling").agg(F.sum("n").alias("n")), "spellings")

    def hashed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            yield pa.RecordBatch.from_arrays([pa.array(_hashes(batch.column(0).to_pylist()), pa.int64())], ["h"])

    plain = found.where(r"base rlike '^[A-Za-z0-9]+$'").select("base").distinct()
    held = texts.sparkSession.sparkContext.broadcast(hash_filter(plain.mapInArrow(hashed, "h bigint")))

    def ascii_words(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, shift = held.value
        if not bitmap.any():
            return
        for batch in parts:
            seen: Counter = Counter()
            for text in batch.column(0).to_pylist():
                seen.update(ASCII_WORD.findall(text))
            words = list(seen)
            keep = np.flatnonzero(holds(bitmap, shift, _hashes(words))) if words else []
            kept = [words[i] for i in keep]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), pa.array([seen[w] for w in kept], pa.int64())], ["base", "n"])

    ascii_ = texts.mapInArrow(ascii_words, "base string, n bigint").groupBy("base").agg(F.sum("n").alias("n")).join(plain, "base", "left_semi")
    return found.unionByName(ascii_.select("base", F.col("base").alias("spelling"), "n"))


def atoms(word: str) -> list[str]:
    """A word as single characters: ligatures and composed letters are taken apart, other look-alikes stay."""
    out: list[str] = []
    for c in word:
        base = unicodedata.normalize("NFD", _base(c))
        out += list(base) if len(base) > 1 else [c]
    return out


class Trie:
    """A trie of spellings and the weighted edit automaton over it."""

    def __init__(self, words: Iterable[str]):
        self.children: list[dict[str, int]] = [{}]
        self.word: dict[int, list[str]] = {}
        for w in words:
            node = 0
            for c in atoms(w):
                nxt = self.children[node].get(c)
                if nxt is None:
                    nxt = len(self.children)
                    self.children.append({})
                    self.children[node][c] = nxt
                node = nxt
            self.word.setdefault(node, []).append(w)

    def _skip(self, states: dict[int, float], most: float) -> dict[int, float]:
        """States after leaving out characters of the trie's words; those without width cost nothing."""
        todo = list(states)
        while todo:
            node = todo.pop()
            for c, nxt in self.children[node].items():
                cost = states[node] + (0 if not _base(c) else 1)
                if cost <= most and cost < states.get(nxt, most + 1):
                    states[nxt] = cost
                    todo.append(nxt)
        return states

    def find(self, word: str, most: float = 0) -> dict[str, float]:
        """Vocabulary words within weighted distance ``most``: look-alikes and characters without width cost 0, other edits 1."""
        states = self._skip({0: 0.0}, most)
        for c in atoms(word):
            base, nxt = _base(c), {}
            for node, cost in states.items():
                stay = cost + (1 if base else 0)
                if stay <= most and stay < nxt.get(node, most + 1):
                    nxt[node] = stay
                for x, child in self.children[node].items():
                    to = cost + (0 if x == c or _base(x) == base else 1)
                    if to <= most and to < nxt.get(child, most + 1):
                        nxt[child] = to
            states = self._skip(nxt, most)
            if not states:
                break
        return {w: cost for node, cost in states.items() for w in self.word.get(node, ())}


def regular(word: str) -> bool:
    """A spelling fit to be canonical: composed, without width forms or ignorables, letters of one script."""
    if unicodedata.normalize("NFC", word) != word or any(len(b := _base(c)) != 1 or (b != c and c not in _text.LOOKALIKE) for c in word):
        return False
    scripts = {unicodedata.name(c, "?").split()[0] for c in word if unicodedata.category(c)[0] == "L"}
    return len(scripts) == 1


def _best(known: dict[str, int], words: Iterable[str]) -> str:
    """The canonical one of spellings of one look: ASCII, else regular, else any; the most frequent, ties to the lower code points."""
    return min(words, key=lambda w: (not w.isascii(), not regular(w), -known[w], w))


def canonical_spellings(vocab: DataFrame) -> DataFrame:
    """(spelling, canonical): the words for which the trie names another form than the table does.

    Every word that is not plain ASCII is walked through the trie of its shard.
    """
    shards = max(1, -(-vocab.count() // SHARD_WORDS))

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        known = dict(zip(part.spelling, part.n, strict=True))
        trie, out = Trie(known), {}
        for word in known:
            if not word.isascii() and (best := tabled(_best(known, trie.find(word)))) != tabled(word):
                out[word] = best
        return pd.DataFrame({"spelling": list(out), "canonical": list(out.values())}, dtype=object)

    tasks = min(shards, max(4 * vocab.sparkSession.sparkContext.defaultParallelism, shards // 64))  # few bytes, much work: not to be merged into few tasks
    return vocab.withColumn("shard", F.pmod(F.xxhash64("base"), F.lit(shards))).repartition(tasks, "shard").groupBy("shard").applyInPandas(choose, "spelling string, canonical string")


# ---------------------------------------------------------------- normalisation


def _rewrite(spellings: dict[str, str] | None, hashed: bool):
    """mapInArrow function over (keys..., text[, own spellings]): the last columns become the canonical text or hashes."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            at = batch.schema.get_field_index("text")
            keys = [batch.column(i) for i in range(at)]
            text = batch.column(at)
            own = batch.column(at + 1).to_pylist() if batch.num_columns > at + 1 else None
            spelled = text
            if spellings or own:
                new = {}
                for i, t in _wordy(text):
                    known = spellings if own is None else dict(own[i] or ())
                    if known and (s := WORD.sub(lambda m, k=known: k.get(m[0], m[0]), t)) != t:
                        new[i] = s
                if new:
                    spelled = pa.array([new.get(i, t) for i, t in enumerate(text.to_pylist())], pa.string())
            out: list = [None] * len(text)
            for first, strings in tabled_strings(spelled):
                out[first : first + len(strings)] = strings
            if not hashed:
                nulls = text.is_null().to_numpy(zero_copy_only=False)
                for i in np.flatnonzero(nulls):
                    out[i] = None
                yield pa.RecordBatch.from_arrays([*keys, pa.array(out, pa.string())], [*batch.schema.names[:at], "canonical"])
            else:
                look = [xxhash.xxh3_128_digest(s.encode("utf-8", "surrogatepass")) for s in out]
                raw = [xxhash.xxh3_128_digest(s.encode()) for s in text.fill_null("").to_pylist()]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(look, pa.binary()), pa.array(raw, pa.binary())], [*batch.schema.names[:at], "look", "raw"])

    return run


def normalize(texts: DataFrame, hashed: bool = False, most_words: int = BROADCAST_WORDS, tries: bool = True) -> DataFrame:
    """Canonical text of every row of ``texts (src_table, row_id, text)``.

    Returns (src_table, row_id, canonical), or with ``hashed`` 128-bit hashes (look, raw) of the canonical and
    the stored text. A null text has a null canonical text and hashes as empty. Letter case, punctuation,
    raised or ringed digits and line ends are kept; the result does not depend on row order. Spellings that the
    tries change are sent with the code up to ``most_words`` words, beyond that joined to the words of each row.
    Without ``tries`` the table alone is applied, which shows what the vocabulary adds.
    """
    texts = texts.select("src_table", "row_id", "text")
    schema = "src_table string, row_id string, " + ("look binary, raw binary" if hashed else "canonical string")
    if not tries:
        return texts.mapInArrow(_rewrite(None, hashed), schema)
    spelled = materialize(canonical_spellings(materialize(vocabulary(texts), "vocabulary")), "spelled")
    if spelled.count() <= most_words:
        return texts.mapInArrow(_rewrite(dict(map(tuple, spelled.collect())), hashed), schema)
    return _joined(texts, spelled).mapInArrow(_rewrite(None, hashed), schema)


def _joined(texts: DataFrame, spelled: DataFrame) -> DataFrame:
    """texts with a map of its own spellings: the way for vocabularies too large to broadcast.

    Only ids and words are joined. A row repeated under one key gets the spellings of all its texts.
    """

    def words(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            rows: list[tuple] = []
            src, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, text in _wordy(batch.column(2)):
                rows += [(src[i], ids[i], w) for w in {w for w in WORD.findall(text) if not w.isascii()}]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.string()) for j in range(3)], ["src_table", "row_id", "spelling"])

    own = texts.mapInArrow(words, "src_table string, row_id string, spelling string").join(spelled, "spelling")
    own = own.groupBy("src_table", "row_id").agg(F.map_from_entries(F.collect_set(F.struct("spelling", "canonical"))).alias("own"))
    return texts.alias("t").join(own, ["src_table", "row_id"], "left").select("src_table", "row_id", "text", "own")


# ---------------------------------------------------------------- pairs


#: Pairs of string classes with at most this many member pairs are written out in full.
FULL_PAIRS = 1000
#: In a look of more different strings, copies beyond FULL_PAIRS are linked to one other string instead of to each.
FULL_CLASS = 10
#: The strings of one look are paired in blocks of about this many, so that a hot look is not one task.
BLOCK = 256


def look_classes(texts: DataFrame, **kw) -> tuple[DataFrame, DataFrame]:
    """(classes, members) of non-empty texts that look the same and are not all the same string.

    classes: src_table, look, raw, rep (least row_id), n, strings (different strings of that look), records (of
    that look), least (the least row_id of the look). members: src_table, look, raw, row_id.
    """
    rows = materialize(normalize(texts.where("text is not null and text <> ''"), hashed=True, **kw), "looks").distinct()
    classes = rows.groupBy("src_table", "look", "raw").agg(F.min("row_id").alias("rep"), F.count("*").alias("n"))
    looks = classes.groupBy("src_table", "look").agg(F.count("*").alias("strings"), F.sum("n").alias("records"), F.min("rep").alias("least")).where("strings > 1")
    classes = materialize(classes.join(looks, ["src_table", "look"]), "look_classes")
    members = rows.join(classes.select("src_table", "look", "raw"), ["src_table", "look", "raw"])
    return classes, members


def look_members(texts: DataFrame, **kw) -> DataFrame:
    """(src_table, row_id, look_id, string_id, links): every record whose text has a look in more than one string.

    ``look_id`` is the least record of the look, ``string_id`` the least record of the same string, ``links`` the
    number of records of other strings. Two records are a pair if they share ``look_id`` and differ in
    ``string_id``: with these rows every pair can be written, however many copies a string has.
    """
    classes, members = look_classes(texts, **kw)
    x = members.join(classes.select("src_table", "look", "raw", "least", "rep", (F.col("records") - F.col("n")).alias("links")), ["src_table", "look", "raw"])
    return x.select("src_table", "row_id", F.col("least").alias("look_id"), F.col("rep").alias("string_id"), "links")


def look_pairs(texts: DataFrame, **kw) -> DataFrame:
    """(src_table, id_a, id_b), id_a < id_b: records with non-empty texts of one look that are different strings.

    All pairs of different strings of a look are written, whatever their number, and two strings with at most
    FULL_PAIRS pairs of members in full. Two strings of more members have many exact copies: their least records
    are paired, and the copies are linked to the least record of each other string, or of one other string where
    the look has more than FULL_CLASS strings, so copies stay linear and no link between different strings is
    lost; ``look_members`` has the copies of every string. Rows repeated under one key count once; null and
    empty texts have no pair.
    """
    classes, members = look_classes(texts, **kw)
    key = ["src_table", "look"]
    blocks = F.ceil(F.col("strings") / BLOCK)
    a = classes.withColumn("block", F.pmod(F.xxhash64("raw"), blocks)).alias("a")
    b = classes.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1))).alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*key, "block"]]
    pairs = a.join(b, [*on, F.col("a.raw") < F.col("b.raw")])
    cols = [F.col("a.src_table").alias("src_table"), F.col("a.look").alias("look"), F.col("a.raw").alias("raw_a"), F.col("b.raw").alias("raw_b"), F.col("a.rep").alias("rep_a"), F.col("b.rep").alias("rep_b"), F.col("a.n").alias("n_a"), F.col("b.n").alias("n_b"), (F.col("a.strings") > FULL_CLASS).alias("many")]
    pairs = pairs.select(cols)
    full = F.col("n_a") * F.col("n_b") <= FULL_PAIRS

    def with_members(p: DataFrame, side: str) -> DataFrame:
        m = members.select("src_table", "look", F.col("raw").alias(f"raw_{side}"), F.col("row_id").alias(f"m_{side}"))
        return p.join(m, ["src_table", "look", f"raw_{side}"])

    whole = with_members(with_members(pairs.where(full), "a"), "b").select("src_table", F.col("m_a").alias("x"), F.col("m_b").alias("y"))
    by_a = with_members(pairs.where(~full & ~F.col("many")), "a").select("src_table", F.col("m_a").alias("x"), F.col("rep_b").alias("y"))
    by_b = with_members(pairs.where(~full & ~F.col("many")), "b").select("src_table", F.col("rep_a").alias("x"), F.col("m_b").alias("y"))
    reps = pairs.where(~full & F.col("many")).select("src_table", F.col("rep_a").alias("x"), F.col("rep_b").alias("y"))
    # copies in looks of many strings: those of the first string link to the least other record, all others to the first's
    hot = classes.where(F.col("strings") > FULL_CLASS)
    second = hot.where("rep <> least").groupBy(*key).agg(F.min("rep").alias("second"))
    hot = hot.join(second, key).select(*key, "raw", F.when(F.col("rep") == F.col("least"), F.col("second")).otherwise(F.col("least")).alias("y"))
    star = members.join(hot, [*key, "raw"]).select("src_table", F.col("row_id").alias("x"), "y")
    out = whole.unionByName(by_a).unionByName(by_b).unionByName(reps).unionByName(star).where("x <> y")
    return out.select("src_table", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
