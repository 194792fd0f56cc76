"""Problem 1: evaluation texts inside training texts, by winnowing.

The items' k-grams are the index; of every training text the minimum k-gram hash of each sliding window is probed.
Hits of one item that lie on neighbouring diagonals are extended to the covered share of the item's wording.
A shared span of w + k - 1 letters or more always yields a hit, and k and w are chosen by the length of the item such
that half of its wording is at least that long.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import _text
from corpusloom.session import materialize

#: Characters of the items that are searched for in one pass; more items are searched for block by block.
BLOCK_LETTERS = 4_000_000
SENTENCE = re.compile(r"(?<=[。？！?!.:：\n])")


@dataclass(frozen=True)
class Params:
    """Profiles (ideographs or not, least letters of an item, k, window), share of the wording, least letters of an item, share of an item's letters whose hits make a candidate, questions that make a sentence stock, width of a diagonal band, letters of a gap, part of the share that must recur unchanged.

    An item belongs to the last profile of its script whose least letters it has. For every length from ``least`` on
    k + window - 1 is at most half of the item, so that an unbroken half always has a hit.
    """

    profiles: tuple[tuple[bool, int, int, int], ...] = ((True, 16, 6, 3), (False, 16, 7, 2), (False, 46, 16, 8))
    share: float = 0.5
    least: int = 16
    seed: float = 0.04
    stock: int = 3
    band: int = 24
    gap: int = 12
    unchanged: float = 0.7


def is_wide(letters: np.ndarray) -> bool:
    return int((letters >= 0x2E80).sum()) * 2 > len(letters)


class Index:
    """The k-grams of the items with their postings."""

    def __init__(self, questions: list[str], stocks: list[set[str]], p: Params):
        self.p, self.letters, self.core = p, [], []
        for q, stock in zip(questions, stocks, strict=True):
            parts = [(plain(s), s) for s in SENTENCE.split(q)]
            self.letters.append(np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(x.encode("utf-32-le"), "<u4") for x, _ in parts)]))
            self.core.append(np.concatenate([np.zeros(0, bool), *(np.full(len(x), x not in stock) for x, _ in parts)]))
        self.profiles = []
        side = [max((n, j) for j, (wide, n, _, _) in enumerate(p.profiles) if n <= len(x) and wide == is_wide(x))[1] if len(x) >= p.least else -1 for x in self.letters]
        for j, (_, _, k, w) in enumerate(p.profiles):
            own = [i for i, mine in enumerate(side) if mine == j]
            points = np.concatenate([np.zeros(0, np.uint32), *(self.letters[i] for i in own)])
            ends = np.cumsum([0, *(len(self.letters[i]) for i in own)])
            h, valid = _text.kgrams(points, ends, k)
            item = np.repeat(np.array(own, np.int64), np.diff(ends))
            pos = np.arange(len(points)) - np.repeat(ends[:-1], np.diff(ends))
            h, item, pos = h[valid], item[valid], pos[valid]
            order = np.argsort(h, kind="stable")
            keys, begin = np.unique(h[order], return_index=True)
            seen = np.zeros(1 << 20, bool)
            seen[(keys >> np.uint64(44)).astype(np.int64)] = True
            self.profiles.append((k, w, keys, np.append(begin, len(h)), item[order], pos[order], seen))

    def candidates(self, points: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Rows (document, item, least and greatest diagonal) whose hits are dense enough to be worth extending."""
        out = []
        for k, w, keys, begin, items, positions, seen in self.profiles:
            if not len(keys):
                continue
            h, valid = _text.kgrams(points, ends, k)
            at = _text.winnow(h, valid, w)
            at = at[seen[(h[at] >> np.uint64(44)).astype(np.int64)]]
            j = np.searchsorted(keys, h[at])
            hit = j < len(keys)
            hit[hit] = keys[j[hit]] == h[at[hit]]
            at, j = at[hit], j[hit]
            if not len(at):
                continue
            n = begin[j + 1] - begin[j]
            where = np.repeat(begin[j], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            item, spot = items[where], np.repeat(at, n)
            doc = np.searchsorted(ends, spot, "right") - 1
            diag = spot - ends[doc] - positions[where]
            length = np.array([len(x) for x in self.letters])
            for shift in (0, self.p.band):
                b = (diag + shift + (1 << 30)) // (2 * self.p.band)
                order = np.lexsort((b, item, doc))
                d, i, b = doc[order], item[order], b[order]
                new = np.flatnonzero(np.concatenate([[True], (np.diff(d) != 0) | (np.diff(i) != 0) | (np.diff(b) != 0)]))
                count = np.diff(np.append(new, len(d)))
                keep = count >= np.maximum(1, self.p.seed * length[i[new]] * 2 / (w + 1))
                g = diag[order]
                low, high = np.minimum.reduceat(g, new), np.maximum.reduceat(g, new)
                out.append(np.stack([d[new], i[new], low, high], 1)[keep])
        return np.concatenate([np.zeros((0, 4), np.int64), *out])

    def holds(self, item: int, text: np.ndarray) -> bool:
        """Half of the item's wording, and of it without its stock sentences, recurs in order in one place, most of that unchanged."""
        q, core = self.letters[item], self.core[item]
        same = _text.cover(q, text, 4 if is_wide(q) else 7, 2 * self.p.band, 0)
        if same.mean() < self.p.share * self.p.unchanged:
            return False
        mask = _text.filled(same, self.p.gap)
        return mask.mean() >= self.p.share and (not core.any() or mask[core].mean() >= self.p.share * 0.8)

    def window(self, points: np.ndarray, begin: int, end: int, item: int, low: int, high: int) -> np.ndarray:
        pad = 4 * self.p.band
        return points[max(begin, begin + low - pad) : min(end, begin + high + len(self.letters[item]) + pad)]


def plain(text: str) -> str:
    """The letters and digits of a text in base form."""
    return _text.to_strings(*_text.letters(pa.array([text])))[0]


def with_stock(items: DataFrame, least: int) -> DataFrame:
    """``items (item_id, question)`` with ``stock``: those of its sentences that open or close ``least`` or more different questions."""
    pieces = items.mapInPandas(_pieces, "item_id bigint, question string, sentence string, whole string")
    often = pieces.where("sentence <> '' and sentence <> whole").groupBy("sentence").agg(F.countDistinct("whole").alias("n")).where(F.col("n") >= least)
    return pieces.join(often.select("sentence", F.col("sentence").alias("own")), "sentence", "left").groupBy("item_id", "question").agg(F.collect_set("own").alias("stock"))


def _pieces(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in parts:
        yield pd.DataFrame([(i, q, plain(s), plain(q)) for i, q in zip(x.item_id, x.question, strict=True) for s in SENTENCE.split(q)], columns=["item_id", "question", "sentence", "whole"])


def leaks(texts: DataFrame, items: DataFrame, p: Params | None = None, block_letters: int = BLOCK_LETTERS) -> DataFrame:
    """(src_table, row_id, item_id): rows of ``texts (src_table, row_id, text)`` that hold an item of ``items (item_id, question)``.

    A row holds an item if at least ``share`` of the letters and digits of its question recur in order and in one
    place; case, look-alike characters, marks, punctuation and blanks do not matter and single changed words or
    characters may be scattered. Items of fewer than ``least`` letters or digits, null questions and null texts
    have no rows; repeated rows count once. Whole texts are read and none is shuffled: the items travel to the
    workers, in blocks of about ``block_letters`` characters, each of which is searched for in one pass.
    """
    p = p or Params()
    texts = texts.select("src_table", "row_id", "text").where("text is not null and text <> ''")
    items = items.select("item_id", "question").where((F.length("question") >= p.least) & F.col("item_id").isNotNull()).distinct()
    ready = materialize(with_stock(items, p.stock), "items")
    blocks = max(1, -(-(ready.agg(F.sum(F.length("question"))).first()[0] or 0) // block_letters))
    found = None
    for b in range(blocks):
        rows = ready.where(F.pmod(F.xxhash64("item_id", "question"), F.lit(blocks)) == b).collect()
        one = texts.mapInArrow(_probe([r[0] for r in rows], [r[1] for r in rows], [set(r[2]) for r in rows], p), "src_table string, row_id string, item_id bigint")
        found = one if found is None else found.unionByName(one)
    return found.distinct()


def _probe(ids: list[int], questions: list[str], stocks: list[set[str]], p: Params):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(questions, stocks, p)
        for batch in parts:
            found: dict[tuple[int, int], None] = {}
            for first, part in _text.batches(batch.column(2)):
                points, ends = _text.letters(part)
                for doc, item, low, high in index.candidates(points, ends).tolist():
                    if (first + doc, item) not in found and index.holds(item, index.window(points, ends[doc], ends[doc + 1], item, low, high)):
                        found[first + doc, item] = None
            at = pa.array([d for d, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([ids[i] for _, i in found], pa.int64())], ["src_table", "row_id", "item_id"])

    return run


def leak_report(found: DataFrame, items: DataFrame) -> DataFrame:
    """Rows that leak each item, by item and table: (benchmark, item_id, src_table, leaked_rows)."""
    found = materialize(found, "leaks")
    return found.join(items.select("item_id", "benchmark").dropDuplicates(["item_id"]), "item_id").groupBy("benchmark", "item_id", "src_table").agg(F.count("*").alias("leaked_rows"))
