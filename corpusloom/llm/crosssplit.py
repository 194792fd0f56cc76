"""Problem 4: passages of evaluation records that recur in training records.

A prefix-filter bipartite join on rare shingles. Evaluation passages are indexed under their rarest shingles (by a
count sketch of the whole corpus); every shingle of every training passage probes the index under length and position
filters; candidate pairs are verified on their letters. The join finds every pair that shares SHINGLES of the
evaluation passage's 7-letter shingles. Passages, not records, are joined, so exact copies cost nothing and are
expanded only in the result, and shingles that very many passages hold are split over several tasks.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import _text
from corpusloom.llm._sums import emit, hash_filter, holds, summed
from corpusloom.session import materialize

K = 7
#: Share of an evaluation passage's shingles that a training passage must hold to be a candidate.
SHINGLES = 0.15
#: Share of an evaluation passage's letters that must recur in order and in one place.
LETTERS = 0.75
SKETCH_BITS = 20
#: Occurrences of a shingle from which it is split, where that is far above the mean.
HOT = 4096
FULL_PAIRS = 1000
STRING = re.compile(r'"(ancient|content)"\s*:\s*"((?:[^"\\]|\\.)*)', re.S)
#: Halves of characters, as a cut inside an escaped pair leaves them; Arrow holds none.
HALVES = re.compile("[\ud800-\udfff]")


def passages(payload: str, whole: bool) -> list[str]:
    """The ``ancient`` passage and, if ``whole``, the content of each message; JSON that is cut off gives what it still holds."""
    try:
        data = json.loads(payload)
        out = [data.get("ancient")]
        if whole:
            out += [m.get("content") for m in data.get("messages") or () if isinstance(m, dict)]
        return [x for x in out if isinstance(x, str) and x]
    except (ValueError, AttributeError, TypeError):
        return [x for key, raw in STRING.findall(payload or "") if (whole or key == "ancient") and (x := _unescape(raw))]


def _unescape(raw: str) -> str:
    for cut in range(7):  # a cut can fall inside an escape of up to six characters
        try:
            return json.loads(f'"{raw[: len(raw) - cut]}"', strict=False)
        except ValueError:
            continue
    return ""


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    try:
        column = pa.array(texts, pa.string())
    except UnicodeEncodeError:
        column = pa.array([HALVES.sub("", x) for x in texts], pa.string())
    return _text.letters(column)


def _ids(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    raw = points.astype("<u4")
    return np.array([xxhash.xxh3_64_intdigest(raw[a:b].tobytes()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], np.uint64).view(np.int64)


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, letters, offsets) of the different passages of each record, some rows at a time."""
    side, payload, prompt = (batch.column(c) for c in ("evaluation", "payload", "prompt"))
    sizes = sum(np.asarray(pc.binary_length(c).fill_null(0)) for c in (payload, prompt))
    for first, end in _text.slices(sizes, 1 << 18):
        rows, texts = [], []
        for i, (s, p, q) in enumerate(zip(*(c.slice(first, end - first).to_pylist() for c in (side, payload, prompt)), strict=True)):
            own = dict.fromkeys(passages(p, not s) + [q] * bool(q and not s))
            rows += [first + i] * len(own)
            texts += own
        points, ends = _letters(texts)
        yield np.array(rows, np.int64), points, ends


def _shingles(points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, passage, position) of the different shingles of each passage."""
    h, valid = _text.kgrams(points, ends, K)
    at = np.flatnonzero(valid)
    doc = np.searchsorted(ends, at, "right") - 1
    order = np.lexsort((h[at], doc))
    at, doc = at[order], doc[order]
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(doc) != 0) | (h[at][1:] != h[at][:-1])
    at, doc = at[new], doc[new]
    return h[at], doc, at - ends[doc]


def shingle_sketch(records: DataFrame) -> np.ndarray:
    """Counts of shingles of all passages by the top bits of their hash; its size does not depend on the data."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in parts:
            for _, points, ends in _parts(batch):
                h, valid = _text.kgrams(points, ends, K)
                total += np.bincount((h[valid] >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(total))
        yield from emit(total)

    return summed(records, count, "<i8", 1 << SKETCH_BITS)


def _need(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(prefix length, hits within the prefix that a candidate needs) for passages of n shingles."""
    least = np.maximum(1, np.ceil(SHINGLES * n))
    hits = np.ceil(least / 3)
    return n - least + hits, hits


def _splits(counts: np.ndarray) -> np.ndarray:
    """Number of tasks over which the shingles of each place of the sketch are dealt; 1 but for hot ones."""
    return np.ceil(counts / max(HOT, 64 * counts.mean())).clip(1, 1 << 15).astype(np.int32)


def _places(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _index(sketch):
    """Rarest shingles of the evaluation passages, those of hot shingles once for each of their splits."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, split = sketch.value, _splits(sketch.value)
        for batch in parts:
            for rows, points, ends in _parts(batch):
                pid, size = _ids(points, ends), np.diff(ends)
                h, doc, pos = _shingles(points, ends)
                n = np.bincount(doc, minlength=len(size))
                rare = counts[_places(h)]
                order = np.lexsort((h, rare, doc))
                rank = np.arange(len(order)) - np.repeat(np.cumsum(n) - n, n)
                prefix, need = _need(n)
                keep = order[rank < prefix[doc[order]]]
                times = split[_places(h[keep])]
                keep = np.repeat(keep, times)
                part = np.arange(len(keep)) - np.repeat(np.cumsum(times) - times, times)
                d = doc[keep]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h[keep].view(np.int64), part.astype(np.int32), pid[d], pos[keep].astype(np.int32), size[d].astype(np.int32), need[d].astype(np.int32))], ["h", "part", "epid", "epos", "elen", "need"])

    return run


def _probe(held, sketch):
    """Shingles of the training passages that the index may hold, each in one of its splits."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (bitmap, shift), split = held.value, _splits(sketch.value)
        for batch in parts:
            for rows, points, ends in _parts(batch):
                pid, size = _ids(points, ends), np.diff(ends)
                h, doc, pos = _shingles(points, ends)
                keep = holds(bitmap, shift, h)
                d = doc[keep]
                part = pid[d].view(np.uint64) % split[_places(h[keep])].astype(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h[keep].view(np.int64), part.astype(np.int32), pid[d], pos[keep].astype(np.int32), size[d].astype(np.int32))], ["h", "part", "tpid", "tpos", "tlen"])

    return run


def _texts(held):
    """Passages whose id the filter may hold, with their record."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, shift = held.value
        for batch in parts:
            for rows, points, ends in _parts(batch):
                pid = _ids(points, ends)
                keep = np.flatnonzero(holds(bitmap, shift, pid))
                text = _text.to_strings(points, ends)
                yield pa.RecordBatch.from_arrays([pa.array(pid[keep]), batch.column("row_id").take(pa.array(rows[keep])), pa.array([text[i] for i in keep], pa.string())], ["pid", "row_id", "letters"])

    return run


def _verify(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in parts:
        ok = []
        for e, t in zip(x.e_letters, x.t_letters, strict=True):
            if e in t:
                ok.append(True)
                continue
            a, b = (np.frombuffer(s.encode("utf-32-le"), "<u4") for s in (e, t))
            narrow = (a < 0x2E80).sum() * 2 > len(a)
            ok.append(_text.cover(a, b, 7 if narrow else 4, max(8, len(a) // 8), 3).mean() >= LETTERS)
        yield x.loc[ok, ["epid", "tpid"]]


def passage_pairs(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs (epid, tpid), members (pid, evaluation, row_id)) of ``records (row_id, evaluation, payload)`` and, if they have it, ``prompt``."""
    sc = records.sparkSession.sparkContext
    prompt = F.col("prompt") if "prompt" in records.columns else F.lit(None).cast("string").alias("prompt")
    records = records.select("row_id", "evaluation", "payload", prompt).where("evaluation is not null and (payload is not null or (prompt is not null and not evaluation))")
    ev, tr = records.where("evaluation"), records.where("not evaluation")
    sketch = sc.broadcast(shingle_sketch(records))
    index = materialize(ev.mapInArrow(_index(sketch), "h bigint, part int, epid bigint, epos int, elen int, need int").distinct(), "index")
    held = sc.broadcast(hash_filter(index.select("h")))
    probes = tr.mapInArrow(_probe(held, sketch), "h bigint, part int, tpid bigint, tpos int, tlen int").distinct()
    room = F.least("epos", "tpos") + F.least(F.col("elen") - F.col("epos"), F.col("tlen") - F.col("tpos"))
    hits = probes.join(index, ["h", "part"]).where((F.col("tlen") >= LETTERS * F.col("elen")) & (room + F.greatest(F.lit(8), F.col("elen") / 8) >= LETTERS * F.col("elen")))
    pairs = hits.groupBy("epid", "tpid").agg(F.count("*").alias("n"), F.first("need").alias("need")).where("n >= need").select("epid", "tpid")
    pairs = materialize(pairs, "candidates")
    wanted = []
    for side, name in ((ev, "epid"), (tr, "tpid")):
        known = pairs.select(F.col(name).alias("pid")).distinct()
        own = side.mapInArrow(_texts(sc.broadcast(hash_filter(known))), "pid bigint, row_id string, letters string").join(known, "pid", "left_semi")
        wanted.append(materialize(own, name))
    e, t = (w.groupBy("pid").agg(F.first("letters").alias("letters")) for w in wanted)
    full = pairs.join(e.select(F.col("pid").alias("epid"), F.col("letters").alias("e_letters")), "epid").join(t.select(F.col("pid").alias("tpid"), F.col("letters").alias("t_letters")), "tpid")
    found = materialize(full.mapInPandas(_verify, "epid bigint, tpid bigint"), "passage_pairs")
    members = wanted[0].select("pid", F.lit(True).alias("evaluation"), "row_id").unionByName(wanted[1].select("pid", F.lit(False).alias("evaluation"), "row_id")).distinct()
    return found, members


def overlaps(records: DataFrame) -> DataFrame:
    """(eval_id, train_id): evaluation records whose passage recurs in a training record.

    ``records``: row_id, evaluation (true: dev or test; false: training; null: neither), payload (JSON) and, where the
    table has one, prompt: a message of a training record that stands outside its payload, so it is whole also where
    the payload is null or cut off. At least
    three quarters of the letters and digits of the evaluation record's ``ancient`` must recur in order and in one
    place in the ``ancient`` passage or one message of the training record. Passages of fewer than seven letters
    have no pairs; null payloads and payloads without passages have none; JSON that is cut off counts with what it
    holds; repeated rows count once. A candidate holds at least 15 % of the passage's 7-letter shingles, so
    passages with a change every few letters are not found. Where two passages with many copies meet (more than FULL_PAIRS pairs of records), each record is paired with
    the other side's least id instead of with all copies; ``overlap_members`` has the copies of every passage.
    """
    found, members = passage_pairs(records)
    sizes = members.groupBy("pid", "evaluation").agg(F.count("*").alias("n"), F.min("row_id").alias("rep"))
    e, t = (sizes.where(c).select(F.col("pid").alias(f"{s}pid"), F.col("n").alias(f"{s}n"), F.col("rep").alias(f"{s}rep")) for s, c in (("e", "evaluation"), ("t", "not evaluation")))
    em, tm = (members.where(c).select(F.col("pid").alias(f"{s}pid"), F.col("row_id").alias(f"{s}id")) for s, c in (("e", "evaluation"), ("t", "not evaluation")))
    pairs = found.join(e, "epid").join(t, "tpid").withColumn("full", F.col("en") * F.col("tn") <= FULL_PAIRS)
    full = pairs.where("full").join(em, "epid").join(tm, "tpid").select("eid", "tid")
    by_e = pairs.where("not full").join(em, "epid").select("eid", F.col("trep").alias("tid"))
    by_t = pairs.where("not full").join(tm, "tpid").select(F.col("erep").alias("eid"), "tid")
    return full.unionByName(by_e).unionByName(by_t).select(F.col("eid").alias("eval_id"), F.col("tid").alias("train_id")).distinct()


def overlap_members(records: DataFrame) -> DataFrame:
    """(row_id, evaluation, passage, links): the passages of every record that an overlap touches.

    ``passage`` is the least record of the same letters on the same side, ``links`` the number of different passages
    of the other side that it overlaps. With the pairs of passages, ``overlap_passages``, every pair of records can be
    written, however many copies a passage has.
    """
    return _classes(*passage_pairs(records))[1]


def overlap_passages(records: DataFrame) -> DataFrame:
    """(eval_passage, train_passage): overlapping passages, each named by the least record that holds it."""
    return _classes(*passage_pairs(records))[0]


def _classes(found: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    name = materialize(members.groupBy("pid", "evaluation").agg(F.min("row_id").alias("passage")), "passages")
    e, t = (name.where(c).select(F.col("pid").alias(f"{s}pid"), F.col("passage").alias(f"{s}p")) for s, c in (("e", "evaluation"), ("t", "not evaluation")))
    pairs = found.join(e, "epid").join(t, "tpid")
    links = pairs.groupBy(F.col("epid").alias("pid"), F.lit(True).alias("evaluation")).agg(F.count("*").alias("links")).unionByName(pairs.groupBy(F.col("tpid").alias("pid"), F.lit(False).alias("evaluation")).agg(F.count("*").alias("links")))
    rows = members.join(links, ["pid", "evaluation"]).join(name, ["pid", "evaluation"]).select("row_id", "evaluation", "passage", "links")
    return pairs.select(F.col("ep").alias("eval_passage"), F.col("tp").alias("train_passage")).distinct(), rows


def overlap_report(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """(split, source, train_table, pairs, eval_records): overlaps by the evaluation record's split and source and the training table."""
    info = records.select(F.col("row_id").alias("eval_id"), "split", "source").dropDuplicates(["eval_id"])
    train = records.select(F.col("row_id").alias("train_id"), F.col("src_table").alias("train_table")).dropDuplicates(["train_id"])
    return pairs.join(info, "eval_id").join(train, "train_id").groupBy("split", "source", "train_table").agg(F.count("*").alias("pairs"), F.countDistinct("eval_id").alias("eval_records"))
