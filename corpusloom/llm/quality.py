"""Problem 3: per-document text statistics and a mark that tells natural prose from lists, tables and junk.

Statistics of all documents are standardised, a Gaussian mixture is fitted to them by expectation-maximisation
with one distributed pass per iteration, and its components are named after the inspected examples they explain.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import _text
from corpusloom.llm._sums import summed_vector
from corpusloom.llm.quality_examples import EXAMPLES
from corpusloom.session import materialize

#: Common words of English and French, common characters of modern and classical Chinese.
COMMON_WORDS = """the of and to a in is it that was for on as with at by this but not be are from or an they their which you
one his her had has have we he she its no nor what who if there all some any every each only more than while because before
after near about nobody someone often rarely seldom usually partly clearly quickly slowly gently almost still again call calls
says would think left without nothing kinds another behind last says marked de la le les des et en un une du que qui dans pour
sur au aux par pas est sont ce cette ces se sa son ses leur plus mais ou où ne il elle ils nous vous avec sans sous""".split()
COMMON_CHARS = "的了是在和把与就让都不再没有也会由于之所以若便难于关这里比更谁知道一被对从到为而且但如果因此其焉夫昔故未者矣乎猶犹於何则則无無可很又使那我你他她它们個个吗呢吧着过"
TERMINAL = "。！？.!?；;…"
SENTENCE_MARKS = TERMINAL + "，,、：:“”\"'‘’（）()《》-—«»"
BULLETS = "•·○◇◆■►▪●※→□▶★☐"
SPACED_BULLETS = "-*+—–"
CODE_MARKS = "(){}[];=<>_%+*/&#"
NAMES = ["common", "digits", "symbols", "odd", "marks", "line_ends", "line_length", "bullets", "cells", "variety", "word_length", "case_changes", "code", "spaces", "ended", "listed", "tabular", "run_length"]
#: The statistics that the mixture is fitted to: those by line are left out for the same ones by characters, so that a
#: few short lines do not outweigh the text around them.
MODEL = [i for i, n in enumerate(NAMES) if n not in ("line_ends", "line_length", "bullets", "cells")]
KINDS = ("prose", "code", "list", "table", "junk")


@lru_cache
def _classes() -> dict[str, np.ndarray]:
    import unicodedata

    out = {k: np.zeros(_text.SIZE, bool) for k in ("letter", "cjk", "upper", "lower", "digit", "space", "mark", "terminal", "bullet", "code", "odd", "common", "symbol")}
    for cp in range(0x10000):
        if 0x3400 <= cp < 0xA000 or 0xAC00 <= cp < 0xD7A4:
            out["letter"][cp] = True
            out["cjk"][cp] = True
            continue
        c = chr(cp)
        kind = unicodedata.category(c)
        out["letter"][cp] = kind[0] == "L" or kind == "Mn"
        out["cjk"][cp] = 0x3040 <= cp < 0x3100 or 0xF900 <= cp < 0xFB00
        out["upper"][cp], out["lower"][cp] = kind == "Lu", kind == "Ll"
        out["digit"][cp] = kind[0] == "N"
        out["space"][cp] = kind[0] == "Z" or c in "\t\n\r\x0b\x0c"
        out["symbol"][cp] = kind[0] in "SPC" and not out["space"][cp] and c not in SENTENCE_MARKS
        out["odd"][cp] = (kind in ("So", "Cc", "Co", "Cn", "Sk", "Sm", "Sc") or 0x80 <= cp < 0xC0 or cp == 0xFFFD) and not out["space"][cp] and cp > 0x7F or (cp < 32 and not out["space"][cp])
    out["letter"][0x20000:0x32000] = out["cjk"][0x20000:0x32000] = True
    for key, chars in (("mark", SENTENCE_MARKS), ("terminal", TERMINAL), ("bullet", BULLETS), ("code", CODE_MARKS), ("common", COMMON_CHARS)):
        out[key][[ord(c) for c in chars]] = True
    return out


_POWERS = np.array([pow(int(_text.BASE), i + 1, 1 << 64) for i in range(64)], np.uint64)


def _runs(points: np.ndarray, inside: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, length, hash) of the maximal runs of ``inside`` that do not leave their document."""
    edge = np.ones(len(points), bool)
    edge[1:] = (inside[1:] != inside[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(edge & inside)
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    stop = np.flatnonzero(edge)
    end = np.append(stop, len(points))[np.searchsorted(stop, begin, "right")]
    size = end - begin
    at = np.arange(len(points)) - np.repeat(np.flatnonzero(edge), np.diff(np.append(stop, len(points))))
    with np.errstate(over="ignore"):
        part = np.where(inside, (points.astype(np.uint64) + np.uint64(7)) * _POWERS[at & 63], np.uint64(0))
        h = _text.mix(np.add.reduceat(part, begin) + size.astype(np.uint64))
    return doc[begin], size, h


@lru_cache
def _common_hashes() -> np.ndarray:
    points = np.concatenate([np.append(np.frombuffer(w.encode("utf-32-le"), "<u4"), 32) for w in COMMON_WORDS]).astype(np.uint32)
    return np.unique(_runs(points, points != 32, np.zeros(len(points), np.int64))[2])


def features(column: pa.Array) -> np.ndarray:
    """One row of raw statistics (NAMES) per text; an empty or null text has zeros."""
    points, ends = _text.look_table().apply(*_text.codepoints(column))
    n_docs, c = len(ends) - 1, _classes()
    out = np.zeros((n_docs, len(NAMES)))
    if not len(points):
        return out
    size = np.diff(ends)
    doc = np.repeat(np.arange(n_docs), size)
    has = {k: v[points] for k, v in c.items()}
    total = lambda m: np.bincount(doc[m], minlength=n_docs).astype(float)
    ratio = lambda a, b: a / np.maximum(b, 1)
    solid = total(~has["space"])
    latin = has["letter"] & ~has["cjk"]
    low = points.copy()
    asc = (points >= 65) & (points <= 90)
    low[asc] += 32
    w_doc, w_len, w_hash = _runs(low, latin, doc)
    n_words = np.bincount(w_doc, minlength=n_docs)
    common = np.bincount(w_doc[np.isin(w_hash, _common_hashes())], minlength=n_docs)
    n_cjk = total(has["cjk"])
    out[:, 0] = ratio(common + total(has["common"] & has["cjk"]), n_words + n_cjk)
    out[:, 1] = ratio(total(has["digit"]), solid)
    out[:, 2] = ratio(total(has["symbol"]), solid)
    out[:, 3] = ratio(total(has["odd"]), solid)
    out[:, 4] = ratio(total(has["mark"]), solid)
    # lines
    newline = (points == 10) | (points == 13)
    l_doc, l_len, _ = _runs(points, ~newline, doc)
    edge = np.ones(len(points), bool)
    edge[1:] = (newline[1:] != newline[:-1]) | (doc[1:] != doc[:-1])
    l_begin = np.flatnonzero(edge & ~newline)
    l_end = l_begin + l_len
    seen = np.cumsum(~has["space"])
    solid_before = np.concatenate([[0], seen])
    first = np.searchsorted(seen, solid_before[l_begin] + 1)
    kept = (first < l_end)
    l_doc, l_begin, l_end, first = l_doc[kept], l_begin[kept], l_end[kept], first[kept]
    lines = np.bincount(l_doc, minlength=n_docs)
    last = np.searchsorted(seen, solid_before[l_end])
    out[:, 5] = ratio(np.bincount(l_doc[has["terminal"][last]], minlength=n_docs), lines)
    out[:, 6] = np.log1p(ratio(solid, lines))
    nxt = lambda k: points[np.minimum(first + k, len(points) - 1)]
    a, b, d3 = nxt(0), nxt(1), nxt(2)
    stop = np.isin(b, [ord(x) for x in ".、)）．:"]) | (np.isin(d3, [ord(x) for x in ".、)）．:"]) & c["digit"][b])
    item = np.isin(d3, [ord(x) for x in "项項条條款点點步"]) | c["digit"][d3] & (np.isin(nxt(3), [ord(x) for x in "项項条條款点點步"]) | c["digit"][nxt(3)] & np.isin(nxt(4), [ord(x) for x in "项項条條款点點步"]))
    stop |= (a == ord("第")) & c["digit"][b] & item
    bullet = c["bullet"][a] | (a == ord("第")) & stop | ((c["upper"] | c["lower"])[a] & (a < 128) & np.isin(b, [ord(")"), ord("）")])) | (np.isin(a, [ord(x) for x in SPACED_BULLETS]) & (b == 32)) | (c["digit"][a] & stop) | ((a == ord("(")) | (a == ord("（"))) & c["digit"][b] | (a == ord("[")) | ((a >= 0x2460) & (a < 0x2500))
    out[:, 7] = ratio(np.bincount(l_doc[bullet], minlength=n_docs), lines)
    follow = np.append(points[1:], 10)
    before = np.concatenate([[10], points[:-1]])
    cell = (points == ord("|")) | (points == 9) | (points == ord("=")) | ((points == ord(",")) & (follow != 32) & (follow != 10)) | ((points == 32) & (follow == 32) & (before != 32) & (before != 10))
    n_cell = np.concatenate([[0], np.cumsum(cell)])
    cells = n_cell[l_end] - n_cell[l_begin] >= 2
    out[:, 8] = ratio(np.bincount(l_doc[cells], minlength=n_docs), lines)
    # the same by characters
    l_solid = solid_before[l_end] - solid_before[l_begin]
    for j, own in ((14, has["terminal"][last] & ~bullet & ~cells), (15, bullet), (16, cells)):
        out[:, j] = ratio(np.bincount(l_doc[own], l_solid[own], minlength=n_docs), solid)
    out[:, 17] = np.log1p(ratio(np.bincount(l_doc, l_solid.astype(float) ** 2, minlength=n_docs), solid))
    # words of any script
    r_doc, r_len, r_hash = _runs(points, has["letter"] | has["digit"], doc)
    n_runs = np.bincount(r_doc, minlength=n_docs)
    order = np.lexsort((r_hash, r_doc))
    sd, sh = r_doc[order], r_hash[order]
    fresh = np.ones(len(sd), bool)
    fresh[1:] = (sd[1:] != sd[:-1]) | (sh[1:] != sh[:-1])
    out[:, 9] = np.log1p(np.bincount(sd[fresh], minlength=n_docs)) / np.log1p(np.maximum(n_runs, 1))
    out[:, 10] = np.log1p(ratio(np.bincount(r_doc, r_len, minlength=n_docs), n_runs))
    turn = np.append(has["lower"][:-1] & (has["upper"][1:] | has["digit"][1:]) | has["digit"][:-1] & latin[1:], False)
    out[:, 11] = ratio(total(turn), solid)
    out[:, 12] = ratio(total(has["code"]), solid)
    out[:, 13] = ratio(total(points == 32), size)
    out[size == 0] = 0
    return out


def transform(raw: np.ndarray) -> np.ndarray:
    """The mixture's statistics on scales on which the kinds of text form compact groups."""
    x = raw.copy()
    for j in (1, 2, 3, 4, 11, 12, 13):
        x[:, j] = np.sqrt(x[:, j])
    return x[:, MODEL]


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, words, chars, empty, NAMES...) of ``docs (doc_id, text)``, one row per doc_id.

    Rows repeated under one id count once. The statistics of a null or empty text are 0 and ``empty`` is true.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for first, part in _text.batches(batch.column(1)):
                x = features(part)
                empty = np.asarray(pc.equal(pc.utf8_length(pc.utf8_trim_whitespace(part.fill_null(""))), 0))
                chars = pc.utf8_length(part.fill_null("")).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(part)), chars, pa.array(empty), *(pa.array(x[:, j]) for j in range(len(NAMES)))], ["doc_id", "chars", "empty", *NAMES])

    schema = "doc_id string, chars bigint, empty boolean, " + ", ".join(f"{n} double" for n in NAMES)
    return docs.select("doc_id", "text").mapInArrow(run, schema).dropDuplicates(["doc_id"])


# ---------------------------------------------------------------- the mixture


class Mixture:
    """Gaussian mixture with full covariances; ``kinds`` names each component."""

    def __init__(self, weights: np.ndarray, means: np.ndarray, covs: np.ndarray):
        self.weights, self.means = weights, means
        chol = np.linalg.cholesky(covs)
        self.inverse = np.linalg.inv(chol)
        self.log_det = np.log(np.diagonal(chol, axis1=1, axis2=2)).sum(1)

    def log_joint(self, x: np.ndarray) -> np.ndarray:
        z = np.einsum("kij,nkj->nki", self.inverse, x[:, None, :] - self.means[None])
        return np.log(self.weights) - 0.5 * (z * z).sum(2) - self.log_det - 0.5 * x.shape[1] * np.log(2 * np.pi)

    def posterior(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        a = self.log_joint(x)
        top = a.max(1, keepdims=True)
        p = np.exp(a - top)
        s = p.sum(1, keepdims=True)
        return p / s, float((top + np.log(s)).sum())


def _blocks(batch: pa.RecordBatch, shift: np.ndarray, scale: np.ndarray, rows: int = 4096) -> Iterator[tuple[int, np.ndarray]]:
    raw = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in NAMES], 1)
    for i in range(0, len(raw), rows):
        yield i, (transform(raw[i : i + rows]) - shift) / scale


def fit(stats: DataFrame, iterations: int = 20, floor: float = 0.02) -> tuple[Mixture, np.ndarray, np.ndarray, np.ndarray]:
    """(mixture, shift, scale, kind shares per component) fitted to all non-empty rows of ``stats``.

    The components start from the groups of inspected examples. Each iteration is one pass; the
    partitions' sufficient statistics (k * d * d numbers) are added up on the executors. A component is shared out
    between kinds in proportion to the examples it explains.
    """
    d = len(MODEL)

    def moments(parts: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(2 * d + 1)
        for batch in parts:
            for _, x in _blocks(batch, np.zeros(d), np.ones(d)):
                total += np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])
        return total

    used = stats.where("not empty").select(*NAMES)
    m = summed_vector(used, moments, 2 * d + 1)
    n = max(m[0], 1.0)
    shift = m[1 : d + 1] / n
    scale = np.sqrt(np.maximum(m[d + 1 :] / n - shift**2, 1e-4))
    groups = [(kind, (transform(features(pa.array(texts))) - shift) / scale) for kind, texts in EXAMPLES]
    means = np.stack([x.mean(0) for _, x in groups])
    covs = np.tile(np.eye(d) * 0.3, (len(groups), 1, 1))
    mixture = Mixture(np.full(len(groups), 1 / len(groups)), means, covs)
    sc = stats.sparkSession.sparkContext
    k, before = len(groups), -np.inf
    for _ in range(iterations):
        now = sc.broadcast(mixture)

        def expect(parts: Iterator[pa.RecordBatch], now=now) -> np.ndarray:
            s0, s1, s2, ll = np.zeros(k), np.zeros((k, d)), np.zeros((k, d, d)), 0.0
            for batch in parts:
                for _, x in _blocks(batch, shift, scale):
                    p, part = now.value.posterior(x)
                    s0 += p.sum(0)
                    s1 += p.T @ x
                    s2 += (p[:, :, None] * x[:, None, :]).transpose(1, 2, 0) @ x
                    ll += part
            return np.concatenate([[ll], s0, s1.ravel(), s2.ravel()])

        s = summed_vector(used, expect, 1 + k + k * d + k * d * d)
        now.unpersist()
        ll, s0 = s[0], s[1 : k + 1]
        s1, s2 = s[k + 1 : k + 1 + k * d].reshape(k, d), s[k + 1 + k * d :].reshape(k, d, d)
        # a weak prior keeps each component at its examples until documents support it
        prior = 5.0
        mean = (s1 + prior * means) / (s0 + prior)[:, None]
        cov = (s2 + prior * (np.eye(d) * 0.3 + means[:, :, None] * means[:, None, :])) / (s0 + prior)[:, None, None] - mean[:, :, None] * mean[:, None, :]
        mixture = Mixture((s0 + 1) / (s0.sum() + k), mean, cov + np.eye(d) * floor)
        if ll - before < 1e-4 * abs(ll):
            break
        before = ll
    shares = np.full((k, len(KINDS)), 0.0)
    for i, (kind, x) in enumerate(groups):
        p, _ = mixture.posterior(x)
        shares[:, KINDS.index(kind)] += p.mean(0)
        shares[i, KINDS.index(kind)] += 0.05
    return mixture, shift, scale, shares / shares.sum(1, keepdims=True)


def mark(docs: DataFrame, iterations: int = 20) -> DataFrame:
    """Statistics of every document with ``kind`` (prose, code, list, table, junk) and ``natural``, the probability of prose or code.

    ``docs``: doc_id, text, quality_prior. The prior is carried along as ``prior`` where it lies in 0..1 and is null
    otherwise. Null and empty texts have kind ``empty`` and natural null. Copies of one doc_id count once.
    """
    prior = docs.groupBy("doc_id").agg(F.max(F.when(F.col("quality_prior").between(0, 1), F.col("quality_prior"))).alias("prior"))
    stats = materialize(statistics(docs), "statistics")
    mixture, shift, scale, shares = fit(stats, iterations)

    def assign(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            p = np.zeros((batch.num_rows, len(KINDS)))
            for i, x in _blocks(batch, shift, scale):
                p[i : i + len(x)] = mixture.posterior(x)[0] @ shares
            empty = batch.column("empty").to_numpy(zero_copy_only=False)
            kind = np.array(KINDS, object)[p.argmax(1)]
            kind[empty] = "empty"
            natural = pa.array(np.where(empty, np.nan, p[:, 0] + p[:, 1]), from_pandas=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kind, pa.string()), natural], [*batch.schema.names, "kind", "natural"])

    schema = stats.schema.simpleString()[len("struct<") : -1].replace(":", " ").replace(",", ", ") + ", kind string, natural double"
    return stats.mapInArrow(assign, schema).join(prior, "doc_id", "left")


def unnatural(docs: DataFrame) -> DataFrame:
    """(doc_id): documents with text that is mostly list items, tabular data or junk."""
    return mark(docs.select("doc_id", "text", F.lit(None).cast("double").alias("quality_prior"))).where("natural < 0.5").select("doc_id")
