"""Problem 9: subject areas of documents, by label propagation over a verified document-similarity graph.

Documents become vectors of weighted topical terms. Every document is linked to every other that shares a topical
term with it: a step of the walk goes from a document to one of its terms by weight, and from the term to one of its
documents by weight. The links of all pairs are kept, and none is written out, because the sum over a document's
partners is a sum over its terms of one table of sums per term. Labels spread over the links in rounds that join the
documents' terms with that table, with trusted seeds clamped, and documents keep the shares of all subjects. A
subject counts for a document that it reached, if also at least a quarter of the document's sentences treat it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import _text
from corpusloom.llm._sums import PIECE, emit, padded, summed
from corpusloom.session import materialize

TERM_BITS = 17


@dataclass(frozen=True)
class Params:
    """Bounds of a topical term's document share, rounds, power that sharpens spread shares, propagated share that gives a subject, share of sentences, evidence a sentence needs, the subject of program code.

    ``anchors`` bounds nothing any more: all documents are linked. ``links`` and ``least`` are of ``pursue`` alone.
    """

    rare: float = 0.003
    common: float = 0.12
    anchors: int = 1024
    links: int = 4
    least: float = 0.02
    rounds: int = 6
    power: float = 1.5
    given: float = 0.02
    share: float = 0.25
    evidence: float = 1.2
    code: str = "software"


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(document, sentence, term) of every term of a column, and the number of sentences by document last.

    Terms are words of alphabets and pairs of neighbouring ideographs, in base form and without case, hashed to
    TERM_BITS bits. A sentence ends at sentence marks, commas between clauses and line ends.
    """
    points, ends = _text.look_table().apply(*_text.codepoints(column))
    n = len(points)
    kinds = _kinds()
    kind = kinds[points] if n else np.zeros(0, np.uint8)
    doc = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    low = np.where((points >= 65) & (points <= 90), points + 32, points)
    stop = (kind == 3) & ~((points == 46) & (np.append(kind[1:], 3) == 4)) if n else np.zeros(0, bool)
    edge = np.zeros(n, bool)
    if n:
        edge[0] = True
        edge[1:] = stop[:-1] | (doc[1:] != doc[:-1])
    sentence = np.cumsum(edge) - 1
    # pairs of ideographs
    pair = np.flatnonzero((kind[:-1] == 1) & (kind[1:] == 1) & (doc[1:] == doc[:-1])) if n else np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h2 = _text.mix(low[pair].astype(np.uint64) * _text.BASE + low[np.minimum(pair + 1, max(0, n - 1))].astype(np.uint64))
        from corpusloom.llm.quality import _runs

        w_doc, w_len, w_hash = _runs(low, kind == 2, doc) if n else (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    begin = np.flatnonzero((kind == 2) & np.concatenate([[True], (kind[1:] != kind[:-1]) | (doc[1:] != doc[:-1])])) if n else np.zeros(0, np.int64)
    keep = w_len >= 2
    at = np.concatenate([pair, begin[keep]])
    h = np.concatenate([h2, w_hash[keep]])
    order = np.argsort(at, kind="stable")
    at, h = at[order], h[order]
    return doc[at], sentence[at], (h >> np.uint64(64 - TERM_BITS)).astype(np.int64), len(ends) - 1


def _kinds() -> np.ndarray:
    """1 ideograph, 2 letter, 3 end of a sentence or clause, 4 digit."""
    global _KINDS
    if _KINDS is None:
        from corpusloom.llm.quality import _classes

        c = _classes()
        out = np.zeros(_text.SIZE, np.uint8)
        out[c["letter"]] = 2
        out[c["cjk"]] = 1
        out[c["digit"]] = 4
        out[ord("_")] = 2
        out[[ord(x) for x in "。！？!?；;，,.…\n\r"]] = 3
        _KINDS = out
    return _KINDS


_KINDS: np.ndarray | None = None


#: Frequent words that tell the languages of alphabetic texts apart.
LANGUAGE_WORDS = {
    "en": "the and that with without only often some every about because while they what this".split(),
    "fr": "les des une dans est que qui pour avec mais sur par près chaque cette".split(),
    "de": "der die das und nicht mit ein eine auf für von dem sich auch wird".split(),
    "es": "los las una del que por con para como pero más este esta son entre".split(),
}
GROUPS = 3 + len(LANGUAGE_WORDS)


def languages(column: pa.Array, doc: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
    """Group of each document: 0 ideographs, 1 code-like, 2 other, 3... a language of LANGUAGE_WORDS.

    What is common differs between languages, so every document is judged within its group.
    """
    global _WORDS
    if _WORDS is None:
        _WORDS = [np.unique(terms(pa.array([" ".join(w)]))[2]) for w in LANGUAGE_WORDS.values()]
    points, ends = _text.look_table().apply(*_text.codepoints(column))
    at = np.repeat(np.arange(n), np.diff(ends))
    size = np.maximum(np.diff(ends), 1)
    cjk = np.bincount(at[points >= 0x2E80], minlength=n) / size
    code = np.bincount(at[np.isin(points, CODE)], minlength=n) / size
    hits = np.stack([np.bincount(doc[np.isin(term, w)], minlength=n) for w in _WORDS])
    out = np.where(hits.max(0) > 0, 3 + hits.argmax(0), 2)
    out[code > 0.05] = 1
    out[cjk > 0.25] = 0
    return out


_WORDS: list[np.ndarray] | None = None
CODE = np.array([ord(x) for x in "_=(){}<>;[]"], np.uint32)


def _distinct(doc: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key, n = np.unique(doc.astype(np.int64) << TERM_BITS | term, return_counts=True)
    return key >> TERM_BITS, key & ((1 << TERM_BITS) - 1), n


def document_counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(documents per group and term, occurrences per group and term, documents per group); fixed-size arrays."""
    size = GROUPS << TERM_BITS

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * size + PIECE, np.int64)
        for batch in parts:
            for _, part in _text.batches(batch.column(1)):
                doc, _, term, n = terms(part)
                group = languages(part, doc, term, n)
                d, t, tf = _distinct(doc, term)
                at = (group[d] << TERM_BITS) | t
                total[:size] += np.bincount(at, minlength=size)
                total[size : 2 * size] += np.bincount(at, tf, size).astype(np.int64)
                total[2 * size : 2 * size + GROUPS] += np.bincount(group, minlength=GROUPS)
        yield from emit(total)

    out = summed(docs, run, "<i8", 2 * size + PIECE)
    return out[:size].reshape(GROUPS, -1), out[size : 2 * size].reshape(GROUPS, -1), out[2 * size : 2 * size + GROUPS]


def _topical(df: np.ndarray, n: np.ndarray, p: Params) -> np.ndarray:
    """Mask of the terms by group that are neither too rare nor too common there to tell a subject."""
    return (df >= np.maximum(3, p.rare * n)[:, None]) & (df <= np.maximum(p.common * n, 4)[:, None])


def _weights(df: np.ndarray, tf: np.ndarray, n: np.ndarray, p: Params) -> np.ndarray:
    """Residual inverse document frequency of topical terms by group: how much a term clusters in few documents beyond chance."""
    n = np.maximum(n, 1)[:, None]
    idf = np.log(n / np.maximum(df, 1))
    chance = -np.log(np.maximum(1 - np.exp(-tf / n), 1e-9))
    return np.where(_topical(df, n[:, 0], p), np.maximum(idf - chance, 0), 0).astype(np.float32)


def vectors(docs: DataFrame, weights: np.ndarray, topical: np.ndarray) -> DataFrame:
    """(row, doc_id, language group, terms: topical terms as 4-byte numbers, parts: their weights as 4-byte floats, node: one number per different vector); vectors have length 1 or 0."""
    held = docs.sparkSession.sparkContext.broadcast((weights, topical))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, some = held.value
        for batch in parts:
            for first, part in _text.batches(batch.column(1)):
                doc, _, term, n = terms(part)
                group = languages(part, doc, term, n)
                keep = some[group[doc], term]
                d, t, tf = _distinct(doc[keep], term[keep])
                weight = w[group[d], t] * (1 + np.log(tf))
                norm = np.sqrt(np.bincount(d, weight * weight, n))
                weight = (weight / np.maximum(norm, 1e-6)[d]).astype("<f4")
                cut = np.searchsorted(d, np.arange(n + 1))
                t4 = t.astype("<i4")
                raw = [pa.array([x[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary()) for x in (t4, weight)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(group.astype(np.int32)), *raw], ["doc_id", "language", "terms", "parts"])

    out = docs.mapInArrow(run, "doc_id bigint, language int, terms binary, parts binary")
    return out.withColumn("node", F.xxhash64("terms", "parts")).withColumn("row", F.monotonically_increasing_id())


# ---------------------------------------------------------------- the graph


def pursue(x: np.ndarray, own: np.ndarray, a: np.ndarray, like: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """(anchors, weights), ``links`` per row of ``x``; weight 0 is no link. No query uses it: it links to given anchors only.

    The first link is the anchor of greatest cosine, by comparison with all of them. Each further one is the
    anchor most like what the ones before leave unexplained (matching pursuit), so a document of two subjects
    is linked to both. A weight is an exact inner product and at least ``least``, save the first's, which is
    positive. ``own`` is a row's own place among the anchors or -1: no document is linked to itself.
    """
    at, w = np.zeros((len(x), p.links), np.int32), np.zeros((len(x), p.links), np.float32)
    for i in range(0, len(x), 1024):
        c = x[i : i + 1024] @ a.T
        rows = np.arange(len(c))
        mine = np.flatnonzero(own[i : i + 1024] >= 0)
        c[mine, own[i : i + 1024][mine]] = -np.inf
        for s in range(min(p.links, len(a))):
            j = c.argmax(1)
            v = np.where(np.isfinite(c[rows, j]), np.maximum(c[rows, j], 0), 0)
            at[i : i + 1024, s], w[i : i + 1024, s] = j, np.where(v >= (p.least if s else 1e-6), v, 0)
            c -= v[:, None] * like[j]
    return at, w


def _lists(column: pa.Array, k: int) -> np.ndarray:
    """A column of arrays of ``k`` numbers as rows; zeros for null."""
    out = np.zeros((len(column), k))
    out[np.asarray(column.is_valid())] = np.asarray(column.flatten()).reshape(-1, k)
    return out


def _some(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of documents cut by the bytes of their terms, so that scratch arrays stay small."""
    for batch in parts:
        for first, part in _text.batches(batch.column("terms"), 1 << 21):
            yield batch.slice(first, len(part))


def edges(x: pa.RecordBatch, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place of the term, weight) of every term of a batch's documents."""
    terms_, parts = x.column("terms").to_pylist(), x.column("parts").to_pylist()
    row = np.repeat(np.arange(len(terms_)), [len(t) // 4 for t in terms_])
    return row, places[np.frombuffer(b"".join(terms_), "<i4")], np.frombuffer(b"".join(parts), "<f4").astype(float)


def near(links: tuple[np.ndarray, np.ndarray, np.ndarray], fixed: np.ndarray, table: np.ndarray | None, p: Params) -> np.ndarray:
    """Shares of the subjects among the documents linked to each row, raised to ``power`` and normalised; zeros where no label is near.

    ``table`` has a line per term: the weights of its labelled documents, summed by subject and, last, in all. The
    mean over a row's terms of these sums, each by its whole, is the mean over all partners. ``fixed`` are the clamped
    labels of the rows, which are taken out of the sums: no seed is linked to itself.
    """
    n, k = fixed.shape
    out = np.zeros((n, k))
    if table is None:
        return out
    mean = table[:, :k] / np.maximum(table[:, k:], 1e-12)
    seed = fixed.sum(1) > 0
    row, at, weight = links
    for a in range(0, len(row), 1 << 14):
        r, t, w = row[a : a + (1 << 14)], at[a : a + (1 << 14)], weight[a : a + (1 << 14)]
        share, own = mean[t], np.flatnonzero(seed[r])
        if len(own):
            left = table[t[own], k] - w[own]
            rest = np.maximum(table[t[own], :k] - w[own, None] * fixed[r[own]], 0) / np.maximum(left, 1e-12)[:, None]
            share[own] = np.where(left[:, None] > 1e-6, rest, 0)
        starts = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        out[r[starts]] += np.add.reduceat(share * w[:, None], starts, axis=0)
    out = (out / np.maximum(out.sum(1, keepdims=True), 1e-12)) ** p.power
    return out / np.maximum(out.sum(1, keepdims=True), 1e-12)


def trusted(links: tuple[np.ndarray, np.ndarray, np.ndarray], own: np.ndarray, table: np.ndarray | None, p: Params) -> np.ndarray:
    """``own`` without the labels of seeds whose partners give their subjects less than a tenth."""
    if table is None:
        return own
    mine = (own.sum(1) > 0)[links[0]]
    got = near(tuple(x[mine] for x in links), own, table, p)
    return np.where(((got.sum(1) > 0.5) & ((got * (own > 0)).sum(1) < 0.1))[:, None], 0, own)


def propagate(graph: DataFrame, places: np.ndarray, k: int, p: Params) -> tuple[np.ndarray | None, np.ndarray | None]:
    """(table of sums per term after ``rounds``, the one after half of them, by which seeds are trusted).

    ``graph (terms, parts, own)`` has a row per different document; ``own`` are the shares of its labels. In each round
    a document takes the mean of its partners, but a seed keeps its own; a seed that is not trusted is let go after
    half of the rounds. The table has a line per topical term, so its size does not grow with the documents.
    """
    size = (int(places.max()) + 1) * (k + 1)
    last = half = None
    for i in range(p.rounds):
        judged = i == (p.rounds + 1) // 2
        half = last if judged else half
        held = graph.sparkSession.sparkContext.broadcast((places, last, half))

        def spread(parts: Iterator[pa.RecordBatch], held=held, judged=judged) -> Iterator[pa.RecordBatch]:
            place, table, judge = held.value
            total = np.zeros((size // (k + 1), k + 1))
            for x in _some(parts):
                links = row, at, w = edges(x, place)
                given = _lists(x.column("own"), k)
                own = trusted(links, given, judge, p)
                now = np.where(own.sum(1, keepdims=True) > 0, own, near(links, given if judged else own, table, p))  # the table still has the labels of seeds just let go
                now = np.concatenate([now, now.sum(1, keepdims=True) > 0.5], 1)
                for j in range(k + 1):
                    total[:, j] += np.bincount(at, w * now[row, j], len(total))
            yield from emit(np.append(total.ravel(), np.zeros(padded(size) - size)))

        last = summed(graph.select("terms", "parts", "own"), spread, "<f8", size).reshape(-1, k + 1)
        held.unpersist()
    return last, half


def reached(graph: DataFrame, places: np.ndarray, tables: tuple[np.ndarray | None, np.ndarray | None], k: int, p: Params) -> DataFrame:
    """(doc_id, language, terms, scores, reach): the trusted labels of labelled documents and the spread ones of others; ``reach`` also has the spread ones of the labelled."""
    held = graph.sparkSession.sparkContext.broadcast((places, *tables))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, table, judge = held.value
        for x in _some(parts):
            links = edges(x, place)
            own = trusted(links, _lists(x.column("own"), k) * x.column("labelled").to_numpy(zero_copy_only=False)[:, None], judge, p)
            got = near(links, own, table, p)
            ends = pa.array(np.arange(len(got) + 1, dtype=np.int32) * k)
            scores = np.where(own.sum(1, keepdims=True) > 0, own, got)
            yield pa.RecordBatch.from_arrays([*(x.column(c) for c in ("doc_id", "language", "terms")), *(pa.ListArray.from_arrays(ends, pa.array(y.ravel())) for y in (scores, np.maximum(own, got)))], ["doc_id", "language", "terms", "scores", "reach"])

    return graph.select("doc_id", "language", "terms", "parts", "own", "labelled").mapInArrow(run, "doc_id bigint, language int, terms binary, scores array<double>, reach array<double>")


def term_subjects(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shares of subjects summed per term, documents per term and group, shares summed per group) of ``docs (terms, language, scores)``; fixed-size arrays."""
    a, b = k << TERM_BITS, GROUPS << TERM_BITS

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(a + b + PIECE)
        for batch in parts:
            score = np.array(batch.column(2).to_pylist(), np.float32).reshape(-1, k)
            group = batch.column(1).to_numpy()
            for raw, s, g in zip(batch.column(0).to_pylist(), score, group, strict=True):
                at = np.frombuffer(raw, "<i4").astype(np.int64)
                for j in np.flatnonzero(s > 0.01):
                    total[(j << TERM_BITS) + at] += s[j]
                total[a + (g << TERM_BITS) + at] += 1
            for g in range(GROUPS):
                total[a + b + g * k : a + b + (g + 1) * k] += score[group == g].sum(0)
        yield from emit(total.astype("<f4"))

    out = summed(docs.select("terms", "language", "scores"), run, "<f4", a + b + PIECE)
    return out[:a].reshape(k, -1).T, out[a : a + b].reshape(GROUPS, -1).T, out[a + b : a + b + GROUPS * k].reshape(GROUPS, k)


def _table(counts: np.ndarray, groups: np.ndarray, shares: np.ndarray, strength: float = 4.0) -> np.ndarray:
    """Evidence of each term for each subject: its smoothed share against what its documents' languages lead to expect."""
    usual = (shares + 0.5) / (shares.sum(1, keepdims=True) + 0.5 * shares.shape[1])
    total = counts.sum(1, keepdims=True)
    prior = (groups @ usual + 1e-6) / (groups.sum(1, keepdims=True) + 1e-6 * shares.shape[1])
    share = (counts + strength * prior) / (total + strength)
    out = np.clip(np.log(np.maximum(share, 1e-4) / np.maximum(prior, 1e-4)), -2, 3)
    return np.where(total > 0, out, 0).astype(np.float32)


def sentence_shares(docs: DataFrame, evidence: np.ndarray, topical: np.ndarray, names: list[str], p: Params) -> DataFrame:
    """(doc_id, subject, share): the share of a document's sentences that treat each subject.

    A sentence treats the subject with most evidence, if that is enough and more than for no subject. All
    sentences of program code treat ``p.code``.
    """
    held = docs.sparkSession.sparkContext.broadcast((evidence, topical))
    none = names.index("none")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (table, some), k = held.value, len(names)
        for batch in parts:
            for first, part in _text.batches(batch.column(1)):
                doc, sentence, term, n = terms(part)
                if not len(doc):
                    continue
                group = languages(part, doc, term, n)
                starts = np.flatnonzero(np.concatenate([[True], sentence[1:] != sentence[:-1]]))
                sizes = np.diff(np.append(starts, len(sentence)))
                score = np.add.reduceat(table[term] * some[group[doc], term][:, None], starts, axis=0)
                score[:, none] = np.maximum(score[:, none], 0)
                best = score.argmax(1)
                value = score[np.arange(len(score)), best]
                own = doc[starts]
                real = sizes >= 2
                hit = real & (value >= p.evidence) & (best != none)
                total = np.maximum(np.bincount(own[real], minlength=n), 1)
                count = np.zeros((n, k))
                np.add.at(count, (own[hit], best[hit]), 1)
                if p.code in names:
                    code = group == 1
                    count[code] = 0
                    count[code, names.index(p.code)] = total[code]
                i, j = np.nonzero(count)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first + i)), pa.array([names[x] for x in j], pa.string()), pa.array(count[i, j] / total[i])], ["doc_id", "subject", "share"])

    return docs.mapInArrow(run, "doc_id bigint, subject string, share double")


MOST_SUBJECTS = 1000


def document_subjects(docs: DataFrame, labels: DataFrame, subjects: DataFrame, p: Params | None = None) -> DataFrame:
    """(doc_id, subject, score, share): none, one or more subjects per document of ``docs (doc_id, text)``.

    ``labels (doc_id, subject)`` are seeds, ``none`` for no subject; ``subjects`` names the areas (more than
    MOST_SUBJECTS are an error). A document's subjects are those that reach it over the graph with at least ``given`` of
    its propagated label (``score``; a labelled document's own labels count too), checked by its sentences: at
    least ``share`` of them must treat the subject, by the evidence that the propagated labels give its terms.
    Without the graph no document has a subject. Null and empty texts have none; rows repeated under one
    doc_id have the subjects of each of their texts once; labels of unknown subjects or documents are ignored.
    """
    p = p or Params()
    docs = docs.where("doc_id is not null and text is not null and text <> ''").select("doc_id", "text")
    known = {r[0] for r in subjects.select("subject").where("subject is not null").distinct().limit(MOST_SUBJECTS + 1).collect()} - {"none"}
    if len(known) > MOST_SUBJECTS:
        raise ValueError("too many subjects")
    names = [*sorted(known), "none"]
    k = len(names)
    df, tf, n = document_counts(docs)
    topical = _topical(df, np.maximum(n, 1), p)
    some = topical.any(0)
    places = np.where(some, np.cumsum(some) - 1, 0).astype(np.int32)
    rows = materialize(vectors(docs, _weights(df, tf, n, p), topical), "vectors")
    at = rows.select("row", "node", "doc_id")
    seen = labels.where(F.col("subject").isin(names)).select("doc_id", "subject").distinct()
    own = seen.groupBy("doc_id").agg(*(F.sum((F.col("subject") == s).cast("double")).alias(f"c{i}") for i, s in enumerate(names)))
    # documents of the same vector are one node
    seeds = own.join(at.select("doc_id", "node").distinct(), "doc_id").groupBy("node").agg(*(F.sum(f"c{i}").alias(f"c{i}") for i in range(k)))
    total = sum((F.col(f"c{i}") for i in range(1, k)), F.col("c0"))
    seeds = seeds.select("node", F.array(*(F.col(f"c{i}") / total for i in range(k))).alias("own"))
    marks = at.join(at.groupBy("node").agg(F.min("row").alias("first")), "node").join(seeds, "node", "left").join(own.select("doc_id", F.lit(True).alias("labelled")), "doc_id", "left")
    marks = materialize(marks.where("own is not null or row <> first").select("row", "own", "labelled", (F.col("row") == F.col("first")).alias("first")), "marks")
    graph = rows.join(marks, "row", "left").select("doc_id", "language", "terms", "parts", "own", F.coalesce("labelled", F.lit(False)).alias("labelled"), F.coalesce("first", F.lit(True)).alias("first"))
    graph = materialize(graph, "graph", replaces=rows)
    scored = materialize(reached(graph, places, propagate(graph.where("first"), places, k, p), k, p), "scored")
    evidence = _table(*term_subjects(scored, k))
    at = F.posexplode(F.slice("reach", 1, k - 1)).alias("at", "score")
    given = scored.select("doc_id", at).where(F.col("score") >= p.given)
    given = given.select("doc_id", F.element_at(F.array(*map(F.lit, names)), F.col("at") + 1).alias("subject"), "score").groupBy("doc_id", "subject").agg(F.max("score").alias("score"))
    shares = sentence_shares(docs, evidence, topical, names, p).where(F.col("share") >= p.share).groupBy("doc_id", "subject").agg(F.max("share").alias("share"))
    return given.join(shares, ["doc_id", "subject"])


def composition(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(subject, docs, chars) over the corpus; documents without a subject count under ``none``, documents of several under each."""
    d = docs.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.length("text")).alias("chars"))
    x = d.join(found.select("doc_id", "subject"), "doc_id", "left")
    return x.groupBy(F.coalesce("subject", F.lit("none")).alias("subject")).agg(F.count("*").alias("docs"), F.sum("chars").alias("chars"))
