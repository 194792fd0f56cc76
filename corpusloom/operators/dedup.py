"""Exact and near-duplicate removal.

Near duplicates: MinHash signatures of shingle sets, bands as join keys, star edges to the least member of a band
(linear in its size), verification by exact Jaccard where asked, and connected components over the links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.graph import components
from corpusloom.session import materialize, small

#: Rows of one content from which it is joined by broadcast.
HOT = 100_000

#: Rank of a source by its quality profile.
PROFILE_RANK = {"curated_zh": 0, "curated_en": 0, "classical": 1, "scientific": 1, "math": 1, "code": 1, "web_zh": 2, "web_multilingual": 2, "broad_zh": 3}
UNKNOWN_PROFILE, UNKNOWN_SOURCE = 100, 1_000_000


def source_rank(source: Column, profiles: dict[str, str]) -> Column:
    """Rank of a source by its quality profile; low is preferred."""
    rank = {s: PROFILE_RANK.get(p, UNKNOWN_PROFILE) for s, p in profiles.items()}
    out = F.lit(UNKNOWN_SOURCE)
    for s, r in sorted(rank.items()):
        out = F.when(source == s, r).otherwise(out)
    return out


def exact_representatives(docs: DataFrame, rank: Column) -> DataFrame:
    """(doc_id, content_sha256, kept_doc_id) for every row with a text: the kept document of its content.

    Kept is the least (rank, -quality_prior with null last, -length, doc_id). Only the hash, the id and three
    numbers are shuffled, and they are combined before the shuffle, so a text that a third of all rows share
    costs one row per map task. Contents of more than HOT rows are then joined by broadcast, in as many tasks as
    their rows are read; there is at most one of them per HOT rows. Null texts are left out.
    """
    narrow = materialize( docs.where("text is not null").select("doc_id", T.content_hash(F.col("text")).alias("content_sha256"), rank.alias("r"), (-F.coalesce("quality_prior", F.lit(-1e30))).alias("q"), (-F.length("text")).alias("n")), "hashes")
    best = narrow.groupBy("content_sha256").agg(F.min(F.struct("r", "q", "n", "doc_id")).alias("k"), F.count("*").alias("rows"))
    best = materialize(best.select("content_sha256", F.col("k.doc_id").alias("kept_doc_id"), "rows"), "kept")
    hot = small(best.where(F.col("rows") > HOT).select("content_sha256", F.col("kept_doc_id").alias("__hot")))
    x = narrow.select("doc_id", "content_sha256").join(hot, "content_sha256", "left")
    cold = x.where("__hot is null").drop("__hot").join(best.where(F.col("rows") <= HOT).drop("rows"), "content_sha256")
    return cold.select("doc_id", "content_sha256", "kept_doc_id").unionByName(x.where("__hot is not null").withColumnRenamed("__hot", "kept_doc_id").select("doc_id", "content_sha256", "kept_doc_id"))


def rounds_removals(rounds: list[DataFrame], rank: Column) -> DataFrame:
    """Exact removals over the candidates of all rounds, earlier and present: a copy in a later round meets the kept one of any round."""
    every = rounds[0]
    for r in rounds[1:]:
        every = every.unionByName(r, allowMissingColumns=True)
    return exact_removals(every, rank)


def exact_removals(docs: DataFrame, rank: Column) -> DataFrame:
    """(doc_id, content_sha256, kept_doc_id) of the rows that exact deduplication removes; every row with the kept id stays."""
    return exact_representatives(docs, rank).where("doc_id <> kept_doc_id")


def exact_kept(docs: DataFrame, rank: Column) -> DataFrame:
    """The rows of ``docs`` that exact deduplication keeps; rows of a null text go."""
    gone = exact_removals(docs, rank).select("doc_id").distinct()
    return docs.where("text is not null").join(gone, "doc_id", "left_anti")


def minhash_profile(domain: Column, language: Column) -> Column:
    """The shingle profile of a document: code, zh or en."""
    return F.when(domain.isin("code", "structured"), "code").when(language.isin("zh", "zh_en_mixed"), "zh").otherwise("en")


def shingles(text: Column, profile: Column, k: int = 5) -> Column:
    """Distinct shingles of ``k`` characters (zh), code tokens (code) or words (en)."""
    zh = T.char_grams(T.compact(text), k)
    return F.array_distinct(F.when(profile == "zh", zh).when(profile == "code", T.windows(T.code_tokens(text), k)).otherwise(T.windows(T.words(text), k)))


def lsh_dimensions(buckets: int, threshold: float) -> tuple[int, int]:
    """(bands, hashes per band) whose banding curve has its knee at the threshold."""
    if buckets < 2 or not 0 < threshold < 1:
        raise ValueError("at least two buckets and a threshold between 0 and 1 are needed")
    return buckets, max(1, round(-math.log(buckets) / math.log(threshold)))


def minhash_bands(docs: DataFrame, bands: int, rows: int, seed: int = 1, k: int = 5) -> DataFrame:
    """(doc_id, band, key): band keys of each document's MinHash signature; documents without shingles have none.

    ``docs``: doc_id, text, profile.
    """
    n = bands * rows
    sets = docs.select("doc_id", F.transform(shingles(F.col("text"), F.col("profile"), k), lambda s: F.xxhash64(s)).alias("s"))

    def sign(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.random.default_rng(seed)
        a, b = (r.integers(1, 1 << 63, n, dtype=np.int64).astype(np.uint64) for _ in range(2))
        a |= np.uint64(1)
        for batch in parts:
            ids, out, keys, own = [], [], [], batch.column(1)
            flat = own.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            ends = np.concatenate([[0], np.cumsum(np.diff(own.offsets.to_numpy()))])
            for i in range(len(own)):
                s = flat[ends[i] : ends[i + 1]]
                if not len(s):
                    continue
                low = np.full(n, np.uint64(0xFFFFFFFFFFFFFFFF))
                with np.errstate(over="ignore"):
                    for c in range(0, len(s), 4096):
                        low = np.minimum(low, (s[c : c + 4096, None] * a + b).min(0))
                ids += [i] * bands
                out += range(bands)
                keys += [xxhash.xxh3_64_intdigest(low[j * rows : (j + 1) * rows].tobytes(), j) - (1 << 63) for j in range(bands)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(out, pa.int32()), pa.array(keys, pa.int64())], ["doc_id", "band", "key"])

    return sets.mapInArrow(sign, f"doc_id {dict(docs.dtypes)['doc_id']}, band int, key bigint")


def band_links(bands: DataFrame) -> DataFrame:
    """(u, v): every member of a band bucket linked to the bucket's least member, which connects it as all pairs would."""
    least = bands.groupBy("band", "key").agg(F.min("doc_id").alias("u"), F.count("*").alias("n")).where("n > 1")
    return bands.join(least, ["band", "key"]).where("doc_id <> u").select("u", F.col("doc_id").alias("v")).distinct()


def minhash_clusters(docs: DataFrame, bands: int = 14, threshold: float = 0.8, seed: int = 1, k: int = 5) -> DataFrame:
    """(doc_id, cluster): documents joined through equal bands, cluster named by its least doc_id; unlinked documents are their own cluster."""
    b, r = lsh_dimensions(bands, threshold)
    links = band_links(materialize(minhash_bands(docs, b, r, seed, k), "bands"))
    comp = components(links)
    return docs.select("doc_id").distinct().join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("cluster"))


def near_clusters(docs: DataFrame, exact_only: tuple[str, ...] = (), **kw) -> DataFrame:
    """(doc_id, cluster) by MinHash; documents of a profile in ``exact_only`` are clusters of their own, as exact deduplication left them."""
    only = F.col("profile").isin(*exact_only) if exact_only else F.lit(False)
    only = F.coalesce(only, F.lit(False))
    return minhash_clusters(docs.where(~only), **kw).unionByName(docs.where(only).select("doc_id", F.col("doc_id").alias("cluster")).distinct())


def near_duplicates(docs: DataFrame, threshold: float = 0.85, bands: int = 16, rows: int = 4, k: int = 5, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(pairs (id_a, id_b, jaccard), classes (doc_id, class)) of verified near duplicates.

    ``docs``: doc_id, text. Shingles are ``k`` characters without white space; texts of fewer than 16 characters
    have none. Equal shingle sets are one representative, so copies make no pairs; pairs of representatives
    share a band and have the Jaccard similarity ``threshold`` at least. A bucket's representatives are compared
    in blocks, each with each, on the shingles themselves.
    """
    x = docs.where(F.length(T.compact(F.col("text"))) >= 16).select("doc_id", F.array_sort(F.array_distinct(F.transform(T.char_grams(T.compact(F.col("text")), k), lambda s: F.xxhash64(s)))).alias("s"))
    x = materialize(x.withColumn("h", F.md5(F.to_json("s"))), "shingles")
    reps = x.groupBy("h").agg(F.min("doc_id").alias("rep"))
    sets = materialize(x.join(reps, "h").where("doc_id = rep").select("doc_id", "s").dropDuplicates(["doc_id"]), "representatives")
    n = bands * rows

    def sign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = np.random.default_rng(seed)
        a, b = (r.integers(1, 1 << 63, n, dtype=np.int64).astype(np.uint64) for _ in range(2))
        a |= np.uint64(1)
        for part in parts:
            ids, band, key = [], [], []
            for i, s in zip(part.doc_id, part.s, strict=True):
                with np.errstate(over="ignore"):
                    low = (np.asarray(s).astype(np.int64).view(np.uint64)[:, None] * a + b).min(0)
                ids += [i] * bands
                band += range(bands)
                key += [xxhash.xxh3_64_intdigest(low[j * rows : (j + 1) * rows].tobytes(), j) - (1 << 63) for j in range(bands)]
            yield pd.DataFrame({"doc_id": ids, "band": band, "key": key})

    kind = dict(docs.dtypes)["doc_id"]
    keys = materialize(sets.mapInPandas(sign, f"doc_id {kind}, band int, key bigint"), "keys")
    pairs = keys.alias("a").join(keys.alias("b"), ["band", "key"]).where("a.doc_id < b.doc_id").select(F.col("a.doc_id").alias("id_a"), F.col("b.doc_id").alias("id_b")).distinct()
    full = pairs.join(sets.select(F.col("doc_id").alias("id_a"), F.col("s").alias("sa")), "id_a").join(sets.select(F.col("doc_id").alias("id_b"), F.col("s").alias("sb")), "id_b")
    both = F.size(F.array_intersect("sa", "sb"))
    jaccard = both / (F.size("sa") + F.size("sb") - both)
    pairs = materialize(full.select("id_a", "id_b", jaccard.alias("jaccard")).where(F.col("jaccard") >= threshold), "pairs")
    comp = components(pairs.select(F.col("id_a").alias("u"), F.col("id_b").alias("v")))
    member = x.join(reps, "h").select("doc_id", "rep").distinct()
    classes = docs.select("doc_id").distinct().join(member, "doc_id", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep", "doc_id").alias("class"))
    return pairs, classes


def spread_block(classes: DataFrame, hits: DataFrame) -> DataFrame:
    """(doc_id): all documents of a class any member of which is hit (``hits``: doc_id)."""
    bad = classes.join(hits.select("doc_id").distinct(), "doc_id", "left_semi").select("class").distinct()
    return classes.join(bad, "class", "left_semi").select("doc_id")


def first_per_key(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in the given order; null keys are one key. Combined before the shuffle."""
    names = rows.columns
    packed = rows.groupBy(*key).agg(F.min_by(F.struct(*names), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("r"))
    return packed.select(*[F.col(f"r.`{n}`").alias(n) for n in names])


def two_key_greedy(rows: DataFrame, group: str, key_a: str, key_b: str, order: list[str]) -> DataFrame:
    """Rows taken in order within a group unless one of their two keys is already held by a taken row.

    A refused row holds no key, so this is not two independent filters. It is solved in rounds: a row that comes
    first among the open rows of both keys is taken, rows that share a key with it are refused, the others stay
    open. Null keys are never held. Ties in ``order`` are broken by both keys, then by a hash of the whole row, so
    the result does not depend on the partitioning.
    """
    x = rows.withColumn("__o", F.struct(*order, F.coalesce(key_a, F.lit("")).alias("__a"), F.coalesce(key_b, F.lit("")).alias("__b"), F.xxhash64(*rows.columns).alias("__h"), F.monotonically_increasing_id().alias("__i")))
    open_, taken = materialize(x, "open"), None
    while True:
        a = open_.groupBy(group, key_a).agg(F.min("__o").alias("__fa"))
        b = open_.groupBy(group, key_b).agg(F.min("__o").alias("__fb"))
        y = open_.join(a, [group, key_a], "left").join(b, [group, key_b], "left")
        first = (F.col("__fa").isNull() | (F.col("__fa") == F.col("__o"))) & (F.col("__fb").isNull() | (F.col("__fb") == F.col("__o")))
        won = materialize(y.where(first).select(*x.columns), "won")
        if won.isEmpty():
            break
        taken = won if taken is None else taken.unionByName(won)
        left = open_.join(won.select("__o"), "__o", "left_anti").join(won.select(group, key_a).distinct(), [group, key_a], "left_anti").join(won.select(group, key_b).distinct(), [group, key_b], "left_anti")
        open_ = materialize(left.select(*x.columns), "open")
        if open_.isEmpty():
            break
    return (taken if taken is not None else x.where("false")).select(*rows.columns)


def source_dedup(pairs: DataFrame, blocked: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``status`` to ``pairs (source, ...)``: kept, duplicate (an earlier row has the same source) or overlap (``blocked``: source, split).

    A repeated row counts as duplicate before overlap is looked at.
    """
    w = Window.partitionBy("source").orderBy(*order)
    held = blocked.select("source").distinct().withColumn("__held", F.lit(True))
    x = pairs.withColumn("__n", F.row_number().over(w)).join(held, "source", "left")
    return x.withColumn("status", F.when(F.col("__n") > 1, "duplicate").when(F.col("__held"), "overlap").otherwise("kept")).drop("__n", "__held")
