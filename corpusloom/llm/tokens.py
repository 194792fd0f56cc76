"""Problem 5: token budget per source, language and domain, kept up to date through signed deltas.

A ledger of token counts is keyed by (tokenizer hash, content hash). An update encodes only contents the ledger
does not hold; the texts themselves are never shuffled. Cubes change by the signed differences between the old
and the new membership, so removed, changed and relabelled documents leave the totals they were in.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm._sums import hash_filter, holds
from corpusloom.session import load_version, materialize, save_version

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the split pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Counts a worker remembers, so that copies of one text are encoded once per worker at most.
REMEMBERED = 50_000


def tokenizer_path(spark: SparkSession, path: str | None) -> str:
    """The tokenizer's file: as given, else as the session's spark.corpusloom.tokenizer names it, else TOKENIZER."""
    return path or spark.conf.get("spark.corpusloom.tokenizer", TOKENIZER)


def tokenizer_hash(path: str = TOKENIZER) -> str:
    """Names a tokenizer by its vocabulary and split pattern."""
    return hashlib.sha256(Path(path).read_bytes() + PATTERN.encode()).hexdigest()[:16]


class Counter:
    """Counts tokens of texts; the vocabulary travels with the code, so workers need no file."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        raw = Path(tokenizer_path(spark, path)).read_bytes()
        self.held = spark.sparkContext.broadcast(raw)

    def __call__(self, text: str) -> int:
        if not hasattr(self, "coder"):
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.held.value.splitlines()) if a}
            self.coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return len(self.coder.encode_ordinary(text))

    def __getstate__(self):
        return {"held": self.held}


def count_tokens(df: DataFrame, keys: list[str], path: str | None = None) -> DataFrame:
    """(keys, tokens) for every row of ``df`` (keys, text); null and empty texts have 0 tokens. No shuffle."""
    counter = Counter(df.sparkSession, path)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in parts:
            out = []
            for text in batch.column(len(keys)).to_pylist():
                n = known.get(text) if text else 0
                if n is None:
                    n = counter(text)
                    if len(text) < 20_000:
                        if len(known) >= REMEMBERED // 10:
                            known.clear()
                        known[text] = n
                out.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(out, pa.int64())], [*keys, "tokens"])

    x = df.select(*keys, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema.fields[:-1])
    return x.mapInArrow(run, f"{schema}, tokens bigint")


# ---------------------------------------------------------------- labels

#: Spellings of languages.
LANGUAGES = {
    "zh": ["zh", "zho", "chi", "chinese", "cmn", "zh-cn", "zh-hans", "zh-tw", "zh-hant"],
    "lzh": ["lzh", "zh-classical", "zh-lzh", "wenyan", "classical chinese"],
    "en": ["en", "eng", "english", "en-us", "en-gb"],
    "fr": ["fr", "fra", "fre", "french", "fr-fr"],
    "mixed": ["mixed", "zh-en", "en-zh", "multi", "bilingual"],
    "code": ["code"],
}
#: Spellings that name nothing.
NOTHING = ["", "unknown", "unk", "und", "none", "null", "nan", "n/a", "na", "?", "-", "other"]


def language_key(c: Column) -> Column:
    """A language's one spelling; null, empty, unknown and unheard-of spellings are ``unknown``."""
    x = F.translate(F.lower(F.trim(c)), "_", "-")
    out = F.lit("unknown")
    for name, spellings in LANGUAGES.items():
        out = F.when(x.isin(spellings), F.lit(name)).otherwise(out)
    return out


def label_key(c: Column) -> Column:
    """A label in lower case without blanks around it; null and empty labels are ``unknown``."""
    x = F.lower(F.trim(c))
    return F.when(x.isNull() | x.isin(NOTHING), F.lit("unknown")).otherwise(x)


# ---------------------------------------------------------------- the ledger

DIMENSIONS = ["source", "language", "domain"]


@dataclass
class Ledger:
    """counts (tokenizer, content, tokens), members (doc_id, content, dimensions) and cube (dimensions, docs, tokens)."""

    counts: DataFrame
    members: DataFrame
    cube: DataFrame


def empty_ledger(spark: SparkSession) -> Ledger:
    dims = ", ".join(f"{d} string" for d in DIMENSIONS)
    return Ledger(
        spark.createDataFrame([], "tokenizer string, content string, tokens bigint"),
        spark.createDataFrame([], f"doc_id string, content string, {dims}"),
        spark.createDataFrame([], f"{dims}, docs bigint, tokens bigint"),
    )


def records(docs: DataFrame) -> DataFrame:
    """(doc_id, content, dimensions) with one row per doc_id, the one loaded last (ties: greatest content hash)."""
    row = F.struct(F.col("loaded_at"), F.md5(F.coalesce("text", F.lit(""))).alias("content"), label_key(F.col("source")).alias("source"), language_key(F.col("language")).alias("language"), label_key(F.col("domain")).alias("domain"))
    return docs.where("doc_id is not null").groupBy("doc_id").agg(F.max(row).alias("r")).select("doc_id", "r.content", *(f"r.{d}" for d in DIMENSIONS))


def _content_hash(text: Column) -> Column:
    """A bigint from the content hash, for the filter."""
    return F.xxhash64(F.md5(F.coalesce(text, F.lit(""))))


def save(ledger: Ledger, path: str) -> int:
    """Keep a ledger as the next version below ``path``, a folder that outlives the session."""
    return save_version({"counts": ledger.counts, "members": ledger.members, "cube": ledger.cube}, path)


def load(spark: SparkSession, path: str) -> Ledger:
    """The ledger kept last below ``path``; an empty one where there is none."""
    kept = load_version(spark, path, ["counts", "members", "cube"])
    return Ledger(**kept) if kept else empty_ledger(spark)


def update(docs: DataFrame, ledger: Ledger, path: str | None = None) -> Ledger:
    """The ledger after ``docs (doc_id, text, source, language, domain, loaded_at)`` has become the whole corpus.

    Contents without a count under this tokenizer are encoded, each distinct content once per worker at most;
    documents that are gone, changed or relabelled are taken out of the cube by negative deltas. Rows repeated
    under one doc_id count once; null and empty texts have 0 tokens; rows without a doc_id are left out.
    """
    path = tokenizer_path(docs.sparkSession, path)
    name = tokenizer_hash(path)
    now = materialize(records(docs), "members")
    counted = ledger.counts.where(F.col("tokenizer") == name)
    unseen = materialize(now.select("content").distinct().join(counted.select("content"), "content", "left_anti"), "unseen")
    held = docs.sparkSession.sparkContext.broadcast(hash_filter(unseen.select(F.xxhash64("content").alias("h"))))
    counter = Counter(docs.sparkSession, path)

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, shift = held.value
        done: set[int] = set()
        for batch in parts:
            h = batch.column(1).to_numpy()
            rows = []
            for i in np.flatnonzero(holds(bitmap, shift, h)).tolist():
                if h[i] not in done:
                    if len(done) >= REMEMBERED:
                        done.clear()
                    done.add(h[i])
                    rows.append(i)
            take = pa.array(rows, pa.int64())
            texts = batch.column(2).take(take).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array([counter(t) if t else 0 for t in texts], pa.int64())], ["content", "tokens"])

    text = docs.select(F.md5(F.coalesce("text", F.lit(""))).alias("content"), _content_hash(F.col("text")).alias("h"), "text")
    fresh = text.mapInArrow(encode, "content string, tokens bigint").groupBy("content").agg(F.first("tokens").alias("tokens")).join(unseen, "content", "left_semi")
    counts = materialize(ledger.counts.unionByName(fresh.select(F.lit(name).alias("tokenizer"), "content", "tokens")), "counts")
    sized = counts.where(F.col("tokenizer") == name).select("content", "tokens")
    key = ["doc_id", "content", *DIMENSIONS]
    signed = now.select(*key, F.lit(1).alias("sign")).unionByName(ledger.members.select(*key, F.lit(-1).alias("sign")))
    # a record that stays as it was cancels out before anything is joined
    moved = signed.groupBy(*key).agg(F.sum("sign").alias("sign")).where("sign <> 0")
    delta = moved.join(sized, "content").groupBy(*DIMENSIONS).agg(F.sum("sign").alias("docs"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens"))
    cube = ledger.cube.unionByName(delta.select(*DIMENSIONS, "docs", "tokens")).groupBy(*DIMENSIONS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    return Ledger(counts, now, materialize(cube.where("docs <> 0"), "cube"))


def rollup(cube: DataFrame) -> DataFrame:
    """Totals by every subset of the dimensions; ``level`` names the dimensions that are kept."""
    g = cube.cube(*DIMENSIONS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"), F.grouping_id().alias("gid"))
    level = F.array_join(F.filter(F.array(*(F.when(F.col("gid").bitwiseAND(1 << (len(DIMENSIONS) - 1 - i)) == 0, F.lit(d)) for i, d in enumerate(DIMENSIONS))), lambda x: x.isNotNull()), ",")
    return g.select(level.alias("level"), *DIMENSIONS, "docs", "tokens")
