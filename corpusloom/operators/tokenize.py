"""Tokenization with reuse of earlier encodings, and checks of encoded samples."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tokenize(docs: DataFrame, tokenizer_file: str, keys: list[str]) -> DataFrame:
    """(keys, input_ids, token_count) of ``docs (keys, text)`` under a tokenizer file; null texts have no tokens.

    The file travels with the code, so workers need no copy; special tokens in a text are ordinary text.
    """
    held = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_file).read_text(encoding="utf-8"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tokenizers import Tokenizer

        coder = Tokenizer.from_str(held.value)
        coder.encode_special_tokens = True
        for x in parts:
            ids = [e.ids for e in coder.encode_batch([t or "" for t in x.text], add_special_tokens=False)]
            out = x[keys].copy()
            out["input_ids"], out["token_count"] = ids, [len(i) for i in ids]
            yield out

    x = docs.select(*keys, "text")
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema.fields[:-1])
    return x.mapInPandas(run, f"{shape}, input_ids array<bigint>, token_count bigint")


def tokenize_with_reuse(docs: DataFrame, earlier: DataFrame, tokenizer_file: str, tokenizer_hash: str) -> DataFrame:
    """(doc_id, text_hash, input_ids, token_count, reused) of ``docs (doc_id, text)``.

    ``earlier``: doc_id, text_hash, tokenizer_sha256, plan, input_ids, token_count. An encoding is reused if id, text
    and tokenizer are the same; of several plans the latest counts. Only the rest is encoded.
    """
    now = docs.select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_hash"))
    old = earlier.where(F.col("tokenizer_sha256") == tokenizer_hash).groupBy("doc_id", "text_hash").agg(F.max_by(F.struct("input_ids", "token_count"), "plan").alias("e"))
    joined = now.join(old, ["doc_id", "text_hash"], "left")
    kept = joined.where("e is not null").select("doc_id", "text_hash", "e.input_ids", "e.token_count", F.lit(True).alias("reused"))
    fresh = tokenize(joined.where("e is null").select("doc_id", "text_hash", "text"), tokenizer_file, ["doc_id", "text_hash"]).withColumn("reused", F.lit(False))
    return kept.unionByName(fresh)


def round_trip(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """(doc_id, exact, tokens, hanzi, single_hanzi): whether decoding gives the text back, and how many ideographs are one token each."""
    held = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_file).read_text(encoding="utf-8"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tokenizers import Tokenizer

        coder = Tokenizer.from_str(held.value)
        coder.encode_special_tokens = True
        single: dict[str, bool] = {}
        for x in parts:
            rows = []
            for i, t in zip(x.doc_id, x.text, strict=True):
                t = t or ""
                e = coder.encode(t, add_special_tokens=False)
                han = [c for c in t if "㐀" <= c <= "鿿"]
                for c in set(han) - single.keys():
                    single[c] = len(coder.encode(c, add_special_tokens=False).ids) == 1
                rows.append((i, coder.decode(e.ids, skip_special_tokens=False) == t, len(e.ids), len(han), sum(single[c] for c in han)))
            yield pd.DataFrame(rows, columns=["doc_id", "exact", "tokens", "hanzi", "single_hanzi"])

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {dict(docs.dtypes)['doc_id']}, exact boolean, tokens bigint, hanzi bigint, single_hanzi bigint")


def end_mark_evidence(ids: Column, labels: Column, end_mark: int, tail: int = 8, ignore: int = -100) -> Column:
    """Why the end mark of an encoded row is suspect, or null: no_end_mark, far_from_tail, not_supervised."""
    back = F.array_position(F.reverse(ids), F.lit(end_mark))
    label = F.get(F.reverse(labels), (back - 1).cast("int"))
    return F.when(back == 0, "no_end_mark").when(back > tail, "far_from_tail").when(label == ignore, "not_supervised")
