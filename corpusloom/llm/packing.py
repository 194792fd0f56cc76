"""Problem 7: filling containers of fixed capacity with documents, by vector best fit.

An item has three sizes: tokens, one document, and attention cost (tokens squared). It goes to the open container
that has room under every capacity and whose weighted residual norm afterwards is least. Items are packed within
blocks of bounded size, so the work is spread and no block's greedy pass grows with the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import materialize


@dataclass(frozen=True)
class Limits:
    """Capacities besides tokens: documents per container (one per ``tokens_per_doc`` tokens, at least 8) and attention cost as a share of capacity squared (a document that alone costs more has a container to itself); weights of the residuals; items per block."""

    tokens_per_doc: int = 32
    attention: float = 0.9
    weights: tuple[float, float, float] = (1.0, 0.02, 0.02)
    block: int = 4096


def best_fit(tokens: np.ndarray, capacity: int, limits: Limits) -> np.ndarray:
    """Container number of each item, given in any order; items are taken by falling size."""
    most = np.array([1.0, 1.0, 1.0])
    docs = max(8, capacity // limits.tokens_per_doc)
    size = np.stack([tokens / capacity, np.full(len(tokens), 1 / docs), (tokens / capacity) ** 2 / limits.attention], 1)
    size[:, 2] = np.minimum(size[:, 2], 1.0)  # a whole document always fits an empty container
    weights = np.array(limits.weights)
    room = np.zeros((len(tokens), 3))
    out = np.zeros(len(tokens), np.int64)
    smallest = size.min(0) if len(size) else most
    open_, n, eps = np.zeros(0, np.int64), 0, 1e-9
    for i in np.argsort(-tokens, kind="stable").tolist():
        left = room[open_] - size[i]
        ok = np.flatnonzero((left > -eps).all(1))
        if len(ok):
            b = open_[ok[np.argmin(((left[ok] * weights) ** 2).sum(1))]]
        else:
            b, n = n, n + 1
            room[b] = most
            open_ = np.append(open_, b)
        room[b] -= size[i]
        out[i] = b
        if (room[b] < smallest - eps).any():
            open_ = open_[open_ != b]
    return out


def pack(items: DataFrame, kinds: DataFrame, limits: Limits | None = None) -> DataFrame:
    """(container_kind, container_id, doc_id, piece, first_token, tokens) for every container kind.

    ``items``: doc_id, tokens; ``kinds``: container_kind, capacity_tokens. An item longer than the capacity is cut
    into pieces that each fill a container and one rest; all others stay whole. Documents of 0 or null tokens have
    no piece; kinds of null or no capacity have no containers; repeated doc_ids are packed as often as they come.
    """
    limits = limits or Limits()
    k = kinds.where("container_kind is not null and capacity_tokens > 0").select("container_kind", "capacity_tokens").distinct()
    items = materialize(items.where("tokens > 0").select("doc_id", "tokens"), "items")
    blocks = max(1, -(-items.count() // limits.block))
    # a row per item and kind: the kinds are a small fixed table whose size is checked by the broadcast threshold
    kind_rows = [(r[0], int(r[1])) for r in k.limit(1001).collect()]
    if len(kind_rows) > 1000:
        raise ValueError("more than 1000 kinds of container")
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("container_kind"), F.lit(c).cast("bigint").alias("capacity")) for a, c in kind_rows))) if kind_rows else F.explode(F.array().cast("array<struct<container_kind:string,capacity:bigint>>"))
    x = items.select("doc_id", "tokens", each.alias("k")).select("doc_id", "tokens", "k.*").withColumn("full", F.floor(F.col("tokens") / F.col("capacity")))
    # a document that comes again has containers of its own
    again = F.row_number().over(Window.partitionBy("container_kind", "doc_id").orderBy("tokens"))
    whole = x.where("full > 0").withColumn("again", again).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1)))
    own = F.concat_ws("-", F.col("container_kind"), F.lit("d"), F.col("doc_id").cast("string"), F.when(F.col("again") > 1, F.concat(F.lit("x"), F.col("again").cast("string"))), F.col("piece").cast("string"))
    whole = whole.select("container_kind", own.alias("container_id"), "doc_id", "piece", (F.col("piece") * F.col("capacity")).alias("first_token"), F.col("capacity").alias("tokens"))
    rest = x.select("container_kind", "capacity", "doc_id", F.col("full").alias("piece"), (F.col("full") * F.col("capacity")).alias("first_token"), (F.col("tokens") - F.col("full") * F.col("capacity")).alias("tokens")).where("tokens > 0")
    rest = rest.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)))

    def fill(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["tokens", "doc_id"], ascending=[False, True], kind="stable")
        bins = best_fit(part.tokens.to_numpy(), int(part.capacity.iloc[0]), limits)
        stem = f"{part.container_kind.iloc[0]}-{part.block.iloc[0]}-"
        return pd.DataFrame({"container_kind": part.container_kind, "container_id": [f"{stem}{b}" for b in bins], "doc_id": part.doc_id, "piece": part.piece, "first_token": part.first_token, "tokens": part.tokens})

    shape = f"container_kind string, container_id string, doc_id {dict(items.dtypes)['doc_id']}, piece bigint, first_token bigint, tokens bigint"
    return whole.unionByName(rest.groupBy("container_kind", "block").applyInPandas(fill, shape))


def fill_report(packed: DataFrame, kinds: DataFrame, limits: Limits | None = None) -> DataFrame:
    """(container_kind, containers, pieces, tokens, capacity_tokens, most, most_pieces, over, fill): how full the containers are.

    ``over`` counts the containers that break a limit of ``limits``: tokens, documents, or attention cost with more than one piece.
    """
    limits = limits or Limits()
    sized = kinds.where("capacity_tokens > 0").groupBy("container_kind").agg(F.max("capacity_tokens").alias("c"))
    own = packed.join(sized, "container_kind").groupBy("container_kind", "container_id").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("tokens"), F.first("c").alias("c"), F.sum(F.pow(F.col("tokens") / F.col("c"), F.lit(2.0))).alias("cost"))
    over = (F.col("tokens") > F.col("c")) | (F.col("pieces") > F.greatest(F.lit(8), F.floor(F.col("c") / limits.tokens_per_doc))) | ((F.col("pieces") > 1) & (F.col("cost") > limits.attention + 1e-6))
    g = own.groupBy("container_kind").agg(F.count("*").alias("containers"), F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("most"), F.max("pieces").alias("most_pieces"), F.count_if(over).alias("over"))
    k = kinds.where("capacity_tokens > 0").groupBy("container_kind").agg(F.max("capacity_tokens").alias("capacity_tokens"))
    return g.join(k, "container_kind").select("container_kind", "containers", "pieces", "tokens", "capacity_tokens", "most", "most_pieces", "over", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill"))
