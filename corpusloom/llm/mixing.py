"""Problem 8: mixing sources to target shares, by systematic sampling.

Every document of a source has the same expected number of copies. The expectations are prefix-summed within the
source over documents ordered by size band and hash, one random offset is added, and a document is emitted once
per integer boundary its stretch crosses: floor(r) or ceil(r) copies each, and nearly the wanted number of tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.prefix import prefix_sum
from corpusloom.session import materialize

#: Expected copies are whole multiples of 2**-24, so prefix sums are exact integers.
UNIT = 1 << 24
MOST_SOURCES = 10_000


def rates(available: dict[str, int], targets: dict[str, tuple[float, int]], total: float | None = None, shortfall: float = 0.01) -> dict[str, float]:
    """Expected copies per document of each source.

    With a total size the shares that capped sources leave free go to the others in proportion. Without one the
    largest total is taken at which the shares missed by capped sources sum to at most ``shortfall`` (besides
    those of sources without documents).
    """
    some = {s: (w, m) for s, (w, m) in targets.items() if available.get(s, 0) > 0 and w > 0 and m > 0}
    if not some:
        return {}
    cap = {s: m * available[s] for s, (w, m) in some.items()}
    whole = sum(w for w, _ in some.values())
    share = {s: w / whole for s, (w, _) in some.items()}

    def given(t: float) -> dict[str, float]:
        free, out, left = set(some), {}, t
        while free:
            weight = sum(share[s] for s in free)
            over = {s for s in free if share[s] / weight * left >= cap[s]}
            if not over:
                return out | {s: share[s] / weight * left for s in free}
            out |= {s: cap[s] for s in over}
            left -= sum(cap[s] for s in over)
            free -= over
        return out

    def missed(t: float) -> float:
        g = given(t)
        size = sum(g.values())
        return sum(max(0.0, share[s] - g[s] / size) for s in some)

    if total is None:
        low, high = min(cap[s] / share[s] for s in some), float(sum(cap.values()))
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if missed(mid) <= shortfall else (low, mid)
        total = low
    return {s: x / available[s] for s, x in given(total).items()}


def mix(docs: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(selection (doc_id, source, copy, tokens), report) of ``docs (doc_id, source, tokens)`` for ``targets (source, target_share, max_repeats)``.

    Documents of 0 or null tokens, of a null source or of a source without a share are not selected; a document
    comes at most ``max_repeats`` times. report: source, target_share, max_repeats, available_docs,
    available_tokens, expected_copies, copies, tokens, actual_share, for every source that has documents or a share.
    """
    docs = materialize(docs.where("tokens > 0 and source is not null").select("doc_id", "source", "tokens"), "sized")
    wanted = targets.where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    have = docs.groupBy("source").agg(F.count("*").alias("available_docs"), F.sum("tokens").alias("available_tokens"))
    known = materialize(wanted.join(have, "source", "full").na.fill(0, ["available_docs", "available_tokens"]), "sources")
    rows = known.where("target_share > 0").limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError("too many sources with a share")
    rate = rates({r["source"]: r["available_tokens"] for r in rows}, {r["source"]: (r["target_share"], r["max_repeats"] or 0) for r in rows}, total)
    units = docs.sparkSession.createDataFrame([(s, int(r * UNIT), r) for s, r in rate.items()], "source string, units bigint, expected_copies double")
    x = docs.join(F.broadcast(units.select("source", "units")), "source")  # at most MOST_SOURCES rows
    x = prefix_sum(x, F.col("units"), F.xxhash64(F.lit(seed), "doc_id"), ["source"], band=F.floor(F.log2("tokens")).cast("int"))
    offset = F.pmod(F.xxhash64(F.lit(seed), "source"), F.lit(UNIT))
    begin, end = F.floor((F.col("prefix") + offset) / UNIT), F.floor((F.col("prefix") + offset + F.col("units")) / UNIT)
    x = x.withColumn("copies", (end - begin).cast("int"))
    chosen = materialize(x.where("copies > 0").select("doc_id", "source", "tokens", "copies"), "chosen")
    selection = chosen.select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"), "tokens")
    got = chosen.groupBy("source").agg(F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("tokens")).alias("tokens"))
    report = known.join(units.drop("units"), "source", "left").join(got, "source", "left").na.fill(0, ["copies", "tokens"])
    size = got.agg(F.sum("tokens")).first()[0] or 1
    return selection, report.withColumn("actual_share", F.col("tokens") / F.lit(float(size)))
