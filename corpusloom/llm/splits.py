"""Problem 6: train, dev and test splits that keep related records together.

Records are tied by the book and the doc they name. Only the names are nodes of the graph, a record that names
both is an edge, and equal edges are one, so a book of any number of records stays small. Components come from a
persisted spanning forest by minimum-edge contraction; whole components are dealt to the splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import NO_BOOK as NO_BOOK
from corpusloom.functions.text import book_key, doc_key
from corpusloom.operators.graph import component_roots
from corpusloom.operators.prefix import prefix_sum
from corpusloom.session import materialize


def tied(records: DataFrame, path: str | None = None) -> DataFrame:
    """(id, split, root): the set of tied records that each record of ``records (id, book, doc, split)`` belongs to.

    With a ``path`` the spanning forest over books and docs is kept there and earlier deliveries' ties count. A record that names neither book nor doc is a set of its own. Records repeated under one id count once (the
    least of each value); rows without an id are left out.
    """
    r = records.where("id is not null").groupBy("id").agg(F.min("split").alias("split"), F.min("book").alias("book"), F.min("doc").alias("doc"))
    r = r.select("id", "split", F.md5(F.concat(F.lit("b:"), book_key(F.col("book")))).alias("b"), F.md5(F.concat(F.lit("d:"), doc_key(F.col("doc")))).alias("d"))
    r = materialize(r, "records")
    roots = component_roots(r.where("b is not null and d is not null").select(F.col("b").alias("u"), F.col("d").alias("v")).distinct(), path)
    by = F.coalesce("b", "d", F.concat(F.lit("r:"), F.col("id")))
    return materialize(r.withColumn("node", by).join(roots, "node", "left").select("id", "split", F.coalesce("root", "node").alias("root")), "tied")


def torn(records: DataFrame) -> DataFrame:
    """(id): records of a set of tied records whose present splits differ; null splits are no split."""
    t = tied(records)
    mixed = t.groupBy("root").agg(F.min("split").alias("lo"), F.max("split").alias("hi")).where("lo <> hi").select("root")
    return t.join(mixed, "root", "left_semi").select("id")


def assign(records: DataFrame, shares: dict[str, float], seed: int = 0, path: str | None = None) -> DataFrame:
    """(id, root, split, new_split, torn): splits in the proportions ``shares`` that keep tied records together.

    Sets of tied records larger than the smaller splits' whole size go to the largest split; the others are
    stratified by size band (powers of two) and dealt systematically within a band: split s takes a set whenever
    the running size, scaled by its rate and shifted by a random offset, crosses an integer.
    """
    t = tied(records, path)
    sets = materialize(t.groupBy("root").agg(F.count("*").alias("n"), (F.min("split") != F.max("split")).alias("torn")), "sets")
    names = sorted(shares, key=lambda s: (-shares[s], s))
    total = sets.agg(F.sum("n")).first()[0] or 0
    whole = sum(shares.values())
    target = {s: shares[s] / whole * total for s in names}
    most = max(1, min(target.values(), default=0))
    dealt = sets.where(F.col("n") <= most)
    left = dealt.agg(F.sum("n")).first()[0] or 1
    dealt = dealt.withColumn("band", F.floor(F.log2("n")).cast("int"))
    dealt = prefix_sum(dealt, F.col("n"), F.xxhash64(F.lit(seed), "root"), ["band"])
    # one pass over [0, 1): the small splits take their stretch of every period
    choice, begin = F.lit(names[0]), 0.0
    period = F.pow(2.0, F.col("band")) * max(8.0, whole / min(shares.values()) * 2)
    offset = (F.pmod(F.xxhash64(F.lit(seed), "band"), F.lit(1 << 20)) / float(1 << 20)).cast("double")
    spot = (F.col("prefix") + F.col("n") / 2) / period + offset
    spot = spot - F.floor(spot)
    for s in names[1:]:
        rate = min(1.0, target[s] / left)
        choice = F.when((spot >= begin) & (spot < begin + rate), F.lit(s)).otherwise(choice)
        begin += rate
    chosen = dealt.select("root", "torn", choice.alias("new_split")).unionByName(sets.where(F.col("n") > most).select("root", "torn", F.lit(names[0]).alias("new_split")))
    return t.join(chosen, "root").select("id", "root", "split", "new_split", F.coalesce("torn", F.lit(False)).alias("torn"))


def share_report(assigned: DataFrame, shares: dict[str, float]) -> DataFrame:
    """(new_split, records, sets, share, target, torn_sets): the achieved proportions; no set of tied records is in two splits (torn_sets 0)."""
    homes = assigned.groupBy("root").agg(F.count_distinct("new_split").alias("homes"))
    whole = assigned.agg(F.count("*").alias("whole"))
    x = assigned.join(homes, "root").groupBy("new_split").agg(F.count("*").alias("records"), F.count_distinct("root").alias("sets"), F.count_distinct(F.when(F.col("homes") > 1, F.col("root"))).alias("torn_sets"))
    target = F.create_map(*(y for s, w in shares.items() for y in (F.lit(s), F.lit(w / sum(shares.values())))))
    n = whole.first()[0]
    return x.select("new_split", "records", "sets", (F.col("records") / F.lit(max(1, n))).alias("share"), target[F.col("new_split")].alias("target"), "torn_sets")
