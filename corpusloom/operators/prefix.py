"""Distributed prefix sums: running totals over a global or per-group order without a one-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 256


def prefix_sum(df: DataFrame, value: Column, order: Column, groups: list[str], out: str = "prefix", buckets: int = BUCKETS, band: Column | None = None) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same groups that come before this one.

    ``order`` is a bigint column, best a hash, made unique by the caller; rows are ordered by (``band``, its top
    bits, itself). Rows are summed per (group, band, bucket) first, the few bucket totals are accumulated, and
    only rows of one bucket meet in one task, so a group that holds most rows is spread over ``buckets`` tasks.
    Null values count as 0; null group keys form a group of their own.
    """
    taken = set(df.columns)
    name = {k: f"__px_{k}" for k in ("v", "o", "b", "band", "base")}
    assert not taken & set(name.values())
    x = df.withColumns({name["v"]: F.coalesce(value, F.lit(0)), name["o"]: order, name["band"]: band if band is not None else F.lit(0)})
    x = x.withColumn(name["b"], F.floor((F.col(name["o"]).cast("double") + 2.0**63) / (2.0**64 / buckets)).cast("int"))
    keys = [*groups, name["band"], name["b"]]
    totals = x.groupBy(*keys).agg(F.sum(name["v"]).alias("__px_t"))
    before = Window.partitionBy(*groups).orderBy(name["band"], name["b"]).rowsBetween(Window.unboundedPreceding, -1)
    base = totals.withColumn(name["base"], F.coalesce(F.sum("__px_t").over(before), F.lit(0))).drop("__px_t")
    inside = Window.partitionBy(*keys).orderBy(name["o"]).rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("__px_in", F.coalesce(F.sum(name["v"]).over(inside), F.lit(0)))
    on = [x[k].eqNullSafe(base[k]) for k in keys]
    joined = x.join(base, on, "inner").select(*[x[c] for c in df.columns], (x["__px_in"] + base[name["base"]]).alias(out))
    return joined
