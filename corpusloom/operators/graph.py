"""Spanning forests and connected components by minimum-edge contraction, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import load_version, materialize, save_version


def _flatten(parent: DataFrame) -> DataFrame:
    """(node, root) of a forest of (node, root) pointers, by pointer doubling."""
    last = None
    while True:
        up = parent.select(F.col("node").alias("root"), F.col("root").alias("above"))
        last = parent = materialize(parent.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), (F.coalesce("above", "root") != F.col("root")).alias("moved")), "jump", last)
        if parent.where("moved").isEmpty():
            return parent.drop("moved")
        parent = parent.drop("moved")


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(forest (u, v), contractions) of undirected ``edges (u, v)`` by Borůvka's rounds.

    In each round every component takes its least edge (edges are ordered by a hash and their ends, so no two
    tie), the chosen edges join the forest, and the trees they form are contracted to one root by pointer
    doubling. Components at least halve per round, so there are at most log2(nodes) rounds. Each contraction
    (node, root) maps the roots of the round before to their new root; all are persisted. Self-loops, nulls and
    repeated edges are ignored.
    """
    e = edges.select("u", "v").where("u is not null and v is not null and u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    live = materialize(e.select(F.struct(F.xxhash64("u", "v").alias("w"), "u", "v").alias("edge"), F.col("u").alias("a"), F.col("v").alias("b")), "edges")
    forest, rounds = live.where("false").select("edge.u", "edge.v"), []
    while not live.isEmpty():
        ends = live.select("a", "b", "edge").unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b"), "edge"))
        hook = materialize(ends.groupBy("a").agg(F.min(F.struct("edge", "b")).alias("m")).select(F.col("a").alias("node"), F.col("m.b").alias("root"), "m.edge"), "hook")
        back = hook.select(F.col("node").alias("root"), F.col("root").alias("back"))
        tree = hook.select("node", "root").join(back, "root").select("node", F.when((F.col("back") == F.col("node")) & (F.col("node") < F.col("root")), F.col("node")).otherwise(F.col("root")).alias("root"))
        forest = forest.unionByName(hook.select("edge.u", "edge.v").distinct())
        rounds.append(_flatten(tree))
        up = rounds[-1]
        a = live.join(up.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(up.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b").where("ra <> rb")
        live = materialize(a.groupBy(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).agg(F.min("edge").alias("edge")), "edges")
    return forest, rounds


def component_roots(edges: DataFrame, path: str | None = None) -> DataFrame:
    """(node, root): the component of every node that an edge names; the root is one of its nodes.

    With a ``path`` the spanning forest is kept there: the edges of the forest kept last count beside ``edges``,
    and the forest of both becomes the next version. A delivery of new edges so joins the components of all
    earlier ones without reading their edges again.
    """
    if path:
        kept = load_version(edges.sparkSession, path, ["forest"])
        edges = edges.select("u", "v").unionByName(kept["forest"].select("u", "v")) if kept else edges
    forest, rounds = spanning_forest(edges)
    if path:
        save_version({"forest": forest}, path)
    if not rounds:
        return edges.select(F.col("u").alias("node"), F.col("u").alias("root")).where("node is not null").distinct()
    nodes = rounds[0]
    for up in rounds[1:]:
        step = up.select(F.col("node").alias("root"), F.col("root").alias("above"))
        nodes = nodes.join(step, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
    own = edges.where("u = v").select(F.col("u").alias("node")).distinct().join(nodes, "node", "left_anti")
    return materialize(nodes.unionByName(own.select("node", F.col("node").alias("root"))), "components")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): components labelled by their least node."""
    roots = component_roots(edges)
    least = roots.groupBy("root").agg(F.min("node").alias("component"))
    return roots.join(least, "root").select("node", "component")
