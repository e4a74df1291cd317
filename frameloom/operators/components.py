"""Strongly connected sets of tables of edges: trimming, then forward colours and backward reach from each colour's root."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import discard, materialize


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each end of edges (i, j); component is the smallest node of its strongly connected set.

    Nodes that nothing leaves or enters are sets of their own and are trimmed, again and again. Every other node takes the
    smallest node that reaches it as its colour; a node that is its own colour is a root, and those of its colour that
    reach it are its set. Sets are taken out, until no edge is left. Tables of edges and nodes only; a step is a join and
    an aggregate, and there are as many steps as the longest of the shortest paths in a set.
    """
    both = edges.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"))
    nodes = materialize(both.select(F.col("i").alias("node")).union(both.select("j")).distinct(), "nodes")
    live = materialize(both.where("i <> j").distinct(), "edges")
    found = None
    while not live.isEmpty():
        live = _trimmed(live)
        if live.isEmpty():
            break
        colours = _colours(live)
        inside = live.join(colours.select(F.col("node").alias("i"), F.col("colour").alias("ci")), "i").join(colours.select(F.col("node").alias("j"), F.col("colour").alias("cj")), "j")
        inside = materialize(inside.where("ci = cj").select("i", "j"), "inside")  # a set lies within a colour
        reached = materialize(colours.where("node = colour"), "reached")
        new = reached
        while True:
            up = inside.join(new.select(F.col("node").alias("j"), "colour"), "j").select(F.col("i").alias("node"), "colour").distinct()
            new = materialize(up.join(reached, "node", "left_anti"), "reach")
            if new.isEmpty():
                break
            reached = materialize(reached.unionByName(new), "reached")
        found = reached if found is None else found.unionByName(reached)
        gone = reached.select("node")
        rest = live.join(gone, live.i == gone.node, "left_anti")
        before, live = live, materialize(rest.join(gone, rest.j == gone.node, "left_anti"), "edges")
        discard(before, inside)
    if found is None:
        return nodes.select("node", F.col("node").alias("component"))
    return nodes.join(found, "node", "left").select("node", F.coalesce("colour", "node").alias("component"))


def _trimmed(live: DataFrame) -> DataFrame:
    n = live.count()
    while n:
        kept = live.join(live.select(F.col("j").alias("i")).distinct(), "i", "left_semi").join(live.select(F.col("i").alias("j")).distinct(), "j", "left_semi")
        before, live = live, materialize(kept.select("i", "j"), "edges")
        m = live.count()
        discard(before)
        if m == n:
            return live
        n = m
    return live


def _colours(live: DataFrame) -> DataFrame:
    """(node, colour): the smallest node that reaches each."""
    colours = materialize(live.select(F.col("i").alias("node")).distinct().withColumn("colour", F.col("node")), "colours")
    while True:
        come = live.join(colours.select(F.col("node").alias("i"), "colour"), "i").groupBy(F.col("j").alias("node")).agg(F.min("colour").alias("least"))
        new = colours.join(come, "node", "left").select("node", F.least("colour", "least").alias("colour"), (F.col("least") < F.col("colour")).alias("moved"))
        before, new = colours, materialize(new, "colours")
        done = new.where("moved").isEmpty()
        colours = new.drop("moved")
        colours._scratch = new._scratch
        discard(before)
        if done:
            return colours


def largest(counts: DataFrame) -> DataFrame:
    """counts (i, j, c) within the largest strongly connected set: by states, then by counts, then the smallest state."""
    sets = materialize(strong_components(counts.select("i", "j")), "sets")
    tagged = counts.join(sets.select(F.col("node").alias("i"), F.col("component").alias("ci")), "i").join(sets.select(F.col("node").alias("j"), F.col("component").alias("cj")), "j").where("ci = cj")
    sizes = sets.groupBy("component").agg(F.count("*").alias("n"))
    held = tagged.groupBy(F.col("ci").alias("component")).agg(F.sum("c").alias("total"))
    top = sizes.join(held, "component", "left").orderBy(F.desc("n"), F.desc(F.coalesce("total", F.lit(0))), "component").limit(1)
    return tagged.join(F.broadcast(top.select(F.col("component").alias("ci"))), "ci").select("i", "j", "c")
