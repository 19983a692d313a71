"""Connected components of an edge table by contraction, without collecting anything to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp) for every node of ``edges(a, b)``: comp is the smallest node id of its component.

    Each round hooks every node to its smallest neighbour, halves the resulting chains until they are flat, and
    goes on with the edges between the roots. Roots at least halve per round, so rounds are logarithmic. Hot
    nodes only meet partial aggregation and joins of written tables, which adaptive execution can split.
    Self-loops and repeated edges are fine; an empty edge table gives an empty result.
    """
    live = scratch.table(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    if live.isEmpty():
        return live.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    while True:
        both = live.select("a", "b").union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = scratch.table(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")), "hook")
        while True:
            up = step.select(F.col("node").alias("comp"), F.col("comp").alias("root"))
            new = scratch.table(step.join(up, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp"), (F.coalesce("root", "comp") != F.col("comp")).alias("moved")), "jump")
            scratch.drop(step)
            step = new
            if step.where("moved").isEmpty():
                break
        step = step.drop("moved")
        if labels is None:
            labels = step
        else:
            up = step.select(F.col("node").alias("comp"), F.col("comp").alias("root"))
            labels = scratch.table(labels.join(up, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")), "labels")
        a, b = (step.select(F.col("node").alias(x), F.col("comp").alias(f"r{x}")) for x in "ab")
        live2 = live.join(a, "a").join(b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        live2 = scratch.table(live2, "edges")
        scratch.drop(live)
        live = live2
        if live.isEmpty():
            return labels
