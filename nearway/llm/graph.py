"""Connected components: of any size on the executors, and what a task's own edges connect."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearway.llm.common import Workspace


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """node and component (the smallest node of its component) for every node of edges (a, b).

    Each round maps every node to the neighbour (or itself) of first rank, ranks being fixed at random anew, and merges
    the edges along that map, so a constant share of the nodes goes each round whatever the shape. A hub's edges are
    pre-aggregated before they meet, and every round is a written table. Nulls and loops don't count.
    """
    live = work.write(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = work.write(live.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("at", F.col("node")))
    turn = 0
    while not live.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("r"), F.col(c).alias("n"))  # noqa: B023, E731
        first = F.least(rank("a"), rank("b"))
        best = live.select(F.explode(F.array("a", "b")).alias("node"), first.alias("best")).groupBy("node").agg(F.min("best").alias("best"))
        step = work.write(best.select("node", F.col("best.n").alias("to")))
        a, b = step.select(F.col("node").alias("a"), F.col("to").alias("ta")), step.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        moved = live.join(a, "a").join(b, "b").where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct()
        # a node and the one it goes to are joined by an edge of live, so merged edges keep what is connected
        merged = work.write(moved)
        relabelled = work.write(labels.join(step.withColumnRenamed("node", "at"), "at", "left").select("node", F.coalesce("to", "at").alias("at")))
        for old in (live, labels, step):
            work.drop(old)
        live, labels, turn = merged, relabelled, turn + 1
    work.drop(live)
    least = labels.groupBy("at").agg(F.min("node").alias("component"))
    return labels.join(least, "at").select("node", "component")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, root) that connect what the edges (a, b) connect: one for each node at most."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        for end in (i, j):
            np.minimum.at(new, end, low)
            np.minimum.at(new, root[end], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    keep = root != np.arange(len(nodes))
    return nodes[keep], nodes[root[keep]]
