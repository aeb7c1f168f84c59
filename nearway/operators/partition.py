"""Balanced partitions of a network's nodes with few cut edges, by coarsening, growth and refinement.

Coarsening goes in rounds, each a few joins: by a coin of the round half of the clusters ask, each its strongest neighbour
of the other half, and are taken in while the asked one's weight allows. What is left after the rounds is a graph of a
bounded number of clusters; regions are grown on it from seeds far apart, and its border is refined by gains. Back on the nodes
some rounds move border nodes where that cuts fewer edges and room is left.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearway.network import RoadNetwork
from nearway.storage import Workspace

#: Clusters that coarsening leaves, at most, unless it stands still; rounds of refinement on nodes.
COARSE, REFINE = 4_096, 3


def balanced_parts(network: RoadNetwork, parts: int, balance: float = 0.03, coarse: int | None = None, seed: int = 1) -> DataFrame:
    """node_id, part_id (from 0): each node once, no part over (1 + balance) times the mean where nodes allow.

    No cluster has more than a twenty-fifth of a part's nodes (two at least). The graph that one task grows has no more
    than twice `coarse` clusters, or 200 for each part if that is more; an error says if a network can't be coarsened so far.
    """
    work = Workspace(network.edges.sparkSession, "partition", lean=True)
    coarse = max(COARSE if coarse is None else coarse, 100 * parts)
    ends = network.edges.select(F.least("start_node", "end_node").alias("a"), F.greatest("start_node", "end_node").alias("b")).where("a <> b")
    fine = edges = work.write(ends.groupBy("a", "b").agg(F.count(F.lit(1)).alias("w")))
    members = work.write(network.nodes.select("node_id", F.col("node_id").alias("cluster")))
    n = members.count()
    cap = max(2, -(-4 * n // coarse))
    clusters, turn, still = n, seed, 0
    while clusters > coarse and still < 6:
        step = work.write(_taken_in(edges, members, cap, turn))
        members, old = work.write(members.join(step, "cluster", "left").select("node_id", F.coalesce("to", "cluster").alias("cluster"))), members
        edges = work.write(_merged(edges, step))
        work.drop(old, step)
        before, clusters, turn = clusters, members.agg(F.countDistinct("cluster")).first()[0], turn + 1
        still = still + 1 if clusters > 0.97 * before else 0
    if clusters > 2 * coarse:
        # clusters without an edge, or whose neighbours are full: those of like hash are dealt together
        few = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
        group = F.pmod(F.xxhash64("cluster"), F.lit(coarse))
        lone = few.join(edges.select(F.explode(F.array("a", "b")).alias("cluster")).distinct(), "cluster", "left_anti")
        step = work.write(lone.withColumn("group", group).withColumn("to", F.min("cluster").over(Window.partitionBy("group"))).select("cluster", "to"))
        members = work.write(members.join(step, "cluster", "left").select("node_id", F.coalesce("to", "cluster").alias("cluster")))
        clusters = members.agg(F.countDistinct("cluster")).first()[0]
        if clusters > 2 * coarse:
            raise ValueError(f"coarsening left {clusters} clusters of {n} nodes; more than {2 * coarse} aren't grown in one task")
    weights = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    rows = weights.select(F.col("cluster").alias("a"), F.lit(None).cast("long").alias("b"), F.col("n").alias("w"))
    rows = rows.unionByName(edges.select("a", "b", "w")).withColumn("one", F.lit(0))

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        nodes, ties = part[part.b.isna()], part[part.b.notna()]
        label = grown(nodes.a.to_numpy(np.int64), nodes.w.to_numpy(np.int64), ties.a.to_numpy(np.int64), ties.b.to_numpy(np.int64), ties.w.to_numpy(np.int64), parts, balance)
        return pd.DataFrame({"cluster": nodes.a, "part_id": label})

    label = work.write(rows.groupBy("one").applyInPandas(grow, "cluster long, part_id int"))
    found = work.write(members.join(label, "cluster").select("node_id", "part_id"))
    for k in range(REFINE):
        found, old = work.write(_refined(found, fine, parts, n, balance, upwards=k % 2 == 0)), found
        work.drop(old)
    return found


def _taken_in(edges: DataFrame, members: DataFrame, cap: int, turn: int) -> DataFrame:
    """cluster, to: clusters that go into another one, which stays."""
    asks = lambda c: F.pmod(F.xxhash64(F.lit(turn), c), F.lit(2)) == 0
    weight = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("cluster"), F.col("b").alias("to")), F.struct(F.col("b").alias("cluster"), F.col("a").alias("to")))).alias("e"), "w").select("e.*", "w")
    both = both.where(asks("cluster") & ~asks("to")).join(weight, "cluster").join(weight.select(F.col("cluster").alias("to"), F.col("n").alias("n_to")), "to").where(F.col("n") + F.col("n_to") <= cap)
    # the strongest tie for its weights, so that light clusters are taken in first
    rank = F.struct((F.col("w") / (F.col("n") * F.col("n_to"))).alias("r"), F.xxhash64("cluster", "to").alias("h"), "to", "n", "n_to")
    best = both.groupBy("cluster").agg(F.max(rank).alias("b")).select("cluster", "b.*")
    order = Window.partitionBy("to").orderBy(F.desc("r"), "h").rowsBetween(Window.unboundedPreceding, 0)
    return best.withColumn("sum", F.sum("n").over(order)).where(F.col("sum") + F.col("n_to") <= cap).select("cluster", "to")


def _merged(edges: DataFrame, step: DataFrame) -> DataFrame:
    moved = edges
    for c in ("a", "b"):
        moved = moved.join(step.select(F.col("cluster").alias(c), F.col("to").alias(f"to_{c}")), c, "left").withColumn(c, F.coalesce(f"to_{c}", c)).drop(f"to_{c}")
    return moved.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("w").alias("w"))


def grown(nodes: np.ndarray, weight: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, parts: int, balance: float, tries: int = 8) -> np.ndarray:
    """A part for each node: the least cut of some tries, each from other seeds."""
    order = np.argsort(nodes, kind="stable")
    at = lambda x: order[np.searchsorted(nodes[order], x)]
    i, j = at(a), at(b)
    ties: list[list[tuple[int, int]]] = [[] for _ in nodes]
    for x, y, s in zip(i.tolist(), j.tolist(), w.tolist(), strict=True):
        ties[x].append((y, s))
        ties[y].append((x, s))
    weight, best = weight.tolist(), None
    for k in range(tries):
        label = _gains(_grow(ties, weight, parts, len(nodes) * k // tries), ties, weight, parts, balance)
        cut = int(w[label[i] != label[j]].sum())
        if best is None or cut < best[0]:
            best = cut, label
    return best[1]


def _grow(ties: list[list[tuple[int, int]]], weight: list[int], parts: int, start: int) -> np.ndarray:
    """Regions from seeds far apart: the lightest takes next what ties it most to itself and least to the rest."""
    n = len(ties)
    label, size = np.full(n, -1), [0] * parts
    heaps: list[list[tuple[int, int, int]]] = [[] for _ in range(parts)]
    inside: list[dict[int, int]] = [{} for _ in range(parts)]
    met = 0  # of equal ties the one met first, which keeps regions round
    whole = [sum(s for _, s in t) for t in ties]
    for p, s in enumerate(_seeds(ties, parts, start)):
        heapq.heappush(heaps[p], (0, 0, s))
    free = sorted(range(n), key=lambda i: (weight[i], i))  # the heaviest last
    while True:
        while free and label[free[-1]] >= 0:
            free.pop()
        if not free:
            return label
        p = size.index(min(size))
        while heaps[p] and label[heaps[p][0][2]] >= 0:
            heapq.heappop(heaps[p])
        i = heapq.heappop(heaps[p])[2] if heaps[p] else free.pop()
        label[i] = p
        size[p] += weight[i]
        for j, s in ties[i]:
            if label[j] < 0:
                inside[p][j] = inside[p].get(j, 0) + s
                met += 1
                heapq.heappush(heaps[p], (whole[j] - 2 * inside[p][j], met, j))


def _gains(label: np.ndarray, ties: list[list[tuple[int, int]]], weight: list[int], parts: int, balance: float, passes: int = 12) -> np.ndarray:
    """Nodes go to the part with most of their ties, or as many if that is lighter, while it has room."""
    most = sum(weight) / parts * (1 + balance / 2)
    size = np.bincount(label, weight, minlength=parts).tolist()
    label = label.tolist()
    for _ in range(passes):
        moved = 0
        for i, t in enumerate(ties):
            own, near = label[i], {}
            for j, s in t:
                near[label[j]] = near.get(label[j], 0) + s
            fits = [(g - near.get(own, 0), -size[p], p) for p, g in near.items() if p != own and size[p] + weight[i] <= most]
            gain, _, p = max(fits, default=(-1, 0, own))
            if gain > 0 or gain == 0 and size[own] > size[p] + weight[i]:
                label[i] = p
                size[own], size[p] = size[own] - weight[i], size[p] + weight[i]
                moved += 1
        if not moved:
            break
    return np.array(label)


def _seeds(ties: list[list[tuple[int, int]]], parts: int, start: int) -> list[int]:
    """One node for each part (while there are so many), each as far from those before as it can be, by ties."""
    n = len(ties)
    far, out, at = np.full(n, np.iinfo(np.int64).max), [], start
    for _ in range(min(parts, n)):
        out.append(int(at))
        ring, d = [at], 0
        far[at] = 0
        while ring:
            d, nxt = d + 1, []
            for i in ring:
                for j, _ in ties[i]:
                    if far[j] > d:
                        far[j] = d
                        nxt.append(j)
            ring = nxt
        at = int(np.argmax(far))
    return out


def _refined(found: DataFrame, edges: DataFrame, parts: int, n: int, balance: float, upwards: bool) -> DataFrame:
    """Border nodes go to the part where most of their ties are, one way between parts, while that has room.

    Where more would come than there is room for, as many do by their hash as are expected to fit.
    """
    p = found.select(F.col("node_id").alias("a"), F.col("part_id").alias("pa")), found.select(F.col("node_id").alias("b"), F.col("part_id").alias("pb"))
    ties = edges.join(p[0], "a").join(p[1], "b")
    seen = ties.select(F.explode(F.array(F.struct(F.col("a").alias("node_id"), F.col("pa").alias("own"), F.col("pb").alias("part")), F.struct(F.col("b").alias("node_id"), F.col("pb").alias("own"), F.col("pa").alias("part")))).alias("e"), "w")
    by_part = seen.groupBy("e.node_id", "e.own", "e.part").agg(F.sum("w").alias("w"))
    one = by_part.groupBy("node_id", "own").agg(F.sum(F.when(F.col("part") == F.col("own"), F.col("w")).otherwise(0)).alias("stay"), F.max(F.when(F.col("part") != F.col("own"), F.struct("w", "part"))).alias("go"))
    way = F.col("go.part") > F.col("own") if upwards else F.col("go.part") < F.col("own")
    movers = one.where((F.col("go.w") > F.col("stay")) & way).select("node_id", F.col("go.part").alias("to"))
    # a row for each part
    room = found.groupBy(F.col("part_id").alias("to")).agg((F.lit(n / parts * (1 + balance)) - F.count(F.lit(1))).alias("room"))
    share = movers.groupBy("to").agg(F.count(F.lit(1)).alias("k")).join(room, "to").select("to", F.greatest(F.col("room") / F.col("k"), F.lit(0.0)).alias("share"))
    luck = F.pmod(F.xxhash64("node_id", F.lit(7)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    going = movers.join(share, "to").where((F.col("share") >= 1) | (luck < F.col("share") * 0.9)).select("node_id", "to")
    return found.join(going, "node_id", "left").select("node_id", F.coalesce("to", "part_id").cast("int").alias("part_id"))
