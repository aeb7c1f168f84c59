"""Exact search by parts: inside each part in a task, and between parts over the overlay of their border nodes.

Going up, each part is searched from its own seeds to its border nodes. Border labels are exchanged over the overlay: cut
edges, and shortcuts inside parts between border nodes with no border node between them, which keeps them few. Going down,
each part is searched once more from its seeds and its border nodes' labels, which gives every node its label. A part's
edges are shuffled to its task twice, however long the paths are, and no more than a bound of them: larger parts are split.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearway.network import RoadNetwork
from nearway.operators.ann import expand
from nearway.operators.numbering import numbered
from nearway.operators.on_edge import nearest_on_edge
from nearway.operators.relax import relax, seeds_of, steps_of
from nearway.storage import Workspace

#: Edges inside a part, at most, that one task holds; values of the keys that it searches for at a time.
PART_EDGES, KEYS = 100_000, 64


class Local:
    """One part's nodes and inner edges as arrays: those of node i are first[i]:first[i + 1]."""

    def __init__(self, edges: pd.DataFrame, more: Iterable[int]):
        a, b, w = edges["a"].to_numpy(np.int64), edges["b"].to_numpy(np.int64), edges["w"].to_numpy(np.float64)
        self.nodes = np.unique(np.concatenate([a, b, np.asarray(list(more), np.int64)]))
        src, dst = np.searchsorted(self.nodes, np.concatenate([a, b])), np.searchsorted(self.nodes, np.concatenate([b, a]))
        order = np.argsort(src, kind="stable")
        self.first = np.searchsorted(src[order], np.arange(len(self.nodes) + 1)).tolist()
        self.dst, self.w = dst[order].tolist(), np.concatenate([w, w])[order].tolist()

    def at(self, nodes) -> list[int]:
        return np.searchsorted(self.nodes, np.asarray(nodes, np.int64)).tolist()

    def search(self, seeds: list[tuple[float, int, int]], most: float | None = None, stop: set[int] | None = None) -> dict[int, tuple[float, int]]:
        """place: (dist, obj), the least from seeds (dist, obj, place); no search goes on from `stop`, but for a seed."""
        heap, best = list(seeds), {}
        heapq.heapify(heap)
        starts = {i for _, _, i in seeds} if stop else ()
        while heap:
            d, o, i = heapq.heappop(heap)
            if i in best:
                continue
            if most is not None and d > most:
                break
            best[i] = (d, o)
            if stop and i in stop and i not in starts:
                continue
            for k in range(self.first[i], self.first[i + 1]):
                if self.dst[k] not in best:
                    heapq.heappush(heap, (d + self.w[k], o, self.dst[k]))
        return best

    def nearest(self, ends: list[tuple[float, int]], rest: dict[int, tuple[float, int]], most: float | None) -> tuple[dict[int, float], tuple[float, int] | None]:
        """Places with their distance from one query, as far as the nearest that it finds, and that; rest: what is nearest from a place."""
        heap, seen, best = list(ends), {}, None
        heapq.heapify(heap)
        while heap:
            d, i = heapq.heappop(heap)
            if i in seen or most is not None and d > most:
                continue
            seen[i] = d
            if i in rest:
                found = (d + rest[i][0], rest[i][1])
                best = found if best is None else min(best, found)
                most = best[0] if most is None else min(most, best[0])
            for k in range(self.first[i], self.first[i + 1]):
                if self.dst[k] not in seen:
                    heapq.heappush(heap, (d + self.w[k], self.dst[k]))
        return seen, best


def bounded_parts(network: RoadNetwork, parts: DataFrame | None, most: int, work: Workspace) -> DataFrame:
    """node_id, part_id (long) of every node, no part with more than `most` inner edges: larger ones are cut by node number.

    Without parts, all nodes are one, and so cut into blocks of numbers.
    """
    nodes = network.nodes.select("node_id")
    given = nodes.withColumn("part_id", F.lit(0)) if parts is None else nodes.join(parts.select("node_id", "part_id"), "node_id", "left")
    made = work.write(given.select("node_id", F.coalesce(F.col("part_id").cast("long"), F.lit(-1).cast("long")).alias("part_id")))
    while True:
        over = _inner(network, made).groupBy("part_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
        over = work.write(over.select("part_id", F.ceil(2 * F.col("n") / most).cast("long").alias("pieces")))
        if over.isEmpty():
            return made
        # blocks of the numbers of a part's nodes, in order; each has an id of its own
        ranked = numbered(made.join(over, "part_id"), ["part_id", "node_id"], "nth")
        sizes = ranked.groupBy("part_id").agg(F.min("nth").alias("low"), F.count(F.lit(1)).alias("size"))
        block = F.floor((F.col("nth") - F.col("low")) * F.col("pieces") / F.col("size"))
        cut = ranked.join(sizes, "part_id").select("node_id", F.xxhash64("part_id", block).alias("part_id"))
        made = work.write(made.join(over, "part_id", "left_anti").unionByName(cut))


def _inner(network: RoadNetwork, parts: DataFrame) -> DataFrame:
    """part_id, a, b, w: the shortest edge between any two nodes of one part."""
    ends = _placed(network, parts).where("start_part = end_part")
    return ends.groupBy(F.col("start_part").alias("part_id"), "a", "b").agg(F.min("w").alias("w"))


def _placed(network: RoadNetwork, parts: DataFrame) -> DataFrame:
    p, q = parts.select(F.col("node_id").alias("a"), F.col("part_id").alias("start_part")), parts.select(F.col("node_id").alias("b"), F.col("part_id").alias("end_part"))
    edges = network.edges.select(F.least("start_node", "end_node").alias("a"), F.greatest("start_node", "end_node").alias("b"), F.col("length").cast("double").alias("w"))
    return edges.join(p, "a").join(q, "b")


class Parted:
    """A network cut into parts that one task each can search."""

    def __init__(self, network: RoadNetwork, parts: DataFrame | None = None, most: int | None = None):
        self.network, self.work = network, Workspace(network.edges.sparkSession, "parted", lean=True)
        self.parts = bounded_parts(network, parts, PART_EDGES if most is None else most, self.work)
        self.inner = self.work.write(_inner(network, self.parts))
        cut = _placed(network, self.parts).where("start_part <> end_part")
        self.cut = self.work.write(cut.select("a", "b", "w", "start_part", "end_part"))
        ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("start_part").alias("part_id")), F.struct(F.col("b").alias("node"), F.col("end_part").alias("part_id"))))
        self.border = self.work.write(self.cut.select(ends.alias("e")).select("e.node", "e.part_id").distinct())

    @cached_property
    def overlay(self) -> DataFrame:
        """src, dst, w, own of border nodes, see steps_of()."""

        def shortcuts(edges: pd.DataFrame, border: pd.DataFrame) -> pd.DataFrame:
            net = Local(edges, border.node)
            places = net.at(border.node)
            stop, out = set(places), []
            for i in places:
                out += [(i, j, d) for j, (d, _) in net.search([(0.0, 0, i)], stop=stop).items() if j in stop and j != i]
            made = np.array(out, dtype=[("i", "i8"), ("j", "i8"), ("w", "f8")])
            return pd.DataFrame({"src": net.nodes[made["i"]], "dst": net.nodes[made["j"]], "w": made["w"]})

        inside = self.inner.groupBy("part_id").cogroup(self.border.groupBy("part_id")).applyInPandas(shortcuts, "src long, dst long, w double")
        both = F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), "w"), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"), "w")))
        return self.work.write(steps_of(self.cut.select(both.alias("e")).select("e.src", "e.dst", "e.w").unionByName(self.work.write(inside))))

    def _by_part(self, rows: DataFrame, keys: tuple[str, ...], search, schema: str) -> DataFrame:
        """search(local network, rows of a part and of some values of the keys), for each part that has rows."""
        slices = 1
        if keys:
            slices = max(1, -(-rows.select(*keys).distinct().count() // KEYS))
        dealt = rows.withColumn("slice", F.pmod(F.xxhash64(*keys), F.lit(slices)) if keys else F.lit(0).cast("long"))
        lines = self.inner.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))

        def run(edges: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
            return search(Local(edges, part.node) if len(part) else None, part)

        return lines.groupBy("part_id", "slice").cogroup(dealt.groupBy("part_id", "slice")).applyInPandas(run, schema)

    def labels(self, seeds: DataFrame, keys: tuple[str, ...] = (), within: float | None = None) -> DataFrame:
        """As relax() over the whole network's adjacency: keys, node, dist and obj."""
        names = [*keys, "node"]
        kinds = "".join(f"{k} {seeds.schema[k].dataType.simpleString()}, " for k in keys)
        least = seeds.groupBy(*names).agg(F.min(F.struct(F.col("dist").cast("double").alias("dist"), "obj")).alias("b")).select(*names, "b.*")
        placed = self.work.write(least.join(self.parts.withColumnRenamed("node_id", "node"), "node"))
        up = self._searched(placed, keys, within, kinds)
        border = self.work.write(up.join(self.border.select("node"), "node", "left_semi"))
        exchanged = relax(border, self.overlay, keys, within)
        down = placed.unionByName(exchanged.join(self.border, "node").select(*placed.columns))
        return self.work.write(self._searched(down, keys, within, kinds))

    def _searched(self, rows: DataFrame, keys: tuple[str, ...], within: float | None, kinds: str) -> DataFrame:
        def search(net: Local | None, part: pd.DataFrame) -> pd.DataFrame:
            made = []
            for key, own in part.groupby(list(keys)) if keys else [((), part)] if len(part) else []:
                best = net.search(list(zip(own.dist.tolist(), own.obj.tolist(), net.at(own.node), strict=True)), within)
                d, o = zip(*best.values(), strict=True) if best else ((), ())
                made.append(pd.DataFrame({**dict(zip(keys, key, strict=True)), "node": net.nodes[list(best)], "dist": d, "obj": o}))
            return pd.concat(made) if made else pd.DataFrame({c: [] for c in [*keys, "node", "dist", "obj"]})

        return self._by_part(rows, keys, search, f"{kinds}node long, dist double, obj long")


def expanded_by_parts(parted: Parted, marked: DataFrame) -> DataFrame:
    """q, dist, obj: an expansion from each asking object, inside its part in a task and then over the overlay.

    What is nearest to a border node inside its part is told once; an expansion goes no further than its nearest so far.
    """
    work, network = Workspace(marked.sparkSession, "by-parts", lean=True), parted.network
    asking, answering = marked.where("asks"), marked.where("not asks")
    places = parted.parts.withColumnRenamed("node_id", "node")
    own = work.write(nearest_on_edge(marked))
    known = own.select("q", F.col("dist").alias("most"))
    rows = seeds_of(network, asking).withColumnRenamed("obj", "q").join(known, "q", "left").select("node", "dist", "q", F.lit(None).cast("long").alias("obj"), "most")
    data = seeds_of(network, answering).groupBy("node").agg(F.min(F.struct("dist", "obj")).alias("b")).select("node", "b.dist", F.lit(None).cast("long").alias("q"), "b.obj", F.lit(None).cast("double").alias("most"))
    marks = parted.border.select("node", F.lit(None).cast("double").alias("dist"), F.lit(None).cast("long").alias("q"), F.lit(None).cast("long").alias("obj"), F.lit(None).cast("double").alias("most"))
    both = rows.unionByName(data).unionByName(marks).join(places, "node")

    def search(net: Local | None, part: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"q": [], "node": [], "dist": [], "obj": []}

        def add(q, node, dist, obj):
            for k, v in zip(out, (q, node, dist, obj), strict=True):
                out[k].append(v)

        if len(part):
            data, asks = part[part.obj.notna()], part[part.q.notna()]
            borders = set(net.at(part.node[part.obj.isna() & part.q.isna()]))
            rest = dict(zip(net.at(data.node), zip(data.dist.tolist(), data.obj.astype("int64").tolist(), strict=True), strict=True))
            # entries: what is nearest inside the part from each border node
            inside = net.search([(d, o, i) for i, (d, o) in rest.items()])
            for i in borders & inside.keys():
                add(None, net.nodes[i], *inside[i])
            for q, ends in asks.groupby("q"):
                most = ends.most.iloc[0]
                seen, best = net.nearest(list(zip(ends.dist.tolist(), net.at(ends.node), strict=True)), rest, None if pd.isna(most) else most)
                if best:
                    add(int(q), None, *best)
                for i in borders & seen.keys():
                    if not best or seen[i] <= best[0]:
                        add(int(q), net.nodes[i], seen[i], None)
        return pd.DataFrame({k: pd.array(v, "Float64" if k == "dist" else "Int64") for k, v in out.items()})

    made = work.write(parted._by_part(both, (), search, "q long, node long, dist double, obj long"))
    entry = work.write(made.where("q is null").select("node", F.col("dist").alias("rest"), F.col("obj").alias("found")))
    inside = work.write(made.where("node is null").select("q", "dist", "obj").unionByName(own))
    starts = made.where("obj is null").select("q", "node", "dist", F.lit(0).cast("long").alias("obj"))
    return expand(starts, parted.overlay, entry, inside)
