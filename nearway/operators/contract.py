"""Shortest-path labels by way of chains.

Inner nodes of chains take no part in the search: seeds on a chain are carried to its ends, the search goes over a network
of chains' ends with an edge for each chain, and inner nodes are labelled afterwards from their chain's ends and from
seeds on it. Rounds thus follow the number of chains on a path and not that of edges.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearway.network import RoadNetwork
from nearway.operators.chains import degrees
from nearway.operators.relax import relax, steps_of
from nearway.skew import SLOT_ROWS, join_hot
from nearway.storage import Workspace


class Contracted:
    """A network's chains as single edges; chains: what chain_edges() returned, if it has been made before."""

    def __init__(self, network: RoadNetwork, chains: DataFrame | None = None, slot_rows: int | None = None):
        self.work = Workspace(network.edges.sparkSession, "contracted")
        self.slot_rows = SLOT_ROWS if slot_rows is None else slot_rows
        # without a node of two edges every edge is a chain, and the search goes over the network itself
        self.plain = self.work.write(steps_of(network.adjacency)) if chains is None and degrees(network).where("n_edges = 2").isEmpty() else None
        if self.plain is not None:
            return
        chains = network.chains if chains is None else chains
        e = chains.join(network.edges.select("edge_id", "start_node", "end_node"), "edge_id")
        tail, head = F.when(F.col("reversed"), F.col("end_node")).otherwise(F.col("start_node")), F.when(F.col("reversed"), F.col("start_node")).otherwise(F.col("end_node"))
        self.spots = self.work.write(e.select("chain_id", "pos", F.col("start_at").alias("at"), tail.alias("node"), head.alias("head"), (F.col("start_at") + F.col("length")).alias("total")))
        self.inner = self.spots.where("pos > 0").select("node", "chain_id", "pos", "at")

    @cached_property
    def ends(self) -> DataFrame:
        """chain_id, first, last, total and top: a row for each chain."""
        whole = self.spots.groupBy("chain_id").agg(F.min_by("node", "pos").alias("first"), F.max_by("head", "pos").alias("last"), F.max("total").alias("total"), (F.max("pos") + 1).alias("top"))
        return self.work.write(whole)

    @cached_property
    def adjacency(self) -> DataFrame:
        """src, dst, w, own: the shortest chain between two ends, in both directions, and a step from each end to itself."""
        way = lambda src, dst, w: F.struct(F.col(src).alias("src"), F.col(dst).alias("dst"), w.alias("w"))
        ways = [way("first", "last", F.col("total")), way("last", "first", F.col("total")), way("first", "first", F.lit(0.0)), way("last", "last", F.lit(0.0))]
        least = self.ends.select(F.explode(F.array(*ways)).alias("e")).groupBy("e.src", "e.dst").agg(F.min("e.w").alias("w"))
        return self.work.write(least.withColumn("own", F.col("src") == F.col("dst")))

    def labels(self, seeds: DataFrame, keys: tuple[str, ...] = (), within: float | None = None, delta: float | None = None) -> DataFrame:
        """As relax() over the network's own adjacency: keys, node, dist and obj."""
        if self.plain is not None:
            return relax(seeds, self.plain, keys, within, delta=delta)
        keys_ = list(keys)
        on_chain, start = self._carried(seeds, keys_)
        found = relax(start, self.adjacency, keys, within, delta=delta)  # a written table
        points = self._points(on_chain, found, self.ends, keys_)
        inner = self._inner(self.work.write(points), keys_)
        if within is not None:
            inner = inner.where(F.col("dist") <= within)
        return found.select(*keys_, "node", "dist", "obj").unionByName(self.work.write(inner))

    def relabelled(self, known: DataFrame, seeds: DataFrame) -> DataFrame:
        """As relax() over the network's own adjacency with `known`, labels of some nodes that seeds may better: node, dist and obj.

        Of known labels those of chains' ends take part in the search. Inner nodes are labelled anew on chains that have a
        seed on them or an end whose label is new, and keep what they have on all others.
        """
        known = known.select("node", F.col("dist").cast("double").alias("dist"), "obj")
        if self.plain is not None:
            return relax(seeds, self.plain, known=known)
        on_chain, start = self._carried(seeds, [])
        at_ends = self.work.write(known.join(self.adjacency.where("own").select(F.col("src").alias("node")), "node", "left_semi"))
        found = relax(start, self.adjacency, known=at_ends)
        fresh = found.join(at_ends, ["node", "dist", "obj"], "left_anti").select("node")
        touched = [on_chain.select("chain_id"), *[self.ends.join(fresh, F.col(c) == F.col("node"), "left_semi").select("chain_id") for c in ("first", "last")]]
        touched = self.work.write(touched[0].unionByName(touched[1]).unionByName(touched[2]).distinct())
        points = self._points(on_chain, found, self.ends.join(touched, "chain_id", "left_semi"), [])
        every = known.unionByName(found.select("node", "dist", "obj")).unionByName(self._inner(self.work.write(points), []))
        return self.work.write(every.groupBy("node").agg(F.min(F.struct("dist", "obj")).alias("b")).select("node", "b.*"))

    def _carried(self, seeds: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
        """Seeds at inner nodes with their places, and all seeds as the search begins with them: at ends of chains."""
        seeds = seeds.groupBy(*keys, "node").agg(F.min(F.struct("dist", "obj")).alias("b")).select(*keys, "node", "b.dist", "b.obj")
        on_chain = self.work.write(seeds.join(self.inner, "node"))
        carried = join_hot(on_chain, self.ends, ["chain_id"], "node")
        out = F.explode(F.array(F.struct(F.col("first").alias("node"), (F.col("dist") + F.col("at")).alias("dist")), F.struct(F.col("last").alias("node"), (F.col("dist") + F.col("total") - F.col("at")).alias("dist"))))
        start = seeds.join(self.inner.select("node"), "node", "left_anti").select(*keys, "node", "dist", "obj")
        return on_chain, start.unionByName(carried.select(*keys, out.alias("e"), "obj").select(*keys, "e.node", "e.dist", "obj"))

    @staticmethod
    def _points(on_chain: DataFrame, found: DataFrame, ends: DataFrame, keys: list[str]) -> DataFrame:
        """Chains' points with known labels: their ends, and seeds on them."""
        at_first = found.join(ends, F.col("node") == F.col("first")).select(*keys, "chain_id", F.lit(0).cast("long").alias("pos"), F.lit(0.0).alias("at"), "dist", "obj")
        at_last = found.join(ends, F.col("node") == F.col("last")).select(*keys, "chain_id", F.col("top").alias("pos"), F.col("total").alias("at"), "dist", "obj")
        return on_chain.select(*keys, "chain_id", "pos", "at", "dist", "obj").unionByName(at_first).unionByName(at_last)

    def _inner(self, points: DataFrame, keys: list[str]) -> DataFrame:
        """keys, node, dist and obj of every inner node, from the points before and after it on its chain."""
        slot = F.floor(F.col("pos") / self.slot_rows).cast("long").alias("slot")
        forth, back = F.struct((F.col("dist") - F.col("at")).alias("d"), "obj"), F.struct((F.col("dist") + F.col("at")).alias("d"), "obj")
        nothing = F.lit(None).cast("struct<d:double,obj:bigint>")
        known = points.select(*keys, "chain_id", slot, "pos", F.lit(None).cast("long").alias("node"), "at", forth.alias("f"), back.alias("b"))
        # every chain with a point is asked for by each key
        lines = points.select(*keys, "chain_id").distinct()
        asked = join_hot(self.inner, lines, ["chain_id"], "node").select(*keys, "chain_id", slot, "pos", "node", "at", nothing.alias("f"), nothing.alias("b"))
        own = Window.partitionBy(*keys, "chain_id", "slot").orderBy("pos")
        rows = known.unionByName(asked).withColumns({"l": F.min("f").over(own.rangeBetween(Window.unboundedPreceding, 0)), "r": F.min("b").over(own.rangeBetween(0, Window.unboundedFollowing))}).where("node is not null")
        lo, hi = F.col("l"), F.col("r")
        if (self.ends.agg(F.max("top")).first()[0] or 0) >= self.slot_rows:
            # a long chain's slots know of each other by a summary; slots without a point have a row as well
            each = asked.select(*keys, "chain_id", "slot").distinct().join(known.groupBy(*keys, "chain_id", "slot").agg(F.min("f").alias("f"), F.min("b").alias("b")), [*keys, "chain_id", "slot"], "full")
            along = Window.partitionBy(*keys, "chain_id").orderBy("slot")
            each = each.select(*keys, "chain_id", "slot", F.min("f").over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("lo"), F.min("b").over(along.rowsBetween(1, Window.unboundedFollowing)).alias("hi"))
            rows, lo, hi = rows.join(each, [*keys, "chain_id", "slot"]), F.least("l", "lo"), F.least("r", "hi")
        way = lambda s, d: F.when(s.isNotNull(), F.struct(d.alias("dist"), s["obj"].alias("obj")))
        best = F.least(way(lo, lo["d"] + F.col("at")), way(hi, hi["d"] - F.col("at")))
        return rows.select(*keys, "node", best.alias("best")).where("best is not null").select(*keys, "node", "best.dist", "best.obj")
