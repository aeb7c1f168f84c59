"""Objects along their own edge: nearest of the other type, ranks, ends and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearway.network import RoadNetwork
from nearway.skew import SLOT_ROWS, in_order


def nearest_on_edge(marked: DataFrame, slot_rows: int = SLOT_ROWS, digits: int | None = None) -> DataFrame:
    """q, dist, obj: for each object that asks the nearest one on its edge that doesn't, ties to the smaller id.

    A backward and a forward as-of join in one sort: an edge's objects are cut into slots by offset, so that no edge
    is one task's; what a slot doesn't know of its neighbours comes from a summary with a row for each slot. marked
    are objects with their edge's length and whether each asks. digits: distances are rounded to so many, for offsets
    that are sums, of which equal ones may differ in the last place.
    """
    rows = marked.select("edge_id", F.col("dist_from_start").alias("off"), F.col("obj_id").alias("id"), "length", "asks")
    counts = rows.groupBy("edge_id").agg(F.ceil(F.count(F.lit(1)) / slot_rows).cast("long").alias("slots"))
    rows = rows.join(counts, "edge_id").withColumn("slot", F.least(F.floor(F.col("off") / F.col("length") * F.col("slots")), F.col("slots") - 1))
    # a place sorts by offset; of equal offsets the least id is wanted, once another one if it is the asker's own
    here = F.when(~F.col("asks"), F.struct("off", F.col("id").alias("i")))
    left = F.when(~F.col("asks"), F.struct("off", (-F.col("id")).alias("i")))
    summary = rows.groupBy("edge_id", "slot").agg(F.max(left).alias("last"), F.min(here).alias("first"))
    wide = Window.partitionBy("edge_id").orderBy("slot")
    summary = summary.select("edge_id", "slot", F.max("last").over(wide.rowsBetween(Window.unboundedPreceding, -1)).alias("b"), F.min("first").over(wide.rowsBetween(1, Window.unboundedFollowing)).alias("a"))
    inside = Window.partitionBy("edge_id", "slot").orderBy("off")
    before, after = inside.rangeBetween(Window.unboundedPreceding, 0), inside.rangeBetween(0, Window.unboundedFollowing)
    near = rows.select("*", F.max(left).over(before).alias("l"), F.min(here).over(after).alias("r")).where("asks")
    near = near.join(summary, ["edge_id", "slot"])
    way = lambda d: d if digits is None else F.round(d, digits)
    gap = lambda s, i: F.when(s.isNotNull(), F.struct(way(F.abs(F.col("off") - s["off"])).alias("dist"), i.alias("obj")))
    lo, hi = F.greatest("l", "b"), F.least("r", "a")
    best = F.least(gap(lo, -lo["i"]), gap(hi, hi["i"]))
    return near.select(F.col("id").alias("q"), best.alias("best")).where("best is not null").select("q", "best.dist", "best.obj")


def nearest_other_on_edge(objects: DataFrame, slot_rows: int | None = None) -> DataFrame:
    """q, dist, obj: the nearest other object of any type on the same edge, ties to the smaller id."""
    off, place = F.col("dist_from_start"), F.struct("dist_from_start", "obj_id")
    rows = objects.select("edge_id", "dist_from_start", "obj_id")
    # of the objects at the place before the least id is wanted, so what counts is that place's first object
    here = rows.groupBy("edge_id", "dist_from_start").agg(F.count(F.lit(1)).alias("k"), F.min("obj_id").alias("least"))
    places = in_order(here, "edge_id", "dist_from_start", ["dist_from_start"], F.struct("dist_from_start", F.col("least").alias("obj_id")), slot_rows=slot_rows)
    found = rows.join(places.select("edge_id", "dist_from_start", "k", "least", "before", "after"), ["edge_id", "dist_from_start"])
    gap = lambda s: F.when(s.isNotNull(), F.struct(F.abs(off - s["dist_from_start"]).alias("dist"), s["obj_id"].alias("obj")))
    first = F.when(F.col("obj_id") != F.col("least"), F.struct(F.lit(0.0).alias("dist"), F.col("least").alias("obj")))
    # the least object of a place with several is nearest to the next one by id
    second = in_order(rows.join(here.where("k > 1").select("edge_id", "dist_from_start"), ["edge_id", "dist_from_start"]), "edge_id", "dist_from_start", ["dist_from_start", "obj_id"], place, slot_rows=slot_rows)
    second = second.where(F.col("after.dist_from_start") == off).select(F.col("obj_id").alias("s_obj"), F.struct(F.lit(0.0).alias("dist"), F.col("after.obj_id").alias("obj")).alias("next"))
    found = found.join(second, F.col("obj_id") == F.col("s_obj"), "left").withColumn("best", F.coalesce(first, "next", F.least(gap(F.col("before")), gap(F.col("after")))))
    return found.select(F.col("obj_id").alias("q"), "best").where("best is not null").select("q", "best.dist", "best.obj")


def ranked_objects(network: RoadNetwork, by: str = "dist_from_start", descending: bool = False, slot_rows: int | None = None) -> DataFrame:
    """Objects with their rank on their edge by offset, id or rating, nulls last; ties to the smaller id."""
    order = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last()
    known = network.objects.where(F.col(by).isNotNull())
    ranked = in_order(known, "edge_id", by, [order, "obj_id"], F.lit(0), descending, slot_rows).withColumn("rank_on_edge", F.col("nth").cast("int")).select(*network.objects.columns, "rank_on_edge")
    # those without a value follow in the order of their ids
    others = in_order(network.objects.where(F.col(by).isNull()), "edge_id", "obj_id", ["obj_id"], F.lit(0), slot_rows=slot_rows)
    others = others.join(known.groupBy("edge_id").agg(F.count(F.lit(1)).alias("_known")), "edge_id", "left").withColumn("rank_on_edge", (F.col("nth") + F.coalesce("_known", F.lit(0))).cast("int"))
    return ranked.unionByName(others.select(*network.objects.columns, "rank_on_edge"))


def _typed(kind: bool | None) -> Column:
    return F.lit(True) if kind is None else F.col("is_query") == kind


def ends_on_edge(network: RoadNetwork, kind: bool | None = None) -> DataFrame:
    """edge_id with the object nearest to and farthest from the start node, of one type or all, ties to the smaller id."""
    own = network.objects.where(_typed(kind))
    return own.groupBy("edge_id").agg(F.min(F.struct("dist_from_start", "obj_id")).alias("n"), F.max(F.struct("dist_from_start", (-F.col("obj_id")).alias("i"))).alias("f")).select("edge_id", F.col("n.obj_id").alias("nearest_obj_id"), F.col("n.dist_from_start").alias("nearest_dist"), (-F.col("f.i")).alias("farthest_obj_id"), F.col("f.dist_from_start").alias("farthest_dist"))


def nearest_to_node(network: RoadNetwork, kind: bool | None = None) -> DataFrame:
    """node_id, edge_id, obj_id, dist: each end of an edge with the edge's object nearest to it."""
    placed = network.placed.where(_typed(kind))
    ends = F.explode(F.array(F.struct(F.col("start_node").alias("node_id"), F.col("dist_from_start").alias("dist")), F.struct(F.col("end_node").alias("node_id"), (F.col("length") - F.col("dist_from_start")).alias("dist"))))
    return placed.select("edge_id", "obj_id", ends.alias("e")).groupBy("e.node_id", "edge_id").agg(F.min(F.struct("e.dist", "obj_id")).alias("b")).select("node_id", "edge_id", "b.obj_id", "b.dist")


def offset_from(node: Column) -> Column:
    """Distance of an object from a node of its edge; null for a node that isn't an end."""
    return F.when(node == F.col("start_node"), F.col("dist_from_start")).when(node == F.col("end_node"), F.col("length") - F.col("dist_from_start"))


def edge_segments(network: RoadNetwork, slot_rows: int | None = None) -> DataFrame:
    """edge_id, seq, from_obj, to_obj, segment_length: every edge parted at its objects; null is an end of the edge."""
    objects = network.objects.select("edge_id", "obj_id", "dist_from_start")
    rows = in_order(objects, "edge_id", "dist_from_start", ["dist_from_start", "obj_id"], F.struct("dist_from_start", "obj_id"), slot_rows=slot_rows)
    rows = network.edges.select("edge_id", "length").join(rows, "edge_id", "left")
    part = lambda seq, a, b, length: F.struct(seq.cast("int").alias("seq"), a.alias("from_obj"), b.alias("to_obj"), length.alias("segment_length"))
    none, off = F.lit(None).cast("long"), F.col("dist_from_start")
    own = part(F.col("nth") - 1, F.col("before.obj_id"), F.col("obj_id"), off - F.coalesce("before.dist_from_start", F.lit(0.0)))
    last = part(F.col("nth"), F.col("obj_id"), none, F.col("length") - off)
    found = F.when(F.col("obj_id").isNull(), F.array(part(F.lit(0), none, none, F.col("length")))).when(F.col("after").isNull(), F.array(own, last)).otherwise(F.array(own))
    return rows.select("edge_id", F.explode(found).alias("s")).select("edge_id", "s.seq", "s.from_obj", "s.to_obj", "s.segment_length")
