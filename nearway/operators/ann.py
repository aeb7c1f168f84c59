"""All nearest neighbours: for every query object the nearest data object by network distance.

Ways with one answer: `voronoi` labels every node with its nearest data object once and looks all queries up; `naive`
expands from every query; `scl` expands from the ends of runs of queries along a chain and derives the rest; `parts` and
`parts_naive` do as the first two within parts, in tasks, and exchange what crosses between parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearway.network import RoadNetwork
from nearway.operators.chains import objects_on_chains
from nearway.operators.on_edge import nearest_on_edge, nearest_other_on_edge
from nearway.operators.relax import relax, relax_two, seeds_of
from nearway.storage import Workspace

DIRECTIONS = ("true_to_false", "false_to_true", "auto")


def query_type(network: RoadNetwork, direction: str) -> bool:
    """Whether objects of type true ask. `auto`: the smaller side asks, type true if both are as many."""
    if direction == "auto":
        n = network.objects.agg(F.count_if("is_query").alias("t"), F.count_if(~F.col("is_query")).alias("f")).first()
        return n["f"] >= n["t"]
    if direction not in DIRECTIONS:
        raise ValueError(f"direction is one of {DIRECTIONS}")
    return direction == "true_to_false"


def _lookup(asking: DataFrame, labels: DataFrame) -> DataFrame:
    """q, dist, obj over both ends of each asking object's edge."""
    ends = F.explode(F.array(F.struct(F.col("start_node").alias("node"), F.col("dist_from_start").alias("way")), F.struct(F.col("end_node").alias("node"), (F.col("length") - F.col("dist_from_start")).alias("way"))))
    at = asking.select(F.col("obj_id").alias("q"), ends.alias("e")).select("q", "e.node", "e.way")
    return at.join(labels, "node").select("q", (F.col("way") + F.col("dist")).alias("dist"), "obj")


def nearest(marked: DataFrame, labels: DataFrame) -> DataFrame:
    """q, dist, obj: the least over the own edge and both its ends; no row if nothing is reached."""
    found = nearest_on_edge(marked).unionByName(_lookup(marked.where("asks"), labels))
    return found.groupBy("q").agg(F.min(F.struct("dist", "obj")).alias("b")).select("q", "b.dist", "b.obj")


def _result(asking: DataFrame, found: DataFrame) -> DataFrame:
    return asking.join(found, asking["obj_id"] == found["q"], "left").select(F.col("obj_id").alias("query_obj_id"), F.col("obj").alias("data_obj_id"), F.col("dist").alias("distance"))


def all_nearest(network: RoadNetwork, direction: str = "true_to_false", algorithm: str = "voronoi", parts: DataFrame | None = None) -> DataFrame:
    """query_obj_id, data_obj_id, distance for every query object; null if no data object can be reached.

    Ties go to the smaller data object; objects at one place are 0 apart. parts (node_id, part_id; of every node) are for
    the algorithms `parts` and `parts_naive` alone, see two_level; without them, blocks of node numbers are taken.
    """
    kind = query_type(network, direction)
    marked = network.placed.withColumn("asks", F.col("is_query") == kind)
    asking, answering = marked.where("asks"), marked.where("not asks")
    if algorithm == "voronoi":
        return _result(asking, nearest(marked, network.contracted.labels(seeds_of(network, answering))))
    if algorithm == "naive":
        return _result(asking, _naive(network, marked))
    if algorithm == "scl":
        from nearway.operators.runs import shared_execution

        return _result(asking, shared_execution(network, marked))
    if algorithm in ("parts", "parts_naive"):
        from nearway.operators.two_level import Parted, expanded_by_parts

        parted = Parted(network, parts)
        if algorithm == "parts_naive":
            found = expanded_by_parts(parted, marked)
        else:
            found = nearest(marked, parted.labels(seeds_of(network, answering)))
        return parted.work.write(_result(asking, found))
    raise ValueError("algorithm is voronoi, naive, scl, parts or parts_naive")


def looked_up(network: RoadNetwork, labels: DataFrame, kind: bool) -> DataFrame:
    """The answers for objects of a type from a table of node labels that was made before."""
    marked = network.placed.withColumn("asks", F.col("is_query") == kind)
    return _result(marked.where("asks"), nearest(marked, labels))


def node_labels(network: RoadNetwork, kind: bool) -> DataFrame:
    """node, dist, obj: the nearest object of a type for each node, the table that answers later queries."""
    return network.contracted.labels(seeds_of(network, network.objects.where(F.col("is_query") == kind)))


def _lines(network: RoadNetwork) -> tuple[DataFrame, DataFrame]:
    """chain_id, first, last, total of every chain, and objects with chain_id and at, for a network that may have none."""
    contracted = network.contracted
    if contracted.plain is not None:  # every edge is a chain
        ends = network.edges.select(F.col("edge_id").alias("chain_id"), F.col("start_node").alias("first"), F.col("end_node").alias("last"), F.col("length").alias("total"))
        return ends, network.objects.select("obj_id", F.col("edge_id").alias("chain_id"), F.col("dist_from_start").alias("at"))
    return contracted.ends, objects_on_chains(network, network.chains).select("obj_id", "chain_id", "at")


#: Lengths are added in another order than along a path, so distances that differ by less than this share are one.
SLACK = 1e-12


def least_found(rows: DataFrame) -> DataFrame:
    """q, dist, obj: the least of each query; distances that are equal but for the last digits are a tie."""
    return rows.groupBy("q").agg(F.min(F.struct(F.round("dist", 9).alias("r"), "obj", "dist")).alias("b")).select("q", "b.dist", "b.obj")


def expand(starts: DataFrame, steps: DataFrame, entry: DataFrame, own: DataFrame) -> DataFrame:
    """q, dist, obj: an expansion from each query, which goes no further than the nearest that it has found so far.

    starts: q, node, dist, obj. entry: node, rest, found, what is nearest from a node without going on. own: q, dist, obj
    that are found without an expansion. A query's bound is a row, told anew with each job.
    """
    work = Workspace(starts.sparkSession, "expand")
    bound = [work.write(own.groupBy("q").agg((F.min("dist") * (1 + SLACK)).alias("most")))]

    def bounds(labels: DataFrame) -> DataFrame:
        met = labels.join(entry, "node").select("q", ((F.col("dist") + F.col("rest")) * (1 + SLACK)).alias("most"))
        bound.append(work.write(bound[-1].unionByName(met).groupBy("q").agg(F.min("most").alias("most"))))
        return bound[-1]

    labels = relax(starts, steps, keys=("q",), bounds=bounds)
    found = labels.join(entry, "node").select("q", (F.col("dist") + F.col("rest")).alias("dist"), F.col("found").alias("obj"))
    return least_found(found.unionByName(own))


def _naive(network: RoadNetwork, marked: DataFrame) -> DataFrame:
    """One expansion from each asking object over the network of chains' ends."""
    work = Workspace(network.edges.sparkSession, "naive")
    lines, places = _lines(network)
    on_line = work.write(places.join(marked.select("obj_id", "asks"), "obj_id").join(lines, "chain_id"))
    ends = F.explode(F.array(F.struct(F.col("first").alias("node"), F.col("at").alias("dist")), F.struct(F.col("last").alias("node"), (F.col("total") - F.col("at")).alias("dist"))))
    at_ends = on_line.select("asks", "obj_id", ends.alias("e")).select("asks", "obj_id", "e.node", "e.dist")
    best = F.min(F.struct(F.round("dist", 9).alias("r"), F.col("obj_id").alias("found"), F.col("dist").alias("rest"))).alias("b")
    entry = at_ends.where("not asks").groupBy("node").agg(best).select("node", "b.rest", "b.found")
    own = nearest_on_edge(on_line.select("obj_id", F.col("chain_id").alias("edge_id"), F.col("at").alias("dist_from_start"), F.col("total").alias("length"), "asks"), digits=9)
    starts = at_ends.where("asks").select(F.col("obj_id").alias("q"), "node", "dist", F.lit(0).cast("long").alias("obj"))
    steps = network.contracted.adjacency if network.contracted.plain is None else network.contracted.plain
    return expand(starts, steps, work.write(entry), work.write(own))


def untyped_nearest(network: RoadNetwork) -> DataFrame:
    """query_obj_id, data_obj_id, distance: the nearest other object of any type for every object."""
    placed = network.placed
    labels = relax_two(seeds_of(network), network.adjacency).drop("rank")
    found = nearest_other_on_edge(network.objects).unionByName(_lookup(placed, labels).where("q <> obj"))
    best = found.groupBy("q").agg(F.min(F.struct("dist", "obj")).alias("b")).select("q", "b.dist", "b.obj")
    return _result(placed, best)
