"""Partitioned networks: cut edges, border nodes, shortest paths between them, and the overlay network."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearway.network import RoadNetwork
from nearway.operators import minplus
from nearway.operators.ann import all_nearest
from nearway.operators.numbering import numbered
from nearway.storage import Workspace


def by_position(network: RoadNetwork, parts: DataFrame) -> DataFrame:
    """node_id, part_id from a partition file's lines (line, part_id): line i belongs to the i-th smallest node."""
    nodes = numbered(network.nodes.select("node_id"), ["node_id"], "line")
    return nodes.join(parts, "line").select("node_id", "part_id")


def grid_parts(nodes: DataFrame, columns: int, rows: int) -> DataFrame:
    """node_id, part_id by a grid over the coordinates; nodes without coordinates are dealt by their id."""
    box = nodes.agg(F.min("longitude").alias("x0"), F.max("longitude").alias("x1"), F.min("latitude").alias("y0"), F.max("latitude").alias("y1"))
    cell = lambda v, lo, hi, n: F.when(F.col(hi) > F.col(lo), F.least(F.floor((F.col(v) - F.col(lo)) / (F.col(hi) - F.col(lo)) * n), F.lit(n - 1))).otherwise(F.lit(0))
    part = cell("longitude", "x0", "x1", columns) + cell("latitude", "y0", "y1", rows) * columns
    return nodes.crossJoin(F.broadcast(box)).select("node_id", F.coalesce(part, F.pmod(F.xxhash64("node_id"), F.lit(columns * rows))).cast("int").alias("part_id"))


def _ends(network: RoadNetwork, parts: DataFrame) -> DataFrame:
    p, q = parts.select(F.col("node_id").alias("start_node"), F.col("part_id").alias("start_part")), parts.select(F.col("node_id").alias("end_node"), F.col("part_id").alias("end_part"))
    return network.edges.join(p, "start_node").join(q, "end_node")


def cut_edges(network: RoadNetwork, parts: DataFrame) -> DataFrame:
    """Edges whose nodes are in different parts."""
    return _ends(network, parts).where("start_part <> end_part").select("edge_id", "start_node", "end_node", "length", "start_part", "end_part")


def border_nodes(network: RoadNetwork, parts: DataFrame) -> DataFrame:
    """node_id, part_id of the nodes of cut edges."""
    cut = cut_edges(network, parts)
    return cut.select(F.explode(F.array(F.struct(F.col("start_node").alias("node_id"), F.col("start_part").alias("part_id")), F.struct(F.col("end_node").alias("node_id"), F.col("end_part").alias("part_id")))).alias("b")).select("b.node_id", "b.part_id").distinct()


def borders_by_part(network: RoadNetwork, parts: DataFrame) -> DataFrame:
    return border_nodes(network, parts).groupBy("part_id").agg(F.array_sort(F.collect_set("node_id")).alias("nodes"))


def part_subgraphs(network: RoadNetwork, parts: DataFrame) -> DataFrame:
    """part_id, edge_id, start_node, end_node, length and objects of every edge within one part."""
    inside = _ends(network, parts).where("start_part = end_part").select(F.col("start_part").alias("part_id"), "edge_id")
    return inside.join(network.objects_by_edge(), "edge_id").select("part_id", "edge_id", "start_node", "end_node", "length", "objects")


def inside_parts(network: RoadNetwork, parts: DataFrame) -> RoadNetwork:
    """The network without cut edges and what is on them."""
    return network.without_edges(cut_edges(network, parts).select("edge_id"))


def part_local_nearest(network: RoadNetwork, parts: DataFrame, direction: str = "true_to_false", algorithm: str = "voronoi") -> DataFrame:
    """Nearest neighbours within each part alone: approximate, since no path and no object may be on a cut edge."""
    return all_nearest(inside_parts(network, parts), direction, algorithm)


def border_paths(network: RoadNetwork, parts: DataFrame, across: bool | None = None, block: int = 512) -> DataFrame:
    """a, b (a < b), a_part, b_part, distance of every two border nodes that are joined.

    across: only pairs of different parts, or only of the same; None: both. Distances are those of the overlay, by
    matrices of blocks of its chains' ends, at most `block` each.
    """
    from nearway.operators.two_level import Parted

    work = Workspace(network.edges.sparkSession, "borders")
    border = work.write(border_nodes(network, parts))
    # splitting large parts gives the overlay further border nodes, which take part as all do
    steps = Parted(network, parts).overlay.where("src < dst").select(F.lit(0).alias("g"), F.col("src").alias("a"), F.col("dst").alias("b"), "w")
    pairs = minplus.all_pairs(steps, border, block)
    if across is not None:
        pairs = pairs.where(F.col("a_part") != F.col("b_part") if across else F.col("a_part") == F.col("b_part"))
    kind = parts.schema["part_id"].dataType
    return pairs.select("a", "b", F.col("a_part").cast(kind).alias("a_part"), F.col("b_part").cast(kind).alias("b_part"), "distance")


def overlay_edges(network: RoadNetwork, parts: DataFrame, block: int = 512) -> DataFrame:
    """start_node, end_node, length, is_cut: cut edges, and shortcuts between border nodes of one part.

    A shortcut's length is that of the shortest path inside the part, so paths in the overlay are paths in the network.
    It is found by matrices of blocks of the part's border nodes, see border_paths().
    """
    from nearway.operators.two_level import Parted

    work = Workspace(network.edges.sparkSession, "overlay")
    border, cut = work.write(border_nodes(network, parts)), cut_edges(network, parts)
    of = lambda c, g: parts.select(F.col("node_id").alias(c), F.col("part_id").alias(g))
    inside = Parted(network, parts).overlay.where("src < dst").join(of("src", "g"), "src").join(of("dst", "h"), "dst").where("g = h")
    shortcuts = minplus.all_pairs(inside.select("g", F.col("src").alias("a"), F.col("dst").alias("b"), "w"), border, block)
    shortcuts = shortcuts.select(F.col("a").alias("start_node"), F.col("b").alias("end_node"), F.col("distance").alias("length"), F.lit(False).alias("is_cut"))
    # written, as both sides may be dealt by their end node (see Workspace.write)
    return cut.select("start_node", "end_node", "length", F.lit(True).alias("is_cut")).unionByName(work.write(shortcuts))


def edges_within(network: RoadNetwork, edge_id: int, perimeter: float) -> DataFrame:
    """edge_id, distance of the edges all of which is within the perimeter of an edge, by ways along edges.

    The edge itself is at 0; another one is as far as the nearer of its nodes and its own length.
    """
    start = network.edges.where(F.col("edge_id") == edge_id).select(F.explode(F.array("start_node", "end_node")).alias("node")).select("node", F.lit(0.0).alias("dist"), F.lit(0).cast("long").alias("obj"))
    labels = network.contracted.labels(start, within=perimeter)
    reached = network.adjacency.where(F.col("edge_id") != edge_id).join(labels, F.col("src") == F.col("node")).groupBy("edge_id").agg(F.min(F.col("dist") + F.col("w")).alias("distance")).where(F.col("distance") <= perimeter)
    return reached.unionByName(network.edges.where(F.col("edge_id") == edge_id).select("edge_id", F.lit(0.0).alias("distance")))


def adjacent_edges(network: RoadNetwork) -> DataFrame:
    """edge_id, neighbour_id of edges that share a node."""
    ends = network.adjacency.select(F.col("src").alias("node"), "edge_id")
    return ends.join(ends.withColumnRenamed("edge_id", "neighbour_id"), "node").where("edge_id <> neighbour_id").select("edge_id", "neighbour_id").distinct()


def virtual_source(network: RoadNetwork, parts: DataFrame, node_id: int) -> DataFrame:
    """Edges of length 0 from one new node to all border nodes."""
    return border_nodes(network, parts).select(F.lit(node_id).cast("long").alias("start_node"), F.col("node_id").alias("end_node"), F.lit(0.0).alias("length"))


def part_counts(network: RoadNetwork, parts: DataFrame) -> DataFrame:
    """part_id with its number of nodes and its share of all nodes in percent."""
    n = parts.groupBy("part_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    return n.withColumn("percent", F.round(100 * F.col("n_nodes") / F.sum("n_nodes").over(Window.partitionBy()), 2))
