"""Point look-ups and conversions between ids and rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearway.network import RoadNetwork
from nearway.operators.numbering import numbered
from nearway.operators.parts import adjacent_edges

#: Rows of a category table that are sent to every task without a shuffle.
MAX_CATEGORIES = 100_000


def edges_between(network: RoadNetwork, pairs: DataFrame, either_way: bool = True) -> DataFrame:
    """a, b, edge_id, length: all edges that join the nodes of each pair (a, b), from a to b alone or either way."""
    edges = network.edges.select("edge_id", "start_node", "end_node", "length")
    if not either_way:
        return pairs.join(edges, (F.col("a") == F.col("start_node")) & (F.col("b") == F.col("end_node"))).select("a", "b", "edge_id", "length")
    low, high = F.least("start_node", "end_node"), F.greatest("start_node", "end_node")
    p = pairs.withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")})
    return p.join(edges.withColumns({"lo": low, "hi": high}), ["lo", "hi"]).select("a", "b", "edge_id", "length")


def objects_by_ids(network: RoadNetwork, lists: DataFrame, key: str = "list_id", ids: str = "ids") -> DataFrame:
    """key, pos and the object's columns for each id of an array, in the array's order; ids that no object has are left out."""
    each = lists.select(key, F.posexplode(ids).alias("pos", "obj_id"))
    return each.join(network.objects, "obj_id").select(key, "pos", "obj_id", "edge_id", "is_query", "dist_from_start")


def ids_by_edge(network: RoadNetwork, kind: bool | None = None) -> DataFrame:
    """edge_id, ids: ids of each edge's objects (of one type) by offset and id."""
    own = network.objects if kind is None else network.objects.where(F.col("is_query") == kind)
    return own.groupBy("edge_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dist_from_start", "obj_id"))), lambda s: s["obj_id"]).alias("ids"))


def with_categories(objects: DataFrame, categories: DataFrame) -> DataFrame:
    """objects with their category's name; the table is sent to every task if it is small, by a count that is checked."""
    names = categories.select("category_id", F.col("name").alias("category_name"))
    small = names.limit(MAX_CATEGORIES + 1).count() <= MAX_CATEGORIES
    return objects.join(F.broadcast(names) if small else names, "category_id", "left")


def objects_between_nodes(network: RoadNetwork, pairs: DataFrame) -> DataFrame:
    """a, b, obj_id, distance: objects on edges that join each pair's nodes, with their distance from a."""
    found = edges_between(network, pairs).drop("length").join(network.placed, "edge_id")
    return found.select("a", "b", "obj_id", F.when(F.col("start_node") == F.col("a"), F.col("dist_from_start")).otherwise(F.col("length") - F.col("dist_from_start")).alias("distance"))


def nodes_by_ids(network: RoadNetwork, lists: DataFrame, ids: str = "ids") -> DataFrame:
    """pos and node_id for each id of an array, in the array's order; ids that no node has are left out."""
    return lists.select(F.posexplode(ids).alias("pos", "node_id")).join(network.nodes.select("node_id"), "node_id").select("pos", "node_id")


def nodes_by_index(network: RoadNetwork) -> DataFrame:
    """idx (from 0, by id) and node_id of every node."""
    return numbered(network.nodes.select("node_id"), ["node_id"], "idx", first=0).select("idx", "node_id")


def ends_of_edges(network: RoadNetwork, edge_ids: DataFrame) -> DataFrame:
    """edge_id, start_node, end_node of the edges asked for."""
    return network.edges.select("edge_id", "start_node", "end_node").join(edge_ids, "edge_id", "left_semi")


def has_edges(network: RoadNetwork, pairs: DataFrame) -> DataFrame:
    """a, b, joined: whether an edge joins the nodes of each pair, either way."""
    joined = network.adjacency.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(True).alias("joined")).distinct()
    return pairs.join(joined, ["a", "b"], "left").select("a", "b", F.coalesce("joined", F.lit(False)).alias("joined"))


def edges_of_objects(network: RoadNetwork, obj_ids: DataFrame) -> DataFrame:
    """obj_id and the columns of its edge, for the objects asked for."""
    return network.placed.join(obj_ids, "obj_id", "left_semi").select("obj_id", "edge_id", "start_node", "end_node", "length")


def adjacent_with_objects(network: RoadNetwork) -> DataFrame:
    """edge_id, neighbour_id, n_objects of edges that share a node, where the neighbour has objects."""
    n = network.objects.groupBy(F.col("edge_id").alias("neighbour_id")).agg(F.count(F.lit(1)).alias("n_objects"))
    return adjacent_edges(network).join(n, "neighbour_id").select("edge_id", "neighbour_id", "n_objects")
