"""Counts, sums and extremes of networks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearway.network import RoadNetwork


def network_stats(network: RoadNetwork) -> DataFrame:
    """One row: nodes, edges, objects of each type, edges with objects, and total length."""
    nodes = network.nodes.agg(F.count(F.lit(1)).alias("n_nodes"))
    edges = network.edges.agg(F.count(F.lit(1)).alias("n_edges"), F.sum("length").alias("total_length"))
    objects = network.objects.agg(F.count(F.lit(1)).alias("n_objects"), F.count_if("is_query").alias("n_true"), F.count_if(~F.col("is_query")).alias("n_false"), F.countDistinct("edge_id").alias("n_populated_edges"))
    return nodes.crossJoin(F.broadcast(edges)).crossJoin(F.broadcast(objects))  # one row each


def objects_per_edge(network: RoadNetwork) -> DataFrame:
    """edge_id, n_objects, n_true, n_false of every edge."""
    n = network.objects.groupBy("edge_id").agg(F.count(F.lit(1)).alias("n_objects"), F.count_if("is_query").alias("n_true"), F.count_if(~F.col("is_query")).alias("n_false"))
    return network.edges.select("edge_id").join(n, "edge_id", "left").fillna(0)


def edge_length_stats(network: RoadNetwork) -> DataFrame:
    return network.edges.agg(F.min("length").alias("min_length"), F.max("length").alias("max_length"), F.sum("length").alias("total_length"), F.count(F.lit(1)).alias("n_edges"))


def nearest_of(rows: DataFrame, key: str, distance: str, value: str) -> DataFrame:
    """The value with the least distance for each key, ties to the smaller value."""
    return rows.groupBy(key).agg(F.min(F.struct(distance, value)).alias("b")).select(key, f"b.{value}", f"b.{distance}")


def speedup(naive_s: float, clustered_s: float) -> float:
    """Percent of the naive time that is saved."""
    return 100 - clustered_s / naive_s * 100
