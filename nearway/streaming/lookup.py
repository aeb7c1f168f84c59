"""Query objects as a stream against the labels of a network that stands still."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearway.network import RoadNetwork


def edge_candidates(network: RoadNetwork, labels: DataFrame, kind: bool) -> DataFrame:
    """For each edge its length, its ends' labels (dist, obj) and its objects of the data type by offset.

    A static table with a row for each edge, so a stream needs one join and no state.
    """
    data = network.objects.where(F.col("is_query") == kind).groupBy("edge_id").agg(F.array_sort(F.collect_list(F.struct(F.col("dist_from_start").alias("off"), F.col("obj_id").alias("obj")))).alias("data"))
    s, e = labels.select(F.col("node").alias("start_node"), F.struct("dist", "obj").alias("s")), labels.select(F.col("node").alias("end_node"), F.struct("dist", "obj").alias("e"))
    return network.edges.join(s, "start_node", "left").join(e, "end_node", "left").join(data, "edge_id", "left").select("edge_id", "length", "s", "e", "data")


def nearest_in_stream(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """query_obj_id, data_obj_id, distance for queries (obj_id, edge_id, dist_from_start), as they come.

    Queries on edges that aren't known have nulls. Works on a stream (append mode, no state) and on a table alike.
    """
    off = F.col("dist_from_start")
    way = lambda label, d: F.when(label.isNotNull(), F.struct((label["dist"] + d).alias("dist"), label["obj"].alias("obj")))
    own = F.array_min(F.transform("data", lambda d: F.struct(F.abs(d["off"] - off).alias("dist"), d["obj"].alias("obj"))))
    best = F.least(own, way(F.col("s"), off), way(F.col("e"), F.col("length") - off))
    return queries.join(candidates, "edge_id", "left").select(F.col("obj_id").alias("query_obj_id"), best["obj"].alias("data_obj_id"), best["dist"].alias("distance"))
