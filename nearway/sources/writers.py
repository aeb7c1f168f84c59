"""Writers of network files, and the tables that they write.

A writer makes a folder of part files, in order where the format has one, unless single asks for one file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearway.network import RoadNetwork
from nearway.operators.numbering import numbered


def _text(df: DataFrame, path: str, columns: list[str], separator: str, single: bool = False) -> None:
    out = df.select(F.concat_ws(separator, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("value"))
    (out.coalesce(1) if single else out).write.mode("overwrite").text(path)


def write_nodes(nodes: DataFrame, path: str, separator: str = " ", single: bool = False) -> None:
    _text(nodes.orderBy("node_id"), path, ["node_id", "longitude", "latitude"], separator, single)


def write_edges(edges: DataFrame, path: str, separator: str = " ", single: bool = False) -> None:
    _text(edges.orderBy("edge_id"), path, ["edge_id", "start_node", "end_node", "length"], separator, single)


def write_objects_csv(objects: DataFrame, path: str, single: bool = False) -> None:
    _text(objects.orderBy("edge_id", "dist_from_start", "obj_id"), path, ["edge_id", "obj_id", "is_query", "dist_from_start"], ",", single)


def write_objects(objects: DataFrame, path: str, single: bool = False) -> None:
    kind = F.when(F.col("is_query"), "T").otherwise("F")
    _text(objects.withColumn("kind", kind).orderBy("obj_id"), path, ["obj_id", "kind", "dist_from_start", "edge_id"], " ", single)


def reindexed_nodes(nodes: DataFrame, by: int = 1) -> DataFrame:
    return nodes.withColumn("node_id", F.col("node_id") + by)


def reindexed_edges(edges: DataFrame, by: int = 1) -> DataFrame:
    """Edges with all ids moved, such as from 0-based to 1-based."""
    return edges.select(*[(F.col(c) + by).alias(c) for c in ("edge_id", "start_node", "end_node")], "length")


def without_reverse_edges(edges: DataFrame, adjacent_only: bool = False) -> DataFrame:
    """Edges without those that repeat another one the other way round; the least id stays.

    adjacent_only leaves out only the repeat of the edge before it by id.
    """
    edges = edges.select("edge_id", "start_node", "end_node", "length")
    if adjacent_only:
        rows = numbered(edges, ["edge_id"], "n")
        before = rows.select((F.col("n") + 1).alias("n"), F.col("start_node").alias("s"), F.col("end_node").alias("e"))
        return rows.join(before, "n", "left").where("not coalesce(start_node = e and end_node = s, false)").drop("n", "s", "e")
    pair = Window.partitionBy(F.least("start_node", "end_node"), F.greatest("start_node", "end_node")).orderBy("edge_id")
    return edges.withColumn("n", F.row_number().over(pair)).where("n = 1").drop("n")


def metis_rows(network: RoadNetwork) -> DataFrame:
    """node_id, neighbours (text, by id, each once) of every node."""
    return network.adjacency.groupBy(F.col("src").alias("node_id")).agg(F.array_join(F.array_sort(F.collect_set("dst")), " ").alias("neighbours"))


def write_metis(network: RoadNetwork, path: str, single: bool = False) -> None:
    """`nNodes nEdges`, then a line of neighbours for each node; nodes must be numbered from 1 without a gap."""
    rows = metis_rows(network)
    pairs = network.edges.select(F.least("start_node", "end_node").alias("a"), F.greatest("start_node", "end_node").alias("b")).distinct()
    header = network.nodes.agg(F.count(F.lit(1)).alias("n")).crossJoin(pairs.agg(F.count(F.lit(1)).alias("m"))).select(F.lit(0).cast("long").alias("node_id"), F.concat_ws(" ", "n", "m").alias("neighbours"))
    out = header.unionByName(rows).orderBy("node_id").select(F.col("neighbours").alias("value"))
    (out.coalesce(1) if single else out).write.mode("overwrite").text(path)


def hgr_rows(network: RoadNetwork, weighted: bool = False) -> DataFrame:
    """edge_id, hyperedge: an hMETIS line for each edge, its weight first if asked (lengths as whole numbers)."""
    parts = [F.col("start_node").cast("string"), F.col("end_node").cast("string")]
    if weighted:
        parts.insert(0, F.floor(F.col("length") + 0.5).cast("string"))
    return network.edges.select("edge_id", F.concat_ws(" ", *parts).alias("hyperedge"))


def write_hgr(network: RoadNetwork, path: str, weighted: bool = False, single: bool = False) -> None:
    counts = network.edges.agg(F.count(F.lit(1)).alias("m")).crossJoin(network.nodes.agg(F.max("node_id").alias("n")))
    header = counts.select(F.lit(-1).cast("long").alias("edge_id"), F.concat_ws(" ", "m", "n", *([F.lit("1")] if weighted else [])).alias("hyperedge"))
    out = header.unionByName(hgr_rows(network, weighted)).orderBy("edge_id").select(F.col("hyperedge").alias("value"))
    (out.coalesce(1) if single else out).write.mode("overwrite").text(path)


def write_node_clusters(chain_nodes: DataFrame, path: str, single: bool = False) -> None:
    """`idx,[a, b, c]` for each chain."""
    nodes = F.transform(F.array_sort(F.collect_list(F.struct("pos", "node_id"))), lambda s: s["node_id"].cast("string"))
    out = chain_nodes.groupBy("chain_id").agg(F.concat(F.lit("["), F.array_join(nodes, ", "), F.lit("]")).alias("nodes")).orderBy("chain_id").select(F.concat_ws(",", F.col("chain_id").cast("string"), "nodes").alias("value"))
    (out.coalesce(1) if single else out).write.mode("overwrite").text(path)


def append_report(report: DataFrame, path: str) -> None:
    """Adds rows of measures (such as times or counts of runs) to a CSV folder with a header."""
    report.write.mode("append").option("header", True).csv(path)


def write_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").parquet(path)
