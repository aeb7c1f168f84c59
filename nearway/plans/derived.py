"""A road network derived from the supplier, customer and part tables, and the SQL that derives the same.

Suppliers make a ring of nodes and edges, customers are further edges, parts are objects. Lengths and offsets are whole
numbers, so sums are exact in any order. In `dense` every customer is a chord of the ring; in `mixed` each has a node of
its own, and LONG customers in a row are a chain from one supplier to another (the first and the last may end nowhere);
in `tips` TIP customers in a row are a chain that ends nowhere; `ring` has suppliers alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearway.network import RoadNetwork
from nearway.operators.numbering import numbered
from nearway.storage import Workspace

#: Customers of a chain of `mixed`.
LONG, PARTS = 75, 3
#: Customers of a chain of `tips`.
TIP = 6
#: For each variant how a customer's edge begins and ends (k: number of suppliers), if it has one, and a part's type.
VARIANTS = {
    "dense": ("c_custkey % {k}", "(c_custkey * 31 + 7) % {k}", "p_size % 3 = 0"),
    "mixed": (
        f"CASE WHEN c_custkey % {LONG} = 0 THEN c_custkey % {{k}} ELSE {{k}} + c_custkey - 1 END",
        f"CASE WHEN c_custkey % {LONG} = {LONG - 1} THEN (c_custkey * 31 + 7) % {{k}} ELSE {{k}} + c_custkey END",
        "p_partkey % 97 <> 0",
    ),
    "tips": (f"CASE WHEN c_custkey % {TIP} = 0 THEN c_custkey % {{k}} ELSE {{k}} + c_custkey - 1 END", "{k} + c_custkey", "p_partkey % 5 = 0"),
    "ring": (None, None, "p_partkey % 97 <> 0"),
}


def network(spark: SparkSession, sf_dir: str, variant: str = "dense") -> RoadNetwork:
    start, end, kind = VARIANTS[variant]
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    work, supplier = Workspace(spark, "derived", lean=True), read("supplier")
    k = supplier.count()
    edges = supplier.selectExpr("s_suppkey * 2 AS edge_id", f"s_suppkey % {k} AS start_node", f"(s_suppkey + 1) % {k} AS end_node", "cast(100 + (s_suppkey * 7919) % 900 AS double) AS length")
    if start:
        edges = edges.unionByName(read("customer").selectExpr("c_custkey * 2 + 1 AS edge_id", f"{start.format(k=k)} AS start_node", f"{end.format(k=k)} AS end_node", "cast(100 + (c_custkey * 104729) % 2900 AS double) AS length"))
    edges = work.write(numbered(edges.where("start_node <> end_node"), ["edge_id"], "rn", first=0))
    m = edges.count()
    parts = read("part").selectExpr("p_partkey AS obj_id", f"{kind} AS is_query", f"p_partkey % {m} AS rn", "p_partkey")
    objects = work.write(parts.join(edges, "rn").selectExpr("obj_id", "edge_id", "is_query", "cast((p_partkey * 53) % (cast(length AS long) + 1) AS double) AS dist_from_start"))
    return RoadNetwork(edges.drop("rn"), objects, name=variant)


def node_parts(net: RoadNetwork, parts: int = PARTS) -> DataFrame:
    """node_id, part_id: blocks of node numbers."""
    k = net.nodes.agg(F.max("node_id")).first()[0] + 1
    return net.nodes.select("node_id", F.floor(F.col("node_id") * parts / F.lit(k)).cast("int").alias("part_id"))


def node_places(net: RoadNetwork) -> DataFrame:
    """node_id, longitude, latitude."""
    return net.nodes.selectExpr("node_id", "cast((node_id * 7919) % 1000 AS double) AS longitude", "cast((node_id * 104729) % 1000 AS double) AS latitude")


def sql(variant: str = "dense") -> str:
    """Common table expressions edges, adj and objects, as in network()."""
    start, end, kind = VARIANTS[variant]
    chords = f"""UNION ALL SELECT c_custkey * 2 + 1, {start.format(k="k")}, {end.format(k="k")}, 100 + (c_custkey * 104729) % 2900 FROM customer, n""" if start else ""
    return f"""n AS (SELECT count(*) AS k FROM supplier),
edges AS (SELECT edge_id, start_node, end_node, length FROM (
  SELECT s_suppkey * 2 AS edge_id, s_suppkey % k AS start_node, (s_suppkey + 1) % k AS end_node, 100 + (s_suppkey * 7919) % 900 AS length FROM supplier, n {chords}) u
  WHERE start_node <> end_node),
adj AS (SELECT start_node AS src, end_node AS dst, edge_id, length AS w FROM edges UNION ALL SELECT end_node, start_node, edge_id, length FROM edges),
e2 AS (SELECT *, row_number() OVER (ORDER BY edge_id) - 1 AS rn, count(*) OVER () AS m FROM edges),
objects AS (SELECT p_partkey AS obj_id, {kind} AS is_query, edge_id, (p_partkey * 53) % (length + 1) AS dist_from_start, start_node, end_node, length FROM part JOIN e2 ON p_partkey % m = rn),
parts AS (SELECT src AS node_id, CAST(floor(src * {PARTS} / CAST((SELECT max(src) + 1 FROM adj) AS DOUBLE)) AS INTEGER) AS part_id FROM (SELECT DISTINCT src FROM adj)),
cut AS (SELECT e.*, a.part_id AS start_part, b.part_id AS end_part FROM edges e JOIN parts a ON a.node_id = start_node JOIN parts b ON b.node_id = end_node WHERE a.part_id <> b.part_id),
border AS (SELECT DISTINCT node_id, part_id FROM (SELECT start_node AS node_id, start_part AS part_id FROM cut UNION ALL SELECT end_node, end_part FROM cut))"""
