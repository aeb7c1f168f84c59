"""A road network: nodes, edges and typed objects along edges, as tables."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearway import schema as S
from nearway.storage import Workspace


@dataclass(frozen=True)
class RoadNetwork:
    """edges(edge_id, start_node, end_node, length) and objects(obj_id, edge_id, is_query, dist_from_start, ...).

    Offsets are measured from an edge's start node. Nodes are those of the edges, unless a table of them is given.
    """

    edges: DataFrame
    objects: DataFrame
    given_nodes: DataFrame | None = None
    name: str = ""

    @classmethod
    def checked(cls, edges: DataFrame, objects: DataFrame | None = None, nodes: DataFrame | None = None, distinct_offsets: bool = False, name: str = "") -> tuple[RoadNetwork, DataFrame, DataFrame]:
        """A network of the rows that keep the rules, and reports of rejected edges and objects."""
        good, bad = S.check_edges(edges)
        if objects is None:
            objects = edges.sparkSession.createDataFrame([], S.OBJECTS)
        placed, lost = S.check_objects(objects, good, distinct_offsets)
        return cls(good, placed, nodes, name), bad, lost

    @cached_property
    def nodes(self) -> DataFrame:
        used = self.edges.select(F.explode(F.array("start_node", "end_node")).alias("node_id")).distinct()
        if self.given_nodes is None:
            return used
        return self.given_nodes.dropDuplicates(["node_id"]).join(used, "node_id", "full")

    @cached_property
    def adjacency(self) -> DataFrame:
        """src, dst, edge_id, w: every edge in both directions; parallel edges stay."""
        ends = F.explode(F.array(F.struct(F.col("start_node").alias("src"), F.col("end_node").alias("dst")), F.struct(F.col("end_node").alias("src"), F.col("start_node").alias("dst"))))
        return self.edges.select(ends.alias("e"), "edge_id", F.col("length").alias("w")).select("e.src", "e.dst", "edge_id", "w")

    @cached_property
    def placed(self) -> DataFrame:
        """Objects with their edge's nodes and length."""
        own = [c for c in self.objects.columns if c not in ("start_node", "end_node", "length")]
        return self.objects.select(*own).join(self.edges.select("edge_id", "start_node", "end_node", "length"), "edge_id")

    @cached_property
    def chains(self) -> DataFrame:
        """chain_edges(), made once for this network and written."""
        from nearway.operators.chains import chain_edges

        return Workspace(self.edges.sparkSession, "network").write(chain_edges(self))

    @cached_property
    def contracted(self):
        """The network of chains' ends, made once for this network."""
        from nearway.operators.contract import Contracted

        return Contracted(self)

    def with_edges(self, added: DataFrame) -> RoadNetwork:
        return replace(self, edges=self.edges.unionByName(S.conform(added, S.EDGES)).dropDuplicates(["edge_id"]))

    def without_edges(self, edge_ids: DataFrame) -> RoadNetwork:
        """Without these edges and what is on them."""
        return replace(self, edges=self.edges.join(edge_ids, "edge_id", "left_anti"), objects=self.objects.join(edge_ids, "edge_id", "left_anti"))

    def with_objects(self, objects: DataFrame) -> RoadNetwork:
        return replace(self, objects=objects)

    def objects_by_edge(self) -> DataFrame:
        """Each edge with the array of its objects by offset; an edge without objects has a null."""
        nested = self.objects.groupBy("edge_id").agg(F.array_sort(F.collect_list(F.struct("dist_from_start", "obj_id", "is_query"))).alias("objects"))
        return self.edges.join(nested, "edge_id", "left")
