"""A table of node labels that outlives a query: kept in buckets by node, looked up without a shuffle, repaired in place.

Data objects are points within edges, so an edge with objects is one of several segments between its nodes and them; a
label is the nearest such point of a node, and a query reads the labels of its edge's two nodes and the points beside it.
When objects come or go, only nodes that they are nearest to, or come nearer to, are labelled anew.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearway import schema as S
from nearway.network import RoadNetwork
from nearway.operators.ann import looked_up
from nearway.operators.relax import seeds_of
from nearway.storage import Workspace


@dataclass(frozen=True)
class StoredLabels:
    """node, dist and obj of every node that an object of a type reaches, as a table of `buckets` buckets by node."""

    network: RoadNetwork
    kind: bool
    labels: DataFrame
    buckets: int

    @classmethod
    def made(cls, network: RoadNetwork, kind: bool, buckets: int = 16) -> StoredLabels:
        """The labels of the network's objects of a type."""
        seeds = seeds_of(network, network.objects.where(F.col("is_query") == kind))
        return cls(network, kind, _kept(network.contracted.labels(seeds), buckets), buckets)

    def nearest(self, asking: RoadNetwork | None = None) -> DataFrame:
        """query_obj_id, data_obj_id, distance of the other type's objects, of this network or of one with other queries."""
        return looked_up(self.network if asking is None else asking, self.labels, not self.kind)

    def updated(self, added: DataFrame | None = None, removed: DataFrame | None = None) -> StoredLabels:
        """Labels once objects have come (rows of objects) and gone (obj_id); the type of the labels alone matters.

        Nodes that were nearest to what is gone begin from their neighbours' labels and from the objects on their own
        edges; what has come begins from its edge's nodes; the search goes on over chains' ends as far as something is bettered.
        """
        added = None if added is None else S.conform(added, S.OBJECTS)
        network, kind = self.network, F.col("is_query") == self.kind
        objects = network.objects
        if removed is not None:
            objects = objects.join(removed.select("obj_id"), "obj_id", "left_anti")
        if added is not None:
            objects = objects.unionByName(added.select(*objects.columns))
        changed = network.with_objects(Workspace(objects.sparkSession, "objects").write(objects))
        known, seeds = self.labels.select("node", "dist", "obj"), None
        if removed is not None:
            gone = removed.select(F.col("obj_id").alias("obj"))
            lost = known.join(gone, "obj", "left_semi").select("node")
            known = known.join(gone, "obj", "left_anti").select("node", "dist", "obj")
            across = known.join(network.adjacency, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), (F.col("dist") + F.col("w")).alias("dist"), "obj")
            own = seeds_of(changed, changed.objects.where(kind)).select("node", "dist", "obj")
            seeds = across.unionByName(own).join(lost, "node", "left_semi")
        if added is not None:
            come = seeds_of(network, added.where(kind)).select("node", "dist", "obj")
            seeds = come if seeds is None else seeds.unionByName(come)
        if seeds is None:
            return self
        made = network.contracted.relabelled(known, seeds)
        return StoredLabels(changed, self.kind, _kept(made, self.buckets), self.buckets)


def _kept(labels: DataFrame, buckets: int) -> DataFrame:
    spark = labels.sparkSession
    name = f"nearway_labels_{uuid.uuid4().hex}"
    path = Workspace(spark, "labels").path
    labels.repartition(buckets, "node").write.bucketBy(buckets, "node").sortBy("node").option("path", path).saveAsTable(name)
    return spark.table(name)
