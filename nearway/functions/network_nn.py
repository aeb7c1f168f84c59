"""Nearest neighbours of a network's parts from SQL: a table function over one TABLE argument."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, LongType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, PartitioningColumn

#: What the table argument has: edges have is_query null, objects have their edge's nodes and an offset.
COLUMNS = ("part_id", "edge_id", "start_node", "end_node", "length", "obj_id", "is_query", "dist_from_start")


class NetworkNN:
    """network_nn(TABLE(rows)): query_obj_id, data_obj_id, distance within each part, whose rows come to one task.

    Rows are edges, and objects with their edge (see COLUMNS). The part's edges are held as they come and searched at its
    end, so a part is no larger than a task can hold; see two_level for parts that are cut to a bound.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        missing = [c for c in COLUMNS if c not in rows.dataType.names] if rows.isTable else COLUMNS
        if missing:
            raise ValueError(f"network_nn takes a TABLE with {', '.join(COLUMNS)}; without: {', '.join(missing)}")
        schema = StructType().add("query_obj_id", LongType()).add("data_obj_id", LongType()).add("distance", DoubleType())
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn("part_id")])

    def __init__(self):
        self.edges: dict[int, tuple[int, int, float]] = {}
        self.objects: list[tuple[int, int, bool, float]] = []

    def eval(self, rows):
        self.edges[rows["edge_id"]] = (rows["start_node"], rows["end_node"], rows["length"])
        if rows["obj_id"] is not None:
            self.objects.append((rows["obj_id"], rows["edge_id"], rows["is_query"], rows["dist_from_start"]))

    def terminate(self):
        import pandas as pd

        from nearway.operators.two_level import Local

        if not self.edges:
            return
        net = Local(pd.DataFrame(list(self.edges.values()), columns=["a", "b", "w"]), [])
        seeds, on_edge = [], {}
        for o, e, asks, off in self.objects:
            if not asks:
                a, b, w = self.edges[e]
                seeds += [(off, o, net.at([a])[0]), (w - off, o, net.at([b])[0])]
                on_edge.setdefault(e, []).append((off, o))
        best = net.search(seeds)
        for q, e, asks, off in self.objects:
            if asks:
                a, b, w = self.edges[e]
                found = [(abs(off - d), o) for d, o in on_edge.get(e, ())]
                found += [(best[i][0] + way, best[i][1]) for i, way in ((net.at([a])[0], off), (net.at([b])[0], w - off)) if i in best]
                d, o = min(found, default=(None, None))
                yield q, o, d


def register(spark: SparkSession) -> None:
    """Makes network_nn known to the session's SQL."""
    spark.udtf.register("network_nn", udtf(NetworkNN))
