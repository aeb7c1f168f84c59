"""Schemas of road networks and the rules that rows must keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


LONG, DOUBLE, BOOLEAN, INT, STRING = T.LongType(), T.DoubleType(), T.BooleanType(), T.IntegerType(), T.StringType()
NODES = _schema(node_id=LONG, longitude=DOUBLE, latitude=DOUBLE)
EDGES = _schema(edge_id=LONG, start_node=LONG, end_node=LONG, length=DOUBLE)
OBJECTS = _schema(obj_id=LONG, edge_id=LONG, is_query=BOOLEAN, dist_from_start=DOUBLE, category_id=INT, rating=DOUBLE, longitude=DOUBLE, latitude=DOUBLE)
NODE_PARTITION = _schema(node_id=LONG, part_id=INT)
RESULT = _schema(query_obj_id=LONG, data_obj_id=LONG, distance=DOUBLE)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with exactly the schema's columns; those it lacks are null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def check_edges(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges that keep the rules, and those that don't with the reason; a repeated edge id keeps its least row."""
    e = conform(edges, EDGES)
    nth = F.row_number().over(Window.partitionBy("edge_id").orderBy("start_node", "end_node", "length"))
    reason = (
        F.when(F.col("edge_id").isNull() | (F.col("edge_id") < 0), "edge id is negative or missing")
        .when(F.col("start_node").isNull() | F.col("end_node").isNull(), "node is missing")
        .when(F.col("length").isNull() | ~(F.col("length") > 0) | F.isnan("length"), "length is not above 0")
        .when(F.col("start_node") == F.col("end_node"), "edge is a loop")
        .when(F.col("nth") > 1, "edge id is repeated")
    )
    marked = e.withColumn("nth", nth).withColumn("reason", reason).drop("nth")
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def check_objects(objects: DataFrame, edges: DataFrame, distinct_offsets: bool = False) -> tuple[DataFrame, DataFrame]:
    """Objects that keep the rules against checked edges, and those that don't with the reason.

    An object id is unique in the whole network (the least row stays). With distinct_offsets only the first object by
    id stays of those at one place of an edge.
    """
    o = conform(objects, OBJECTS)
    nth = F.row_number().over(Window.partitionBy("obj_id").orderBy("edge_id", "dist_from_start", "is_query"))
    joined = o.withColumn("nth", nth).join(edges.select("edge_id", "length"), "edge_id", "left")
    reason = (
        F.when(F.col("obj_id").isNull(), "object id is missing")
        .when(F.col("length").isNull(), "edge does not exist")
        .when(F.col("is_query").isNull(), "type is missing")
        .when(F.col("dist_from_start").isNull() | F.isnan("dist_from_start") | (F.col("dist_from_start") < 0), "offset is negative or missing")
        .when(F.col("dist_from_start") > F.col("length"), "offset is beyond the edge")
        .when(F.col("rating").isNotNull() & ~F.col("rating").between(0, 10), "rating is outside 0 to 10")
        .when(F.col("nth") > 1, "object id is repeated")
    )
    marked = joined.withColumn("reason", reason)
    if distinct_offsets:
        place = Window.partitionBy("edge_id", "dist_from_start", F.col("reason").isNull()).orderBy("obj_id")
        marked = marked.withColumn("reason", F.coalesce("reason", F.when(F.row_number().over(place) > 1, F.lit("place is taken"))))
    marked = marked.select(*OBJECTS.names, "reason")
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")
