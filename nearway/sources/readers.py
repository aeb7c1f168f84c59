"""Readers of network files: headerless text, columns by a blank or a comma, rows of another width left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearway.operators.numbering import numbered

BOM = "﻿"


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """value and line (from 1, through all files in the order of their paths), without a BOM and carriage returns."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"))
    value = F.regexp_replace(F.regexp_replace("value", f"^{BOM}", ""), "\r$", "")
    return numbered(raw.withColumn("value", value), ["file", "block", "nth"], "line").select("value", "line")


def fields(spark: SparkSession, path: str | list[str], separator: str) -> DataFrame:
    """f, the fields of every line; no order."""
    clean = F.trim(F.regexp_replace(F.regexp_replace("value", f"^{BOM}", ""), "\r$", ""))
    return spark.read.text(path).select(F.split(clean, r"\s+" if separator == " " else separator).alias("f"))


def _num(i: int, kind: str = "long") -> Column:
    return F.expr(f"try_cast(trim(f[{i}]) AS {kind})")


def _at(width: int) -> Column:
    return F.size("f") == width


def read_nodes(spark: SparkSession, path: str, separator: str = " ") -> DataFrame:
    """node_id, longitude, latitude from `id lon lat` or `seq id lon lat`."""
    f = fields(spark, path, separator)
    skip = F.when(_at(4), 1).when(_at(3), 0)
    at = lambda i, kind: F.expr(f"try_cast(trim(try_element_at(f, {i + 1} + size(f) - 3)) AS {kind})")
    return f.where(skip.isNotNull()).select(at(0, "long").alias("node_id"), at(1, "double").alias("longitude"), at(2, "double").alias("latitude")).where("node_id is not null")


def _split(separator: str) -> Column:
    return F.split(F.trim("value"), r"\s+" if separator == " " else separator).alias("f")


def read_edges(spark: SparkSession, path: str, separator: str = " ", renumber: bool = False, by_line: bool = False) -> DataFrame:
    """edge_id, start_node, end_node, length from `id start end length`.

    Renumbered from 1 by id if asked, or in the order of lines, through all files, so that repeated ids stay apart.
    """
    rows = lines(spark, path).select(_split(separator), "line") if by_line else fields(spark, path, separator).withColumn("line", F.lit(0))
    e = rows.where(_at(4)).select(_num(0).alias("edge_id"), _num(1).alias("start_node"), _num(2).alias("end_node"), _num(3, "double").alias("length"), "line")
    e = e.where("edge_id is not null")
    if renumber or by_line:
        e = numbered(e, ["line" if by_line else "edge_id"], "n").withColumn("edge_id", F.col("n"))
    return e.select("edge_id", "start_node", "end_node", "length")


def read_edge_lengths(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    return read_edges(spark, path, separator).select("length")


def _truth(i: int) -> Column:
    v = F.lower(F.trim(F.col("f")[i]))
    return F.when(v.isin("t", "true"), True).when(v.isin("f", "false"), False)


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """obj_id, edge_id, is_query, dist_from_start from `obj T|F offset edge` (or true|false); the header line is left out."""
    f = fields(spark, path, " ").where(_at(4) & ~F.col("f")[0].startswith("#"))
    return f.select(_num(0).alias("obj_id"), _num(3).alias("edge_id"), _truth(1).alias("is_query"), _num(2, "double").alias("dist_from_start")).where("obj_id is not null")


def read_objects_csv(spark: SparkSession, path: str) -> DataFrame:
    """The same from `edge,obj,true|false,offset`."""
    f = fields(spark, path, ",").where(_at(4))
    return f.select(_num(1).alias("obj_id"), _num(0).alias("edge_id"), _truth(2).alias("is_query"), _num(3, "double").alias("dist_from_start")).where("obj_id is not null")


def read_merged(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Edges and objects from lines `start end length n`, each followed by a line `obj offset obj offset ...` if n > 0.

    Edges are numbered from 1 in the order of their lines; objects have no type. A line that could be an edge line with
    objects is followed by an object line if it is an edge line itself, so kinds alternate within a run of such lines,
    and the first of a run is an edge line. Runs are found by numbering, without a window over the whole file.
    """
    rows = numbered(lines(spark, path).where("trim(value) <> ''").withColumn("f", F.split(F.trim("value"), r"\s+")), ["line"], "k")
    could = numbered(rows.where("size(f) = 4 and try_cast(f[3] AS int) > 0").select("k"), ["k"], "m").withColumn("island", F.col("k") - F.col("m"))
    first = could.groupBy("island").agg(F.min("k").alias("first"))
    owners = could.join(first, "island").where((F.col("k") - F.col("first")) % 2 == 0).select((F.col("k") + 1).alias("k"), F.lit(True).alias("owned"))
    kind = rows.join(owners, "k", "left")
    edges = numbered(kind.where("owned is null and size(f) = 4"), ["k"], "edge_id")
    out = edges.select("edge_id", _num(0).alias("start_node"), _num(1).alias("end_node"), _num(2, "double").alias("length"))
    owned = kind.where("owned").select((F.col("k") - 1).alias("k"), "f").join(edges.select("k", "edge_id"), "k").where("size(f) > 1")
    pair = F.explode(F.expr("transform(sequence(0, int(size(f) / 2) - 1), i -> struct(try_cast(f[2 * i] AS long) AS obj_id, try_cast(f[2 * i + 1] AS double) AS off))")).alias("o")
    return out, owned.select("edge_id", pair).select("o.obj_id", "edge_id", F.col("o.off").alias("dist_from_start"))


def read_poi(spark: SparkSession, path: str) -> DataFrame:
    """obj_id (the line's number), longitude, latitude, category_id from `lon,lat,category`."""
    f = lines(spark, path).withColumn("f", F.split("value", ",")).where(_at(3))
    return numbered(f, ["line"], "obj_id").select("obj_id", _num(0, "double").alias("longitude"), _num(1, "double").alias("latitude"), _num(2, "int").alias("category_id"))


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    """category_id, name, is_query from `id,name,true|false` (the type may be missing)."""
    f = fields(spark, path, ",").where(F.size("f").isin(2, 3))
    return f.select(_num(0, "int").alias("category_id"), F.trim(F.col("f")[1]).alias("name"), F.expr("CASE lower(trim(try_element_at(f, 3))) WHEN 'true' THEN true WHEN 'false' THEN false END").alias("is_query"))


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """line, part_id from a partition file, one number a line."""
    return lines(spark, path).select("line", F.expr("try_cast(trim(value) AS int)").alias("part_id")).where("part_id is not null")


def read_metis(spark: SparkSession, path: str) -> DataFrame:
    """node_id, neighbours (array) from a METIS graph: a header, then a line for each node."""
    split = F.when(F.trim("value") == "", F.expr("cast(array() AS array<bigint>)")).otherwise(F.split(F.trim("value"), r"\s+").cast("array<long>"))
    return lines(spark, path).where("line > 1").select((F.col("line") - 1).alias("node_id"), split.alias("neighbours"))


def metis_adjacency(metis: DataFrame) -> DataFrame:
    return metis.select(F.col("node_id").alias("src"), F.explode("neighbours").alias("dst"))


def read_node_clusters(spark: SparkSession, path: str) -> DataFrame:
    """chain_id, pos, node_id from `idx,[a, b, c]`."""
    raw = spark.read.text(path).select(F.split("value", ",", 2).alias("f")).where("size(f) = 2")
    nodes = F.split(F.regexp_replace(F.col("f")[1], r'[\[\]"\s]', ""), ",")
    return raw.select(_num(0).alias("chain_id"), F.posexplode(nodes).alias("pos", "node")).select("chain_id", F.col("pos").cast("long").alias("pos"), F.expr("try_cast(node AS long)").alias("node_id")).where("node_id is not null")


def read_object_parameters(spark: SparkSession, path: str) -> DataFrame:
    """dataset, n_objects, parameter from `DATASET n param`."""
    f = fields(spark, path, " ").where(_at(3))
    return f.select(F.col("f")[0].alias("dataset"), _num(1).alias("n_objects"), _num(2, "double").alias("parameter"))


def word_count(text: DataFrame, column: str = "value") -> DataFrame:
    """word, n: words parted by single blanks, empty ones too; a hot word is summed before the shuffle."""
    return text.select(F.explode(F.split(column, " ")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def latest_rows(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by the order: what a later row of a file replaces."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).where("_n = 1").drop("_n")
