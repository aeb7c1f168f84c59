"""Numbering rows in an order without bringing them to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearway.storage import Workspace


def numbered(df: DataFrame, by: list[str], name: str, first: int = 1) -> DataFrame:
    """df with the row's number in the order of the columns: ranges are numbered within, after those before them.

    The ranges are written once, so that what is counted is what is numbered.
    """
    work = Workspace(df.sparkSession, "numbering", lean=True)
    dealt = work.write(df.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()))
    counts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))  # a row for each task
    before = counts.select("_range", F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_range").orderBy(*by))
    return dealt.withColumn("_nth", nth).join(before, "_range").select(*df.columns, (F.col("_nth") + F.col("_before") + (first - 1)).cast("long").alias(name))
