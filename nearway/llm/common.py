"""Shared pieces of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearway.skew import join_hot
from nearway.storage import Workspace, shared_root

__all__ = ["Workspace", "crc_mod", "join_hot", "shared_root", "table", "unwrapped", "wrapped"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables of a data directory; Spark alone opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, n: int):
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


def wrapped(docs: DataFrame):
    """All columns of docs as one struct column, so that no column added beside it can clash with one of docs."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def unwrapped(docs: DataFrame, **instead) -> list:
    """The columns of docs out of `row`, with their types; instead: what takes the place of some."""
    return [instead[c].cast(docs.schema[c].dataType).alias(c) if c in instead else F.col("row").getField(c).alias(c) for c in docs.columns]
