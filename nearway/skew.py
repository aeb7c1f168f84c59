"""Joins and orders in which one key or line may hold a great share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A key is hot if it has more than this share of a table's rows, but for so few rows; there are at most HOT of them.
HOT, FEW = 1_024, 256
#: Rows of a line that one task orders.
SLOT_ROWS = 4_096


def join_hot(left: DataFrame, right: DataFrame, on: list[str], by: str, how: str = "inner", counted: DataFrame | None = None) -> DataFrame:
    """left joined with right, whose rows are few for each key; the rows of left's hot keys are dealt over many tasks.

    by: a column of left that tells rows of one key apart, whose hash deals them. counted: a table that has left's keys as
    often as left, if left is costly. No more than HOT keys can have more than a share of 1 / HOT of the rows each, so
    what is broadcast is bounded, and the rows of right that are repeated for them number 2 * HOT at most times right's
    rows of a key. Rows without a key meet nothing: if they are hot and how keeps them, they are dealt and nothing is repeated.
    """
    counted = left if counted is None else counted
    least = max(FEW, counted.count() // HOT)
    hot = counted.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / F.lit(least)).cast("int").alias("_spread")).where("_spread > 1").collect()
    if not hot:
        return left.join(right, on, how)
    known = [row for row in hot if None not in row]
    spread = F.broadcast(left.sparkSession.createDataFrame(known, left.select(*on).schema.add("_spread", T.IntegerType())))
    keyless = F.when(F.greatest(*[F.col(c).isNull() for c in on], F.lit(False)), F.lit(2 * HOT))
    dealt = left.join(spread, on, "left").withColumn("_salt", F.pmod(F.xxhash64(by), F.coalesce("_spread", keyless, F.lit(1))).cast("int")).drop("_spread")
    copied = right.join(spread, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_spread", F.lit(1)) - 1))).drop("_spread")
    return dealt.join(copied, [*on, "_salt"], how).drop("_salt")


def slotted(rows: DataFrame, line: str, at: str, slot_rows: int | None = None) -> tuple[DataFrame, bool]:
    """rows with _slot, the part of its line that a row's place is in, and whether any line has several.

    A line has as many slots as it has slot_rows of rows; they are even in place. One number comes to the driver.
    """
    slot_rows = SLOT_ROWS if slot_rows is None else slot_rows
    sizes = rows.groupBy(line).agg(F.ceil(F.count(F.lit(1)) / slot_rows).cast("long").alias("_slots"), F.min(at).alias("_low"), F.max(at).alias("_high"))
    if (sizes.agg(F.max("_slots")).first()[0] or 1) == 1:
        return rows.withColumn("_slot", F.lit(0).cast("long")), False
    share = F.try_divide(F.col(at) - F.col("_low"), F.col("_high") - F.col("_low"))
    placed = rows.join(sizes.where("_slots > 1"), line, "left")  # lines with several slots alone have a row
    return placed.withColumn("_slot", F.coalesce(F.least(F.floor(share * F.col("_slots")).cast("long"), F.col("_slots") - 1), F.lit(0).cast("long"))).drop("_slots", "_low", "_high"), True


def in_order(rows: DataFrame, line: str, at: str, by: list[Column | str], value: Column, descending: bool = False, slot_rows: int | None = None) -> DataFrame:
    """rows with nth (from 1), before and after: each row's number along its line, and the value of its neighbours.

    by is the whole order, and begins with the column `at` (descending if so told). A line's slots are ordered on their
    own, and what a slot doesn't know of its neighbours comes from a summary with a row for each slot.
    """
    rows, several = slotted(rows, line, at, slot_rows)
    own = Window.partitionBy(line, "_slot").orderBy(*by)
    out = rows.withColumn("_value", value).withColumns({"nth": F.row_number().over(own), "before": F.lag("_value").over(own), "after": F.lead("_value").over(own)})
    if several:
        along = Window.partitionBy(line).orderBy(F.col("_slot").desc() if descending else F.col("_slot"))
        ends = out.groupBy(line, "_slot").agg(F.count(F.lit(1)).alias("_n"), F.min_by("_value", "nth").alias("_first"), F.max_by("_value", "nth").alias("_last"))
        ends = ends.select(line, "_slot", (F.sum("_n").over(along) - F.col("_n")).alias("_start"), F.lag("_last").over(along).alias("_lag"), F.lead("_first").over(along).alias("_lead"))
        out = out.join(ends, [line, "_slot"]).withColumns({"nth": F.col("nth") + F.col("_start"), "before": F.coalesce("before", "_lag"), "after": F.coalesce("after", "_lead")}).drop("_start", "_lag", "_lead")
    return out.drop("_value")


def islands(ordered: DataFrame, line: str, new: Column) -> DataFrame:
    """What in_order() returned, with run (a number along the line), seq (from 1) and n: rows from one `new` row to the next."""
    own = Window.partitionBy(line, "_slot").orderBy("nth")
    up_to, rest = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(1, Window.unboundedFollowing)
    start = F.when(F.col("_new"), F.col("nth"))
    out = ordered.withColumn("_new", new).withColumns({"_run": F.count_if("_new").over(up_to), "_from": F.max(start).over(up_to), "_to": F.min(start).over(rest)})
    sums = out.groupBy(line, "_slot").agg(F.count_if("_new").alias("_runs"), F.max(start).alias("_last"), F.min(start).alias("_first"), F.max("nth").alias("_top"))
    along = Window.partitionBy(line).orderBy("_slot")
    before, after = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(1, Window.unboundedFollowing)
    sums = sums.select(line, "_slot", F.coalesce(F.sum("_runs").over(before), F.lit(0)).alias("_earlier"), F.max("_last").over(before).alias("_open"), F.min("_first").over(after).alias("_next"), F.max("_top").over(Window.partitionBy(line)).alias("_all"))
    out = out.join(sums, [line, "_slot"])
    begin, end = F.coalesce("_from", "_open"), F.coalesce("_to", "_next", F.col("_all") + 1)
    return out.withColumns({"run": (F.col("_run") + F.col("_earlier")).cast("int"), "seq": (F.col("nth") - begin + 1).cast("int"), "n": (end - begin).cast("long")}).drop("_new", "_run", "_from", "_to", "_earlier", "_open", "_next", "_all")
