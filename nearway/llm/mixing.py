"""Mixing sources to target weights, with DataFrame functions alone.

Every document gets a key that is random but fixed (the md5 of its id). Within each source the documents are cut to
ranges of that key, so many that a range holds some thousands of rows whatever a source's size; sums of the ranges and
then sums within a range give each document's distributed prefix sum of words, and the source is cut at its budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearway.llm.common import Workspace, unwrapped, wrapped
from nearway.skew import HOT

#: Rows that a range of keys is meant to hold, and equal rows that one task makes anew.
RANGE_ROWS, SAME_ROWS = 4_000, 65_536


def word_count(text: Column) -> Column:
    """Number of runs of characters other than blank, tab, newline, vertical tab, form feed and carriage return."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """source, source_size and target of each source.

    sizes has a row for each source. Weights repeat over the sources by code point, null last. All words are shared
    by weight; a target stops at `most` times its source's size, and the excess is shared anew by weight. That level
    of words a weight is found by ascending size a weight: the first so many sources are full.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    level = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    up_to, before = level.rowsBetween(Window.unboundedPreceding, 0), level.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = sizes.withColumn("w", w).withColumns({
        "total": F.sum("source_size").over(all_rows),
        "w_all": F.sum("w").over(all_rows),
        "full_before": F.coalesce(F.sum("source_size").over(before), F.lit(0)),
        "w_before": F.coalesce(F.sum("w").over(before), F.lit(0.0)),
    })
    # with all smaller ones full, would this source get more than it may?
    s = s.withColumn("share", (F.col("total") - F.lit(float(most)) * F.col("full_before")) / (F.col("w_all") - F.col("w_before")))
    s = s.withColumn("over", F.col("share") * F.col("w") > F.lit(float(most)) * F.col("source_size"))
    s = s.withColumn("level", F.min(F.when(~F.col("over"), F.struct(F.col("source_size") / F.col("w"), F.row_number().over(level), "share"))).over(all_rows)["share"])
    return s.select("source", "source_size", F.when(F.col("over") & (F.col("level").isNull() | (F.col("level") * F.col("w") > F.lit(float(most)) * F.col("source_size"))), F.lit(float(most)) * F.col("source_size")).otherwise(F.col("level") * F.col("w")).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Id, size, source_size, target and taken (words taken, repeats counted) of every document.

    A source gives whole epochs of all its documents first, then documents by key until its budget is met exactly; the
    last of these is cut. A document without an id is known by its text. A null text has no words and gives none; a null
    source is a source of its own, after the others; repeated rows count each, and stand together; an empty table gives
    an empty result, and a table without words targets of 0. Other columns play no part, whatever their names.
    Rows of one id and size are a row with a number, before they are sent, and become rows again over many tasks.
    """
    # words are counted once, into a table of numbers
    work = Workspace(docs.sparkSession, "mixing")
    sized = _sized(docs, id_col, text_col, source_col).drop("text")
    rows, seen = work.write_seen(sized.groupBy("source", "key", "doc_id", "size").agg(F.count(F.lit(1)).alias("times")), most=F.max("times"))
    taken = _taken(rows, rows, weights, most, range_rows)
    chunk = F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / SAME_ROWS))
    taken = taken.withColumn("chunk", F.explode(chunk))
    if (seen["most"] or 0) > SAME_ROWS:
        taken = taken.repartition("key", "chunk")
    low = F.col("chunk") * SAME_ROWS
    each = taken.withColumn("nth", F.explode(F.sequence(low, F.least(low + SAME_ROWS, F.col("times")) - 1)))
    return each.select("doc_id", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), _words_of("nth"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    """doc_id, source, text, size and key of every row, and more."""
    text = F.col(text_col)
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), text.alias("text"), word_count(text).alias("size"), key.alias("key"), *more)


def _taken(rows: DataFrame, sizes: DataFrame, weights: tuple[float, ...], most: float, range_rows: int) -> DataFrame:
    """rows with source_size, target, epochs, rest and taken; sizes are the same rows' sources, sizes and keys, written.

    A row may stand for so many equal ones (times); taken is then that of the first, and rest what is left before it.
    If rows have a `part`, those of one key are dealt by size and part where they are more than a task should order.
    """
    weight = F.col("size") * F.col("times") if "times" in rows.columns else F.col("size")
    # as many key ranges as there are range_rows of rows; the count is one number
    n_ranges = max(1, -(-sizes.count() // range_rows))
    slot = (F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * n_ranges / 2**32).cast("long")
    if "part" in sizes.columns:
        slot = _dealt(sizes, slot, n_ranges, range_rows)
    ranges = sizes.groupBy("source", slot.alias("slot")).agg(F.sum(weight).alias("slot_size"))
    aims = targets(ranges.groupBy("source").agg(F.sum("slot_size").alias("source_size")), weights, most)
    earlier = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("slots_before", F.coalesce(F.sum("slot_size").over(earlier), F.lit(0))).drop("slot_size")
    plan = ranges.join(aims.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # the same partitioning serves the window and the join; structs are equal where they hold the same null, and a null-safe
    # comparison would have rows moved once more for the join, whenever they are ready before the plan is
    place = F.struct("source", "slot")
    inside = Window.partitionBy("place").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("slot", slot).withColumn("place", place).withColumn("in_slot", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    out = rows.join(plan.select(place.alias("p_place"), "slots_before", "source_size", "target"), F.col("place") == F.col("p_place"))
    size, budget = F.col("size"), F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - epochs * F.col("source_size") - F.col("slots_before") - F.col("in_slot")
    return out.withColumns({"epochs": epochs, "rest": rest}).withColumn("taken", _words_of())


def _dealt(sizes: DataFrame, slot: Column, n_ranges: int, range_rows: int) -> Column:
    """slot, cut further where a key has more rows than several ranges: by key, and that key's rows by size and part.

    The order of slots stays that of key and size. No more than HOT keys have more than a share of 1 / HOT of all rows.
    """
    most = max(4 * range_rows, n_ranges * range_rows // HOT)
    hot = sizes.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(slot).alias("slot")).where(F.col("n") > most).collect()
    if not hot:
        return slot
    within, own = slot.isin(sorted({x["slot"] for x in hot})), F.col("key").isin([x["key"] for x in hot])
    parts = min(HOT, -(-max(x["n"] for x in hot) // range_rows))
    return F.struct(
        slot.alias("slot"),
        F.when(within, F.col("key")).otherwise("").alias("key"),
        F.when(own, F.col("size")).otherwise(0).alias("size"),
        F.when(own, F.pmod("part", F.lit(parts))).otherwise(0).alias("part"),
    )


def _words_of(nth: str | None = None) -> Column:
    """Words taken of the nth (from 0) of equal rows."""
    size, rest = F.col("size"), F.col("rest") if nth is None else F.col("rest") - F.col(nth) * F.col("size")
    return (F.col("epochs") * size + F.greatest(F.lit(0), F.least(size, rest))).cast("long").alias("taken")


def mixed_rows(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", range_rows: int = RANGE_ROWS) -> DataFrame:
    """docs as the mix of mix_sources takes them: each whole copy is a row, and a cut document's last row has its first words.

    A document of which nothing is taken goes, one without words too (a mix of words takes none of it). Every row is
    taken on its own, those that share an id or have none too. Rows move once, with their texts, to their key ranges;
    texts that share an id may be many, and take as many ranges.
    """
    work, part = Workspace(docs.sparkSession, "mixed"), F.xxhash64(text_col).alias("part")
    sizes = work.write(_sized(docs, id_col, text_col, source_col, part).drop("text", "doc_id"))
    # a text moves as a part of its row alone
    rows = _sized(docs, id_col, text_col, source_col, wrapped(docs), part).drop("text")
    rows = _taken(rows, sizes, weights, most, range_rows).where("taken > 0").withColumn("text", F.col("row").getField(text_col))
    whole, cut_to = F.floor(F.col("taken") / F.col("size")).cast("int"), F.col("taken") % F.col("size")
    copies = F.concat(F.array_repeat(F.lit(-1).cast("long"), whole), F.when(cut_to > 0, F.array(cut_to)).otherwise(F.expr("cast(array() as array<bigint>)")))
    rows = rows.select("row", "text", F.explode(copies).alias("words"))
    # the first words with the white space before each; only a cut row is parted into words
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), 1, F.greatest(F.col("words"), F.lit(0)).cast("int")), "")
    out = rows.withColumn("made", F.when(F.col("words") < 0, F.col("text")).otherwise(cut))
    instead = {text_col: F.col("made")}
    if "n_chars" in docs.columns:
        instead["n_chars"] = F.when(F.col("words") < 0, F.col("row.n_chars")).otherwise(F.length("made"))
    return out.select(*unwrapped(docs, **instead))
