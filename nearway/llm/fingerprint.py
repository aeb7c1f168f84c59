"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last eight bytes decides where a text is cut, so a change in one place moves no cut elsewhere. Each
chunk gives one symbol of two characters, and a fingerprint is `block:symbols:symbols`: the text's block size (a power of
two, chosen by its length alone) and its chunks' symbols at that block size and at twice as much. Fingerprints are
compared where they have a block size in common, by the edit distance of their symbols.

Chunks have a quarter of the block size at least and four times as much at most, counted from the cut before; hence texts
of one repeated character are cut as well, and no fingerprint has more than 4 * SYMBOLS symbols at its block size.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import pandas_udf

from nearway.llm.common import Workspace

#: A text's block size is the least power of two, from LEAST_BLOCK on, of which it has no more than SYMBOLS.
SYMBOLS, LEAST_BLOCK = 128, 4
#: Bytes whose rolling hashes are held at a time.
PIECE = 1 << 18
WINDOW = 8
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
PAIRS = [a + b for a in ALPHABET for b in ALPHABET]
U = np.uint64


def block_bits(n: int) -> int:
    """The logarithm of the block size of a text of n bytes."""
    bits = LEAST_BLOCK.bit_length() - 1
    while n > SYMBOLS << bits:
        bits += 1
    return bits


def triggers(data: bytes, bits: int) -> tuple[list[int], list[int]]:
    """Places after which the rolling hash calls for a cut, for block sizes 2**bits and 2**(bits + 1).

    The hash is h = (h << 8 | byte) modulo 2**64, which forgets what is over eight bytes back, scrambled by a multiplication.
    """
    single, double = [], []
    for at in range(0, len(data), PIECE):
        back = min(at, WINDOW - 1)
        h = np.zeros(WINDOW - 1 + min(PIECE, len(data) - at), U)
        h[WINDOW - 1 - back :] = np.frombuffer(data, np.uint8, min(PIECE, len(data) - at) + back, at - back)
        for step in (1, 2, 4):  # two, four, and then eight bytes
            h[step:] |= h[:-step] << U(8 * step)
        top = (h[WINDOW - 1 :] * U(0x9E3779B97F4A7C15)) >> U(63 - bits)
        hit = np.flatnonzero(top >> U(1) == U((1 << bits) - 1))
        single.append(hit + (at + 1))
        double.append(hit[top[hit] == U((2 << bits) - 1)] + (at + 1))
    return np.concatenate(single).tolist(), np.concatenate(double).tolist()


def symbols(data: bytes, cuts: list[int], block: int) -> str:
    """Two characters for each chunk; a chunk ends at the first cut of a quarter to four times the block size on."""
    out, at, n, view = [], 0, len(data), memoryview(data)
    while at < n:
        k = bisect_left(cuts, at + block // 4)
        end = min(cuts[k] if k < len(cuts) else n, at + 4 * block, n)
        out.append(PAIRS[zlib.crc32(view[at:end]) >> 20])
        at = end
    return "".join(out)


def fingerprint(data: bytes) -> str:
    """The fingerprint of a text's bytes; that of an empty text is `4::`."""
    if not data:
        return f"{LEAST_BLOCK}::"
    bits = block_bits(len(data))
    single, double = triggers(data, bits)
    return f"{1 << bits}:{symbols(data, single, 1 << bits)}:{symbols(data, double, 2 << bits)}"


def edit_distance(a: list, b: list) -> int:
    """Insertions, deletions and changes from a to b; columns of the table are bits of a number, of any length."""
    if not a or not b:
        return max(len(a), len(b))
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance = full, 0, len(a)  # where the distance rises, or falls, from a row to the next
    for x in b:
        same = at.get(x, 0)
        level = (((same & up) + up) ^ up) | same | down
        right, left = down | ~(level | up) & full, up & level
        distance += bool(right & last) - bool(left & last)
        right = right << 1 | 1
        up, down = (left << 1 | ~(level | right)) & full, right & level
    return distance


def likeness(a: str | None, b: str | None) -> float | None:
    """From 0 to 1: one less the edit distance over the longer's symbols, the best of the block sizes in common.

    Without one it is 0, equal fingerprints are 1 alike, and a null gives a null.
    """
    if a is None or b is None:
        return None
    if a == b:
        return 1.0
    mine, other = _parts(a), _parts(b)
    best = 0.0
    for block in mine.keys() & other.keys():
        x, y = mine[block], other[block]
        if x and y:
            best = max(best, 1 - edit_distance(x, y) / max(len(x), len(y)))
    return best


def _parts(text: str) -> dict[int, list[str]]:
    block, single, double = text.split(":")
    cut = lambda s: [s[i : i + 2] for i in range(0, len(s), 2)]
    return {int(block): cut(single), 2 * int(block): cut(double)}


@pandas_udf(T.StringType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint((t or "").encode()) for t in texts], dtype=object)


@pandas_udf(T.DoubleType())
def _likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([likeness(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def with_fingerprints(docs: DataFrame, text_col: str = "text", name: str = "fingerprint") -> DataFrame:
    """docs with a column more (in place of one of that name): the fingerprint of every whole text.

    Null and empty texts have that of an empty text, texts of any length are hashed in pieces, equal texts have equal
    fingerprints, repeated rows and other columns stay, and an empty table stays empty.
    """
    return docs.withColumn(name, _fingerprints(F.col(f"`{text_col}`")))


def likeness_of(a: Column, b: Column) -> Column:
    """likeness() of two columns of fingerprints."""
    return _likeness(a, b)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: A task's rows and, for the seams between tasks, its first and last text.
PARTIAL = f"{SCHEMA}, task int, place string, text string"


def edited(text: str, following: str) -> str:
    """text with its last third replaced by as much, or all, of the text that follows."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _row(doc_id: int | None, text: str, own: str, following: str, theirs: str) -> tuple:
    changed = edited(text, following).encode()
    mark = fingerprint(changed)
    return doc_id, len(text), hashlib.sha256(changed).hexdigest(), own, mark, likeness(own, mark), likeness(own, theirs)


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[f.dataType.simpleString()]) for c, f in zip(columns, schema, strict=True)], schema.names)


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint, that of its text with the last third edited, and how alike they and the next one's are.

    The next document is that of the next smaller id (after the last: the first), whose beginning replaces the third;
    null ids come last, and rows that share an id follow each other by a hash of their texts. Null texts are empty, an
    empty table gives an empty result, a single row is its own next one, and repeated rows have a row each.

    Texts move once, to ranges of ids, where each task reads its own in order; equal rows are dealt by where they are
    read, which no result depends on, so that no id is one task's. Only the first and last text of each task meet again.
    """
    work, schema = Workspace(docs.sparkSession, "fingerprint"), T.StructType.fromDDL(PARTIAL)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie"), F.col("origin")]
    dealt = rows.withColumns({"tie": F.xxhash64("text"), "origin": F.monotonically_increasing_id()}).repartitionByRange(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, before = TaskContext.get().partitionId(), None
        seam = (None,) * 6
        for b in batches:
            out = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py()
                mark = fingerprint(text.encode())
                if before is None:
                    out.append((doc_id, *seam, task, "first", text))
                else:
                    out.append((*_row(*before, text, mark), task, None, None))
                before = (doc_id, text, mark)
            yield _batch(out, schema)
        if before is not None:
            yield _batch([(before[0], *seam, task, "last", before[1])], schema)

    made = work.write(dealt.sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(run, schema))
    # a row for each task that has rows: which task's texts follow its own
    tasks = made.where("place = 'first'").select("task")
    along = Window.orderBy("task")
    after = tasks.select("task", F.coalesce(F.lead("task").over(along), F.min("task").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("next_task"))
    first = made.where("place = 'first'").select(F.col("task").alias("next_task"), F.col("text").alias("following"))
    seams = made.where("place = 'last'").select("doc_id", "text", "task").join(after, "task").join(first, "next_task").select("doc_id", "text", "following")
    plain = T.StructType.fromDDL(SCHEMA)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [(d, t, f) for d, t, f in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield _batch([_row(d, t, fingerprint(t.encode()), f, fingerprint(f.encode())) for d, t, f in texts], plain)

    return made.where("place is null").select(*plain.names).unionByName(work.write(seams.mapInArrow(join, plain)))
