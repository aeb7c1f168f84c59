"""Substring dedup by hashing lines, and runs of words within them.

Units are lines. A unit is normalised (white space between words, capitals A-Z) and gets a 128-bit digest; digests are
grouped over all documents, the occurrence with the smallest (document, line) is kept and the others go, with the
offsets they had, however short they are. Neighbouring lines that go make one span.

A passage may begin and end within lines, so `repeated_passages` also looks at every run of RUN words, wherever lines
end: the least hash of GRAM words within a run is its anchor, the same in every copy, and the runs of an anchor are
neighbours. Anchors are grouped with all the words of their runs first; runs themselves are grouped only of the first
such stretch, and only if its anchor recurs with other words round it. No copy is missed.

Texts are hashed once for lines and once for stretches, into written tables. A digest that a great share of all rows
have is grouped where its rows are before it is sent, and its rows are dealt over many tasks where they meet the group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearway.llm.common import Workspace, join_hot, unwrapped, wrapped
from nearway.llm.textkernel import Words, buffers, run_digests, slices, words

#: Words of a run that is a passage, over 50; words whose hash is an anchor; words of a reported span, at least. Half of
#: all documents have a shorter line by chance in common with others, a word or two, which is no passage.
RUN, GRAM, LEAST_WORDS = 51, 16, 20


def lines(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """text, line, first word, start and end (code points), words and digest of every line with words, and whether it is
    the text's first such line. Line numbers leave out lines without words."""
    w = words(data, offsets)
    n = len(w.hash)
    if not n:
        return dict.fromkeys(("text", "line", "word", "start", "end", "n", "d1", "d2"), np.zeros(0, np.int64)) | {"fresh": np.zeros(0, bool)}
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(w.first))
    newline = np.concatenate([[0], np.cumsum(data == 10)])
    ends = np.ones(n, bool)
    ends[:-1] = (text[1:] != text[:-1]) | (newline[w.start[1:]] > newline[w.end[:-1]])
    last = np.flatnonzero(ends)
    first = np.concatenate([[0], last[:-1] + 1])
    d1, d2 = run_digests(w.hash, first, last + 1)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    own = text[first]
    base = points[offsets[:-1]][own]
    order = np.lexsort((np.arange(len(first)), d2, d1, own))
    fresh = np.ones(len(first), bool)
    same = (d1[order][1:] == d1[order][:-1]) & (d2[order][1:] == d2[order][:-1]) & (own[order][1:] == own[order][:-1])
    fresh[order[1:][same]] = False
    return {"text": own, "line": np.arange(len(first)) - np.searchsorted(own, np.arange(len(offsets)))[own], "word": first - w.first[own], "start": points[w.start[first]] - base, "end": points[w.end[last]] - base, "n": last + 1 - first, "d1": d1.view(np.int64), "d2": d2.view(np.int64), "fresh": fresh}


def anchors(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """text and first word of every run of RUN words, its anchor's first word, and the hashes by an anchor's place."""
    n = len(w.hash)
    at = np.arange(max(n - RUN + 1, 0))
    if not len(at):
        return at, at, at, np.zeros(0, np.uint64)
    gram = np.arange(n - GRAM + 1)
    hashes, _ = run_digests(w.hash, gram, gram + GRAM)
    text = np.searchsorted(w.first, at, "right") - 1
    inside = at + RUN <= w.first[text + 1]
    text, at = text[inside], at[inside]
    least = np.lib.stride_tricks.sliding_window_view(hashes, RUN - GRAM + 1)
    place = np.empty(len(at), np.int64)
    for i in range(0, len(at), 8_192):
        place[i : i + 8_192] = least[at[i : i + 8_192]].argmin(1)
    return text, at, at + place, hashes


def _gone_lines(rows: DataFrame, work: Workspace) -> DataFrame:
    """doc_id, line, word, start, end, n, kept_doc_id and copies of every line that is kept elsewhere."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            data, offsets = buffers(b.column(1))
            for i, j in slices(offsets):
                u = lines(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j][u["text"]], pa.int64()), *(pa.array(u[c].astype(np.int32)) for c in ("line", "word", "start", "end", "n")), *(pa.array(u[c]) for c in ("d1", "d2", "fresh"))], ["doc_id", "line", "word", "start", "end", "n", "d1", "d2", "fresh"])

    all_lines = work.write(rows.mapInArrow(part, "doc_id long, line int, word int, start int, end int, n int, d1 long, d2 long, fresh boolean"))
    groups = work.write(all_lines.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("kept_doc_id")).where("copies > 1"))
    gone = join_hot(all_lines, groups, ["d1", "d2"], "doc_id").where("not (doc_id = kept_doc_id and fresh)")
    gone = work.write(gone.select("doc_id", "line", "word", "start", "end", "n", "kept_doc_id", "copies").dropDuplicates(["doc_id", "line", "start"]))
    work.drop(all_lines, groups)
    return gone


def _gone_runs(rows: DataFrame, work: Workspace) -> DataFrame:
    """doc_id, word, start, end, n, kept_doc_id and copies of every run of RUN words that stands at an earlier place.

    Neighbouring runs of one anchor that all stand at an earlier place together are one row.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            data, offsets = buffers(b.column(1))
            for i, j in slices(offsets):
                own, ends = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                w = words(own, ends)
                text, at, anchor, hashes = anchors(w)
                new = np.flatnonzero(np.diff(anchor, prepend=-1))  # anchors of later runs are never before
                last = np.append(new[1:], len(at)) - 1 if len(at) else new
                text, begin, end, anchor = text[new], at[new], at[last] + RUN, anchor[new]
                d1, d2 = run_digests(w.hash, begin, end)
                points = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
                base = points[ends[:-1]][text]
                ints = begin - w.first[text], anchor - begin, end - begin, points[w.start[begin]] - base, points[w.end[end - 1]] - base
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j][text], pa.int64()), *(pa.array(c.astype(np.int32)) for c in ints), *(pa.array(d.view(np.int64)) for d in (hashes[anchor], d1, d2))], ["doc_id", "word", "lead", "n", "start", "end", "h", "d1", "d2"])

    ints = "doc_id long, word int, lead int, n int, start int, end int"
    marks = work.write(rows.mapInArrow(mark, f"{ints}, h long, d1 long, d2 long"))
    first = work.write(marks.groupBy("d1", "d2", "lead").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "word")).alias("kept"), F.min("h").alias("h")))
    # of what has the same words as an earlier stretch all runs go, unless the two overlap
    copied = join_hot(marks, first.where("copies > 1").drop("h"), ["d1", "d2", "lead"], "doc_id")
    copied = work.write(copied.select("doc_id", "word", "start", "end", "n", "kept", "copies"))
    work.drop(marks)
    apart = "doc_id <> kept.doc_id or word >= kept.word + n"
    whole = work.write(copied.where(apart).select("doc_id", "word", "start", "end", "n", F.col("kept.doc_id").alias("kept_doc_id"), "copies"))
    # the rest are firsts, and what overlaps them; their runs are looked at if their anchor has other words round it too
    mixed = first.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("h")
    rest = join_hot(first.select("h", "d1", F.col("kept.doc_id").alias("of"), F.col("kept.word").alias("at"), F.col("copies").alias("times")), mixed, ["h"], "d1").select("of", "at", "times")
    overlap = copied.where(f"not ({apart}) and not (doc_id = kept.doc_id and word = kept.word)").select(F.col("doc_id").alias("of"), F.inline(F.array(F.struct(F.col("kept.word").alias("at"), F.col("copies").alias("times")), F.struct(F.col("word").alias("at"), F.lit(0).cast("long").alias("times")))))  # counted with the first
    # at most as many as the longest text of an id has words
    begins = rest.unionByName(overlap).groupBy("of", "at").agg(F.max("times").alias("times"))
    lists = begins.groupBy(F.col("of").alias("doc_id")).agg(F.collect_list(F.struct("at", "times")).alias("begins"))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            data, offsets = buffers(b.column(1))
            held, times = (b.column(2).flatten().field(c).to_numpy(zero_copy_only=False) for c in ("at", "times"))
            bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(b.column(2)).to_numpy())])
            for i, j in slices(offsets):
                own, ends = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                w = words(own, ends)
                text, at, anchor, _ = anchors(w)
                asked = np.full(len(w.hash) + 1, -1, np.int64)
                of = np.repeat(np.arange(j - i), np.diff(bounds[i : j + 1]))
                begin = held[bounds[i] : bounds[j]] + w.first[of]
                inside = begin < w.first[of + 1]
                asked[begin[inside]] = times[bounds[i] : bounds[j]][inside]
                new = np.diff(anchor, prepend=-1) != 0
                stands = asked[at[new]][np.cumsum(new) - 1]
                text, at, stands = text[stands >= 0], at[stands >= 0], stands[stands >= 0]
                d1, d2 = run_digests(w.hash, at, at + RUN)
                points = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
                base = points[ends[:-1]][text]
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j][text], pa.int64()), *(pa.array(c.astype(np.int32)) for c in (at - w.first[text], points[w.start[at]] - base, points[w.end[at + RUN - 1]] - base)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array(stands)], ["doc_id", "word", "start", "end", "d1", "d2", "times"])

    # rows of a hot id are dealt by where they are read
    read = rows.withColumn("at", F.monotonically_increasing_id())
    found = join_hot(read, lists, ["doc_id"], "at", counted=rows.select("doc_id")).select("doc_id", "text", "begins")
    runs = work.write(found.mapInArrow(part, "doc_id long, word int, start int, end int, d1 long, d2 long, times long"))
    work.drop(first, copied)
    earliest = runs.groupBy("d1", "d2").agg(F.sum("times").alias("copies"), F.min(F.struct("doc_id", "word")).alias("kept")).where("copies > 1")
    # a run that overlaps the one that is kept stays
    gone = join_hot(runs, earliest, ["d1", "d2"], "doc_id").where(f"doc_id <> kept.doc_id or word >= kept.word + {RUN}")
    gone = work.write(gone.select("doc_id", "word", "start", "end", F.lit(RUN).alias("n"), F.col("kept.doc_id").alias("kept_doc_id"), "copies"))
    work.drop(runs)
    return whole.unionByName(gone)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """As repeated_spans, but a span also has every word of a run of RUN words or more that stands at an earlier place.

    Places are ordered by document, then by word. A passage of RUN words or more is thus found whole wherever it begins
    and however its lines are broken; lines that go beside it are of its span, and lines of `least_words` words or more
    together are a span of their own. kept_doc_id and copies are those of the span's first line, run or stretch of runs.
    """
    work, rows = Workspace(docs.sparkSession, "passages"), _rows(docs, id_col, text_col)
    columns = ["doc_id", "word", "start", "end", "n", "kept_doc_id", "copies"]
    return _spans(_gone_lines(rows, work).select(columns).unionByName(_gone_runs(rows, work).select(columns)), least_words)


def _spans(pieces: DataFrame, least_words: int) -> DataFrame:
    """Pieces that touch or overlap as one span; a document's pieces are at most as many as its words."""
    before = Window.partitionBy("doc_id").orderBy("word", "start", "n")
    reach = F.max(F.col("word") + F.col("n")).over(before.rowsBetween(Window.unboundedPreceding, -1))
    spans = pieces.withColumn("new", F.when(F.col("word") > reach, 1).otherwise(0)).withColumn("span", F.sum("new").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    made = spans.groupBy("doc_id", "span").agg(F.min("start").cast("long").alias("start"), F.max("end").cast("long").alias("end"), (F.max(F.col("word") + F.col("n")) - F.min("word")).cast("long").alias("words"), F.min_by(F.struct("kept_doc_id", "copies"), F.struct("word", "n")).alias("first"))
    return made.where(F.col("words") >= least_words).select("doc_id", "start", "end", "words", "first.kept_doc_id", "first.copies")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 1) -> DataFrame:
    """A row for each span of whole lines that goes: doc_id, start and end (code points, end exclusive), words, kept_doc_id, copies.

    kept_doc_id is the document that keeps the span's first line, copies the number of that line's occurrences. Every
    line that stands at an earlier place goes, one of a single word too, unless spans of fewer words are to stay. Rows
    that share an id are one document; rows without an id, null and empty texts have no spans and keep nothing for
    others; an empty table gives an empty result; other columns play no part, whatever their names.
    """
    return _spans(_gone_lines(_rows(docs, id_col, text_col), Workspace(docs.sparkSession, "lines")), least_words)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 1, passages: bool = True) -> DataFrame:
    """docs without the spans of repeated_passages (or of repeated_spans), and what each row lost.

    The last column, `removed` (with an underscore more for each such name that docs has), is an array of its spans with
    their original offsets; a row that lost nothing has a null there and keeps its text as it is. Rows without an id, null
    and empty texts lose nothing, rows that share an id lose the same places, and an empty table gives an empty result.
    """
    spans = (repeated_passages if passages else repeated_spans)(docs, id_col, text_col, least_words)
    name = "removed"
    while name in docs.columns:
        name += "_"
    lists = spans.groupBy(F.col("doc_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("start", "end", "kept_doc_id"))).alias("removed"))  # at most as many as a document has words
    rows = docs.select(wrapped(docs), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("at"))
    found = join_hot(rows, lists, ["id"], "at", how="left", counted=rows.select("id")).select("row", "text", "removed")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for text, spans in zip(b.column(1), b.column(2), strict=True):
                whole, gone, at = text.as_py(), spans.as_py(), 0
                if gone and whole:
                    kept = []
                    for x in gone:
                        kept.append(whole[at : x["start"]])
                        at = x["end"]
                    whole = "".join([*kept, whole[at:]])
                made.append(whole)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, b.column(1).type), b.column(2)], ["row", "text", "removed"])

    out = found.mapInArrow(cut, T.StructType(found.schema.fields))
    return out.select(*unwrapped(docs, **{text_col: F.col("text")}), F.col("removed").alias(name))
