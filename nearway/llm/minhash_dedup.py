"""MinHash near-dedup with BagMinHash signatures, banding and exact multiset overlap.

A document is the multiset of its shingles (words in a row). BagMinHash gives every shingle and unit of weight a Poisson
process in time whose points fall on random registers; a register keeps its earliest point. Two documents agree on a
register with the probability of their weighted Jaccard similarity, without bias. Weights are discretised by doubling
intervals (0,1], (1,2], (2,4], ...: an interval is one process of its width's rate, a point of which counts if its
place in the interval is within the document's weight, so a count of thousands costs a dozen processes. Points come
in order of time, and a process stops at the latest register time of its document, so most shingles of a long document
make one point.

Signatures are cut into bands. Documents that agree on a band are compared exactly, on whole multisets: all pairs in a
small bucket; in a large one first every member with a few chosen ones, which joins most of what belongs together. Then,
in every large bucket that still holds several components, each member outside the largest meets all members of other
components: in blocks of bounded size, a task comparing one block with another and returning no more links than it has
documents. So a bucket of thousands of near copies makes no pairs of rows, and no pair that could join two components
is left out. Buckets, texts and chosen members with a great share of all rows are dealt over many tasks (join_hot).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearway.llm.common import Workspace, join_hot, unwrapped, wrapped
from nearway.llm.graph import components, forest
from nearway.llm.textkernel import buffers, mix, occurrences, run_digests, shingles, slices, words

#: Registers are bands x rows. A pair at the threshold of 0.8 meets in a band with probability 0.9999.
BANDS, ROWS = 25, 5
#: Bucket size up to which all pairs are compared at once; members chosen from a larger one, about.
SMALL, CHOSEN = 24, 3
#: Hashes that choose members: the buckets of a group of copies choose about so many times CHOSEN of them together.
CHOICES = 8
#: Rows and shingles of a block, at most (a longer document is a block of its own), and rows of a block that asks.
BLOCK_ROWS, BLOCK_SHINGLES, ASK_ROWS = 1_024, 500_000, 512
GOLDEN = 0x9E3779B97F4A7C15
#: Stands for a null id where rows are joined.
NO_ID = -(1 << 63)


def salt(k: int) -> np.uint64:
    return np.uint64(k * GOLDEN % 2**64)


def bag_minhash(keys: np.ndarray, counts: np.ndarray, first: np.ndarray, registers: int = BANDS * ROWS) -> np.ndarray:
    """Signatures (earliest time on each register) of the multisets keys[first[i]:first[i+1]] with their counts."""
    n = len(first) - 1
    text = np.repeat(np.arange(n), np.diff(first))
    out = np.full(n * registers, np.inf)
    active = []
    level = 0
    while True:
        # interval (low, low + width] of weights; a count takes part if it is above low
        low, width = (0, 1) if level == 0 else (1 << (level - 1), 1 << (level - 1))
        own = counts > low
        if not own.any():
            break
        active.append((text[own], mix(keys[own] + salt(level + 1)), np.full(own.sum(), float(width)), (counts[own] - low) / width))
        level += 1
    if not active:
        return out.reshape(n, registers)
    t, seed, width, reach = (np.concatenate(x) for x in zip(*active, strict=True))
    time, turn = np.zeros(len(t)), 0
    while len(t):
        turn += 1
        u = mix(seed + salt(turn))
        time = time - np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (registers * width)
        register = ((u & np.uint64(2047)).astype(np.int64) * registers) >> 11
        hit = np.ones(len(t), bool)
        part = reach < 1
        if part.any():
            place = (mix(u[part] + np.uint64(1)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            hit[part] = place < reach[part]
        np.minimum.at(out, t[hit] * registers + register[hit], time[hit])
        latest = out.reshape(n, registers).max(1)
        more = time < latest[t]
        t, seed, width, reach, time = t[more], seed[more], width[more], reach[more], time[more]
    return out.reshape(n, registers)


def band_keys(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    bits = signatures[:, : bands * rows].copy().view(np.uint64).reshape(-1, bands, rows)
    h = np.zeros(bits.shape[:2], np.uint64) + np.arange(bands, dtype=np.uint64) * salt(1)
    for j in range(rows):
        h = mix(h ^ mix(bits[:, :, j]))
    return h.view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The first three columns of the rows, number of shingles, 128-bit digest of the words and band keys of the fourth."""
    for b in batches:
        data, offsets = buffers(b.column(3))
        for i, j in slices(offsets):
            w = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            s, first = shingles(w, k)
            keys, counts, own = occurrences(s, first)
            d1, d2 = run_digests(w.hash, w.first[:-1], w.first[1:])
            bands = band_keys(bag_minhash(keys, counts, own))
            yield pa.RecordBatch.from_arrays([*(c[i:j] for c in b.columns[:3]), pa.array(np.diff(first), pa.int64()), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * BANDS, pa.int32()), pa.array(bands.ravel()))], ["doc_id", "rid", "key", "n", "d1", "d2", "bands"])


def _multisets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """node, its shingles as numbers of their own for each occurrence, so that multisets compare as sets, and bands."""
    for b in batches:
        data, offsets = buffers(b.column(1))
        for i, j in slices(offsets):
            s, first = shingles(words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), k)
            keys, counts, own = occurrences(s, first)
            nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            tagged = mix(np.repeat(keys, counts) + nth.astype(np.uint64) * salt(1))
            yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(tagged.view(np.int64))), b.column(2)[i:j]], ["node", "sh", "bands"])


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose multisets overlap enough; a node that was chosen in a large bucket has very many."""
    left, right = sets.select(F.col("node").alias("a"), F.col("sh").alias("sa")), sets.select(F.col("node").alias("b"), F.col("sh").alias("sb"))
    both = join_hot(join_hot(pairs, left, ["a"], "b"), right, ["b"], "a", counted=pairs)
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", shared.alias("shared"), (F.size("sa") + F.size("sb")).alias("total")).where(F.col("shared") >= F.lit(similarity) * (F.col("total") - F.col("shared")) - 1e-9).select("a", "b")


def _block_links(part: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """Links that connect documents of different components in one block of asking rows and one of all rows.

    A pair that meets in an earlier band too is left to that band.
    """
    ask, have = part[part.asks], part[~part.asks]
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 2]
    if len(ask) and len(have):
        ids, comp, n = (have[c].to_numpy() for c in ("node", "at", "n"))
        bands = np.stack(have.bands.to_list())
        order = int(np.flatnonzero((bands == part.band.iloc[0]).all(0))[0])
        tokens, row = np.concatenate(have.sh.to_list()), np.repeat(np.arange(len(have)), n)
        by = np.argsort(tokens, kind="stable")
        tokens, row = tokens[by], row[by]
        for doc, at, size, own, sh in zip(ask.node, ask["at"], ask.n, ask.bands, ask.sh, strict=True):
            can = (comp != at) & (np.minimum(n, size) >= similarity * np.maximum(n, size) - 1e-9)
            can &= ~(bands[:, :order] == own[:order]).any(1)
            if not can.any():
                continue
            left, right = np.searchsorted(tokens, sh, "left"), np.searchsorted(tokens, sh, "right")
            times = right - left
            hits = np.repeat(left - np.cumsum(times) + times, times) + np.arange(times.sum())
            shared = np.bincount(row[hits], minlength=len(have))
            ok = can & (shared >= similarity * (n + size - shared) - 1e-9)
            found.append((np.full(ok.sum(), doc), ids[ok]))
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    node, root = forest(a, b)
    return pd.DataFrame({"a": np.minimum(node, root), "b": np.maximum(node, root)})


def _linked(docs: DataFrame, similarity: float, shingle: int, id_col: str, text_col: str, work: Workspace) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, rid, key, n, d1, d2, bands), nodes (the different texts, with the first row of each) and links.

    A row is known by its id (rid; a null has a number of its own) and a hash of its text (key), so rows that share an
    id but not their text are kept apart.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("rid"), F.xxhash64(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    signed = work.write(texts.mapInArrow(lambda it: _signed(it, shingle), "doc_id long, rid long, key long, n long, d1 long, d2 long, bands array<long>"))
    # a text that a third of all rows share is one row of each task's before it is sent
    first_row = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "rid", "key"))
    nodes = signed.where("n > 0").groupBy("d1", "d2").agg(F.first("n").alias("n"), F.first("bands").alias("bands"), F.min("doc_id").alias("least_id"), first_row.alias("r"))
    nodes = work.write(nodes.select(F.monotonically_increasing_id().alias("node"), "d1", "d2", "n", "bands", "least_id", "r.rid", "r.key"))
    keys = nodes.select("node", "n", F.explode("bands").alias("band"))
    # members are chosen by one of a few hashes, so buckets of the same documents choose some of the same, not all
    order = F.xxhash64("node", F.pmod("band", F.lit(CHOICES)))
    sizes = work.write(keys.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min(order).alias("least")).where("size > 1"))
    members = work.write(join_hot(keys, sizes, ["band"], "node"))
    compared = nodes.join(members.select("node").distinct(), "node", "left_semi").select("rid", "key", "node", "bands")
    # repeated rows of a hot document are dealt by where they are read, and are one row of each task's before they meet
    read = texts.select("rid", "key", "text").withColumn("at", F.monotonically_increasing_id())
    held = join_hot(read, compared, ["rid", "key"], "at", counted=signed).dropDuplicates(["rid", "key"])
    sets = work.write(held.select("node", "text", "bands").mapInArrow(lambda it: _multisets(it, shingle), "node long, sh array<long>, bands array<long>"))

    # all pairs of small buckets; of large ones, members chosen by a fixed hash (one at least) with all
    place = F.pmod(order, F.lit(1 << 40)) / F.lit(float(1 << 40))
    live = members.withColumn("picked", (F.col("size") <= SMALL) | (order == F.col("least")) | (place < F.lit(float(CHOSEN)) / F.col("size")))
    chosen = live.where("picked").select("band", F.col("node").alias("c"), F.col("n").alias("cn"))
    pairs = join_hot(live, chosen, ["band"], "node").where(((F.col("node") < F.col("c")) | (~F.col("picked") & (F.col("node") != F.col("c")))) & (F.least("n", "cn") >= F.lit(similarity) * F.greatest("n", "cn") - 1e-9))
    pairs = work.write(pairs.select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b")).distinct())
    links = work.write(_verified(pairs, sets, similarity))
    reached = work.write(components(links, work))

    # what large buckets still hold apart
    at = members.where(F.col("size") > SMALL).join(reached.withColumnRenamed("component", "to"), "node", "left").select("band", "size", "node", "n", F.coalesce("to", "node").alias("at"))
    at = work.write(at)
    most = at.groupBy("band", "at").agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("n")).groupBy("band").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("k", "at")).alias("m"), F.max("n").alias("longest")).where("parts > 1")
    rows = F.greatest(F.lit(1), F.least(F.lit(BLOCK_ROWS), F.floor(F.lit(BLOCK_SHINGLES) / F.col("longest"))))
    grid = work.write(most.select("band", F.col("m.at").alias("main"), rows.alias("rows"), F.least(F.lit(ASK_ROWS), rows).alias("ask_rows"), F.col("m.k").alias("main_size")))
    if not grid.isEmpty():
        apart = join_hot(at, grid, ["band"], "node").withColumn("blocks", F.ceil(F.col("size") / F.col("rows")).cast("int")).withColumn("chunks", F.ceil((F.col("size") - F.col("main_size")) / F.col("ask_rows")).cast("int"))
        deal = lambda c, of: F.pmod(F.xxhash64("node", F.lit(of)), F.col(c)).cast("int")
        each_of = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        asks = apart.where(F.col("at") != F.col("main")).select("band", each_of("blocks").alias("block"), deal("chunks", 3).alias("chunk"), "node", "at", "n", F.lit(True).alias("asks"))
        met = asks.select("band", "block", "chunk").distinct()
        have = apart.select("band", deal("blocks", 5).alias("block"), each_of("chunks").alias("chunk"), "node", "at", "n", F.lit(False).alias("asks")).join(met, ["band", "block", "chunk"], "left_semi")
        met_rows = asks.unionByName(have).join(sets, "node")
        further = met_rows.groupBy("band", "block", "chunk").applyInPandas(lambda part: _block_links(part, similarity), "a long, b long")
        links = work.write(links.unionByName(further))
    for done in (pairs, members, sets, at, sizes, reached):
        work.drop(done)
    return signed, nodes, links


def near_duplicates(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (the smallest id of its class) and kept (doc_id = class_id) of every row.

    Documents are in a class if links lead from one to the other; a link is a weighted Jaccard similarity of at least
    `similarity` of their shingles (texts of fewer words make one shingle). Equal texts (up to white space and A-Z)
    are one node, so copies cost no pairs. Rows that share an id are one document: their classes are one, whatever
    their texts, and repeated rows have the same class each. Null texts and texts without words are classes of their
    own; rows without an id have none, but their texts link others; an empty table gives an empty result; other columns
    play no part, whatever their names.
    """
    work = Workspace(docs.sparkSession, "minhash")
    signed, nodes, links = _linked(docs, similarity, shingle, id_col, text_col, work)
    # ids with several texts link these; one id may have very many, and one text very many ids
    several = work.write(signed.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("d1").alias("d"), F.max("d1").alias("e")).where("d <> e").select("doc_id"))
    if not several.isEmpty():
        told = work.write(join_hot(signed.where("n > 0").select("doc_id", "d1", "d2").distinct(), several, ["doc_id"], "d1", how="left_semi", counted=signed.select("doc_id")))
        theirs = work.write(join_hot(told, nodes.select("d1", "d2", "node"), ["d1", "d2"], "doc_id").select("doc_id", "node"))
        least = theirs.groupBy("doc_id").agg(F.min("node").alias("a"))
        links = links.unionByName(join_hot(theirs, least, ["doc_id"], "node").select("a", F.col("node").alias("b")))
    classes = _least_of_classes(nodes, links, F.min("least_id").alias("class_id"), work)
    found = join_hot(signed.where("n > 0").select("doc_id", "d1", "d2"), classes.select("d1", "d2", "class_id"), ["d1", "d2"], "doc_id").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"))
    out = found.unionByName(signed.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False)))


def _least_of_classes(nodes: DataFrame, links: DataFrame, least, work: Workspace) -> DataFrame:
    """nodes with the aggregate `least` of all nodes of their class; most classes are one node."""
    flat = work.write(nodes.drop("bands").join(components(links, work), "node", "left").withColumn("component", F.coalesce("component", "node")))
    return work.write(join_hot(flat.drop("class_id"), flat.groupBy("component").agg(least), ["component"], "node"))


def drop_near_duplicates(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class of texts: that with the smallest id, then by a hash of the text.

    Rows without an id come last. A row goes only if another one that links to it is kept, so rows that share an id but
    no text stay each; of repeated rows one stays. Texts without words are no duplicates, but for repeated rows.
    """
    work = Workspace(docs.sparkSession, "distinct")
    signed, nodes, links = _linked(docs, similarity, shingle, id_col, text_col, work)
    first = F.min(F.struct((F.col("rid") == F.lit(NO_ID)).alias("z"), "rid", "key")).alias("first")
    kept = _least_of_classes(nodes, links, first, work).where("rid = first.rid and key = first.key").select("rid", "key").unionByName(signed.where("n = 0").select("rid", "key").distinct())
    hashed = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
    rows = docs.select(wrapped(docs), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("rid"), F.xxhash64(F.col(text_col)).alias("key"), F.xxhash64(*hashed).alias("h"))
    # repeated rows are one row of each task's before they are sent
    return rows.groupBy("rid", "key").agg(F.min_by("row", "h").alias("row")).join(kept, ["rid", "key"], "left_semi").select(*unwrapped(docs))
