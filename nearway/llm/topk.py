"""Exact top-k search by inner product over an impact-ordered index, score at a time.

A component x becomes the integer floor(scale * x), its quantised impact. A part of the rows is indexed by postings
(dimension, row, impact), in segments by the magnitude of the impact, a power of two each and by dimension within;
impacts of zero have none. Segments are processed by descending impact, for some queries at once; a thin segment goes
by its postings, of which those of dimensions that no query weighs are skipped, and a full one as a block. What is left of a row can change its score by at most the length of the query times the
length of the row's unprocessed part, and by at most the sum over dimensions of the query's weight times the greatest
impact left; a row is a possible member of the answer if its score plus that bound reaches the k-th best score minus
bound, or the k-th best of the parts before. Processing stops for a query as soon as it is cheaper to score its possible
members from their vectors than to go on; the bound proves that they hold the answer, and they are rescored exactly.

Scores are whole numbers of any size. Accumulators are floats where those are exact, else the bound has their rounding;
rescoring is in whole numbers throughout.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a shard and queries of a block: what one task holds.
SHARD_ROWS, BLOCK_QUERIES = 65_536, 16_384
#: Rows indexed together, and queries scored together: their accumulators stay in a core's cache.
PART_ROWS, AT_ONCE = 8_192, 64
#: The share of a block that postings must fill for it to be scored by a product of matrices.
THIN = 1 / 32
#: The greatest long.
LONGEST = (1 << 63) - 1


class ImpactIndex:
    """Segments of postings of some rows by descending impact, and what is left after each.

    The first segment has the greatest impacts, half of all postings or more; each further one has a power of two. A
    segment that is thinner than THIN keeps its postings by dimension, a fuller one is cheaper as a block.
    """

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        self.vectors, self.ids, self.dims = vectors, ids, vectors.shape[1]
        self.most = int(np.abs(vectors).max(initial=0))
        self.kind = np.float32 if self.most < 1 << 24 else np.float64
        self.segments: list[tuple] = []
        size, impact = np.abs(vectors.astype(np.float64)), vectors.astype(self.kind)
        left = self.total = int(np.count_nonzero(size))
        self.processed, above, level = 0, np.inf, 1 << max(self.most.bit_length() - 1, 0)
        while left:
            floor = float(max(level, 1))
            below = size < floor
            after = int(np.count_nonzero(size[below])) if floor > 1 else 0
            if after < left and (after <= self.total // 2 or not after):
                part = ~below & (size < above)
                if left - after < THIN * vectors.size:
                    dim, row = np.nonzero(part.T)
                    held = (np.searchsorted(dim, np.arange(self.dims + 1)), row, impact[row, dim])
                else:
                    held = (np.where(part, impact, 0).T,)
                rest = np.where(below, size, 0) if after else np.zeros((len(ids), 1))
                self.segments.append((held, left - after, np.sqrt((rest**2).sum(1)), np.broadcast_to(rest.max(0, initial=0), self.dims), after))
                left, above = after, floor
            level //= 2

    def _members(self, queries: np.ndarray, own: np.ndarray, k: int, floors: np.ndarray) -> list[np.ndarray]:
        """For each query the rows that can be among its k best; floors: scores that they must reach."""
        n, size = len(self.ids), np.abs(queries.astype(np.float64))
        greatest = float(size.max(initial=0)) * self.most * self.dims
        members: list[np.ndarray] = [np.arange(n)] * len(queries)
        if not greatest < 1e300 or n <= k:
            return members
        kind = np.float32 if greatest < 1 << 24 else np.float64
        rounding = 0.0 if greatest < 1 << 53 else greatest * self.dims * 2.0**-50
        open_, weights, length = np.arange(len(queries)), queries.astype(kind), np.sqrt((size**2).sum(1))
        scores, known = np.zeros((len(queries), n), kind), np.isfinite(floors).all()
        for held, count, rest, most, left in self.segments:
            asked = weights[open_]
            if len(held) == 1:
                scores += asked @ held[0].astype(kind, copy=False)
            else:
                first, row, impact = held
                for dim in np.flatnonzero((first[1:] > first[:-1]) & asked.any(0)):
                    a, b = first[dim], first[dim + 1]
                    scores[:, row[a:b]] += asked[:, dim, None] * impact[a:b].astype(kind, copy=False)
            self.processed += count * len(open_)
            same = own[open_, None] == self.ids  # the query's own rows don't count
            bound = np.minimum(length[open_, None] * rest, (size[open_] @ most)[:, None]) * (1 + 1e-9) + rounding
            kth = floors[open_] - rounding
            if not known:
                kth = np.maximum(kth, np.partition(np.where(same, -np.inf, scores - bound), n - k, axis=1)[:, n - k])
            can = (scores + bound >= kth[:, None]) & ~same
            ends = can.sum(1) * self.dims <= left if left else np.ones(len(open_), bool)
            for j in np.flatnonzero(ends):
                members[open_[j]] = np.flatnonzero(can[j])
            open_, scores = open_[~ends], scores[~ends]
            if not len(open_):
                break
        return members

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, floors: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the ids and scores of the k best rows, ties to the smaller id, without rows with its own id."""
        floors = np.full(len(queries), -np.inf) if floors is None else floors
        out = []
        for i, found in enumerate(self._members(queries, own, k, floors)):
            found = found[self.ids[found] != own[i]]
            exact, ids = products(self.vectors[found], queries[i]), self.ids[found]
            best = np.lexsort((ids, -exact))[:k]
            out.append((ids[best], exact[best]))
        return out


def products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in whole numbers: longs where they hold any sum, else Python's own."""
    if rows.dtype != object and query.dtype != object and int(np.abs(rows).max(initial=0)) * int(np.abs(query).max(initial=0)) * max(rows.shape[1], 1) <= LONGEST:
        return rows @ query
    return rows.astype(object) @ query.astype(object) if len(rows) else np.zeros(0, np.int64)


def impacts(vectors, scale: float) -> np.ndarray:
    """floor(scale * x) of vectors, filled up with zeros: longs, or Python's whole numbers if some are greater."""
    sizes = vectors.map(len).to_numpy()
    x = np.zeros((len(sizes), int(sizes.max(initial=0))))
    if len(sizes) and (sizes == sizes[0]).all():
        x[:] = np.concatenate(vectors.to_list()).reshape(x.shape)
    else:
        for i, v in enumerate(vectors):
            x[i, : len(v)] = v
    with np.errstate(over="ignore"):
        scaled = np.floor(x * scale)
    if np.abs(scaled).max(initial=0) < 1 << 31:
        return scaled.astype(np.int64)
    whole = [[int(s) if np.isfinite(s) else int(v) * int(scale) for s, v in zip(a, b, strict=True)] for a, b in zip(scaled.tolist(), x.tolist(), strict=True)]
    return np.array(whole, object).reshape(x.shape)


def _usable(column: str):
    c = F.col(column)
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return c.isNotNull() & ~F.coalesce(bad, F.lit(True))


def top_k(vectors: DataFrame, is_query, k: int = 20, scale: float = 64, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows of each query: every row but those with the query's id.

    is_query is a condition on the table's columns. Rows with a null id, a null vector, or null or non-finite
    components take no part; shorter vectors count as filled up with zeros. Ranks are by exact scores of any size; a
    score that a long can't hold is shown as the nearest long. Of rows that repeat a query's id, the one of smallest
    impacts asks, once; repeated rows are candidates each. Fewer than k candidates are all returned; no rows give no
    rows. Other columns play no part, whatever their names.

    Queries in blocks meet rows in shards; a task holds one of each, and the k best of all shards are merged.
    """
    rows = vectors.where(_usable(vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), is_query.alias("q"))
    by_impact = F.transform("v", lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    queries = rows.where("q").groupBy("id").agg(F.min(F.struct(by_impact.alias("i"), "v")).alias("m")).select("id", "m.v")
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("q").alias("q")).first()
    spark = vectors.sparkSession
    # at least as many shards as tasks can run, so that small tables are spread too
    shards = max(-(-counts["n"] // shard_rows), min(spark.sparkContext.defaultParallelism, -(-counts["n"] // 2048)), 1)
    blocks = max(1, -(-counts["q"] // block_queries))
    # rows are dealt by their place in the table, so that a row that is repeated often is many tasks'
    deal = lambda n, key: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), deal(blocks, "id").alias("block"), F.lit(True).alias("asks"), "id", "v")
    held = rows.withColumn("at", F.monotonically_increasing_id()).select(deal(shards, "at").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(False).alias("asks"), "id", "v")

    def search(part: pd.DataFrame) -> pd.DataFrame:
        asks = part.asks.to_numpy(bool)
        out: list[tuple[np.ndarray, np.ndarray, list]] = []
        if asks.any() and not asks.all():
            every, ids = impacts(part.v, scale), part.id.to_numpy(np.int64)
            own, queries, have, rows = ids[asks], every[asks], every[~asks], ids[~asks]
            best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(own)
            for start in range(0, len(rows), PART_ROWS):
                index = ImpactIndex(have[start : start + PART_ROWS], rows[start : start + PART_ROWS])
                for at in range(0, len(own), AT_ONCE):
                    some = range(at, min(at + AT_ONCE, len(own)))
                    # what the parts before have found is the least that a row must reach
                    floors = np.array([float(best[i][1][k - 1]) if len(best[i][1]) == k else -np.inf for i in some])
                    for i, (found, scores) in zip(some, index.search(queries[at : at + AT_ONCE], own[at : at + AT_ONCE], k, floors), strict=True):
                        found, scores = np.concatenate([best[i][0], found]), np.concatenate([best[i][1], scores])
                        first = np.lexsort((found, -scores))[:k]
                        best[i] = found[first], scores[first]
            out = [(np.full(len(found), q), found, scores) for q, (found, scores) in zip(own, best, strict=True)]
        if not out:
            out = [(np.zeros(0, np.int64),) * 3]
        query, found, scores = (np.concatenate(x) for x in zip(*out, strict=True))
        held = [max(-LONGEST - 1, min(LONGEST, int(x))) for x in scores] if scores.dtype == object else scores
        beyond = [_beyond(int(x)) for x in scores] if scores.dtype == object else [None] * len(scores)
        return pd.DataFrame({"query_id": query.astype(np.int64), "vec_id": found.astype(np.int64), "score": np.array(held, np.int64), "beyond": pd.Series(beyond, dtype=object)})

    found = asked.unionByName(held).groupBy("shard", "block").applyInPandas(search, "query_id long, vec_id long, score long, beyond string")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("beyond").desc_nulls_last(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _beyond(x: int) -> str | None:
    """For a whole number that no long holds a text that sorts as it does; None for others."""
    if -LONGEST - 1 <= x <= LONGEST:
        return None
    digits = str(abs(x))
    if x > 0:
        return f"{len(digits):06d}{digits}"
    return f"{999_999 - len(digits):06d}" + "".join("9876543210"[int(d)] for d in digits)
