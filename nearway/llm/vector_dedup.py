"""Embedding near-duplicates: inverted lists with product-quantised residuals, then exact cosine.

Vectors are scaled to length 1, so a cosine of t is a distance of sqrt(2 - 2t) = reach. Coarse centroids and residual
codebooks are fitted on a bounded sample; every vector is indexed in the list of its label and cell. A query probes a
cell by its distance from the plane half-way between its own centroid and the cell's, which parts their vectors: a
vector within reach lies beyond the plane only if its way there, `reach` long at most, leads that far along the plane's
normal. Every list that this and the distances of its vectors from the centroid allow is probed, so no link can be
lost; of two cells the lower asks the higher, and a link counts for both its ends. In a list, the distance from a query
to each vector as it is coded is that from the centroid and a sum of looked-up products (one table a query serves all
lists); the coding error is kept with the vector, so whatever can be within reach stays and is compared exactly.

Lists travel by groups of neighbouring cells: a group's lists are one task's, or a few blocks', and a query goes to each
group once, however many of its lists it probes. There are as many groups as the largest label needs for its lists to
fit, so a table of one task's size is sent once, and what a query costs in shuffle follows the groups, not the cells.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearway.llm.common import Workspace, join_hot
from nearway.llm.graph import components, forest

#: Vectors for each cell that centroids and codebooks are fitted on, and at least; subspaces and codewords of each.
SAMPLE, LEAST_SAMPLE, PARTS, WORDS = 16, 16_384, 8, 64
#: Cells are the square root of the number of vectors, within these bounds.
LEAST_CELLS, MOST_CELLS = 16, 1_024
#: Vectors of a group's lists, and queries, that one task compares.
BLOCK = 16_384


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """At most k centroids of the rows of x."""
    rng = np.random.default_rng(seed)
    c = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(rounds):
        near = np.argmin((c**2).sum(1) - 2 * x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(c))
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


class Quantiser:
    """Coarse centroids and codebooks of the residuals' subspaces."""

    def __init__(self, sample: np.ndarray, cells: int, parts: int, words: int):
        self.centroids = kmeans(sample, cells)
        dims = sample.shape[1]
        self.bounds = [dims * i // parts for i in range(parts + 1)]
        cell, _ = self.nearest(sample)
        residual = sample - self.centroids[cell]
        self.books = [kmeans(residual[:, a:b], words) for a, b in self._spans()]
        self.apart = np.sqrt(np.maximum(((self.centroids**2).sum(1)[:, None] + (self.centroids**2).sum(1) - 2 * self.centroids @ self.centroids.T), 1e-18))
        self.groups = np.zeros(len(self.centroids), np.int64)

    def grouped(self, groups: int) -> None:
        """Parts the cells into so many groups of neighbours, at most."""
        if groups > 1:
            middle = kmeans(self.centroids, groups)
            self.groups = np.argmin((middle**2).sum(1) - 2 * self.centroids @ middle.T, axis=1)

    def _spans(self):
        return zip(self.bounds, self.bounds[1:], strict=False)

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (self.centroids**2).sum(1) - 2 * x @ self.centroids.T, 0))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = self.distances(x)
        return d.argmin(1), d

    def encode(self, x: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of the residuals, the length of what they miss, and what a vector as it is coded adds to any distance."""
        c = self.centroids[cell]
        residual, coded = x - c, np.zeros_like(x)
        codes = np.zeros((len(x), len(self.books)), np.uint8)
        for m, (a, b) in enumerate(self._spans()):
            part, book = residual[:, a:b], self.books[m]
            codes[:, m] = np.argmin((book**2).sum(1) - 2 * part @ book.T, axis=1)
            coded[:, a:b] = book[codes[:, m]]
        return codes, np.sqrt(((residual - coded) ** 2).sum(1)), (coded**2).sum(1) + 2 * (c * coded).sum(1)

    def probes(self, d: np.ndarray, own: np.ndarray, reach: float, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Whether each vector (by its distances from the centroids and its own cell) may find others within reach in a cell.

        least and most: between which distances from its centroid each cell's vectors lie. Of two cells the lower asks.
        """
        plane = (d**2 - np.take_along_axis(d, own[:, None], 1) ** 2) / (2 * self.apart[own])
        plane[np.arange(len(d)), own] = 0
        return (plane <= reach + 1e-9) & (d - most <= reach + 1e-9) & (least - d <= reach + 1e-9) & (np.arange(len(self.centroids)) >= own[:, None])

    def tables(self, x: np.ndarray) -> np.ndarray:
        """Products of each query's parts with the codewords: parts x codewords x queries."""
        out = np.zeros((len(self.books), max(map(len, self.books)), len(x)), np.float32)
        for m, ((a, b), book) in enumerate(zip(self._spans(), self.books, strict=True)):
            out[m, : len(book)] = book @ x[:, a:b].T
        return out


def link(q: np.ndarray, d: np.ndarray, can: np.ndarray, x: np.ndarray, cells: np.ndarray, coded: tuple, model: Quantiser, cosine: float, at_once: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Places (in q, in x) of all pairs whose cosine is at least that asked for, of queries and vectors of probed cells.

    d: the queries' distances from the centroids, can: the cells they probe, cells: the vectors', coded: as encode().
    """
    reach, left, right = np.sqrt(max(0.0, 2 - 2 * cosine)), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    codes, error, adds = coded
    most = ((reach + error + 1e-6) ** 2 + 1e-4 - adds).astype(np.float32)
    order = np.argsort(cells, kind="stable")
    held, first = np.unique(cells[order], return_index=True)
    lists = np.split(order, first[1:])
    for at in range(0, len(q), at_once):
        part = slice(at, at + at_once)
        table, near = model.tables(q[part]), d[part] ** 2
        for cell, rows in zip(held, lists, strict=True):
            asks = np.flatnonzero(can[part, cell])
            if not len(asks):
                continue
            total = np.zeros((len(rows), len(asks)), np.float32)
            for m in range(len(table)):
                total += table[m][:, asks][codes[rows, m]]
            j, i = np.nonzero(near[asks, cell].astype(np.float32) - 2 * total <= most[rows, None])
            i, j = asks[i] + at, rows[j]
            for k in range(0, len(i), 1 << 16):
                a, b = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                exact = np.einsum("ij,ij->i", q[a], x[b]) >= cosine
                left.append(a[exact])
                right.append(b[exact])
    return np.concatenate(left), np.concatenate(right)


def _unit(vectors, dims: int) -> np.ndarray:
    sizes = {len(v) for v in vectors}
    if sizes == {dims}:
        x = np.concatenate(list(vectors)).reshape(len(vectors), dims).astype(np.float64)
    else:
        x = np.zeros((len(vectors), dims))
        for i, v in enumerate(vectors):
            x[i, : len(v)] = v
    x /= np.abs(x).max(1, keepdims=True, initial=1e-300)  # squares of great or tiny components stay finite
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def near_vectors(vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cells: int | None = None, parts: int = PARTS, words: int = WORDS, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row; rows link if labels are equal and the cosine is enough.

    Rows with a null label or id, a null, empty or zero vector, or null or non-finite components link with nothing and
    are their own component. Shorter vectors count as filled up with zeros. Equal vectors of a label (by a 128-bit hash)
    are one node with a multiplicity, so a hot vector costs no pairs; repeated rows are vectors of their own. An empty
    table gives an empty result; other columns play no part, whatever their names.
    """
    work = Workspace(vectors.sparkSession, "vectors")
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    fit = F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(fit, F.col(label_col)).alias("label"), fit.alias("fit"), F.xxhash64(label_col, vector_col).alias("h1"), F.xxhash64(F.lit(1), vector_col, label_col).alias("h2"), F.when(fit, v).alias("v"))
    slim = rows.drop("v", "label")
    nodes = work.write(rows.where("fit").groupBy("h1", "h2").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")).withColumn("node", F.monotonically_increasing_id()))
    facts = nodes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dims")).first()
    alone = slim.where("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    if not facts["n"]:
        return alone
    dims, cells = facts["dims"], cells or int(min(max(np.sqrt(facts["n"]), LEAST_CELLS), MOST_CELLS))
    sample = max(LEAST_SAMPLE, SAMPLE * cells)
    share = min(1.0, sample / facts["n"])
    # the sample is a hash's; the limit is a bound for the driver that the hash hardly ever meets
    picked = nodes.where(F.pmod(F.xxhash64("node"), F.lit(1_000_000)) <= F.lit(int(share * 1_000_000))).select("node", "v").orderBy("node").limit(2 * sample).toPandas()
    if not len(picked):
        picked = nodes.select("node", "v").orderBy("node").limit(1).toPandas()
    model = Quantiser(_unit(picked.v, dims), cells, parts, words)
    largest = nodes.groupBy("label").count().agg(F.max("count")).first()[0]
    model.grouped(-(-largest // block))
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    label_type = vectors.schema[label_col].dataType.simpleString()
    vector_type = nodes.schema["v"].dataType.simpleString()

    def place(batches):
        for b in batches:
            x = _unit(b.v, dims)
            cell, d = model.nearest(x)
            codes, error, adds = model.encode(x, cell)
            yield pd.DataFrame({"node": b.node, "n": b.n, "label": b.label, "cell": cell, "radius": d[np.arange(len(x)), cell], "codes": [c.tobytes() for c in codes], "error": error, "adds": adds, "v": b.v})

    coded = work.write(nodes.select("node", "n", "label", "v").mapInPandas(place, f"node long, n long, label {label_type}, cell int, radius double, codes binary, error double, adds double, v {vector_type}"))
    least, most = np.full(len(model.centroids), np.inf), np.full(len(model.centroids), -np.inf)
    for r in coded.groupBy("cell").agg(F.min("radius").alias("a"), F.max("radius").alias("b")).collect():  # as many as there are cells
        least[r["cell"]], most[r["cell"]] = r["a"], r["b"]

    def ask(batches):
        for b in batches:
            x, own = _unit(b.v, dims), b.cell.to_numpy()
            can = model.probes(model.distances(x), own, reach, least, most)
            i, group = np.nonzero(np.stack([can[:, model.groups == g].any(1) for g in range(model.groups.max() + 1)], 1))
            yield pd.DataFrame({"label": b.label.to_numpy()[i], "group": group, "node": b.node.to_numpy()[i], "n": b.n.to_numpy()[i], "cell": own[i], "v": b.v.to_numpy()[i]})

    group_of = F.element_at(F.array(*[F.lit(int(g)) for g in model.groups]), F.col("cell") + 1) if model.groups.any() else F.lit(0)
    asked = work.write(coded.select("label", "node", "n", "cell", "v").mapInPandas(ask, f"label {label_type}, group int, node long, n long, cell int, v {vector_type}"))
    held = coded.withColumn("group", group_of)
    # a group's lists in blocks meet its queries in chunks; both counts follow from the sizes
    sizes = held.groupBy("label", "group").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    grid = work.write(asked.groupBy("label", "group").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("chunks")).join(sizes, ["label", "group"]))
    deal = lambda c, of: F.pmod(F.xxhash64("node", F.lit(of)), F.col(c)).cast("int")
    each_of = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    none = F.lit(None)
    asks = join_hot(asked, grid, ["label", "group"], "node").select("label", "group", each_of("blocks").alias("block"), deal("chunks", 3).alias("chunk"), "node", "n", "cell", "v", none.cast("binary").alias("codes"), F.lit(0.0).alias("error"), F.lit(0.0).alias("adds"))
    have = join_hot(held, grid, ["label", "group"], "node").select("label", "group", deal("blocks", 5).alias("block"), each_of("chunks").alias("chunk"), "node", "n", "cell", "v", "codes", "error", "adds")

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        asking = part.codes.isna().to_numpy()
        ask, have = part[asking], part[~asking]
        if not len(ask) or not len(have):
            return pd.DataFrame({"a": [], "b": [], "links": [], "edge": []}).astype({"a": "int64", "b": "int64", "links": "int64", "edge": bool})
        q, x = _unit(ask.v, dims), _unit(have.v, dims)
        own, cell, d = ask.cell.to_numpy(), have.cell.to_numpy(), model.distances(q)
        codes = np.frombuffer(b"".join(have.codes), np.uint8).reshape(len(have), len(model.books))
        i, j = link(q, d, model.probes(d, own, reach, least, most), x, cell, (codes, have.error.to_numpy(), have.adds.to_numpy()), model, cosine)
        a, b = ask.node.to_numpy()[i], have.node.to_numpy()[j]
        other = a != b
        far = own[i] != cell[j]  # the other end doesn't ask; within a cell both do
        ends, n = np.concatenate([a[other], b[far]]), np.concatenate([have.n.to_numpy()[j][other], ask.n.to_numpy()[i][far]])
        a, b = a[other], b[other]
        who, inverse = np.unique(ends, return_inverse=True)
        count = np.bincount(inverse, weights=n, minlength=len(who)).astype(np.int64)
        node, root = forest(a, b)
        nobody = np.full(len(who), -1, np.int64)
        return pd.DataFrame({"a": np.concatenate([who, node]), "b": np.concatenate([nobody, root]), "links": np.concatenate([count, np.zeros(len(node), np.int64)]), "edge": np.concatenate([np.zeros(len(who), bool), np.ones(len(node), bool)])})

    found = work.write(asks.unionByName(have).groupBy("label", "group", "block", "chunk").applyInPandas(compare, "a long, b long, links long, edge boolean"))
    reached = components(found.where("edge").select("a", "b"), work)
    links = found.where("not edge").groupBy("a").agg(F.sum("links").alias("links"))
    flat = work.write(nodes.drop("v", "label").join(reached.withColumnRenamed("node", "at"), F.col("node") == F.col("at"), "left").join(links, F.col("node") == F.col("a"), "left").select("node", "h1", "h2", "rep", F.coalesce("component", "node").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links")))
    each = join_hot(flat, flat.groupBy("component").agg(F.min("rep").alias("component_id")), ["component"], "node").select("h1", "h2", "n_links", "component_id")
    linked = join_hot(slim.where("fit"), each, ["h1", "h2"], "vec_id").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return linked.unionByName(alone)
