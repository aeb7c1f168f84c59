"""Distances of all pairs by blocks: a row of a table is one matrix, and products take the least sum.

Chains of a network take no part in products: matrices are those of chains' ends alone, cut into blocks, and of two blocks
one matrix is kept, if it has a path at all. For each block in turn every matrix takes what is shorter by way of that block.
Pairs are made last, those of two cells of nodes in a task: a node is a sum or two away from its chain's ends.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearway import schema as S
from nearway.network import RoadNetwork
from nearway.operators.chains import degrees
from nearway.operators.contract import Contracted
from nearway.operators.numbering import numbered
from nearway.storage import Workspace

#: Nodes of a cell, at most, whose pairs with another cell's are made in one task; pairs that are made at a time.
CELL, AT_ONCE = 2_048, 1 << 16
#: g: the group; i, j (i <= j): the matrix's blocks; d: its entries, row after row, infinite where there is no path.
MATRIX = "g long, i long, j long, n_i int, n_j int, d array<double>"
PAIRS = "a long, b long, a_part long, b_part long, distance double"
MEMBER = "struct<node:bigint,part:bigint,chain:bigint,at:double,x_at:int,x_off:double,y_at:int,y_off:double>"


def product(a: np.ndarray, b: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The entries of least, or of a times b where they are less; a row at a time."""
    out = least.copy()
    for r in range(len(a)):
        reached = np.flatnonzero(np.isfinite(a[r]))
        if len(reached):
            np.minimum(out[r], (a[r, reached, None] + b[reached]).min(0), out=out[r])
    return out


def closure(d: np.ndarray) -> np.ndarray:
    """Distances by any number of steps."""
    d = d.copy()
    for k in range(len(d)):
        np.minimum(d, d[:, k : k + 1] + d[k], out=d)
    return d


def _matrix(flat, rows: int) -> np.ndarray:
    return np.asarray(flat, float).reshape(rows, -1)


def _mapped(change: Callable[[tuple], np.ndarray]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                yield pd.DataFrame({"g": [row.g], "i": [row.i], "j": [row.j], "n_i": [row.n_i], "n_j": [row.n_j], "d": [change(row).ravel()]})

    return run


def _from_steps(row) -> np.ndarray:
    d = np.full((row.n_i, row.n_j), np.inf)
    if row.i == row.j:
        np.fill_diagonal(d, 0)
    for step in row.steps if row.steps is not None else ():
        d[step["at_i"], step["at_j"]] = min(d[step["at_i"], step["at_j"]], step["w"])
    return d


def _through_arms(row) -> np.ndarray:
    least = np.full((row.n_i, row.n_j), np.inf) if row.d is None else _matrix(row.d, row.n_i)
    return least if row.down is None else product(_matrix(row.down, row.n_i), _matrix(row.along, row.n_j).T, least)


def _through_own(row) -> np.ndarray:
    """A matrix of the block's row or column, by way of the block's own."""
    d, own = _matrix(row.d, row.n_i), _matrix(row.own, row.n_own)
    return product(own, d, d) if row.i == row.k else product(d, own, d)


from_steps, closed, through_own, through_arms = _mapped(_from_steps), _mapped(lambda row: closure(_matrix(row.d, row.n_i))), _mapped(_through_own), _mapped(_through_arms)


def turned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Matrices of block k's row or column as rows of the other block: g, x, n and arm."""
    for batch in batches:
        for row in batch.itertuples(index=False):
            flip = row.i == row.k
            d = _matrix(row.d, row.n_i)
            yield pd.DataFrame({"g": [row.g], "x": [row.j if flip else row.i], "n": [row.n_j if flip else row.n_i], "arm": [(d.T if flip else d).ravel()]})


def _closed_by_blocks(matrices: DataFrame, rounds: int, work: Workspace) -> DataFrame:
    """Matrices of the least distances; the k-th block of all groups is taken at once."""
    for k in range(rounds):
        own = work.write(matrices.where(f"i = {k} AND j = {k}").mapInPandas(closed, MATRIX))
        centre = own.select("g", F.col("d").alias("own"), F.col("n_i").alias("n_own"), F.lit(k).alias("k"))
        arms = work.write(matrices.where(f"(i = {k}) <> (j = {k})").join(centre, "g").mapInPandas(through_own, MATRIX))
        beside = work.write(arms.withColumn("k", F.lit(k)).mapInPandas(turned, "g long, x long, n int, arm array<double>"))
        side = lambda x, n, d: beside.select("g", F.col("x").alias(x), F.col("n").alias(n), F.col("arm").alias(d))
        keys = beside.select("g", F.col("x").alias("i"))
        both = keys.join(keys.withColumnRenamed("i", "j"), "g").where("i <= j")  # numbers alone
        both = both.join(side("i", "m_i", "down"), ["g", "i"]).join(side("j", "m_j", "along"), ["g", "j"])
        rest = matrices.where(f"i <> {k} AND j <> {k}").join(both, ["g", "i", "j"], "full")
        rest = rest.withColumns({"n_i": F.coalesce("n_i", "m_i"), "n_j": F.coalesce("n_j", "m_j")}).mapInPandas(through_arms, MATRIX)
        before, matrices = matrices, work.write(rest.unionByName(arms).unionByName(own))
        work.drop(before, own, arms, beside)
    return matrices


def all_pairs(steps: DataFrame, wanted: DataFrame, block: int = 512) -> DataFrame:
    """a, b (a < b), a_part, b_part, distance of every two wanted nodes that steps join.

    steps: g, a, b, w (a < b), two nodes once; no step leads from one group g to another. wanted: node_id, part_id.
    """
    work = Workspace(steps.sparkSession, "pairs")
    edges = work.write(numbered(steps.select("g", "a", "b", "w"), ["a", "b"], "edge_id"))
    net = RoadNetwork(edges.select("edge_id", F.col("a").alias("start_node"), F.col("b").alias("end_node"), F.col("w").alias("length")), steps.sparkSession.createDataFrame([], S.OBJECTS))
    chains = Contracted(net, net.chains)
    group = work.write(edges.select(F.col("g").cast("long").alias("g"), F.explode(F.array("a", "b")).alias("node")).distinct())
    # an end without another chain is a place on its chain, as its inner nodes are
    tips = degrees(net).where("n_edges = 1").select(F.col("node_id").alias("node"))
    ends = chains.ends.select("chain_id", F.explode(F.array(F.struct(F.col("first").alias("node"), F.lit(0.0).alias("at")), F.struct(F.col("last").alias("node"), F.col("total").alias("at")))).alias("e")).select("chain_id", "e.*")
    core = ends.select("node").distinct().join(tips, "node", "left_anti").join(group, "node")
    places = work.write(_places(core, block))
    blocks = work.write(places.groupBy("g", "i").agg(F.first("n").alias("n")))
    p, q = (places.select(F.col("node").alias(c), "g", F.col("i").alias(x), F.col("at").alias(f"at_{x}")) for c, x in (("src", "i"), ("dst", "j")))
    made = chains.adjacency.where("not own").join(p, "src").join(q, ["dst", "g"]).where("i <= j").groupBy("g", "i", "j").agg(F.collect_list(F.struct("at_i", "at_j", "w")).alias("steps"))
    sides = made.select("g", "i", "j").unionByName(blocks.select("g", "i", F.col("i").alias("j"))).distinct()
    sides = sides.join(blocks.select("g", "i", F.col("n").alias("n_i")), ["g", "i"]).join(blocks.select("g", F.col("i").alias("j"), F.col("n").alias("n_j")), ["g", "j"])
    matrices = work.write(sides.join(made, ["g", "i", "j"], "left").mapInPandas(from_steps, MATRIX))
    matrices = _closed_by_blocks(matrices, (blocks.agg(F.max("i")).first()[0] or 0) + 1, work)
    wanted = wanted.select(F.col("node_id").alias("node"), F.col("part_id").cast("long").alias("part")).join(group, "node")
    on_chain = chains.inner.select("node", "chain_id", "at").unionByName(ends.join(tips, "node").select("node", "chain_id", "at"))
    on_chain = wanted.join(on_chain, "node").join(chains.ends.select("chain_id", "first", "last", "total"), "chain_id")
    for c, off in (("first", F.col("at")), ("last", F.col("total") - F.col("at"))):
        own = places.select(F.col("node").alias(c), F.struct(F.col("i"), F.col("at").alias("place")).alias("e"))
        on_chain = on_chain.join(own, c, "left").withColumn(c, F.when(F.col("e").isNotNull(), F.struct("e.i", "e.place", off.alias("off")))).drop("e")
    anchors = F.array_sort(F.array_compact(F.array("first", "last")))
    on_chain = work.write(on_chain.select("g", "node", "part", F.col("chain_id").alias("chain"), "at", anchors.alias("anchors")))
    nothing = F.lit(None)
    at_core = wanted.join(places.select("node", "i", F.col("at").alias("place")), "node").select("g", "node", "part", nothing.cast("long").alias("chain"), nothing.cast("double").alias("at"), F.array(F.struct("i", "place", F.lit(0.0).alias("off"))).alias("anchors"))
    found = _between_cells(matrices, on_chain.where("size(anchors) > 0").unionByName(at_core), work)
    # chains that are joined with nothing else
    alone = on_chain.where("size(anchors) = 0")
    name = lambda c: alone.select("chain", F.col("node").alias(c), F.col("part").alias(f"{c}_part"), F.col("at").alias(f"{c}_at"))
    pairs = name("a").join(name("b"), "chain").where("a < b").select("a", "b", "a_part", "b_part", F.abs(F.col("a_at") - F.col("b_at")).alias("distance"))
    return found.unionByName(pairs)


def _places(core: DataFrame, block: int) -> DataFrame:
    """g, node, i (from 0 in each group), at, n: each node's block, at most `block` nodes, its place there, and the block's size."""
    dealt = numbered(core.select("g", "node"), ["g", "node"], "nth", first=0)
    low = dealt.groupBy("g").agg(F.min("nth").alias("low"), F.ceil(F.count(F.lit(1)) / block).alias("pieces"), F.count(F.lit(1)).alias("size"))
    cell = F.floor((F.col("nth") - F.col("low")) * F.col("pieces") / F.col("size")).cast("long")
    dealt = dealt.join(low, "g").select("g", "node", "nth", cell.alias("i"))
    blocks = dealt.groupBy("g", "i").agg(F.min("nth").alias("first"), F.count(F.lit(1)).cast("int").alias("n"))
    return dealt.join(blocks, ["g", "i"]).select("g", "node", "i", (F.col("nth") - F.col("first")).cast("int").alias("at"), "n")


def _between_cells(matrices: DataFrame, nodes: DataFrame, work: Workspace) -> DataFrame:
    """The pairs of nodes with anchors: blocks and places of ends (one or two) and how far they are."""
    x, y = F.col("anchors")[0], F.get("anchors", F.lit(1))
    member = F.struct("node", "part", "chain", "at", x["place"].alias("x_at"), x["off"].alias("x_off"), y["place"].alias("y_at"), y["off"].alias("y_off"))
    rows = nodes.select("g", x["i"].alias("x"), F.coalesce(y["i"], F.lit(-1)).alias("y"), "node", member.alias("m"))
    rows = numbered(rows, ["g", "x", "y", "node"], "nth", first=0)
    low = rows.groupBy("g", "x", "y").agg(F.min("nth").alias("low"))
    cells = rows.join(low, ["g", "x", "y"]).groupBy("g", "x", "y", F.floor((F.col("nth") - F.col("low")) / CELL).alias("piece")).agg(F.collect_list("m").alias("members"))
    cells = work.write(numbered(cells, ["g", "x", "y", "piece"], "c", first=0))
    keys = lambda c, x, y: cells.select("g", F.col("c").alias(c), F.col("x").alias(x), F.col("y").alias(y))
    pairs = work.write(keys("p", "px", "py").join(keys("q", "qx", "qy"), "g").where("p <= q"))  # numbers alone
    slot = lambda k, s, t: F.struct(F.lit(k).alias("slot"), F.least(s, t).alias("i"), F.greatest(s, t).alias("j"), (F.col(s) > F.col(t)).alias("flip"))
    needs = pairs.select("g", "p", "q", F.explode(F.array(slot(0, "px", "qx"), slot(1, "px", "qy"), slot(2, "py", "qx"), slot(3, "py", "qy"))).alias("s")).select("g", "p", "q", "s.*").where("i >= 0")
    null = F.lit(None)
    parts = needs.join(matrices, ["g", "i", "j"]).select("p", "q", "slot", "flip", "n_i", "d", null.cast(f"array<{MEMBER}>").alias("members"))
    for k, c in ((4, "p"), (5, "q")):
        own = pairs.select("p", "q").join(cells.select(F.col("c").alias(c), "members"), c)
        parts = parts.unionByName(own.select("p", "q", F.lit(k).alias("slot"), F.lit(False).alias("flip"), F.lit(0).alias("n_i"), null.cast("array<double>").alias("d"), "members"))
    at_once = AT_ONCE

    def pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        between, sides, same = {}, {}, False
        for batch in batches:
            for k in range(batch.num_rows):
                number = batch.column("slot")[k].as_py()
                same = batch.column("p")[k].as_py() == batch.column("q")[k].as_py()
                if number < 4:
                    d = _matrix(batch.column("d")[k].values.to_numpy(), batch.column("n_i")[k].as_py())
                    between[number] = d.T if batch.column("flip")[k].as_py() else d
                else:
                    m = batch.column("members")[k].values
                    sides[number] = {f.name: m.field(f.name).to_numpy(zero_copy_only=False) if m.field(f.name).null_count == 0 else m.field(f.name).fill_null(-1).to_numpy(zero_copy_only=False) for f in m.type}
        own, other = sides[4], sides[5]
        step = max(1, at_once // len(other["node"]))
        for low in range(0, len(own["node"]), step):
            part = {c: v[low : low + step] for c, v in own.items()}
            least = np.full((len(part["node"]), len(other["node"])), np.inf)
            for number, d in between.items():
                s, t = "xy"[number // 2], "xy"[number % 2]
                ways = d[np.ix_(part[f"{s}_at"], other[f"{t}_at"])]
                np.minimum(least, part[f"{s}_off"][:, None] + ways + other[f"{t}_off"], out=least)
            along = (part["chain"][:, None] == other["chain"]) & (part["chain"] >= 0)[:, None]
            if along.any():
                np.minimum(least, np.abs(part["at"][:, None] - other["at"]), out=least, where=along)
            i, j = np.nonzero(np.isfinite(least) & (part["node"][:, None] < other["node"]) if same else np.isfinite(least))
            turn = part["node"][i] > other["node"][j]
            ends = [np.where(turn, u[j], v[i]) for u, v in ((other["node"], part["node"]), (other["part"], part["part"]))]
            far = [np.where(turn, v[i], u[j]) for u, v in ((other["node"], part["node"]), (other["part"], part["part"]))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (ends[0], far[0], ends[1], far[1], least[i, j])], ["a", "b", "a_part", "b_part", "distance"])

    return parts.groupBy("p", "q").applyInArrow(pairs_of, PAIRS)
