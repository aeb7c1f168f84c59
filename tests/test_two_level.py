"""Search by parts, partitions, buckets of distance and border distances, against one heap-based search."""

import heapq
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from nearway import storage
from nearway.operators import ann, minplus, partition, parts, relax, two_level
from tests.networks import answers, exact, network


def made(seed, n=40, extra=25, objects=60):
    """A ring with chords, a chain that ends nowhere, and an island."""
    r = random.Random(seed)
    edges = [(i, i, (i + 1) % n, float(r.randint(1, 9))) for i in range(n)]
    edges += [(100 + i, *r.sample(range(n), 2), float(r.randint(1, 30))) for i in range(extra)]
    edges += [(200 + i, (3 if i == 0 else 99 + i), 100 + i, 2.0) for i in range(8)] + [(300, 500, 501, 4.0)]
    ids = [e[0] for e in edges]
    length = {e[0]: e[3] for e in edges}
    objs = []
    for o in range(objects):
        e = r.choice(ids)
        objs.append((o, e, r.random() < 0.7, float(r.randint(0, int(length[e])))))
    return edges, objs


def from_one(edges, source):
    adjacency, dist, heap = defaultdict(list), {}, [(0.0, source)]
    for _, a, b, w in edges:
        adjacency[a].append((b, w))
        adjacency[b].append((a, w))
    while heap:
        d, n = heapq.heappop(heap)
        if n not in dist:
            dist[n] = d
            for m, w in adjacency[n]:
                heapq.heappush(heap, (d + w, m))
    return dist


@pytest.mark.parametrize("algorithm, most", [("parts", 100_000), ("parts", 30), ("parts_naive", 100_000)])
def test_search_by_parts_is_exact(spark, monkeypatch, algorithm, most):
    monkeypatch.setattr(two_level, "PART_EDGES", most)
    edges, objs = made(most)
    net = network(spark, edges, objs)
    own = net.nodes.select("node_id", F.pmod(F.col("node_id"), F.lit(3)).alias("part_id")).where("node_id < 30")
    # split where larger; nodes without a part are one of their own
    assert answers(ann.all_nearest(net, "true_to_false", algorithm, None if most == 30 else own)) == exact(edges, objs)
    if most == 30:
        assert two_level.Parted(net).inner.groupBy("part_id").count().agg(F.max("count")).first()[0] <= most


def test_labels_by_parts_and_in_buckets(spark):
    edges, objs = made(5)
    net = network(spark, edges, objs)
    want = {(s, n): d for s in (0, 7, 500) for n, d in from_one(edges, s).items()}
    seeds = spark.createDataFrame([(s, s, 0.0, 0) for s in (0, 7, 500)], "source long, node long, dist double, obj long")
    p = net.nodes.select("node_id", (F.col("node_id") / 15).cast("int").alias("part_id"))
    found = two_level.Parted(net, p).labels(seeds, ("source",)).collect()
    assert {(x["source"], x["node"]): x["dist"] for x in found} == want
    for delta in (4.0, 1000.0):
        rows = relax.relax(seeds, net.adjacency, ("source",), delta=delta).collect()
        assert len(rows) == len(want) and {(x["source"], x["node"]): x["dist"] for x in rows} == want
    near = relax.relax(seeds, net.adjacency, ("source",), within=12.0, delta=6.0).collect()
    assert {(x["source"], x["node"]): x["dist"] for x in near} == {k: d for k, d in want.items() if d <= 12}


def test_many_jobs_merge_their_tables(spark, monkeypatch):
    monkeypatch.setattr(relax, "MOST_HOPS", 1)
    monkeypatch.setattr(relax, "HOPS", 1)
    monkeypatch.setattr(relax, "TABLES", 2)
    edges = [(i, i, i + 1, 1.0) for i in range(6)] + [(50, 0, 6, 5.0)]
    seeds = spark.createDataFrame([(0, 0.0, 1), (6, 0.5, 2)], "node long, dist double, obj long")
    for delta in (None, 2.0):
        found = {x["node"]: (x["dist"], x["obj"]) for x in relax.relax(seeds, network(spark, edges).adjacency, delta=delta).collect()}
        assert found == {i: min((float(i), 1), (6.5 - i, 2)) for i in range(7)}


def test_border_distances_by_blocks(spark, monkeypatch):
    edges, _ = made(8)
    net = network(spark, edges)
    p = net.nodes.select("node_id", F.pmod(F.col("node_id"), F.lit(3)).cast("int").alias("part_id"))
    border = [x["node_id"] for x in parts.border_nodes(net, p).collect()]
    far = {a: from_one(edges, a) for a in border}
    want = {(a, b): far[a][b] for a in border for b in border if a < b and b in far[a]}
    monkeypatch.setattr(two_level, "PART_EDGES", 12)
    got = {(x["a"], x["b"]): x["distance"] for x in parts.border_paths(net, p, block=14).collect()}
    assert got == want


def test_products_take_the_least_sum():
    r = np.random.default_rng(1)
    a, b, c = (np.where(r.random(s) < 0.4, np.inf, r.integers(1, 50, s).astype(float)) for s in ((7, 5), (5, 6), (7, 6)))
    want = np.minimum(c, np.array([[min(a[i, k] + b[k, j] for k in range(5)) for j in range(6)] for i in range(7)]))
    assert (minplus.product(a, b, c) == want).all()


@pytest.mark.parametrize("coarse", [4_096, 400])
def test_partition_is_balanced_and_cuts_few(spark, coarse):
    side = 24
    edges, k = [], 0
    for x in range(side):
        for y in range(side):
            for dx, dy in ((1, 0), (0, 1)):
                if x + dx < side and y + dy < side:
                    edges.append((k, x * side + y, (x + dx) * side + y + dy, 1.0))
                    k += 1
    net = network(spark, edges + [(9_000 + i, 5_000 + 2 * i, 5_001 + 2 * i, 1.0) for i in range(3)])
    found = partition.balanced_parts(net, 4, coarse=coarse).collect()
    assert len(found) == len({x["node_id"] for x in found}) == side * side + 6
    label = {x["node_id"]: x["part_id"] for x in found}
    sizes = [list(label.values()).count(p) for p in range(4)]
    assert max(sizes) <= math.ceil(1.05 * (side * side + 6) / 4)
    cut = sum(label[a] != label[b] for _, a, b, _ in edges)
    assert cut <= 84  # by rows of the grid 72, dealt by a hash some 830


def test_more_parts_than_nodes(spark):
    net = network(spark, [(1, 1, 2, 1.0)])
    assert {x["node_id"] for x in partition.balanced_parts(net, 5).collect()} == {1, 2}


def test_border_pairs_take_chains_together(spark, monkeypatch):
    """Distances go over chains' ends alone, in matrices of few entries; nodes of a chain that is joined with nothing else are paired too."""
    # a square of nodes 0-3 with a diagonal, chains between and beside them, a tip, a cycle and a chain of its own
    edges = [(0, 0, 1, 3.0), (1, 1, 2, 4.0), (2, 2, 3, 1.0), (3, 3, 0, 9.0), (4, 0, 2, 20.0), (5, 3, 40, 2.0), (6, 40, 41, 2.0), (7, 41, 42, 1.0)]
    edges += [(10 + i, 10 + i, 11 + i, 1.0 + i) for i in range(5)] + [(20, 0, 10, 2.0), (21, 15, 2, 2.0), (22, 15, 1, 30.0)]
    edges += [(30 + i, 30 + i, 30 + (i + 1) % 4, 1.0) for i in range(4)] + [(50 + i, 50 + i, 51 + i, 2.0) for i in range(3)]
    net = network(spark, edges)
    p = net.nodes.select("node_id", F.pmod(F.col("node_id"), F.lit(2)).cast("int").alias("part_id"))
    border = [x["node_id"] for x in parts.border_nodes(net, p).collect()]
    far = {a: from_one(edges, a) for a in border}
    want = {(a, b): far[a][b] for a in border for b in border if a < b and b in far[a]}
    monkeypatch.setattr(minplus, "CELL", 3)
    sizes, write = [], minplus.Workspace.write

    def seen(work, df):
        out = write(work, df)
        if df.columns == [c.split()[0] for c in minplus.MATRIX.split(", ")]:
            sizes.append(out.agg(F.coalesce(F.sum(F.size("d")), F.lit(0))).first()[0])
        return out

    monkeypatch.setattr(minplus.Workspace, "write", seen)
    rows = parts.border_paths(net, p, block=2).collect()
    assert len(rows) == len(want) and {(x["a"], x["b"]): x["distance"] for x in rows} == want
    assert 0 < max(sizes) <= 49 < len(border) ** 2  # seven ends of chains at most
    inner = [e for e in edges if e[1] % 2 == e[2] % 2]
    far = {a: from_one(inner, a) for a in border}
    want = {(a, b): far[a][b] for a in border for b in border if a < b and b in far[a]}
    made = parts.overlay_edges(net, p, block=2).where("not is_cut").collect()
    assert len(made) == len(want) and {(x["start_node"], x["end_node"]): x["length"] for x in made} == want


def test_parts_are_joined_without_the_driver(spark, monkeypatch):
    """Tables beyond a bound are shuffled to be joined, in the result too, and the session's own setting stays."""
    plans, real = [], DataFrameWriter.parquet

    def seen(self, path, *args, **kwargs):
        if any(x in path for x in ("/parted-", "/partition-")):
            plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return real(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", seen)
    monkeypatch.setattr(storage, "SENT", 1, raising=False)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    edges, objs = made(3, n=12, extra=4, objects=20)
    net = network(spark, edges, objs)
    assert answers(ann.all_nearest(net, "true_to_false", "parts", partition.balanced_parts(net, 2))) == exact(edges, objs)
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before
