"""Seeded generators of objects on edges.

Every random choice is a hash of the seed and of what it is for, so a generator gives the same objects whatever the
partitions, and a lost executor changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearway.functions.scalar import half_normal, objects_that_fit, random_double, random_int
from nearway.network import RoadNetwork
from nearway.operators.numbering import numbered
from nearway.operators.parts import edges_within
from nearway.skew import join_hot

COLUMNS = ("obj_id", "edge_id", "is_query", "dist_from_start", "rating")


def _picked(edges: DataFrame, ids: DataFrame, seed: int) -> DataFrame:
    """Each id with an edge picked at random, all edges being as likely."""
    e = numbered(edges.select("edge_id", "length"), ["edge_id"], "nth", first=0)
    n = e.count()
    if not n:
        return ids.withColumns({"edge_id": F.lit(None).cast("long"), "length": F.lit(None).cast("double")}).limit(0)
    return ids.withColumn("nth", random_int(0, n - 1, seed, "obj_id")).join(e, "nth").drop("nth")


def _ids(network: RoadNetwork, n: int, first: int, kind: bool) -> DataFrame:
    return network.edges.sparkSession.range(first, first + n).select(F.col("id").alias("obj_id"), F.lit(kind).alias("is_query"))


def _placed(rows: DataFrame, seed: int, where: Column | None = None) -> DataFrame:
    off = random_double(seed + 11, "obj_id") * F.col("length") if where is None else where
    return rows.withColumn("dist_from_start", F.round(off, 6)).withColumn("dist_from_start", F.least("dist_from_start", "length")).withColumn("rating", random_int(1, 10, seed + 12, "obj_id").cast("double")).select(*COLUMNS)


def uniform(network: RoadNetwork, n: int, kind: bool, seed: int, first: int = 1) -> DataFrame:
    """n objects of one type, ids from `first`, on edges and at offsets picked uniformly."""
    return _placed(_picked(network.edges, _ids(network, n, first, kind), seed), seed)


def uniform_both(network: RoadNetwork, n_true: int, n_false: int, seed: int) -> DataFrame:
    """Exact numbers of both types, uniform, with ids of their own."""
    return uniform(network, n_true, True, seed).unionByName(uniform(network, n_false, False, seed + 100, n_true + 1))


def clustered(network: RoadNetwork, n: int, kind: bool, seed: int, centroids: int = 10, deviation: float = 2.0, scale: float = 1.0, first: int = 1, max_steps: int = 64) -> DataFrame:
    """n objects of one type around random nodes: each walks a half-normal distance from its centroid.

    At every node the walk goes on along an edge picked at random, and ends on the edge on which its distance ends, or
    after max_steps at the far end of its edge.
    """
    nodes = numbered(network.nodes.select("node_id"), ["node_id"], "nth", first=0)
    n_nodes = nodes.count()
    ids = _ids(network, n, first, kind).withColumn("c", random_int(0, centroids - 1, seed, "obj_id"))
    at = ids.withColumn("nth", random_int(0, max(n_nodes - 1, 0), seed + 1, "c")).join(nodes, "nth")
    return _placed_walk(network, at.select("obj_id", "is_query", F.col("node_id").alias("at"), half_normal(deviation, scale, seed + 2, "obj_id").alias("left")), seed, max_steps)


def _placed_walk(network: RoadNetwork, walkers: DataFrame, seed: int, max_steps: int) -> DataFrame:
    """Objects where walks of a given length from a node end."""
    from nearway.storage import Workspace

    work = Workspace(network.edges.sparkSession, "walk")
    out = network.adjacency.join(network.edges.select("edge_id", "start_node"), "edge_id")
    steps = work.write(out.withColumn("i", F.row_number().over(Window.partitionBy("src").orderBy("edge_id", "dst"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("src"))))
    live, done, turn = work.write(walkers), None, 0
    while not live.isEmpty():
        chosen = live.join(steps.select("src", "n").distinct(), F.col("at") == F.col("src")).drop("src").withColumn("i", F.pmod(F.xxhash64("obj_id", F.lit(seed + 1000 + turn)), F.col("n")) + 1).drop("n")
        moved = chosen.join(steps.select("src", "i", "dst", "edge_id", "w", "start_node"), (F.col("at") == F.col("src")) & (chosen["i"] == steps["i"])).select("obj_id", "is_query", "left", "at", "dst", "edge_id", "w", "start_node")
        moved = work.write(moved)
        last = turn + 1 >= max_steps
        stays = moved.where(F.lit(True) if last else F.col("left") <= F.col("w"))
        along = F.least("left", "w")
        ended = stays.select("obj_id", "is_query", "edge_id", F.col("w").alias("length"), F.when(F.col("at") == F.col("start_node"), along).otherwise(F.col("w") - along).alias("off"))
        done = ended if done is None else done.unionByName(ended)
        live = work.write(moved.where(F.lit(False) if last else F.col("left") > F.col("w")).select("obj_id", "is_query", F.col("dst").alias("at"), (F.col("left") - F.col("w")).alias("left")))
        turn += 1
    if done is None:
        done = walkers.select("obj_id", "is_query", F.lit(None).cast("long").alias("edge_id"), F.lit(0.0).alias("length"), F.lit(0.0).alias("off")).limit(0)
    return _placed(done, seed, F.col("off"))


def clustered_both(network: RoadNetwork, n_true: int, n_false: int, seed: int, **how) -> DataFrame:
    return clustered(network, n_true, True, seed, **how).unionByName(clustered(network, n_false, False, seed + 500, first=n_true + 1, **how))


def mixed(network: RoadNetwork, n_true: int, n_false: int, seed: int, clustered_type: bool = True, **how) -> DataFrame:
    """One type clustered, the other uniform."""
    a = clustered(network, n_true, True, seed, **how) if clustered_type else uniform(network, n_true, True, seed)
    b = uniform(network, n_false, False, seed + 500, n_true + 1) if clustered_type else clustered(network, n_false, False, seed + 500, first=n_true + 1, **how)
    return a.unionByName(b)


def around_edges(network: RoadNetwork, n: int, kind: bool, seed: int, centroids: list[int], perimeter: float, first: int = 1) -> DataFrame:
    """n objects of one type on edges within a perimeter of the given edges, picked uniformly."""
    near = None
    for c in centroids:
        own = edges_within(network, c, perimeter).select("edge_id")
        near = own if near is None else near.unionByName(own)
    pool = network.edges.join(near.distinct(), "edge_id", "left_semi") if near is not None else network.edges.limit(0)
    return _placed(_picked(pool, _ids(network, n, first, kind), seed), seed)


def around_edges_and_uniform(network: RoadNetwork, n_near: int, n_uniform: int, near_type: bool, seed: int, centroids: list[int], perimeter: float) -> DataFrame:
    """One type around edges, the other uniform over the network."""
    return around_edges(network, n_near, near_type, seed, centroids, perimeter).unionByName(uniform(network, n_uniform, not near_type, seed + 700, n_near + 1))


def filled(network: RoadNetwork, spacing: float, seed: int, p_true: float = 0.5, share_of_edges: float = 1.0, fill: float = 1.0, most: int | None = None) -> DataFrame:
    """Objects at a distance of at least `spacing` from each other on every edge that is picked.

    An edge's capacity is that of objects_that_fit; each of its slots is used with probability `fill`, and an object
    stands at random in the room its slot leaves. `most` keeps the first so many of all in random order.
    """
    fits = objects_that_fit(F.col("length"), F.lit(spacing))
    e = network.edges.where(random_double(seed, "edge_id") < share_of_edges).withColumn("fits", fits).where("fits > 0")
    slot = e.select("edge_id", "length", "fits", F.explode(F.sequence(F.lit(1).cast("long"), F.col("fits"))).alias("slot")).where(random_double(seed + 1, "edge_id", "slot") < fill)
    # slots are length / (fits + 1) apart, at least `spacing`; what is over is the room an object may move by
    step = F.col("length") / (F.col("fits") + 1)
    off = F.col("slot") * step + (random_double(seed + 2, "edge_id", "slot") - 0.5) * (step - spacing)
    rows = slot.withColumn("off", off).withColumn("is_query", random_double(seed + 3, "edge_id", "slot") < p_true)
    if most is not None:
        rows = rows.orderBy(F.xxhash64("edge_id", "slot", F.lit(seed + 4)), "edge_id", "slot").limit(most)
    return _placed(numbered(rows, ["edge_id", "slot"], "obj_id"), seed, F.col("off"))


def filled_exactly(network: RoadNetwork, spacing: float, n_true: int, n_false: int, seed: int) -> DataFrame:
    """Exact numbers of both types with a least spacing; a ValueError if the network has no room for them."""
    rows = filled(network, spacing, seed, most=n_true + n_false)
    ranked = numbered(rows.withColumn("h", F.xxhash64("obj_id", F.lit(seed + 5))), ["h", "obj_id"], "k")
    if ranked.count() < n_true + n_false:
        raise ValueError("the network has no room for so many objects at that spacing")
    return ranked.withColumn("is_query", F.col("k") <= n_true).select(*COLUMNS)


def least_spacing(network: RoadNetwork, shortest_over: float | None = None, total_over: float | None = None, places: int = 5) -> float:
    """A spacing rounded to some places: a share of the shortest edge's length or of all edges' total length.

    0 for a network without edges.
    """
    if (shortest_over is None) == (total_over is None):
        raise ValueError("give shortest_over or total_over")
    shortest, total = network.edges.agg(F.min("length"), F.sum("length")).first()
    return round((shortest or 0.0) / shortest_over if total_over is None else (total or 0.0) / total_over, places)


def sampled(network: RoadNetwork, spacing: float, seed: int, p_true: float = 0.5, most: int | None = None, first: int = 1) -> DataFrame:
    """Objects on a random choice of edges, a random number on each, at least `spacing` from each other.

    Of E edges between E / 2 and E are picked, each number being as likely; a picked edge with room for c objects gets
    between c / 5 and c / 2 of them (whole numbers, rounded down), so short edges may get none. Places are those of
    that many uniform ones in the room that spacing leaves, in order, with a spacing between each and the next: no place
    is tried and rejected, and the first and last may be at the very ends. `most` keeps so many of all, at random.
    """
    if not spacing > 0:
        raise ValueError("spacing must be above 0")
    e = numbered(network.edges.select("edge_id", "length", F.xxhash64("edge_id", F.lit(seed)).alias("h")), ["h", "edge_id"], "nth").drop("h")
    n = e.count()
    fits = objects_that_fit(F.col("length"), F.lit(spacing))
    low, high = F.floor(F.col("fits") / 5).cast("long"), F.floor(F.col("fits") / 2).cast("long")
    # one choice for the whole network: a hash of the seed alone
    picked = e.where(F.col("nth") <= F.lit(n - n // 2) + F.pmod(F.xxhash64(F.lit(seed + 1)), F.lit(n // 2 + 1))).withColumn("fits", fits)
    wanted = picked.withColumn("n", low + F.pmod(F.xxhash64("edge_id", F.lit(seed + 2)), high - low + 1)).where("n > 0")
    slots = wanted.select("edge_id", "length", "n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("slot"))
    drawn = slots.withColumn("u", random_double(seed + 3, "edge_id", "slot"))
    # numbers in the order of all edges, so that an edge of many objects is no single task's
    ranked = numbered(drawn, ["edge_id", "u", "slot"], "k")
    starts = ranked.groupBy("edge_id").agg(F.min("k").alias("start"))
    ranked = join_hot(ranked, starts, ["edge_id"], "slot").withColumn("before", F.col("k") - F.col("start"))
    off = F.col("u") * (F.col("length") - (F.col("n") - 1) * spacing) + F.col("before") * spacing
    rows = ranked.withColumns({"off": off, "is_query": random_double(seed + 4, "edge_id", "slot") < p_true, "obj_id": F.col("k") + (first - 1)})
    if most is not None:
        kept = rows.orderBy(F.xxhash64("edge_id", "slot", F.lit(seed + 5)), "edge_id", "slot").limit(most).drop("obj_id")
        rows = numbered(kept, ["edge_id", "u", "slot"], "obj_id", first)
    return _placed(rows, seed, F.col("off"))


def spacing_for(network: RoadNetwork, n_objects: int) -> float:
    """Total length over the number of objects."""
    return float(network.edges.agg(F.sum("length")).first()[0] or 0.0) / max(n_objects, 1)


def capacity(network: RoadNetwork, spacing: float) -> int:
    """How many objects the network has room for."""
    return int(network.edges.agg(F.sum(objects_that_fit(F.col("length"), F.lit(spacing)))).first()[0] or 0)


def least_parameter(network: RoadNetwork, wanted: int, most: int = 10_000) -> int | None:
    """The least p such that a spacing of the shortest edge over p has room for `wanted` objects; None if no p has.

    Room grows with p, so p is found by halving, with one aggregation a step.
    """
    shortest = network.edges.agg(F.min("length")).first()[0]
    if not shortest or capacity(network, shortest / most) < wanted:
        return None
    low, high = 1, most
    while low < high:
        p = (low + high) // 2
        low, high = (low, p) if capacity(network, shortest / p) >= wanted else (p + 1, high)
    return low


def type_percent(objects: DataFrame) -> DataFrame:
    """n_true, n_false and their percentages, to two places."""
    n = F.count(F.lit(1))
    t, f = F.count_if("is_query"), F.count_if(~F.col("is_query"))
    return objects.agg(t.alias("n_true"), f.alias("n_false"), F.round(F.try_divide(100.0 * t, n), 2).alias("true_percent"), F.round(F.try_divide(100.0 * f, n), 2).alias("false_percent"))
