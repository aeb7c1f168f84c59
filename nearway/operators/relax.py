"""Shortest-path labels by relaxation: the one fixpoint operator of the engine.

A label says which object is nearest to a node and how far. A hop joins the labels that are new with the steps from their
nodes and keeps the least label of each node; a step from every node to itself carries what has been found along, so a
job of several hops is one line of joins with one shuffle each. A job's labels are appended as a table of their own, and
labels of earlier jobs are only read, to drop what is no better. Jobs take more hops as they go on. Ties go to the smallest
distance and then to the smallest object, at every node, which gives the same answer whatever the order of rounds,
partitions or edges.

With `delta` labels go on in the order of distance, a bucket of that width at a time: over light steps until the bucket
stands still, and then once over heavy ones, those longer than the bucket is wide.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearway.network import RoadNetwork
from nearway.storage import Workspace

#: Hops of the first job and of later ones, at most; tables of labels before they are merged into one.
HOPS, MOST_HOPS, TABLES = 2, 8, 12
#: Hops that this process has planned, for measures.
ROUNDS = 0


def seeds_of(network: RoadNetwork, objects: DataFrame | None = None) -> DataFrame:
    """node, dist, obj: every object at both ends of its edge."""
    placed = network.placed if objects is None else network.with_objects(objects).placed
    ends = F.explode(F.array(F.struct(F.col("start_node").alias("node"), F.col("dist_from_start").alias("dist")), F.struct(F.col("end_node").alias("node"), (F.col("length") - F.col("dist_from_start")).alias("dist"))))
    return placed.select(ends.alias("s"), F.col("obj_id").alias("obj")).select("s.node", "s.dist", "obj")


def steps_of(adjacency: DataFrame) -> DataFrame:
    """src, dst, w, own: the shortest step between two nodes, and an own one of length 0 from each node to itself."""
    both = F.explode(F.array(F.struct("src", "dst", F.col("w").cast("double").alias("w")), F.struct("src", F.col("src").alias("dst"), F.lit(0.0).alias("w"))))
    least = adjacency.select(both.alias("e")).groupBy("e.src", "e.dst").agg(F.min("e.w").alias("w"))
    return least.withColumn("own", F.col("src") == F.col("dst"))


def relax(
    seeds: DataFrame,
    adjacency: DataFrame,
    keys: tuple[str, ...] = (),
    within: float | None = None,
    bounds: Callable[[DataFrame], DataFrame] | None = None,
    delta: float | None = None,
    known: DataFrame | None = None,
) -> DataFrame:
    """keys, node, dist and obj: the least (dist, obj) with which each node is reached, for each value of the keys.

    adjacency: src, dst, w, or what steps_of() has made of it, possibly with `bar`, an object that may not come to dst.
    `within` ends paths that are longer; bounds gets the labels that a job has found and returns keys and `most`, beyond
    which labels of these keys go no further (for each key that has labels; a null is no bound). known: labels that are
    right as they are and have been sent on, which seeds may better. Nodes that aren't reached have no row, and no length
    is below 0.
    """
    global ROUNDS
    work, names = Workspace(seeds.sparkSession, "relax"), [*keys, "node"]
    steps = adjacency if "own" in adjacency.columns else work.write(steps_of(adjacency))
    fresh = {"n": F.count_if("fresh"), "near": F.min(F.when(F.col("fresh"), F.col("dist")))}

    def least(rows: DataFrame, *more: Column | str) -> DataFrame:
        return rows.groupBy(*names).agg(F.min(F.struct("dist", "obj", *more)).alias("b")).select(*names, "b.*")

    start = seeds.select(*names, F.col("dist").cast("double").alias("dist"), "obj")
    if within is not None:
        start = start.where(F.col("dist") <= within)
    if known is not None:
        known = known.select(*names, F.col("dist").cast("double").alias("dist"), "obj")
        worse = [F.col(f"m.{c}") == F.col(f"k.{c}") for c in names] + [F.struct("k.dist", "k.obj") <= F.struct("m.dist", "m.obj")]
        start = least(start).alias("m").join(known.alias("k"), worse, "left_anti")
    found, seen = work.write_seen(least(start, F.lit(True).alias("fresh")), **fresh)
    tables, hops = [found] if known is None else [known.withColumn("fresh", F.lit(False)), found], HOPS
    top = None if delta is None else delta
    while seen["n"]:
        light = steps if delta is None else steps.where((F.col("w") <= delta) | F.col("own"))
        while True:
            going = "fresh" if top is None else f"fresh AND dist < {top!r}D"
            frontier = tables[-1].where(going)
            if top is not None and not seen["near"] < top:
                break
            tables, seen = _job(work, tables, frontier, light, going, keys, within, bounds, least, hops, fresh)
            ROUNDS, hops = ROUNDS + hops, min(2 * hops, MOST_HOPS)
            if not seen["n"]:
                break
        if top is None:
            break
        # the bucket stands still: its labels are the least, and heavy steps lead beyond it
        bucket = least(_all(tables)).where((F.col("dist") >= top - delta) & (F.col("dist") < top)).withColumn("fresh", F.lit(True))
        heavy = steps.where((F.col("w") > delta) | F.col("own"))
        tables, _ = _job(work, tables, bucket, heavy, f"dist < {top!r}D", keys, within, bounds, least, 1, fresh)
        ROUNDS += 1
        waiting = least(_all(tables)).where(F.col("dist") >= top)
        near = waiting.agg(F.min("dist")).first()[0]
        if near is None:
            break
        top = max((near // delta + 1) * delta, math.nextafter(near, math.inf))
        found, seen = work.write_seen(waiting.where(F.col("dist") < top).withColumn("fresh", F.lit(True)), **fresh)
        tables = [*tables, found]
    if len(tables) == 1:
        return tables[0].drop("fresh")
    return work.write(least(_all(tables)))


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _job(work, tables, frontier, steps, going, keys, within, bounds, least, hops, fresh) -> tuple[list[DataFrame], dict]:
    """tables and one more: the labels that `hops` hops from the frontier find and that are better than all before."""
    names, merged_from = [*keys, "node"], []
    if len(tables) > TABLES:
        # what is merged has been sent on, or waits in the table that is merged last
        merged = work.write(least(_all(tables[:-1])).withColumn("fresh", F.lit(False)))
        merged_from, tables = tables[:-1], [merged, tables[-1]]
    if bounds is None:
        start = frontier.withColumn("most", F.lit(within).cast("double"))
    else:
        start = frontier.join(bounds(tables[-1]), list(keys), "left").withColumn("most", F.least("most", F.lit(within).cast("double")))
    # one statement, which is analysed once however many hops it has
    quoted = [f"`{c}`" for c in names]
    listed, carried = ", ".join(quoted), "".join(f"s.{c}, " for c in quoted[:-1])
    same, bar = " AND ".join(f"m.{c} = k.{c}" for c in quoted), "AND (e.own OR e.bar IS NULL OR e.bar <> s.obj)" if "bar" in steps.columns else ""
    rows = f"SELECT {listed}, dist, obj, fresh, most FROM {{start}} WHERE most IS NULL OR dist <= most"
    for _ in range(hops):
        moved = f"""SELECT {carried} e.dst AS node, s.dist + e.w AS dist, s.obj, NOT e.own OR (s.fresh AND NOT ({going})) AS fresh, s.most
            FROM ({rows}) s JOIN {{steps}} e ON s.node = e.src AND (e.own OR ({going})) {bar}"""
        least_of = f"SELECT {listed}, min(struct(dist, obj, fresh, most)) AS b FROM ({moved}) WHERE most IS NULL OR dist <= most GROUP BY {listed}"
        rows = f"""SELECT m.* FROM (SELECT {listed}, b.* FROM ({least_of})) m
            LEFT ANTI JOIN {{known}} k ON {same} AND struct(k.dist, k.obj) <= struct(m.dist, m.obj)"""
    state = work.spark.sql(f"SELECT {listed}, dist, obj, fresh FROM ({rows})", start=start, steps=steps, known=_all(tables).select(*names, "dist", "obj"))
    found, seen = work.write_seen(state, **fresh)
    work.drop(*merged_from)  # the frontier may have read them
    return [*tables, found], seen


def relax_two(seeds: DataFrame, adjacency: DataFrame) -> DataFrame:
    """node, dist, obj, rank: the two nearest different objects of each node.

    The nearest are found first. A second one comes from a seed, from a neighbour's nearest where that is another object,
    or from a neighbour's second; what is nearest at a node is barred from being its second.
    """
    work = Workspace(seeds.sparkSession, "relax-two")
    steps = work.write(steps_of(adjacency))
    nearest = relax(seeds, steps)
    own = nearest.select("node", F.col("obj").alias("bar"))
    barred = work.write(steps.join(own.withColumnRenamed("node", "dst"), "dst", "left").select("src", "dst", "w", "own", "bar"))
    across = nearest.join(barred.where("not own"), F.col("node") == F.col("src")).where("bar is null or bar <> obj")
    across = across.select(F.col("dst").alias("node"), (F.col("dist") + F.col("w")).alias("dist"), "obj")
    others = seeds.select("node", "dist", "obj").join(own, "node").where("bar <> obj").drop("bar")
    second = relax(work.write(others.unionByName(across)), barred)
    return nearest.withColumn("rank", F.lit(1)).unionByName(second.withColumn("rank", F.lit(2)))


def shortest_paths(network: RoadNetwork, sources: DataFrame, delta: float | None = None) -> DataFrame:
    """source, node, dist, parent: shortest paths from every source; parent is the least node before on such a path."""
    adjacency = network.adjacency
    start = sources.select(F.col("node_id").alias("source"), F.col("node_id").alias("node"), F.lit(0.0).alias("dist"), F.lit(0).cast("long").alias("obj")).distinct()
    found = network.contracted.labels(start, ("source",), delta=delta).drop("obj")
    before = found.select(F.col("source").alias("s"), F.col("node").alias("src"), F.col("dist").alias("d"))
    steps = adjacency.select("src", F.col("dst").alias("node"), "w")
    parents = found.join(steps, "node").join(before, (F.col("source") == F.col("s")) & (before["src"] == steps["src"])).where("abs(d + w - dist) <= 1e-9 * (1 + dist) and w > 0").groupBy("source", "node").agg(F.min(steps["src"]).alias("parent"))
    return found.join(parents, ["source", "node"], "left")


def path_to(paths: DataFrame, target: int) -> DataFrame:
    """source, step, node: each source's path to the target, by following parents backwards."""
    work = Workspace(paths.sparkSession, "path")
    paths = work.write(paths)
    at = paths.where(F.col("node") == target).select("source", F.lit(0).alias("back"), "node", "parent")
    found = live = work.write(at)
    parents = paths.select("source", "node", "parent")
    while not live.where("parent is not null").isEmpty():
        live = work.write(live.where("parent is not null").select("source", (F.col("back") + 1).alias("back"), F.col("parent").alias("node")).join(parents, ["source", "node"]).select("source", "back", "node", "parent"))
        found = found.unionByName(live)
    return found.select("source", (F.max("back").over(Window.partitionBy("source")) - F.col("back")).alias("step"), "node")
