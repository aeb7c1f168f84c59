"""The k shortest simple paths by deviations from a shortest-path tree.

The tree leads every node to the target. A path is known by its last deviation: it shares a prefix with a path found
before, leaves it by a step that is not the tree's, and follows the tree from there. So each path comes from one parent,
no cheaper than it, and the least that waits are made into nodes first, k or more a round and in each round up to twice
as many as before. Where the tree would take a step back at once, the path goes on by the best other step, and costs that
at least. A tree's tail may come back to the prefix later: such a path is no answer, but is deviated from up to where it
comes back. Candidates are kept as a step beside their parent, without nodes. Tails are read off the tree by jumps of
1, 2, 4, ... steps, so a round takes as many joins as the longest path has binary digits. Work grows with k and with the
paths that come back.

All this goes over chains' ends with one inner node for each chain, so that parallel chains differ in their nodes and a
step into a chain is a step or two from its other end; what lies between is put in at last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearway.network import RoadNetwork
from nearway.skew import join_hot
from nearway.storage import Workspace

#: Costs that differ by no more than this share count as equal when candidates are dropped.
NEARLY = 1e-9
#: Paths that a round makes, at most, since one task chooses them.
MOST_AT_ONCE = 16_384
WAITING = "parent string, at int, dst long, w double, via long, over double, least double"


def simple_paths(network: RoadNetwork, source: int, target: int, k: int, at_once: int = 256) -> DataFrame:
    """rank, cost, nodes: the k shortest simple paths; ties by the list of nodes.

    There are fewer rows where there are fewer paths, and one of no length if the target is the source. Of parallel edges
    the shortest counts. at_once: paths that the first round makes, k at least.
    """
    spark, at_once = network.edges.sparkSession, max(k, at_once)
    work = Workspace(spark, "deviations")
    rest = network.contracted.labels(spark.createDataFrame([(target, 0.0, 0)], "node long, dist double, obj long")).select("node", F.col("dist").alias("rest"))
    legs = work.write(_legs(network, source, target))
    steps = work.write(legs.select("src", "dst", "w").join(rest.withColumnRenamed("node", "dst"), "dst"))
    jumps = _jumps(work, steps, rest)
    steps = work.write(_onward(steps, jumps[0]))
    root = spark.createDataFrame([("", source, 0.0, 0)], "pid string, start long, base double, size int")
    root = root.join(rest, F.col("start") == F.col("node"), "left_semi")  # nothing leads from there if it has no label
    made = work.write(_made(root.withColumns({"prefix": F.array().cast("array<long>"), "costs": F.array().cast("array<double>")}), jumps))
    paths, most = made, float("inf")
    waiting = spark.createDataFrame([], WAITING)
    while True:
        best = paths.where("simple").orderBy("cost").limit(k).agg(F.count(F.lit(1)).alias("n"), F.max("cost").alias("m")).first()
        most = best["m"] * (1 + NEARLY) if best["n"] == k else most
        waiting = work.write(waiting.unionByName(_deviations(made, steps, target)).where(F.col("least") <= most))
        chosen, seen = work.write_seen(waiting.orderBy("least", "parent", "at", "dst").limit(at_once), n=F.count(F.lit(1)))
        if not seen["n"]:
            break
        waiting = waiting.join(chosen, ["parent", "at", "dst"], "left_anti")
        at_once = max(at_once, min(2 * at_once, MOST_AT_ONCE))
        made = work.write(_made(_prefixes(chosen, paths), jumps))
        paths = paths.unionByName(made)
    ended = paths.where(F.col("simple") & (F.col("cost") <= most)).select("pid", "cost", "nodes")
    best = _whole(network, work.write(ended), legs).orderBy("cost", "nodes").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy("cost", "nodes"))).select("rank", "cost", "nodes")


def _legs(network: RoadNetwork, source: int, target: int) -> DataFrame:
    """src, dst, w, chain_id, low, high: steps between nodes that are kept, and what they pass of a chain.

    Kept are the ends of chains, source and target, and along each chain the node after each of these.
    """
    if network.contracted.plain is not None:
        return network.contracted.plain.where("not own").select("src", "dst", "w", *[F.lit(None).cast("long").alias(c) for c in ("chain_id", "low", "high")])
    spots = network.contracted.spots
    ends = network.contracted.ends.select("chain_id", F.col("top").alias("pos"), F.col("total").alias("at"), F.col("last").alias("node"))
    points = spots.select("chain_id", F.col("pos").cast("long").alias("pos"), "at", "node").unionByName(ends)
    marked = spots.where((F.col("pos") == 0) | F.col("node").isin(source, target)).select("chain_id", F.explode(F.array("pos", F.col("pos") + 1)).alias("pos"))
    marked = marked.unionByName(ends.select("chain_id", "pos")).select("chain_id", F.col("pos").cast("long").alias("pos")).distinct()
    along = Window.partitionBy("chain_id").orderBy("pos")  # eight nodes at most
    kept = points.join(marked, ["chain_id", "pos"]).withColumn("next", F.lead(F.struct("pos", "at", "node")).over(along)).where("next is not null")
    way = lambda src, dst: F.struct(src.alias("src"), dst.alias("dst"))
    both = kept.select(F.explode(F.array(way(F.col("node"), F.col("next.node")), way(F.col("next.node"), F.col("node")))).alias("e"), (F.col("next.at") - F.col("at")).alias("w"), "chain_id", F.col("pos").alias("low"), F.col("next.pos").alias("high"))
    return both.where("e.src <> e.dst").groupBy("e.src", "e.dst").agg(F.min(F.struct("w", "chain_id", "low", "high")).alias("b")).select("src", "dst", "b.*")


def _whole(network: RoadNetwork, paths: DataFrame, legs: DataFrame) -> DataFrame:
    """cost and nodes of paths, with the nodes of chains that lie between those kept."""
    if network.contracted.plain is not None:
        return paths.select("cost", "nodes")
    own = paths.select("pid", F.posexplode("nodes").alias("i", "node"))
    passed = own.withColumn("dst", F.lead("node").over(Window.partitionBy("pid").orderBy("i"))).withColumnRenamed("node", "src").join(legs.where("high > low + 1"), ["src", "dst"])
    spots = network.contracted.spots.select("chain_id", "pos", "node")
    # a leg's low node is the chain's inner one, so it tells which way the chain is gone along
    first = spots.select("chain_id", F.col("pos").alias("low"), F.col("node").alias("low_node"))
    passed = passed.join(first, ["chain_id", "low"]).select("pid", "i", "chain_id", "low", "high", (F.col("src") == F.col("low_node")).alias("up"))
    inner = join_hot(spots, passed, ["chain_id"], "pos").where("pos > low AND pos < high")
    inner = inner.select("pid", "i", F.when(F.col("up"), F.col("pos")).otherwise(-F.col("pos")).cast("long").alias("o"), "node")
    # a kept node comes before what follows it
    rows = own.select("pid", "i", F.lit(None).cast("long").alias("o"), "node").unionByName(inner)
    nodes = rows.groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("i", F.col("o").isNotNull().alias("inner"), "o", "node"))).alias("n"))
    return paths.drop("nodes").join(nodes, "pid").select("cost", F.col("n.node").alias("nodes"))


def _jumps(work: Workspace, steps: DataFrame, rest: DataFrame) -> list[DataFrame]:
    """node, to (and w): the tree's step from each node, and the same for 2, 4, ... steps."""
    own = rest.select(F.col("node").alias("src"), F.col("rest").alias("own"))
    onward = steps.join(own, "src").where(F.col("rest") < F.col("own"))
    first = onward.groupBy(F.col("src").alias("node")).agg(F.min_by(F.struct("dst", "w"), F.struct(F.col("w") + F.col("rest"), "dst")).alias("s"))
    out = [work.write(first.select("node", F.col("s.dst").alias("to"), "s.w"))]
    while True:
        last = out[-1].select("node", "to")
        twice = last.join(last.select(F.col("node").alias("to"), F.col("to").alias("far")), "to").select("node", F.col("far").alias("to"))
        twice = work.write(twice)
        if twice.isEmpty():
            return out
        out.append(twice)


def _onward(steps: DataFrame, first: DataFrame) -> DataFrame:
    """src, dst, w, rest, via, over: what is left at least after each step, as no path takes the same step back.

    Where the tree goes back from dst to src, via is the node that the least other way goes on to and over the step there;
    steps that nothing else follows aren't kept. A node has one step of the tree, so no more rows are joined than steps.
    """
    tree = steps.join(first.select(F.col("node").alias("dst"), "to"), "dst", "left")
    back = tree.where("to = src").select("src", "dst")
    after = steps.select(F.col("src").alias("dst"), F.col("dst").alias("via"), F.col("w").alias("over"), F.col("rest").alias("then"))
    least = F.min(F.struct((F.col("over") + F.col("then")).alias("rest"), "via", "over")).alias("o")
    other = back.join(after, "dst").where("via <> src").groupBy("src", "dst").agg(least)
    turned = steps.drop("rest").join(other, ["src", "dst"]).select("src", "dst", "w", "o.rest", "o.via", "o.over")
    none = {"via": F.lit(None).cast("long"), "over": F.lit(None).cast("double")}
    return tree.where("to is null or to <> src").select("src", "dst", "w", "rest").withColumns(none).unionByName(turned)


def _prefixes(chosen: DataFrame, paths: DataFrame) -> DataFrame:
    """pid, start, base, size, prefix, costs: where each chosen candidate's tail begins, and what comes before.

    size counts the nodes shared with the parent; a step that the tree would take back is in the prefix too.
    """
    shared = chosen.join(paths.select(F.col("pid").alias("parent"), "nodes", "costs"), "parent")
    upto, reached = F.col("at") + 1, F.get("costs", F.col("at")) + F.col("w")
    with_step = lambda c, x: F.when(F.col("via").isNull(), F.slice(c, 1, upto)).otherwise(F.concat(F.slice(c, 1, upto), F.array(x)))
    return shared.select(
        F.concat_ws("/", "parent", F.concat_ws(":", "at", "dst")).alias("pid"), F.coalesce("via", "dst").alias("start"),
        (reached + F.coalesce("over", F.lit(0.0))).alias("base"), upto.alias("size"),
        with_step("nodes", F.col("dst")).alias("prefix"), with_step("costs", reached).alias("costs"),
    )


def _made(begun: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """pid, nodes, costs (up to each node), cost, dev, upto, simple: prefixes followed by the tree's way to the target.

    dev is the index of the first node after the deviation; nodes before the index upto differ from each other.
    """
    rows = begun.select("pid", "base", F.lit(0).alias("pos"), F.col("start").alias("node"))
    for i in reversed(range(len(jumps))):
        here, there = F.struct("pos", "node"), F.struct((F.col("pos") + (1 << i)).alias("pos"), F.col("to").alias("node"))
        both = F.when(F.col("to").isNull(), F.array(here)).otherwise(F.array(here, there))
        rows = rows.join(jumps[i].select("node", "to"), "node", "left").select("pid", "base", F.explode(both).alias("e")).select("pid", "base", "e.*")
    along = Window.partitionBy("pid").orderBy("pos")
    rows = rows.join(jumps[0].select("node", "w"), "node", "left").withColumn("step", F.coalesce(F.lag("w").over(along), "base"))
    rows = rows.withColumn("cost", F.sum("step").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    tails = rows.groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("pos", "node", "cost"))).alias("t"))
    out = begun.join(tails, "pid").withColumns({"tail": F.col("t.node"), "hit": F.get(F.array_intersect(F.col("t.node"), "prefix"), F.lit(0))})
    upto = F.size("prefix") + F.when(F.col("hit").isNull(), F.size("tail")).otherwise(F.array_position("tail", F.col("hit")) - 1)
    return out.select(
        "pid", F.concat("prefix", "tail").alias("nodes"), F.concat("costs", F.col("t.cost")).alias("costs"), F.element_at("t.cost", -1).alias("cost"),
        F.col("size").alias("dev"), upto.cast("int").alias("upto"), F.col("hit").isNull().alias("simple"),
    )


def _deviations(made: DataFrame, steps: DataFrame, target: int) -> DataFrame:
    """parent, at, dst, w, via, over, least: every step that leaves a tail for a node that its path hasn't met before."""
    met = made.select("pid", "dev", "upto", F.posexplode(F.arrays_zip("nodes", "costs")).alias("at", "n")).select("pid", "dev", "upto", "at", "n.nodes", "n.costs")
    met = met.select("pid", "dev", "upto", "at", F.col("nodes").alias("src"), F.col("costs").alias("before"))
    follows = F.lead("src").over(Window.partitionBy("pid").orderBy("at"))
    leaving = met.withColumn("follows", follows).where((F.col("at") >= F.col("dev")) & (F.col("at") < F.col("upto")) & (F.col("src") != target))
    left = leaving.join(steps, "src").where(F.col("dst") != F.col("follows")).alias("l")
    back = met.select("pid", F.col("at").alias("seen"), F.col("src").alias("dst")).alias("m")
    again = (F.col("l.pid") == F.col("m.pid")) & (F.col("l.dst") == F.col("m.dst")) & (F.col("m.seen") < F.col("l.at"))
    fresh = left.join(back, again, "left_anti")
    return fresh.select(F.col("pid").alias("parent"), "at", "dst", "w", "via", "over", (F.col("before") + F.col("w") + F.col("rest")).alias("least"))
