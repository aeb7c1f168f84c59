"""Chains: maximal paths whose inner nodes have two edges each.

Every edge is two darts, one for each direction. A dart leads to the one that goes on from its head, if its head is an
inner node. Pointer doubling gives each dart the last dart of its chain, the number of darts to it and their length in
as many rounds as the logarithm of the longest chain; where a dart's own reverse ends tells the other side. Darts that
find no end are on pure cycles, which are cut at their least node and done again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearway.network import RoadNetwork
from nearway.storage import Workspace


def degrees(network: RoadNetwork) -> DataFrame:
    """node_id, degree (different neighbours), n_edges (edges, parallel ones each) and class of every node."""
    found = network.adjacency.groupBy(F.col("src").alias("node_id")).agg(F.countDistinct("dst").alias("degree"), F.count(F.lit(1)).alias("n_edges"))
    kind = F.when(F.col("degree") == 1, "terminal").when(F.col("degree") == 2, "intermediate").otherwise("intersection")
    return found.withColumn("node_class", kind)


def first_intersection(network: RoadNetwork) -> DataFrame:
    """node_id: the least node with three neighbours or more; no row if there is none."""
    return degrees(network).where("degree >= 3").agg(F.min("node_id").alias("node_id")).where("node_id is not null")


def _doubled(darts: DataFrame, work: Workspace) -> DataFrame:
    """darts with last (null on a cycle), hops and way to it, and the least edge and node on the way.

    Each doubling ends some darts of every chain that is not done; if none has ended, what is left are cycles.
    """
    live = {"n": F.count_if(~F.col("ended"))}
    first = darts.select("dart", F.coalesce("next", "dart").alias("last"), F.col("next").isNull().alias("ended"), F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("hops"), F.col("w").alias("way"), F.col("edge_id").alias("least_edge"), F.col("tail").alias("least_node"))
    d, seen = work.write_seen(_twice(_twice(first)), **live)
    before = None
    # two doublings a table: a job costs more than a join
    while seen["n"] and seen["n"] != before:
        before, old = seen["n"], d
        d, seen = work.write_seen(_twice(_twice(d)), **live)
        work.drop(old)
    return d


def _twice(d: DataFrame) -> DataFrame:
    to = d.select(F.col("dart").alias("t"), F.col("last").alias("t_last"), F.col("ended").alias("t_ended"), F.col("hops").alias("t_hops"), F.col("way").alias("t_way"), F.col("least_edge").alias("t_edge"), F.col("least_node").alias("t_node"))
    # `way` counts the dart itself and those up to, but not with, `last`, unless it has ended
    nxt = d.where("not ended").join(to, F.col("last") == F.col("t")).select("dart", F.col("t_last").alias("last"), F.col("t_ended").alias("ended"), (F.col("hops") + F.col("t_hops")).alias("hops"), (F.col("way") + F.col("t_way")).alias("way"), F.least("least_edge", "t_edge").alias("least_edge"), F.least("least_node", "t_node").alias("least_node"))
    return d.where("ended").unionByName(nxt)


def _darts(network: RoadNetwork, inner: DataFrame) -> DataFrame:
    """dart (2 * edge, one more if reversed), edge_id, reversed, tail, head, w, next."""
    both = network.edges.select("edge_id", F.explode(F.array(F.struct(F.lit(0).alias("r"), F.col("start_node").alias("tail"), F.col("end_node").alias("head")), F.struct(F.lit(1).alias("r"), F.col("end_node").alias("tail"), F.col("start_node").alias("head")))).alias("d"), F.col("length").alias("w"))
    darts = both.select((F.col("edge_id") * 2 + F.col("d.r")).alias("dart"), "edge_id", (F.col("d.r") == 1).alias("reversed"), "d.tail", "d.head", "w")
    out = darts.join(inner, darts["tail"] == inner["inner"]).select(F.col("tail").alias("at"), F.col("dart").alias("next"), F.col("edge_id").alias("next_edge"))
    going = darts.join(out, (darts["head"] == out["at"]) & (darts["edge_id"] != out["next_edge"])).select("dart", "next")
    return darts.join(going, "dart", "left")


def chain_edges(network: RoadNetwork) -> DataFrame:
    """chain_id, pos, edge_id, reversed, length, start_at, is_cycle for every edge.

    A chain's id is its least edge. It is travelled from the end whose edge is the less (a chain of one edge from its
    start); start_at is the length before the edge. A pure cycle begins and ends at its least node.
    """
    work = Workspace(network.edges.sparkSession, "chains")
    inner = degrees(network).where("n_edges = 2").select(F.col("node_id").alias("inner"))
    darts = work.write(_darts(network, inner))
    ends = _doubled(darts, work)
    cycles = work.write(ends.where("not ended").select(F.col("least_node").alias("cut")).distinct())
    if not cycles.isEmpty():
        darts = work.write(_darts(network, inner.join(cycles, F.col("inner") == F.col("cut"), "left_anti")))
        ends = _doubled(darts, work)
    back = ends.select(F.col("dart").bitwiseXOR(F.lit(1)).alias("dart"), F.col("last").bitwiseXOR(F.lit(1)).alias("origin"), F.col("hops").alias("pos"), F.col("way").alias("way_back"), F.col("least_edge").alias("back_edge"))
    # each dart with the first and last dart of its direction; of the two directions that with the less first dart
    all_ = darts.join(ends, "dart").join(back, "dart")
    own = all_.where(F.col("origin") < F.col("last").bitwiseXOR(F.lit(1)))
    cut = cycles.select(F.col("cut"), F.lit(True).alias("is_cycle"))
    first = darts.select(F.col("dart").alias("o"), F.col("tail").alias("origin_node"))
    out = own.join(first, F.col("origin") == F.col("o")).join(cut, F.col("origin_node") == F.col("cut"), "left")
    return out.select(F.least("least_edge", "back_edge").alias("chain_id"), F.col("pos").cast("long"), "edge_id", "reversed", F.col("w").alias("length"), (F.col("way_back") - F.col("w")).alias("start_at"), F.coalesce("is_cycle", F.lit(False)).alias("is_cycle"))


def chain_nodes(network: RoadNetwork, chains: DataFrame | None = None) -> DataFrame:
    """chain_id, pos, node_id: the nodes along every chain."""
    e = (network.chains if chains is None else chains).join(network.edges.select("edge_id", "start_node", "end_node"), "edge_id")
    tail, head = F.when(F.col("reversed"), F.col("end_node")).otherwise(F.col("start_node")), F.when(F.col("reversed"), F.col("start_node")).otherwise(F.col("end_node"))
    return e.select("chain_id", "pos", tail.alias("node_id")).unionByName(e.groupBy("chain_id").agg(F.max(F.struct("pos", head.alias("h"))).alias("m")).select("chain_id", (F.col("m.pos") + 1).alias("pos"), F.col("m.h").alias("node_id")))


def chain_stats(network: RoadNetwork, chains: DataFrame | None = None) -> DataFrame:
    """One row: chains, their edges, inner nodes, and nodes with one neighbour."""
    e = network.chains if chains is None else chains
    d = degrees(network).agg(F.count_if(F.col("degree") == 1).alias("n_terminals"))
    return e.agg(F.countDistinct("chain_id").alias("n_chains"), F.count(F.lit(1)).alias("n_edges")).withColumn("n_inner_nodes", F.col("n_edges") - F.col("n_chains")).crossJoin(F.broadcast(d))


def bad_chains(network: RoadNetwork, chains: DataFrame) -> DataFrame:
    """Nodes of chains that break the rule: an inner one without two edges, or an end with two (but for cycles)."""
    nodes = chain_nodes(network, chains)
    last = Window.partitionBy("chain_id")
    marked = nodes.withColumn("top", F.max("pos").over(last)).join(degrees(network), "node_id").join(chains.select("chain_id", "is_cycle").distinct(), "chain_id")
    end = (F.col("pos") == 0) | (F.col("pos") == F.col("top"))
    return marked.where((~end & (F.col("n_edges") != 2)) | (end & (F.col("n_edges") == 2) & ~F.col("is_cycle"))).select("chain_id", "pos", "node_id", "n_edges")


def objects_on_chains(network: RoadNetwork, chains: DataFrame) -> DataFrame:
    """Objects with their chain and place along it (the distance from the chain's start)."""
    at = F.col("start_at") + F.when(F.col("reversed"), F.col("length") - F.col("dist_from_start")).otherwise(F.col("dist_from_start"))
    return network.objects.join(chains, "edge_id").select("chain_id", "pos", at.alias("at"), "obj_id", "is_query", "edge_id", "is_cycle")


def nodes_per_chain(network: RoadNetwork, chains: DataFrame | None = None) -> DataFrame:
    """chain_id, n_nodes: nodes along every chain, both ends counted."""
    return chain_nodes(network, chains).groupBy("chain_id").agg(F.count(F.lit(1)).alias("n_nodes"))


def to_chain_ends(network: RoadNetwork, chains: DataFrame | None = None) -> DataFrame:
    """obj_id, chain_id, to_first, to_last: each object's way along its chain to both of its ends."""
    chains = network.chains if chains is None else chains
    total = chains.groupBy("chain_id").agg(F.max(F.col("start_at") + F.col("length")).alias("total"))
    return objects_on_chains(network, chains).join(total, "chain_id").select("obj_id", "chain_id", F.col("at").alias("to_first"), (F.col("total") - F.col("at")).alias("to_last"))


def closed_ends(network: RoadNetwork, chains: DataFrame) -> DataFrame:
    """chain_id, first_closed, last_closed of chains an end of which has one edge alone."""
    tips = degrees(network).where("n_edges = 1").select("node_id")
    at = chain_nodes(network, chains).join(tips, "node_id")
    return at.groupBy("chain_id").agg(F.max(F.col("pos") == 0).alias("first_closed"), F.max(F.col("pos") > 0).alias("last_closed"))


def dead_ends(network: RoadNetwork, chains: DataFrame | None = None) -> DataFrame:
    """chain_id and tip of chains an end of which has one edge alone; of two such ends the lesser node."""
    nodes = chain_nodes(network, chains)
    tips = degrees(network).where("n_edges = 1").select("node_id")
    return nodes.join(tips, "node_id").groupBy("chain_id").agg(F.min("node_id").alias("tip"))
