"""Runs of objects of one type along an edge or a chain, and shared execution over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearway.network import RoadNetwork
from nearway.operators.ann import nearest
from nearway.operators.chains import closed_ends, objects_on_chains
from nearway.operators.relax import seeds_of
from nearway.skew import in_order, islands
from nearway.storage import Workspace


def runs(objects: DataFrame, line: str, at: str, slot_rows: int | None = None) -> DataFrame:
    """objects with run (a number within the line), seq and n: maximal sequences of one type along each line.

    At one place objects of type false come first, then by id. A long line is cut into slots of places, each of which
    knows the type before it and where the runs that it shares with others begin and end.
    """
    ordered = in_order(objects, line, at, [at, "is_query", "obj_id"], F.col("is_query"), slot_rows=slot_rows)
    found = islands(ordered, line, F.col("before").isNull() | (F.col("before") != F.col("is_query")))
    return found.drop("_slot", "nth", "before", "after")


def _listed(r: DataFrame, line: str, at: str) -> DataFrame:
    """line, run, is_query, n, first_obj, last_obj: a row for each of runs(), numbered by its first place and first object.

    No more than two runs of a line begin at one place, so two numbers change places at most.
    """
    ends = [F.first("n").alias("n"), F.min_by("obj_id", "seq").alias("first_obj"), F.max_by("obj_id", "seq").alias("last_obj"), F.min(at).alias("_place")]
    whole, here = r.groupBy(line, "run", "is_query").agg(*ends), Window.partitionBy(line, "_place")
    number = F.min("run").over(here) + F.row_number().over(here.orderBy("first_obj", "is_query")) - 1
    return whole.withColumn("run", number.cast("int")).drop("_place")


def edge_runs(network: RoadNetwork) -> DataFrame:
    """edge_id, run, is_query, n, first_obj, last_obj: runs of one type on each edge, of equal places the one with the lesser first object first."""
    return _listed(runs(network.objects, "edge_id", "dist_from_start"), "edge_id", "dist_from_start")


def chain_runs(network: RoadNetwork, kind: bool = True, chains: DataFrame | None = None) -> DataFrame:
    """chain_id, run, n, first_obj, last_obj: runs of the objects of one type along each chain, numbered as edge_runs() does."""
    chains = network.chains if chains is None else chains
    r = _listed(runs(objects_on_chains(network, chains), "chain_id", "at"), "chain_id", "at")
    return r.where(F.col("is_query") == kind).drop("is_query")


def run_stats(run_table: DataFrame) -> DataFrame:
    """One row: runs, their objects, objects that are expanded (one or two for each run), and runs of three or more."""
    return run_table.agg(F.count(F.lit(1)).alias("n_runs"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_objects"), F.coalesce(F.sum(F.least("n", F.lit(2))), F.lit(0)).cast("long").alias("n_expanded"), F.count_if(F.col("n") >= 3).alias("n_contributing"))


def misplaced_objects(network: RoadNetwork, chains: DataFrame) -> DataFrame:
    """Objects whose edge is on no chain: none, if the chains are right."""
    return network.objects.join(chains, "edge_id", "left_anti").select("obj_id", "edge_id")


def shared_execution(network: RoadNetwork, marked: DataFrame) -> DataFrame:
    """q, dist, obj: the ends of every run are searched, the objects between take the better of two sums.

    Between two members of a run there is no answering object on the chain, so a path from an inner one leaves the run
    past its first or its last member; up to there it follows the chain. Where a chain ends at a node without another
    edge and no answering object is between the run and that node, no path leaves there, so the run's other end alone is
    searched and all others take its sum.
    """
    work = Workspace(network.edges.sparkSession, "shared")
    chains = network.chains
    answering = marked.where("not asks")
    on_chain = objects_on_chains(network, chains).drop("is_query").join(marked.select("obj_id", F.col("asks").alias("is_query")), "obj_id")
    made = runs(on_chain, "chain_id", "at")
    # the first and the last run of a chain, if it asks, has nothing between it and the chain's end
    top = made.groupBy("chain_id").agg(F.max("run").alias("top"))
    members = made.where("is_query").select("chain_id", "run", "seq", "n", "at", "obj_id")
    tips = closed_ends(network, chains)
    members = work.write(members.join(top, "chain_id").join(tips, "chain_id", "left").select("chain_id", "run", "seq", "n", "at", "obj_id", (F.coalesce("first_closed", F.lit(False)) & (F.col("run") == 1)).alias("no_way_back"), (F.coalesce("last_closed", F.lit(False)) & (F.col("run") == F.col("top"))).alias("no_way_on")))
    is_end = ((F.col("seq") == 1) & ~F.col("no_way_back")) | ((F.col("seq") == F.col("n")) & ~F.col("no_way_on"))
    ends = members.where(is_end)
    searched = marked.join(ends.select("obj_id", F.lit(True).alias("is_end")), "obj_id", "left").where("is_end or not asks")
    found = work.write(nearest(searched, network.contracted.labels(seeds_of(network, answering))))
    known = ends.join(found, F.col("obj_id") == F.col("q")).select("chain_id", "run", F.col("at").alias("end_at"), "dist", "obj")
    inner = members.where(~is_end).join(known, ["chain_id", "run"]).select(F.col("obj_id").alias("q"), (F.col("dist") + F.abs(F.col("at") - F.col("end_at"))).alias("dist"), "obj")
    best = inner.groupBy("q").agg(F.min(F.struct("dist", "obj")).alias("b")).select("q", "b.dist", "b.obj")
    return found.unionByName(best)
