"""Queries of readers, writers, generators and look-ups: what a writer wrote is read and must be the derived tables.

Generators pick by hashes that SQL doesn't have; what they promise (numbers of objects, bounds, spacing, ids) is one row of
checks, and SQL says what that row must be.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearway.functions import network_nn
from nearway.functions.scalar import first_key, key_of_value, last_key
from nearway.network import RoadNetwork
from nearway.operators import chains, generate, lookup, parts, relax, runs
from nearway.plans import derived
from nearway.skew import in_order
from nearway.sources import readers, writers
from nearway.storage import Workspace
from nearway.streaming import lookup as streaming


def _path(spark: SparkSession, name: str) -> str:
    work = Workspace(spark, "files")
    return f"{work.path}/{name}"


def _round_trip(write: Callable[[RoadNetwork, str], None], read: Callable[[SparkSession, str], DataFrame]) -> Callable[[RoadNetwork], DataFrame]:
    def run(net: RoadNetwork) -> DataFrame:
        spark = net.edges.sparkSession
        path = _path(spark, "table")
        write(net, path)
        return read(spark, path)

    return run


def _lines(rows: Callable[[RoadNetwork], DataFrame], read: Callable[[SparkSession, str], DataFrame]) -> Callable[[RoadNetwork], DataFrame]:
    """What is read from lines (the column value, in the order of the column k if there is one) of a network."""

    def write(net: RoadNetwork, path: str) -> None:
        out = rows(net)
        out = out.orderBy("k").select("value") if "k" in out.columns else out.select("value")
        out.write.text(path)

    return _round_trip(write, read)


def _merged_rows(net: RoadNetwork) -> DataFrame:
    own = net.objects.groupBy("edge_id").agg(F.array_sort(F.collect_list(F.struct("obj_id", "dist_from_start"))).alias("o"))
    rows = net.edges.join(own, "edge_id", "left").withColumn("n", F.coalesce(F.size("o"), F.lit(0)))
    head = F.struct((F.col("edge_id") * 2).alias("k"), F.concat_ws(" ", "start_node", "end_node", "length", "n").alias("value"))
    tail = F.struct((F.col("edge_id") * 2 + 1).alias("k"), F.array_join(F.transform("o", lambda x: F.concat_ws(" ", x["obj_id"], x["dist_from_start"])), " ").alias("value"))
    return rows.select(F.explode(F.when(F.col("n") > 0, F.array(head, tail)).otherwise(F.array(head))).alias("r")).select("r.k", "r.value")


EDGE = "SELECT edge_id, start_node, end_node, CAST(length AS DOUBLE) AS length FROM edges"
OBJECT = "SELECT obj_id, edge_id, is_query, CAST(dist_from_start AS DOUBLE) AS dist_from_start FROM objects"
PLACE = "SELECT node_id, CAST((node_id * 7919) % 1000 AS DOUBLE) AS longitude, CAST((node_id * 104729) % 1000 AS DOUBLE) AS latitude FROM parts"


def _edges_by_length(net: RoadNetwork) -> DataFrame:
    """Lines of edges from the shortest on, every one with the same id, and a line that is none."""
    e = net.edges.select((F.col("length") * 10_000_000 + F.col("edge_id")).cast("long").alias("k"), F.concat_ws(" ", F.lit(5), "start_node", "end_node", "length").alias("value"))
    return e.unionByName(e.limit(1).select("k", F.lit("a b c d").alias("value")))


def _two_files(net: RoadNetwork, path: str) -> None:
    """Lines of the edges of even number under a and of the others under b; the ring's edges have even ids."""
    for name, rest in (("a", 0), ("b", 2)):
        rows = net.edges.where(F.col("edge_id") % 4 == rest).orderBy("edge_id")
        rows.select(F.concat(F.lit("edge "), "edge_id").alias("value")).write.text(f"{path}/{name}")


def _numbered_network(net: RoadNetwork) -> RoadNetwork:
    """The ring's nodes numbered from 1 without a gap, as METIS asks."""
    return RoadNetwork(writers.reindexed_edges(net.edges), net.objects)


SOURCES: dict[str, tuple[Callable[[RoadNetwork], DataFrame], str]] = {
    "read_nodes_txt": (_round_trip(lambda n, p: writers.write_nodes(derived.node_places(n), p), readers.read_nodes), PLACE),
    "read_nodes_csv": (_round_trip(lambda n, p: writers.write_nodes(derived.node_places(n), p, ","), lambda s, p: readers.read_nodes(s, p, ",")), PLACE),
    "read_nodes_of_four_columns": (_lines(lambda n: derived.node_places(n).select(F.concat_ws(" ", F.lit("7"), "node_id", "longitude", "latitude").alias("value")), readers.read_nodes), PLACE),
    "read_edges_txt": (_round_trip(lambda n, p: writers.write_edges(n.edges, p), readers.read_edges), EDGE),
    "read_edges_csv": (_round_trip(lambda n, p: writers.write_edges(n.edges, p, ","), lambda s, p: readers.read_edges(s, p, ",")), EDGE),
    "read_edges_with_bom_and_returns": (_lines(lambda n: n.edges.select(F.concat(F.lit(readers.BOM), F.concat_ws("  ", "edge_id", "start_node", "end_node", "length"), F.lit("\r")).alias("value")).unionByName(n.edges.limit(1).select(F.lit("a b c").alias("value"))), readers.read_edges), EDGE),
    "read_edges_renumbered": (_round_trip(lambda n, p: writers.write_edges(n.edges, p), lambda s, p: readers.read_edges(s, p, renumber=True)), "SELECT row_number() OVER (ORDER BY edge_id) AS edge_id, start_node, end_node, CAST(length AS DOUBLE) AS length FROM edges"),
    "read_edges_by_line": (
        _lines(_edges_by_length, lambda s, p: readers.read_edges(s, p, by_line=True)),
        "SELECT row_number() OVER (ORDER BY length, edge_id) AS edge_id, start_node, end_node, CAST(length AS DOUBLE) AS length FROM edges",
    ),
    "read_lines_of_two_files": (
        _round_trip(_two_files, lambda s, p: readers.lines(s, [f"{p}/b", f"{p}/a"])),
        "SELECT row_number() OVER (ORDER BY edge_id % 4, edge_id) AS line, 'edge ' || edge_id AS value FROM edges",
    ),
    "read_edge_lengths": (_round_trip(lambda n, p: writers.write_edges(n.edges, p, ","), readers.read_edge_lengths), "SELECT CAST(length AS DOUBLE) AS length FROM edges"),
    "read_objects_txt": (_round_trip(lambda n, p: writers.write_objects(n.objects, p), readers.read_objects), OBJECT),
    "read_objects_csv": (_round_trip(lambda n, p: writers.write_objects_csv(n.objects, p), readers.read_objects_csv), OBJECT),
    "read_merged_edges": (_lines(_merged_rows, lambda s, p: readers.read_merged(s, p)[0]), "SELECT row_number() OVER (ORDER BY edge_id) AS edge_id, start_node, end_node, CAST(length AS DOUBLE) AS length FROM edges"),
    "read_merged_objects": (_lines(_merged_rows, lambda s, p: readers.read_merged(s, p)[1]), "SELECT obj_id, n AS edge_id, CAST(dist_from_start AS DOUBLE) AS dist_from_start FROM objects JOIN (SELECT edge_id, row_number() OVER (ORDER BY edge_id) AS n FROM edges) USING (edge_id)"),
    "read_poi": (_lines(lambda n: derived.node_places(n).select(F.col("node_id").alias("k"), F.concat_ws(",", "longitude", "latitude", F.col("node_id") % 7).alias("value")), readers.read_poi), "SELECT row_number() OVER (ORDER BY node_id) AS obj_id, CAST((node_id * 7919) % 1000 AS DOUBLE) AS longitude, CAST((node_id * 104729) % 1000 AS DOUBLE) AS latitude, CAST(node_id % 7 AS INTEGER) AS category_id FROM parts"),
    "read_parts_by_position": (_round_trip(lambda n, p: derived.node_parts(n).orderBy("node_id").select(F.col("part_id").cast("string")).write.text(p), readers.read_parts), "SELECT row_number() OVER (ORDER BY node_id) AS line, part_id FROM parts"),
    "read_metis": (_round_trip(lambda n, p: writers.write_metis(_numbered_network(n), p), lambda s, p: readers.metis_adjacency(readers.read_metis(s, p))), "SELECT DISTINCT src + 1 AS src, dst + 1 AS dst FROM adj"),
    "read_node_clusters": (_round_trip(lambda n, p: writers.write_node_clusters(n.adjacency.select(F.col("src").alias("chain_id"), F.row_number().over(Window.partitionBy("src").orderBy("dst", "edge_id")).alias("pos"), F.col("dst").alias("node_id")), p), readers.read_node_clusters), "SELECT src AS chain_id, row_number() OVER (PARTITION BY src ORDER BY dst, edge_id) - 1 AS pos, dst AS node_id FROM adj"),
    "read_categories": (_lines(lambda n: n.edges.select(F.concat_ws(",", "edge_id", F.concat(F.lit(" kind"), "edge_id"), F.when(F.col("edge_id") % 3 == 0, "true").when(F.col("edge_id") % 3 == 1, "FALSE")).alias("value")), readers.read_categories), "SELECT CAST(edge_id AS INTEGER) AS category_id, 'kind' || edge_id AS name, CASE edge_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS is_query FROM edges"),
    "read_object_parameters": (_lines(lambda n: n.edges.select(F.concat_ws(" ", F.concat(F.lit("SET"), "edge_id"), "start_node", "length").alias("value")), readers.read_object_parameters), "SELECT 'SET' || edge_id AS dataset, start_node AS n_objects, CAST(length AS DOUBLE) AS parameter FROM edges"),
    "write_hgr": (_round_trip(lambda n, p: writers.write_hgr(n, p, weighted=True), lambda s, p: readers.lines(s, p).select("line", "value")), "SELECT 1::BIGINT AS line, (SELECT count(*) FROM edges) || ' ' || (SELECT max(src) FROM adj) || ' 1' AS value UNION ALL SELECT row_number() OVER (ORDER BY edge_id) + 1, length || ' ' || start_node || ' ' || end_node FROM edges"),
    "write_report": (_round_trip(lambda n, p: [writers.append_report(n.edges.groupBy().agg(F.count(F.lit(1)).alias("n"), F.lit(k).alias("run")), p) for k in (1, 2)], lambda s, p: s.read.option("header", True).option("inferSchema", True).csv(p).select(F.col("n").cast("long").alias("n"), "run")), "SELECT count(*) AS n, 1 AS run FROM edges UNION ALL SELECT count(*), 2 FROM edges"),
    "write_results": (_round_trip(lambda n, p: writers.write_results(n.objects.select("obj_id", "edge_id"), p), lambda s, p: s.read.parquet(p)), "SELECT obj_id, edge_id FROM objects"),
    "latest_rows": (lambda n: readers.latest_rows(n.objects.select("edge_id", "obj_id"), "edge_id", "obj_id"), "SELECT edge_id, max(obj_id) AS obj_id FROM objects GROUP BY edge_id"),
    "without_adjacent_reverse_edges": (lambda n: writers.without_reverse_edges(_there_and_back(n), adjacent_only=True), "SELECT edge_id * 3 AS edge_id, start_node, end_node, CAST(length AS DOUBLE) AS length FROM edges"),
    "subgraph_edges": (lambda n: n.without_edges(n.edges.where("length < 500").select("edge_id")).edges, "SELECT edge_id, start_node, end_node, CAST(length AS DOUBLE) AS length FROM edges WHERE length >= 500"),
    "subgraph_objects": (lambda n: n.without_edges(n.edges.where("length < 500").select("edge_id")).objects.select("obj_id"), "SELECT obj_id FROM objects WHERE length >= 500"),
}


def _there_and_back(net: RoadNetwork) -> DataFrame:
    """Every edge, and after it the same the other way round; ids leave room, so neighbours by id are these pairs."""
    back = net.edges.selectExpr("edge_id * 3 + 1 AS edge_id", "end_node AS start_node", "start_node AS end_node", "length")
    return net.edges.selectExpr("edge_id * 3 AS edge_id", "start_node", "end_node", "length").unionByName(back)


LOOKUPS: dict[str, tuple[Callable[[RoadNetwork], DataFrame], str]] = {
    "nodes_by_ids": (lambda n: lookup.nodes_by_ids(n, _ids(n.nodes, "node_id")), "SELECT CAST(row_number() OVER (ORDER BY node_id) - 1 AS INTEGER) AS pos, node_id FROM parts"),
    "nodes_by_index": (lookup.nodes_by_index, "SELECT row_number() OVER (ORDER BY node_id) - 1 AS idx, node_id FROM parts"),
    "ends_of_edges": (lambda n: lookup.ends_of_edges(n, n.edges.select("edge_id")), "SELECT edge_id, start_node, end_node FROM edges"),
    "has_edges": (lambda n: lookup.has_edges(n, n.edges.select(F.col("start_node").alias("a"), (F.col("end_node") + F.col("edge_id") % 2).alias("b")).distinct()), "SELECT a, b, EXISTS (SELECT 1 FROM adj WHERE src = a AND dst = b) AS joined FROM (SELECT DISTINCT start_node AS a, end_node + edge_id % 2 AS b FROM edges)"),
    "edges_of_objects": (lambda n: lookup.edges_of_objects(n, n.objects.select("obj_id")), "SELECT obj_id, edge_id, start_node, end_node, CAST(length AS DOUBLE) AS length FROM objects"),
    "adjacent_edges_with_objects": (lookup.adjacent_with_objects, "SELECT a.edge_id, b.edge_id AS neighbour_id, count(DISTINCT o.obj_id) AS n_objects FROM adj a JOIN adj b ON a.src = b.src AND a.edge_id <> b.edge_id JOIN objects o ON o.edge_id = b.edge_id GROUP BY a.edge_id, b.edge_id"),
}


def _ids(rows: DataFrame, column: str) -> DataFrame:
    """One row with all ids in order, as a caller's list."""
    return rows.agg(F.array_sort(F.collect_list(column)).alias("ids"))


def _checks(build: Callable[[RoadNetwork], DataFrame], spacing: float | None = None) -> Callable[[RoadNetwork], DataFrame]:
    """One row of what generated objects keep: their numbers, and how many break a rule."""

    def run(net: RoadNetwork) -> DataFrame:
        made = Workspace(net.edges.sparkSession, "made").write(build(net))
        again = build(net)
        placed = made.join(net.edges.select("edge_id", "length"), "edge_id", "left")
        near = in_order(made, "edge_id", "dist_from_start", ["dist_from_start", "obj_id"], F.col("dist_from_start"))
        ok = placed.agg(
            F.count_if("is_query").alias("n_true"), F.count_if(~F.col("is_query")).alias("n_false"), F.countDistinct("obj_id").alias("n_ids"),
            F.count_if(F.col("length").isNull() | ~F.col("dist_from_start").between(0, F.col("length"))).alias("n_outside"), F.count_if(~F.col("rating").between(1, 10)).alias("n_bad_ratings"),
        )
        close = near.agg(F.count_if(F.col("dist_from_start") - F.col("before") < F.lit((spacing or 0.0) - 1e-5)).alias("n_too_close"))
        changed = made.exceptAll(again).agg(F.count(F.lit(1)).alias("n_changed"))
        return ok.crossJoin(F.broadcast(close)).crossJoin(F.broadcast(changed))  # one row each

    return run


def _promised(n_true: str, n_false: str) -> str:
    return f"SELECT {n_true}::BIGINT AS n_true, {n_false}::BIGINT AS n_false, {n_true}::BIGINT + {n_false}::BIGINT AS n_ids, 0::BIGINT AS n_outside, 0::BIGINT AS n_bad_ratings, 0::BIGINT AS n_too_close, 0::BIGINT AS n_changed"


def _sampled_edges(net: RoadNetwork) -> DataFrame:
    """Each edge with its room, whether its objects keep the bounds of a picked edge, and whether enough edges were picked."""
    spacing = generate.least_spacing(net, shortest_over=3)
    made = generate.sampled(net, spacing, seed=7)
    placed = made.join(net.edges.select("edge_id", "length"), "edge_id").where(F.col("dist_from_start").between(0, F.col("length")))
    n = F.coalesce("n", F.lit(0))
    room = F.greatest(F.floor(F.col("length") / spacing) - 1, F.lit(0)).cast("long")
    edges = net.edges.join(placed.groupBy("edge_id").agg(F.count(F.lit(1)).alias("n")), "edge_id", "left").withColumn("room", room)
    edges = Workspace(net.edges.sparkSession, "sampled").write(edges.withColumn("n", n))
    # a picked edge without objects has room for four at most
    used = edges.agg((F.count_if(F.expr("n > 0 OR room < 5")) >= F.floor(F.count(F.lit(1)) / 2)).alias("enough"), (F.count_if(F.expr("n = 0")) > 0).alias("some_left_out"))
    kept = (F.col("n") == 0) | F.col("n").between(F.floor(F.col("room") / 5), F.floor(F.col("room") / 2))
    return edges.select("edge_id", "room", kept.alias("kept")).crossJoin(F.broadcast(used))  # one row


#: What SQL says of generate.sampled(): every edge's room, and that the rules are kept.
SAMPLED = """SELECT edge_id, CAST(greatest(floor(length / s) - 1, 0) AS BIGINT) AS room, true AS kept, true AS enough, true AS some_left_out
FROM edges, (SELECT round(min(length) / 3.0::DOUBLE, 5) AS s FROM edges)"""

GENERATORS: dict[str, tuple[Callable[[RoadNetwork], DataFrame], str]] = {
    "generate_uniform": (_checks(lambda n: generate.uniform_both(n, 300, 200, seed=1)), _promised("300", "200")),
    "generate_clustered": (_checks(lambda n: generate.clustered_both(n, 100, 90, seed=2, deviation=200.0)), _promised("100", "90")),
    "generate_mixed": (_checks(lambda n: generate.mixed(n, 100, 80, seed=3, deviation=200.0)), _promised("100", "80")),
    "generate_mixed_other": (_checks(lambda n: generate.mixed(n, 70, 80, seed=3, clustered_type=False, deviation=200.0)), _promised("70", "80")),
    "generate_around_edges": (_checks(lambda n: generate.around_edges_and_uniform(n, 100, 60, True, 4, [2, 10], 3000.0)), _promised("100", "60")),
    "generate_filled": (_checks(lambda n: generate.filled(n, 60.0, seed=5, p_true=1.0), 60.0), _promised("(SELECT sum(greatest(floor(length / 60.0) - 1, 0)) FROM edges)", "0")),
    "generate_filled_exactly": (_checks(lambda n: generate.filled_exactly(n, 60.0, 120, 50, seed=6), 60.0), _promised("120", "50")),
    "generate_sampled": (_sampled_edges, SAMPLED),
    "generate_sampled_capped": (
        lambda n: _checks(lambda m: generate.sampled(m, generate.least_spacing(m, shortest_over=3), seed=8, p_true=1.0, most=500), generate.least_spacing(n, shortest_over=3))(n),
        _promised("500", "0"),
    ),
    "least_spacing": (
        lambda n: n.edges.agg(
            F.lit(generate.least_spacing(n, shortest_over=7)).alias("by_shortest"), F.lit(generate.least_spacing(n, total_over=1_000)).alias("by_total"),
            F.count(F.lit(1)).alias("n_edges"),
        ),
        "SELECT round(min(length) / 7.0::DOUBLE, 5) AS by_shortest, round(sum(length) / 1000.0::DOUBLE, 5) AS by_total, count(*) AS n_edges FROM edges",
    ),
    "least_parameter": (lambda n: n.edges.sparkSession.createDataFrame([(generate.least_parameter(n, 1_000),)], "parameter long"), "SELECT min(p)::BIGINT AS parameter FROM range(1, 200) t(p) WHERE (SELECT sum(greatest(floor(length / ((SELECT min(length) FROM edges) / p)) - 1, 0)) FROM edges) >= 1000"),
    "spacing_for": (lambda n: n.edges.sparkSession.createDataFrame([(generate.spacing_for(n, 1_000),)], "spacing double"), "SELECT sum(length) / 1000.0::DOUBLE AS spacing FROM edges"),
}

CHAINS: dict[str, tuple[Callable[[RoadNetwork], DataFrame], str]] = {
    "nodes_per_chain": (chains.nodes_per_chain, "SELECT chain_id, count(*) + 1 AS n_nodes FROM chain GROUP BY chain_id"),
    "objects_to_chain_ends": (chains.to_chain_ends, "SELECT obj_id, chain_id, place AS to_first, total - place AS to_last FROM (SELECT chain_id, obj_id, start_at + CASE WHEN reversed THEN c.length - dist_from_start ELSE dist_from_start END AS place FROM objects o JOIN chain c USING (edge_id)) JOIN (SELECT chain_id, sum(length) AS total FROM chain GROUP BY chain_id) USING (chain_id)"),
    "bad_chains": (lambda n: chains.bad_chains(n, n.chains).agg(F.count(F.lit(1)).alias("n")), "SELECT 0::BIGINT AS n"),
    "misplaced_objects": (lambda n: runs.misplaced_objects(n, n.chains).agg(F.count(F.lit(1)).alias("n")), "SELECT 0::BIGINT AS n"),
    "dead_ends": (chains.dead_ends, "SELECT chain_id, min(tip) AS tip FROM (SELECT chain_id, CASE WHEN deg_a = 1 THEN a ELSE b END AS tip FROM (SELECT c.chain_id, CASE WHEN reversed THEN end_node ELSE start_node END AS a, CASE WHEN reversed THEN start_node ELSE end_node END AS b, x.n AS deg_a, y.n AS deg_b FROM chain c JOIN edges e USING (edge_id) JOIN deg x ON x.src = CASE WHEN reversed THEN end_node ELSE start_node END JOIN deg y ON y.src = CASE WHEN reversed THEN start_node ELSE end_node END) WHERE deg_a = 1 OR deg_b = 1) GROUP BY chain_id"),
}

def vertices_of_path(net: RoadNetwork) -> DataFrame:
    """The path from node 0 to node 5 as a graph of its own: its edges."""
    found = relax.shortest_paths(net, net.nodes.where("node_id = 0"))
    steps = relax.path_to(found, 5).select("step", "node")
    nxt = steps.select((F.col("step") - 1).alias("step"), F.col("node").alias("to"))
    pairs = steps.join(nxt, "step").select(F.col("node").alias("a"), F.col("to").alias("b"))
    return lookup.edges_between(net, pairs).groupBy("a", "b").agg(F.min("length").alias("length"))


def streamed(net: RoadNetwork, labels: DataFrame) -> DataFrame:
    """The answers of a stream of query files, which is stopped and begun again from its checkpoint as files arrive.

    Both runs take what is there and end. The sink's log names what has been written, so a batch that is run again
    after a loss adds nothing.
    """
    spark = net.edges.sparkSession
    work = Workspace(spark, "stream")
    candidates = work.write(streaming.edge_candidates(net, labels, False))
    queries = net.objects.where("is_query").select("obj_id", "edge_id", "dist_from_start")
    arrived, found, log = (f"{work.path}/{name}" for name in ("arrived", "found", "log"))
    for turn in (0, 1):
        part = queries.where(F.pmod(F.xxhash64("obj_id"), F.lit(2)) == turn)
        part.repartition(3).write.mode("append").parquet(arrived)
        stream = spark.readStream.schema(queries.schema).option("maxFilesPerTrigger", 2).parquet(arrived)
        answers = streaming.nearest_in_stream(stream, candidates)
        answers.writeStream.format("parquet").option("path", found).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(answers.schema).parquet(found)


def part_tasks(net: RoadNetwork, given: DataFrame, n: int) -> DataFrame:
    """part_id, task, n_edges: edges dealt by part, part i to task i, counted and written there without another exchange."""
    dealt = parts.part_subgraphs(net, given).select("part_id", "edge_id").repartitionById(n, F.col("part_id"))
    placed = Workspace(net.edges.sparkSession, "tasks").write(dealt.withColumn("task", F.spark_partition_id()))
    return placed.groupBy("part_id", "task").agg(F.count(F.lit(1)).alias("n_edges"))


def nearest_by_sql(net: RoadNetwork, given: DataFrame) -> DataFrame:
    """part_local_nearest() by the SQL table function network_nn."""
    spark = net.edges.sparkSession
    network_nn.register(spark)
    subgraphs = parts.part_subgraphs(net, given).select("part_id", "edge_id", "start_node", "end_node", "length", F.explode_outer("objects").alias("o"))
    rows = subgraphs.select("part_id", "edge_id", "start_node", "end_node", "length", "o.obj_id", "o.is_query", "o.dist_from_start")
    return spark.sql("SELECT query_obj_id, data_obj_id, distance FROM network_nn(TABLE({rows}))", rows=rows)


def scalars(net: RoadNetwork) -> DataFrame:
    """Functions of a map of each edge's objects by id."""
    m = net.objects.groupBy("edge_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("obj_id", "dist_from_start")))).alias("m"), F.max("dist_from_start").alias("far"))
    return m.select("edge_id", first_key(F.col("m")).alias("first"), last_key(F.col("m")).alias("last"), key_of_value(F.col("m"), F.col("far")).alias("farthest"))
