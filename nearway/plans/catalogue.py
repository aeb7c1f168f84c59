"""Every named query of the engine with its SQL counterpart, over the derived network.

In SQL a label is one number, dist * 10**7 + object, so that a plain minimum keeps the smaller object of equal distances.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearway.functions.scalar import euclidean, is_integer, objects_that_fit, round_half_up
from nearway.operators import ann, chains, deviations, generate, lookup, on_edge, partition, parts, relax, runs, stats
from nearway.operators.stored import StoredLabels
from nearway.plans import derived, files
from nearway.sources.readers import word_count
from nearway.sources.writers import hgr_rows, metis_rows, reindexed_edges, without_reverse_edges

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def on_network(name: str, build: Callable[..., DataFrame], sql: str | None = None, variant: str = "dense") -> None:
    """A query of a network, whose SQL follows the network's common table expressions."""
    QUERIES[name] = lambda spark, sf_dir: build(derived.network(spark, sf_dir, variant))
    if sql:
        SQL[name] = f"WITH RECURSIVE {derived.sql(variant)}{sql}"


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# nearest neighbours


def ann_sql(kind: bool, adj: str = "adj", objects: str = "objects") -> str:
    asks, answers = ("is_query", "NOT is_query") if kind else ("NOT is_query", "is_query")
    return f""",
seed AS (SELECT node, min(code) AS code FROM (SELECT start_node AS node, dist_from_start * 10000000 + obj_id AS code FROM {objects} WHERE {answers}
  UNION ALL SELECT end_node, (length - dist_from_start) * 10000000 + obj_id FROM {objects} WHERE {answers}) s GROUP BY node),
lab(node, code) USING KEY (node) AS (SELECT node, code FROM seed UNION
  SELECT a.dst, min(l.code + a.w * 10000000) FROM lab l JOIN {adj} a ON a.src = l.node LEFT JOIN recurring.lab r ON r.node = a.dst WHERE r.code IS NULL OR l.code + a.w * 10000000 < r.code GROUP BY a.dst),
best AS (SELECT q, min(code) AS code FROM (SELECT q.obj_id AS q, l.code + q.dist_from_start * 10000000 AS code FROM {objects} q JOIN lab l ON l.node = q.start_node WHERE {asks.replace("is_query", "q.is_query")}
  UNION ALL SELECT q.obj_id, l.code + (q.length - q.dist_from_start) * 10000000 FROM {objects} q JOIN lab l ON l.node = q.end_node WHERE {asks.replace("is_query", "q.is_query")}
  UNION ALL SELECT q.obj_id, abs(q.dist_from_start - d.dist_from_start) * 10000000 + d.obj_id FROM {objects} q JOIN {objects} d ON d.edge_id = q.edge_id WHERE {asks.replace("is_query", "q.is_query")} AND {answers.replace("is_query", "d.is_query")}) x GROUP BY q)
SELECT o.obj_id AS query_obj_id, code % 10000000 AS data_obj_id, CAST((code - code % 10000000) // 10000000 AS DOUBLE) AS distance FROM {objects} o LEFT JOIN best ON best.q = o.obj_id WHERE {asks.replace("is_query", "o.is_query")}"""


for _variant, _prefix in (("dense", "ann"), ("mixed", "ann_mixed"), ("ring", "ann_ring")):
    on_network(f"{_prefix}_true_to_false", lambda n: ann.all_nearest(n, "true_to_false"), ann_sql(True), _variant)
    on_network(f"{_prefix}_false_to_true", lambda n: ann.all_nearest(n, "false_to_true"), ann_sql(False), _variant)
    on_network(f"{_prefix}_auto", lambda n: ann.all_nearest(n, "auto"), ann_sql(_variant == "dense"), _variant)
    on_network(f"{_prefix}_scl", lambda n: ann.all_nearest(n, "true_to_false", "scl"), ann_sql(True), _variant)
on_network("ann_scl_false_to_true", lambda n: ann.all_nearest(n, "false_to_true", "scl"), ann_sql(False), "mixed")
on_network("ann_naive", lambda n: ann.all_nearest(n, "true_to_false", "naive"), ann_sql(True))
on_network("ann_mixed_naive", lambda n: ann.all_nearest(n, "true_to_false", "naive"), ann_sql(True), "mixed")
for _name, _algorithm in (("ann_in_tasks", "parts"), ("ann_naive_in_tasks", "parts_naive")):
    on_network(_name, lambda n, a=_algorithm: ann.all_nearest(n, "true_to_false", a, derived.node_parts(n)), ann_sql(True), "mixed")


def _vivet(n):
    """The table of node labels is made first, then looked up."""
    return ann.looked_up(n, ann.node_labels(n, False), True)


on_network("ann_vivet", _vivet, ann_sql(True))
on_network("ann_untyped", ann.untyped_nearest, """,
d(s, t, c) USING KEY (s, t) AS (SELECT DISTINCT src, src, 0 FROM adj UNION
  SELECT d.s, a.dst, min(d.c + a.w) FROM d JOIN adj a ON a.src = d.t LEFT JOIN recurring.d r ON r.s = d.s AND r.t = a.dst WHERE r.c IS NULL OR d.c + a.w < r.c GROUP BY d.s, a.dst),
ends AS (SELECT obj_id, start_node AS node, dist_from_start AS off FROM objects UNION ALL SELECT obj_id, end_node, length - dist_from_start FROM objects),
near AS (SELECT e.node, o.obj_id, min(d.c + o.off) AS c FROM (SELECT DISTINCT node FROM ends) e JOIN d ON d.s = e.node JOIN ends o ON o.node = d.t GROUP BY e.node, o.obj_id),
two AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY c, obj_id) AS k FROM near) WHERE k <= 2),
x AS (SELECT e.obj_id AS q, t.obj_id AS o, e.off + t.c AS c FROM ends e JOIN two t USING (node) WHERE t.obj_id <> e.obj_id
  UNION ALL SELECT a.obj_id, b.obj_id, abs(a.dist_from_start - b.dist_from_start) FROM objects a JOIN objects b ON a.edge_id = b.edge_id AND a.obj_id <> b.obj_id)
SELECT q AS query_obj_id, CAST(min(c * 10000000 + o) % 10000000 AS BIGINT) AS data_obj_id, CAST(min(c * 10000000 + o) // 10000000 AS DOUBLE) AS distance FROM x GROUP BY q""")  # fmt: skip

on_network("ann_stored", lambda n: StoredLabels.made(n, False).nearest(), ann_sql(True), "mixed")


def _stored_updated(n):
    """Labels of four fifths of the objects, then the rest come and every seventh data object goes."""
    o, gone = n.objects, "NOT is_query AND obj_id % 7 = 0"
    stored = StoredLabels.made(n.with_objects(o.where("obj_id % 5 <> 0")), False)
    return stored.updated(o.where(f"obj_id % 5 = 0 AND NOT ({gone})"), o.where(f"obj_id % 5 <> 0 AND {gone}")).nearest()


on_network("ann_stored_updated", _stored_updated, ", kept AS (SELECT * FROM objects WHERE is_query OR obj_id % 7 <> 0)" + ann_sql(True, objects="kept"), "mixed")
on_network("ann_by_parts", lambda n: ann.all_nearest(n, "true_to_false", "parts", partition.balanced_parts(n, 4)), ann_sql(True), "mixed")

# shortest paths

DIJKSTRA = """,
d(t, c) USING KEY (t) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT) UNION
  SELECT a.dst, min(d.c + a.w) FROM d JOIN adj a ON a.src = d.t LEFT JOIN recurring.d r ON r.t = a.dst WHERE r.c IS NULL OR d.c + a.w < r.c GROUP BY a.dst)
"""
_from_0 = lambda n: relax.shortest_paths(n, n.nodes.where("node_id = 0"))
on_network("sssp_from_node", lambda n: _from_0(n).select(F.col("node").alias("node_id"), F.col("dist").alias("distance")), DIJKSTRA + "SELECT t AS node_id, CAST(c AS DOUBLE) AS distance FROM d", "mixed")
on_network("sssp_parents", lambda n: _from_0(n).select(F.col("node").alias("node_id"), "parent"), DIJKSTRA + "SELECT d.t AS node_id, min(p.t) AS parent FROM d LEFT JOIN (SELECT p.t, p.c, a.dst, a.w FROM d p JOIN adj a ON a.src = p.t) p ON p.dst = d.t AND p.c + p.w = d.c GROUP BY d.t", "mixed")
on_network("path_to_node", lambda n: relax.path_to(_from_0(n), 5).select("step", F.col("node").alias("node_id")), DIJKSTRA + """,
par AS (SELECT d.t, min(p.t) AS parent FROM d JOIN (SELECT p.t, p.c, a.dst, a.w FROM d p JOIN adj a ON a.src = p.t) p ON p.dst = d.t AND p.c + p.w = d.c GROUP BY d.t),
back(node, b) AS (SELECT CAST(5 AS BIGINT), 0 UNION ALL SELECT parent, b + 1 FROM back JOIN par ON par.t = node)
SELECT CAST(max(b) OVER () - b AS INTEGER) AS step, node AS node_id FROM back""", "mixed")  # fmt: skip
# three paths of eight edges at most bound the cost of all others, whatever their number of edges
on_network("k_shortest_paths", lambda n: deviations.simple_paths(n, 0, 3, 3).select("rank", "cost", F.array_join("nodes", " ").alias("path")), """,
step AS (SELECT src, dst, min(w) AS w FROM adj GROUP BY src, dst),
rest(t, c) USING KEY (t) AS (SELECT CAST(3 AS BIGINT), CAST(0 AS BIGINT) UNION
  SELECT a.dst, min(d.c + a.w) FROM rest d JOIN adj a ON a.src = d.t LEFT JOIN recurring.rest r ON r.t = a.dst WHERE r.c IS NULL OR d.c + a.w < r.c GROUP BY a.dst),
few(node, cost, nodes, h) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), [CAST(0 AS BIGINT)], 0 UNION ALL
  SELECT a.dst, p.cost + a.w, list_append(p.nodes, a.dst), h + 1 FROM few p JOIN step a ON a.src = p.node WHERE h < 8 AND p.node <> 3 AND NOT list_contains(p.nodes, a.dst)),
most AS (SELECT max(cost) AS c FROM (SELECT cost FROM few WHERE node = 3 ORDER BY cost LIMIT 3)),
p(node, cost, nodes) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), [CAST(0 AS BIGINT)] UNION ALL
  SELECT a.dst, p.cost + a.w, list_append(p.nodes, a.dst) FROM p JOIN step a ON a.src = p.node JOIN rest ON rest.t = a.dst WHERE p.node <> 3 AND NOT list_contains(p.nodes, a.dst) AND p.cost + a.w + rest.c <= (SELECT c FROM most)),
b AS (SELECT nodes, min(cost) AS cost FROM p WHERE node = 3 GROUP BY nodes)
SELECT CAST(rank AS INTEGER) AS rank, CAST(cost AS DOUBLE) AS cost, array_to_string(nodes, ' ') AS path FROM (SELECT *, row_number() OVER (ORDER BY cost, nodes) AS rank FROM b) WHERE rank <= 3""")  # fmt: skip

# a beam of 400 partial paths finds k whole ones, which bound the cost of all others
MANY_PATHS = """,
step AS (SELECT src, dst, min(w) AS w FROM adj GROUP BY src, dst),
rest(t, c) USING KEY (t) AS (SELECT CAST(3 AS BIGINT), CAST(0 AS BIGINT) UNION
  SELECT a.dst, min(d.c + a.w) FROM rest d JOIN adj a ON a.src = d.t LEFT JOIN recurring.rest r ON r.t = a.dst
  WHERE r.c IS NULL OR d.c + a.w < r.c GROUP BY a.dst),
onward AS MATERIALIZED (SELECT step.*, c FROM step JOIN rest ON t = dst),
few(node, cost, nodes) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), [CAST(0 AS BIGINT)] UNION ALL
  SELECT * FROM (SELECT a.dst, p.cost + a.w, list_append(p.nodes, a.dst) FROM few p JOIN onward a ON a.src = p.node
    WHERE p.node <> 3 AND NOT list_contains(p.nodes, a.dst) ORDER BY p.cost + a.w + a.c LIMIT 400)),
most AS (SELECT CASE WHEN count(*) = {k} THEN max(cost) ELSE 1000000000 END AS c
  FROM (SELECT cost FROM few WHERE node = 3 ORDER BY cost LIMIT {k})),
p(node, cost, nodes) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), [CAST(0 AS BIGINT)] UNION ALL
  SELECT a.dst, p.cost + a.w, list_append(p.nodes, a.dst) FROM p JOIN onward a ON a.src = p.node
  WHERE p.node <> 3 AND NOT list_contains(p.nodes, a.dst) AND p.cost + a.w + a.c <= (SELECT c FROM most))
SELECT CAST(rank AS INTEGER) AS rank, CAST(cost AS DOUBLE) AS cost, array_to_string(nodes, ' ') AS path
FROM (SELECT *, row_number() OVER (ORDER BY cost, nodes) AS rank FROM p WHERE node = 3) WHERE rank <= {k}"""


def _listed(paths: DataFrame) -> DataFrame:
    return paths.select("rank", "cost", F.array_join("nodes", " ").alias("path"))


on_network("k_shortest_paths_50", lambda n: _listed(deviations.simple_paths(n, 0, 3, 50)), MANY_PATHS.format(k=50))
on_network("k_shortest_paths_chains", lambda n: _listed(deviations.simple_paths(n, 0, 3, 20)), MANY_PATHS.format(k=20), "mixed")

# partitions

BORDER_LABELS = """,
d(s, t, c) USING KEY (s, t) AS (SELECT node_id, node_id, CAST(0 AS BIGINT) FROM border UNION
  SELECT d.s, a.dst, min(d.c + a.w) FROM d JOIN {adj} a ON a.src = d.t LEFT JOIN recurring.d r ON r.s = d.s AND r.t = a.dst WHERE r.c IS NULL OR d.c + a.w < r.c GROUP BY d.s, a.dst)
"""
INNER = """,
inner_adj AS (SELECT * FROM adj WHERE edge_id NOT IN (SELECT edge_id FROM cut)), inner_objects AS (SELECT * FROM objects WHERE edge_id NOT IN (SELECT edge_id FROM cut))"""
_with_parts = lambda f, **k: lambda n: f(n, derived.node_parts(n), **k)
on_network("cut_edges", _with_parts(parts.cut_edges), " SELECT edge_id, start_node, end_node, CAST(length AS DOUBLE) AS length, start_part, end_part FROM cut")
on_network("border_nodes", _with_parts(parts.border_nodes), " SELECT node_id, part_id FROM border")
on_network("borders_by_part", lambda n: parts.borders_by_part(n, derived.node_parts(n)).select("part_id", F.array_join("nodes", " ").alias("nodes")), " SELECT part_id, string_agg(CAST(node_id AS VARCHAR), ' ' ORDER BY node_id) AS nodes FROM border GROUP BY part_id")
on_network("part_subgraphs", lambda n: parts.part_subgraphs(n, derived.node_parts(n)).select("part_id", "edge_id", "start_node", "end_node", "length", F.coalesce(F.size("objects"), F.lit(0)).cast("long").alias("n_objects")), """
SELECT a.part_id, e.edge_id, start_node, end_node, CAST(length AS DOUBLE) AS length, (SELECT count(*) FROM objects o WHERE o.edge_id = e.edge_id) AS n_objects
FROM edges e JOIN parts a ON a.node_id = start_node JOIN parts b ON b.node_id = end_node WHERE a.part_id = b.part_id""")  # fmt: skip
on_network("part_local_ann", _with_parts(parts.part_local_nearest), INNER + ann_sql(True, "inner_adj", "inner_objects"))
on_network("ann_by_sql_function", _with_parts(files.nearest_by_sql), INNER + ann_sql(True, "inner_adj", "inner_objects"))
on_network("grid_parts", lambda n: parts.grid_parts(derived.node_places(n).withColumn("longitude", F.col("longitude") - 500), 3, 2), """,
place AS (SELECT DISTINCT src AS node_id, (src * 7919) % 1000 - 500 AS x, (src * 104729) % 1000 AS y FROM adj)
SELECT node_id, CAST(least(floor((x - x0) / (x1 - x0)::DOUBLE * 3), 2) + 3 * least(floor((y - y0) / (y1 - y0)::DOUBLE * 2), 1) AS INTEGER) AS part_id
FROM place, (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM place)""")
on_network("part_tasks", _with_parts(files.part_tasks, n=derived.PARTS), " SELECT a.part_id, a.part_id AS task, count(*) AS n_edges FROM edges JOIN parts a ON a.node_id = start_node JOIN parts b ON b.node_id = end_node WHERE a.part_id = b.part_id GROUP BY a.part_id")
on_network("part_local_ann_naive", _with_parts(parts.part_local_nearest, algorithm="naive"), INNER + ann_sql(True, "inner_adj", "inner_objects"))
on_network("part_local_ann_scl", _with_parts(parts.part_local_nearest, algorithm="scl"), INNER + ann_sql(True, "inner_adj", "inner_objects"), "mixed")
on_network("part_local_ann_scl_false_to_true", _with_parts(parts.part_local_nearest, direction="false_to_true", algorithm="scl"), INNER + ann_sql(False, "inner_adj", "inner_objects"), "mixed")
on_network("border_pair_sp", _with_parts(parts.border_paths), BORDER_LABELS.format(adj="adj") + "SELECT s AS a, t AS b, p.part_id AS a_part, q.part_id AS b_part, CAST(c AS DOUBLE) AS distance FROM d JOIN border p ON p.node_id = s JOIN border q ON q.node_id = t WHERE s < t", "mixed")
on_network("border_pair_sp_across", _with_parts(parts.border_paths, across=True), BORDER_LABELS.format(adj="adj") + "SELECT s AS a, t AS b, p.part_id AS a_part, q.part_id AS b_part, CAST(c AS DOUBLE) AS distance FROM d JOIN border p ON p.node_id = s JOIN border q ON q.node_id = t WHERE s < t AND p.part_id <> q.part_id", "mixed")
on_network("overlay_edges", _with_parts(parts.overlay_edges), INNER + BORDER_LABELS.format(adj="inner_adj") + """SELECT start_node, end_node, CAST(length AS DOUBLE) AS length, true AS is_cut FROM cut
UNION ALL SELECT s, t, CAST(c AS DOUBLE), false FROM d WHERE s < t AND t IN (SELECT node_id FROM border)""", "mixed")  # fmt: skip
on_network("part_counts", lambda n: parts.part_counts(n, derived.node_parts(n)), " SELECT part_id, count(*) AS n_nodes, round(100.0 * count(*) / (SELECT count(*) FROM parts), 2)::DOUBLE AS percent FROM parts GROUP BY part_id")
PIECES = 4


def _partition_report(n):
    """One row: nodes, parts, whether the largest part is within 5 % of the mean, and whether fewer edges are cut than by blocks."""
    made = partition.balanced_parts(n, PIECES)
    sizes = made.groupBy("part_id").agg(F.count(F.lit(1)).alias("size"), F.countDistinct("node_id").alias("different"))
    one = sizes.agg(F.sum("size").alias("n_nodes"), F.sum("different").alias("n_different"), F.count(F.lit(1)).alias("n_parts"), (F.max("size") <= F.ceil(1.05 * F.sum("size") / PIECES)).alias("balanced"))
    cut, by_blocks = (parts.cut_edges(n, p).agg(F.count(F.lit(1)).alias(c)) for p, c in ((made, "cut"), (derived.node_parts(n, PIECES), "blocks")))
    return one.crossJoin(cut).crossJoin(by_blocks).select("n_nodes", "n_different", "n_parts", "balanced", (F.col("cut") < F.col("blocks")).alias("fewer_cut"), F.col("blocks").alias("n_cut_by_blocks"))


on_network("balanced_parts", _partition_report, f""",
block AS (SELECT src AS node_id, CAST(floor(src * {PIECES} / CAST((SELECT max(src) + 1 FROM adj) AS DOUBLE)) AS INTEGER) AS part_id FROM (SELECT DISTINCT src FROM adj))
SELECT count(*) AS n_nodes, count(*) AS n_different, {PIECES}::BIGINT AS n_parts, true AS balanced, true AS fewer_cut,
(SELECT count(*) FROM edges JOIN block a ON a.node_id = start_node JOIN block b ON b.node_id = end_node WHERE a.part_id <> b.part_id) AS n_cut_by_blocks FROM block""", "mixed")
on_network("virtual_source", lambda n: parts.virtual_source(n, derived.node_parts(n), 2_147_483_647), " SELECT 2147483647::BIGINT AS start_node, node_id AS end_node, 0.0::DOUBLE AS length FROM border")
on_network("edges_within_radius", lambda n: parts.edges_within(n, 0, 2500), """,
d(t, c) USING KEY (t) AS (SELECT node, CAST(0 AS BIGINT) FROM (SELECT start_node AS node FROM edges WHERE edge_id = 0 UNION SELECT end_node FROM edges WHERE edge_id = 0) UNION
  SELECT a.dst, min(d.c + a.w) FROM d JOIN adj a ON a.src = d.t LEFT JOIN recurring.d r ON r.t = a.dst WHERE d.c + a.w <= 2500 AND (r.c IS NULL OR d.c + a.w < r.c) GROUP BY a.dst)
SELECT edge_id, CAST(min(c + w) AS DOUBLE) AS distance FROM d JOIN adj ON src = t WHERE edge_id <> 0 AND c + w <= 2500 GROUP BY edge_id UNION ALL SELECT 0, 0.0""", "mixed")  # fmt: skip
on_network("adjacent_edges", parts.adjacent_edges, " SELECT DISTINCT a.edge_id, b.edge_id AS neighbour_id FROM adj a JOIN adj b ON a.src = b.src AND a.edge_id <> b.edge_id", "mixed")

# nodes and edges

on_network("node_degree_class", lambda n: chains.degrees(n), " SELECT src AS node_id, count(DISTINCT dst) AS degree, count(*) AS n_edges, CASE count(DISTINCT dst) WHEN 1 THEN 'terminal' WHEN 2 THEN 'intermediate' ELSE 'intersection' END AS node_class FROM adj GROUP BY src", "mixed")
on_network("first_intersection", chains.first_intersection, " SELECT min(src) AS node_id FROM (SELECT src FROM adj GROUP BY src HAVING count(DISTINCT dst) >= 3) HAVING min(src) IS NOT NULL", "mixed")
on_network("neighbours_of_node", lambda n: n.adjacency.where("src = 7").select("dst", "edge_id", "w"), " SELECT dst, edge_id, CAST(w AS DOUBLE) AS w FROM adj WHERE src = 7", "mixed")
on_network("network_stats", stats.network_stats, " SELECT (SELECT count(DISTINCT src) FROM adj) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges, (SELECT CAST(sum(length) AS DOUBLE) FROM edges) AS total_length, count(*) AS n_objects, CAST(count_if(is_query) AS BIGINT) AS n_true, CAST(count_if(NOT is_query) AS BIGINT) AS n_false, count(DISTINCT edge_id) AS n_populated_edges FROM objects")
on_network("objects_per_edge", stats.objects_per_edge, " SELECT e.edge_id, count(o.obj_id) AS n_objects, CAST(count_if(o.is_query) AS BIGINT) AS n_true, CAST(count_if(NOT o.is_query) AS BIGINT) AS n_false FROM edges e LEFT JOIN objects o USING (edge_id) GROUP BY e.edge_id")
on_network("edge_len_stats", stats.edge_length_stats, " SELECT CAST(min(length) AS DOUBLE) AS min_length, CAST(max(length) AS DOUBLE) AS max_length, CAST(sum(length) AS DOUBLE) AS total_length, count(*) AS n_edges FROM edges")
on_network("edges_by_length", lambda n: n.edges.orderBy(F.desc("length"), "edge_id").limit(10), " SELECT edge_id, start_node, end_node, CAST(length AS DOUBLE) AS length FROM edges ORDER BY edges.length DESC, edge_id LIMIT 10")
on_network("populated_edges", lambda n: n.objects.select("edge_id").distinct(), " SELECT DISTINCT edge_id FROM objects")
on_network("empty_edges", lambda n: n.edges.join(n.objects, "edge_id", "left_anti").select("edge_id"), " SELECT edge_id FROM edges WHERE edge_id NOT IN (SELECT edge_id FROM objects)", "mixed")
on_network(
    "empty_edges_tips",
    lambda n: n.edges.join(n.objects.where("obj_id % 3 = 0"), "edge_id", "left_anti").select("edge_id"),
    " SELECT edge_id FROM edges WHERE edge_id NOT IN (SELECT edge_id FROM objects WHERE obj_id % 3 = 0)",
    "tips",
)
on_network("type_percent", lambda n: generate.type_percent(n.objects), " SELECT CAST(count_if(is_query) AS BIGINT) AS n_true, CAST(count_if(NOT is_query) AS BIGINT) AS n_false, round(100.0 * count_if(is_query) / count(*), 2)::DOUBLE AS true_percent, round(100.0 * count_if(NOT is_query) / count(*), 2)::DOUBLE AS false_percent FROM objects")
on_network("second_shortest_length", lambda n: n.edges.select("length").distinct().orderBy("length").limit(2).agg(F.max("length").alias("length")), " SELECT CAST(max(length) AS DOUBLE) AS length FROM (SELECT DISTINCT length FROM edges ORDER BY length LIMIT 2)")
on_network("edge_by_node_pair", lambda n: n.edges.where("least(start_node, end_node) = 3 and greatest(start_node, end_node) = 4").select("edge_id", "length"), " SELECT edge_id, CAST(length AS DOUBLE) AS length FROM edges WHERE least(start_node, end_node) = 3 AND greatest(start_node, end_node) = 4")
on_network("edge_euclidean", lambda n: n.edges.join(derived.node_places(n).selectExpr("node_id AS start_node", "longitude AS x1", "latitude AS y1"), "start_node").join(derived.node_places(n).selectExpr("node_id AS end_node", "longitude AS x2", "latitude AS y2"), "end_node").select("edge_id", round_half_up(euclidean(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))).alias("straight")), """
SELECT edge_id, CAST(floor(sqrt(((start_node * 7919) % 1000 - (end_node * 7919) % 1000) ** 2 + ((start_node * 104729) % 1000 - (end_node * 104729) % 1000) ** 2) + 0.5) AS BIGINT) AS straight FROM edges""")  # fmt: skip
on_network("capacity_per_edge", lambda n: n.edges.select("edge_id", objects_that_fit(F.col("length"), F.lit(50.0)).alias("capacity")), " SELECT edge_id, CAST(greatest(floor(length / 50.0) - 1, 0) AS BIGINT) AS capacity FROM edges")

# objects along edges

on_network("nearest_on_edge_object", lambda n: on_edge.nearest_on_edge(n.placed.withColumn("asks", F.col("is_query"))).select(F.col("q").alias("query_obj_id"), F.col("obj").alias("data_obj_id"), F.col("dist").alias("distance")), """
SELECT q AS query_obj_id, c % 10000000 AS data_obj_id, CAST(c // 10000000 AS DOUBLE) AS distance FROM (SELECT a.obj_id AS q, min(abs(a.dist_from_start - b.dist_from_start) * 10000000 + b.obj_id) AS c
  FROM objects a JOIN objects b ON a.edge_id = b.edge_id AND a.is_query AND NOT b.is_query GROUP BY a.obj_id)""")  # fmt: skip
on_network("nearest_on_edge_any", lambda n: on_edge.nearest_other_on_edge(n.objects).select(F.col("q").alias("query_obj_id"), F.col("obj").alias("data_obj_id"), F.col("dist").alias("distance")), """
SELECT q AS query_obj_id, c % 10000000 AS data_obj_id, CAST(c // 10000000 AS DOUBLE) AS distance FROM (SELECT a.obj_id AS q, min(abs(a.dist_from_start - b.dist_from_start) * 10000000 + b.obj_id) AS c
  FROM objects a JOIN objects b ON a.edge_id = b.edge_id AND a.obj_id <> b.obj_id GROUP BY a.obj_id)""")  # fmt: skip
on_network("nearest_on_edge_node", lambda n: on_edge.nearest_to_node(n, False).select("node_id", "edge_id", "obj_id", F.col("dist").alias("distance")), """
SELECT node_id, edge_id, c % 10000000 AS obj_id, CAST(c // 10000000 AS DOUBLE) AS distance FROM (SELECT node_id, edge_id, min(d * 10000000 + obj_id) AS c FROM (
  SELECT start_node AS node_id, edge_id, obj_id, dist_from_start AS d FROM objects WHERE NOT is_query UNION ALL SELECT end_node, edge_id, obj_id, length - dist_from_start FROM objects WHERE NOT is_query) GROUP BY node_id, edge_id)""")  # fmt: skip
_ends_sql = """ SELECT edge_id, min(dist_from_start * 10000000 + obj_id) % 10000000 AS nearest_obj_id, CAST(min(dist_from_start) AS DOUBLE) AS nearest_dist,
arg_min(obj_id, (-dist_from_start) * 10000000 + obj_id) AS farthest_obj_id, CAST(max(dist_from_start) AS DOUBLE) AS farthest_dist FROM objects {where} GROUP BY edge_id"""
on_network("ends_on_edge", on_edge.ends_on_edge, _ends_sql.format(where=""))
on_network("ends_on_edge_true", lambda n: on_edge.ends_on_edge(n, True), _ends_sql.format(where="WHERE is_query"))
on_network("ends_on_edge_false", lambda n: on_edge.ends_on_edge(n, False), _ends_sql.format(where="WHERE NOT is_query"))
on_network("rank_objects_on_edge", lambda n: on_edge.ranked_objects(n).select("edge_id", "obj_id", "rank_on_edge"), " SELECT edge_id, obj_id, CAST(row_number() OVER (PARTITION BY edge_id ORDER BY dist_from_start, obj_id) AS INTEGER) AS rank_on_edge FROM objects")
on_network("rank_objects_on_edge_desc", lambda n: on_edge.ranked_objects(n, descending=True).select("edge_id", "obj_id", "rank_on_edge"), " SELECT edge_id, obj_id, CAST(row_number() OVER (PARTITION BY edge_id ORDER BY dist_from_start DESC, obj_id) AS INTEGER) AS rank_on_edge FROM objects")
RATING = "CASE WHEN obj_id % 10 <> 0 THEN CAST(obj_id * 37 % 11 AS DOUBLE) END"
for _name, _way in (("rank_objects_by_rating", ""), ("rank_objects_by_rating_desc", "DESC")):
    on_network(
        _name,
        lambda n, down=bool(_way): on_edge.ranked_objects(n.with_objects(n.objects.withColumn("rating", F.expr(RATING))), "rating", down).select("edge_id", "obj_id", "rank_on_edge"),
        f" SELECT edge_id, obj_id, CAST(row_number() OVER (PARTITION BY edge_id ORDER BY {RATING} {_way} NULLS LAST, obj_id) AS INTEGER) AS rank_on_edge FROM objects",
    )
on_network("objects_from_end_node", lambda n: n.placed.select("obj_id", on_edge.offset_from(F.col("end_node")).alias("distance")), " SELECT obj_id, CAST(length - dist_from_start AS DOUBLE) AS distance FROM objects")
on_network("objects_by_edge", lambda n: n.objects_by_edge().select("edge_id", F.array_join(F.transform("objects", lambda o: o["obj_id"].cast("string")), " ").alias("objs")), " SELECT e.edge_id, (SELECT string_agg(CAST(obj_id AS VARCHAR), ' ' ORDER BY dist_from_start, obj_id) FROM objects o WHERE o.edge_id = e.edge_id) AS objs FROM edges e")
on_network("edge_segments", on_edge.edge_segments, """,
s AS (SELECT edge_id, obj_id, dist_from_start AS off, length, row_number() OVER w AS k, lag(obj_id) OVER w AS f, coalesce(lag(dist_from_start) OVER w, 0) AS g, count(*) OVER (PARTITION BY edge_id) AS n FROM objects WINDOW w AS (PARTITION BY edge_id ORDER BY dist_from_start, obj_id))
SELECT edge_id, CAST(k - 1 AS INTEGER) AS seq, f AS from_obj, obj_id AS to_obj, CAST(off - g AS DOUBLE) AS segment_length FROM s
UNION ALL SELECT edge_id, CAST(n AS INTEGER), obj_id, NULL, CAST(length - off AS DOUBLE) FROM s WHERE k = n
UNION ALL SELECT edge_id, 0, NULL, NULL, CAST(length AS DOUBLE) FROM edges WHERE edge_id NOT IN (SELECT edge_id FROM objects)""")  # fmt: skip

_pairs = lambda n: n.edges.selectExpr("CASE WHEN edge_id % 4 < 2 THEN start_node ELSE end_node END AS a", "CASE WHEN edge_id % 4 < 2 THEN end_node ELSE start_node END AS b")
_pairs_sql = ", pairs AS (SELECT CASE WHEN edge_id % 4 < 2 THEN start_node ELSE end_node END AS a, CASE WHEN edge_id % 4 < 2 THEN end_node ELSE start_node END AS b FROM edges)"
on_network("edges_between_nodes", lambda n: lookup.edges_between(n, _pairs(n)), _pairs_sql + " SELECT a, b, edge_id, CAST(length AS DOUBLE) AS length FROM pairs JOIN edges ON least(a, b) = least(start_node, end_node) AND greatest(a, b) = greatest(start_node, end_node)")
on_network("edges_from_to_nodes", lambda n: lookup.edges_between(n, _pairs(n), either_way=False), _pairs_sql + " SELECT a, b, edge_id, CAST(length AS DOUBLE) AS length FROM pairs JOIN edges ON a = start_node AND b = end_node")
on_network("objects_between_nodes", lambda n: lookup.objects_between_nodes(n, _pairs(n)), _pairs_sql + " SELECT a, b, obj_id, CAST(CASE WHEN start_node = a THEN dist_from_start ELSE length - dist_from_start END AS DOUBLE) AS distance FROM pairs JOIN objects ON least(a, b) = least(start_node, end_node) AND greatest(a, b) = greatest(start_node, end_node)")
on_network("objects_by_ids", lambda n: lookup.objects_by_ids(n, lookup.ids_by_edge(n, True).withColumnRenamed("edge_id", "list_id")).select("list_id", "pos", "obj_id"), " SELECT edge_id AS list_id, CAST(row_number() OVER (PARTITION BY edge_id ORDER BY dist_from_start, obj_id) - 1 AS INTEGER) AS pos, obj_id FROM objects WHERE is_query")


@query("objects_with_category", "SELECT p_partkey AS obj_id, p_size % 7 AS category_id, CASE WHEN p_size % 7 < 5 THEN r_name END AS category_name FROM part LEFT JOIN region ON r_regionkey = p_size % 7")
def _objects_with_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey AS obj_id", "p_size % 7 AS category_id")
    return lookup.with_categories(parts, spark.read.parquet(f"{sf_dir}/region.parquet").selectExpr("r_regionkey AS category_id", "r_name AS name")).select("obj_id", "category_id", "category_name")


# chains and runs

WALK = """,
deg AS (SELECT src, count(*) AS n FROM adj GROUP BY src),
dart AS (SELECT edge_id * 2 + r AS dart, edge_id, r, CASE r WHEN 0 THEN start_node ELSE end_node END AS tail, CASE r WHEN 0 THEN end_node ELSE start_node END AS head, length AS w FROM edges, (VALUES (0), (1)) v(r)),
nxt AS (SELECT a.dart, b.dart AS next FROM dart a JOIN deg ON deg.src = a.head AND deg.n = 2 JOIN dart b ON b.tail = a.head AND b.edge_id <> a.edge_id),
walk(origin, dart, pos, way) AS (SELECT dart, dart, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM dart JOIN deg ON deg.src = tail AND deg.n <> 2
  UNION ALL SELECT origin, next, pos + 1, way + w FROM walk JOIN dart d ON d.dart = walk.dart JOIN nxt ON nxt.dart = walk.dart),
whole AS (SELECT w.*, d.edge_id, d.r, d.w, last_value(w.dart) OVER (PARTITION BY origin ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last, min(d.edge_id) OVER (PARTITION BY origin) AS chain_id FROM walk w JOIN dart d ON d.dart = w.dart),
chain AS (SELECT chain_id, pos, edge_id, r = 1 AS reversed, CAST(w AS DOUBLE) AS length, CAST(way AS DOUBLE) AS start_at FROM whole WHERE origin < xor(last, 1))
"""
on_network("chain_edges", lambda n: chains.chain_edges(n).drop("is_cycle"), WALK + "SELECT * FROM chain", "mixed")
on_network("chain_stats", chains.chain_stats, WALK + "SELECT count(DISTINCT chain_id) AS n_chains, count(*) AS n_edges, count(*) - count(DISTINCT chain_id) AS n_inner_nodes, (SELECT count(*) FROM (SELECT src FROM adj GROUP BY src HAVING count(DISTINCT dst) = 1)) AS n_terminals FROM chain", "mixed")
ON_CHAIN = WALK + """, oc AS (SELECT chain_id, obj_id, is_query, start_at + CASE WHEN reversed THEN c.length - dist_from_start ELSE dist_from_start END AS place FROM objects o JOIN chain c USING (edge_id)),
isl AS (SELECT *, row_number() OVER (PARTITION BY {line} ORDER BY place, is_query, obj_id) - row_number() OVER (PARTITION BY {line}, is_query ORDER BY place, obj_id) AS g FROM oc),
rs AS (SELECT {line}, is_query, g, count(*) AS n, arg_min(obj_id, place * 10000000 + obj_id) AS first_obj, max(place * 10000000 + obj_id) AS z, arg_max(obj_id, place * 10000000 + obj_id) AS last_obj, min(place * 10000000 + obj_id) AS a FROM isl GROUP BY {line}, is_query, g),
rn AS (SELECT *, dense_rank() OVER (PARTITION BY {line} ORDER BY a, is_query) AS run FROM rs)
"""  # fmt: skip
on_network("chain_runs", chains_runs := runs.chain_runs, ON_CHAIN.format(line="chain_id") + "SELECT chain_id, CAST(run AS INTEGER) AS run, n, first_obj, last_obj FROM rn WHERE is_query", "mixed")
on_network("run_stats", lambda n: runs.run_stats(chains_runs(n)), ON_CHAIN.format(line="chain_id") + "SELECT count(*) AS n_runs, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_objects, CAST(coalesce(sum(least(n, 2)), 0) AS BIGINT) AS n_expanded, CAST(count_if(n >= 3) AS BIGINT) AS n_contributing FROM rn WHERE is_query", "mixed")
ON_EDGE = ON_CHAIN.replace(WALK, "").replace("oc AS (SELECT chain_id, obj_id, is_query, start_at + CASE WHEN reversed THEN c.length - dist_from_start ELSE dist_from_start END AS place FROM objects o JOIN chain c USING (edge_id))", "oc AS (SELECT edge_id, obj_id, is_query, dist_from_start AS place FROM objects)").format(line="edge_id")
on_network("object_runs_per_edge", runs.edge_runs, ON_EDGE + "SELECT edge_id, CAST(run AS INTEGER) AS run, is_query, n, first_obj, last_obj FROM rn")

# files' tables

on_network("metis_adjacency", metis_rows, " SELECT src AS node_id, string_agg(CAST(dst AS VARCHAR), ' ' ORDER BY dst) AS neighbours FROM (SELECT DISTINCT src, dst FROM adj) GROUP BY src")
on_network("hgr_edges", lambda n: hgr_rows(n, weighted=True), " SELECT edge_id, length || ' ' || start_node || ' ' || end_node AS hyperedge FROM edges")
on_network("reindex_edges", lambda n: reindexed_edges(n.edges), " SELECT edge_id + 1 AS edge_id, start_node + 1 AS start_node, end_node + 1 AS end_node, CAST(length AS DOUBLE) AS length FROM edges")
on_network("dedup_reverse_edges", lambda n: without_reverse_edges(n.edges).select("edge_id", "start_node", "end_node", "length"), " SELECT edge_id, start_node, end_node, CAST(length AS DOUBLE) AS length FROM edges e WHERE NOT EXISTS (SELECT 1 FROM edges f WHERE f.edge_id < e.edge_id AND least(f.start_node, f.end_node) = least(e.start_node, e.end_node) AND greatest(f.start_node, f.end_node) = greatest(e.start_node, e.end_node))")


@query("word_count", "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY word")
def _word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_count(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text")


@query("integer_strings", "SELECT p_partkey, regexp_full_match(split_part(p_name, ' ', 2), '[+-]?[0-9]+') AS is_int FROM part")
def _integer_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", is_integer(F.split_part("p_name", F.lit(" "), F.lit(2))).alias("is_int"))


# readers, writers, look-ups, generators and checks

for _tables, _variant in ((files.SOURCES, "ring"), (files.LOOKUPS, "mixed"), (files.GENERATORS, "dense")):
    for _name, (_build, _sql) in _tables.items():
        on_network(_name, _build, " " + _sql, _variant)
for _name, (_build, _sql) in files.CHAINS.items():
    on_network(_name, _build, WALK + _sql, "mixed")
on_network("dead_ends_tips", chains.dead_ends, WALK + files.CHAINS["dead_ends"][1], "tips")
on_network("ann_scl_tips", lambda n: ann.all_nearest(n, "true_to_false", "scl"), ann_sql(True), "tips")
on_network("ann_scl_tips_false_to_true", lambda n: ann.all_nearest(n, "false_to_true", "scl"), ann_sql(False), "tips")
on_network("path_vertices", files.vertices_of_path, DIJKSTRA + """,
par AS (SELECT d.t, min(p.t) AS parent FROM d JOIN (SELECT p.t, p.c, a.dst, a.w FROM d p JOIN adj a ON a.src = p.t) p ON p.dst = d.t AND p.c + p.w = d.c GROUP BY d.t),
back(node, parent) AS (SELECT t, parent FROM par WHERE t = 5 UNION ALL SELECT par.t, par.parent FROM back JOIN par ON par.t = back.parent)
SELECT parent AS a, node AS b, CAST(min(w) AS DOUBLE) AS length FROM back JOIN adj ON src = parent AND dst = node GROUP BY parent, node""", "mixed")  # fmt: skip
on_network("ann_stream", lambda n: files.streamed(n, ann.node_labels(n, False)), ann_sql(True))
on_network("object_map_keys", files.scalars, " SELECT edge_id, min(obj_id) AS first, max(obj_id) AS last, CAST(min(CASE WHEN dist_from_start = far THEN obj_id END) AS BIGINT) AS farthest FROM (SELECT *, max(dist_from_start) OVER (PARTITION BY edge_id) AS far FROM objects) GROUP BY edge_id")
