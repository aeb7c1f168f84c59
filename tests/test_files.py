from networks import network

from nearway.network import RoadNetwork
from nearway.operators.chains import chain_nodes
from nearway.operators.numbering import numbered
from nearway.operators.parts import by_position, grid_parts
from nearway.sources import readers as R
from nearway.sources import writers as W


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_bytes(text.encode())
    return str(p)


def test_nodes_of_three_and_four_columns(spark, tmp_path):
    p = put(tmp_path, "n.txt", "﻿0 1.5 2.5\r\n7 1 2 8.0\nbad\n3 4\n")
    assert rows(R.read_nodes(spark, p)) == [(0, 1.5, 2.5), (1, 2.0, 8.0)]
    assert rows(R.read_nodes(spark, put(tmp_path, "n.csv", "1,2,8\n2,3,9\n"), ",")) == [(1, 2.0, 8.0), (2, 3.0, 9.0)]


def test_edges_and_renumbering(spark, tmp_path):
    p = put(tmp_path, "e.txt", "5 1 5 4.24\n9 1 3 3.6\nshort 1\n")
    assert rows(R.read_edges(spark, p)) == [(5, 1, 5, 4.24), (9, 1, 3, 3.6)]
    assert rows(R.read_edges(spark, p, renumber=True)) == [(1, 1, 5, 4.24), (2, 1, 3, 3.6)]
    assert rows(R.read_edge_lengths(spark, p, " ")) == [(3.6,), (4.24,)]


def test_objects(spark, tmp_path):
    p = put(tmp_path, "o.txt", "#obj type dist edge\n101 F 2.3 3\n201 T 1 4\n")
    assert rows(R.read_objects(spark, p)) == [(101, 3, False, 2.3), (201, 4, True, 1.0)]
    assert rows(R.read_objects_csv(spark, put(tmp_path, "o.csv", "3,101,false,2.3\n4,201,true,1\n"))) == [(101, 3, False, 2.3), (201, 4, True, 1.0)]


def test_merged_file_with_lines_that_look_alike(spark, tmp_path):
    # an object line with two objects has four fields, the last a whole number, as an edge line has
    p = put(tmp_path, "m.txt", "1 2 5.5 2\n10 1 11 2\n2 3 4 0\n3 4 9 1\n12 3\n4 5 1 2\n13 1 14 1\n")
    edges, objects = R.read_merged(spark, p)
    assert rows(edges) == [(1, 1, 2, 5.5), (2, 2, 3, 4.0), (3, 3, 4, 9.0), (4, 4, 5, 1.0)]
    assert rows(objects) == [(10, 1, 1.0), (11, 1, 2.0), (12, 3, 3.0), (13, 4, 1.0), (14, 4, 1.0)]


def test_other_files(spark, tmp_path):
    assert rows(R.read_poi(spark, put(tmp_path, "p.csv", "1.5,2.5,7\n3,4,8\n"))) == [(1, 1.5, 2.5, 7), (2, 3.0, 4.0, 8)]
    assert rows(R.read_categories(spark, put(tmp_path, "c.csv", "1,food,true\n2,fuel\n"))) == [(1, "food", True), (2, "fuel", None)]
    assert rows(R.read_node_clusters(spark, put(tmp_path, "k.csv", "0,[5, 6, 7]\n"))) == [(0, 0, 5), (0, 1, 6), (0, 2, 7)]
    assert rows(R.read_object_parameters(spark, put(tmp_path, "t.txt", "CAL 100 2.5\n"))) == [("CAL", 100, 2.5)]
    assert rows(R.word_count(spark.read.text(put(tmp_path, "w.txt", "a b a\nb a\n")))) == [("a", 3), ("b", 2)]
    both = R.lines(spark, [put(tmp_path, "l1.txt", "x\ny"), put(tmp_path, "l2.txt", "z\n")])
    assert [r[0] for r in both.orderBy("line").collect()] == ["x", "y", "z"]


def test_metis_with_carriage_returns_and_a_missing_last_newline(spark, tmp_path):
    m = R.read_metis(spark, put(tmp_path, "g.graph", "3 2\r\n2 3 \r\n1\r\n1"))
    assert rows(m) == [(1, [2, 3]), (2, [1]), (3, [1])]
    assert rows(R.metis_adjacency(m)) == [(1, 2), (1, 3), (2, 1), (3, 1)]


def test_parts_by_position(spark, tmp_path):
    net = network(spark, [(1, 10, 20, 1.0), (2, 20, 30, 1.0)])
    assert rows(by_position(net, R.read_parts(spark, put(tmp_path, "p.txt", "0\n1\n1")))) == [(10, 0), (20, 1), (30, 1)]
    places = spark.createDataFrame([(1, 0.0, 0.0), (2, 9.0, 9.0), (3, None, None)], "node_id long, longitude double, latitude double")
    got = dict(rows(grid_parts(places, 2, 2)))
    assert got[1] == 0 and got[2] == 3 and 0 <= got[3] < 4


def test_round_trips(spark, tmp_path):
    edges = [(1, 1, 2, 4.5), (2, 2, 3, 3.25), (3, 1, 3, 2.0)]
    net = network(spark, edges, [(7, 1, True, 1.5), (8, 2, False, 3.0)])
    W.write_edges(net.edges, str(tmp_path / "e"))
    assert rows(R.read_edges(spark, str(tmp_path / "e"))) == edges
    W.write_objects(net.objects, str(tmp_path / "o"))
    assert rows(R.read_objects(spark, str(tmp_path / "o"))) == [(7, 1, True, 1.5), (8, 2, False, 3.0)]
    W.write_objects_csv(net.objects, str(tmp_path / "oc"))
    assert rows(R.read_objects_csv(spark, str(tmp_path / "oc"))) == [(7, 1, True, 1.5), (8, 2, False, 3.0)]
    W.write_metis(net, str(tmp_path / "m"), single=True)
    assert [r[0] for r in R.lines(spark, str(tmp_path / "m")).orderBy("line").collect()][0] == "3 3"
    assert rows(R.read_metis(spark, str(tmp_path / "m"))) == [(1, [2, 3]), (2, [1, 3]), (3, [1, 2])]
    W.write_hgr(net, str(tmp_path / "h"), weighted=True, single=True)
    assert [r[0] for r in R.lines(spark, str(tmp_path / "h")).orderBy("line").collect()] == ["3 3 1", "5 1 2", "3 2 3", "2 1 3"]
    W.write_node_clusters(chain_nodes(net), str(tmp_path / "c"))
    assert rows(R.read_node_clusters(spark, str(tmp_path / "c"))) == rows(chain_nodes(net))
    nodes = spark.createDataFrame([(1, 2.0, 8.0)], "node_id long, longitude double, latitude double")
    W.write_nodes(W.reindexed_nodes(nodes), str(tmp_path / "n"))
    assert rows(R.read_nodes(spark, str(tmp_path / "n"))) == [(2, 2.0, 8.0)]
    W.append_report(spark.createDataFrame([("tiny", 1.5)], "dataset string, seconds double"), str(tmp_path / "r"))
    W.append_report(spark.createDataFrame([("tiny", 2.5)], "dataset string, seconds double"), str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).count() == 2


def test_reverse_edges(spark):
    e = spark.createDataFrame([(1, 1, 2, 1.0), (2, 2, 1, 1.0), (3, 3, 4, 1.0), (4, 5, 6, 1.0), (5, 4, 3, 1.0)], "edge_id long, start_node long, end_node long, length double")
    assert [r[0] for r in rows(W.without_reverse_edges(e))] == [1, 3, 4]
    assert [r[0] for r in rows(W.without_reverse_edges(e, adjacent_only=True))] == [1, 3, 4, 5]


def test_rejected_rows(spark):
    edges = spark.createDataFrame([(1, 1, 2, 5.0), (1, 1, 2, 6.0), (-1, 1, 2, 5.0), (3, 4, 4, 1.0), (4, 5, 6, 0.0), (5, None, 6, 1.0)], "edge_id long, start_node long, end_node long, length double")
    objects = spark.createDataFrame([(1, 1, True, 2.0), (1, 1, True, 3.0), (2, 1, True, 6.0), (3, 9, True, 1.0), (4, 1, None, 1.0), (5, 1, False, -1.0), (6, 1, False, 2.0)], "obj_id long, edge_id long, is_query boolean, dist_from_start double")
    net, bad, lost = RoadNetwork.checked(edges, objects)
    assert rows(net.edges) == [(1, 1, 2, 5.0)] and bad.count() == 5
    assert [r["obj_id"] for r in net.objects.orderBy("obj_id").collect()] == [1, 6]
    assert {r["obj_id"]: r["reason"] for r in lost.collect()}[2] == "offset is beyond the edge"
    strict, _, _ = RoadNetwork.checked(edges, objects, distinct_offsets=True)
    assert [r["obj_id"] for r in strict.objects.collect()] == [1]


def test_numbering_over_many_ranges(spark):
    df = spark.range(1000).selectExpr("id", "(id * 7919) % 1000 AS k").repartition(9)
    assert numbered(df, ["k"], "n").where("n <> k + 1").isEmpty()
