"""Two hand-made road networks with answers that a heap-based search gave."""

import pytest
from networks import answers, network

from nearway.network import RoadNetwork
from nearway.operators.ann import all_nearest
from nearway.operators.chains import chain_edges, chain_nodes, degrees
from nearway.operators.parts import border_nodes, border_paths, cut_edges, part_counts, part_local_nearest
from nearway.operators.relax import shortest_paths
from nearway.operators.runs import chain_runs

# Edges (id start end length), objects (id type offset edge), parts of the nodes by id.
TINY_EDGES = "1 1 5 4.24;2 1 3 3.60;3 1 2 5.0;4 2 4 5.1;5 2 3 4.24;6 3 4 4.47;7 3 5 5.0;8 4 6 6.32;9 4 7 3.16;10 5 6 5.0;11 6 7 5.1"
TINY_OBJECTS = "101 T 2 1;102 T 1.1 3;103 T 4.2 2;104 T 2.12 5;105 T 2.26 6;106 T 2 4;107 T 5.32 8;108 T 1 11;109 T 1.32 8;110 T 0.66 9;201 F 2.2 2;202 F 3 7;203 F 2.6 10;204 F 1 7;205 F 2.3 3;206 F 1 4;207 F 3 4;208 F 1.26 9;209 F 4.1 11;210 F 2.02 8"
TINY_PARTS = [0, 0, 0, 1, 0, 1, 1]
PC_EDGES = (
    "1 1 5 1.1;2 1 10 5;3 1 11 4.4;4 1 12 10;5 2 5 2.9;6 2 6 2.4;7 2 38 2;8 3 6 8.5;9 3 8 2.4;10 3 9 1.4;11 3 21 2.3;12 4 21 2.2;13 4 22 2;14 4 23 12.6;15 7 8 3.6;16 9 26 14.8;17 12 13 6;18 12 17 3.8;19 13 14 2.2;20 13 18 4.3;"
    "21 14 15 2.1;22 15 16 5.9;23 15 19 6;24 16 20 5.7;25 17 18 5.7;26 17 38 9;27 18 19 6.4;28 18 25 4.8;29 19 27 4.2;30 19 28 7.4;31 20 28 2.3;32 23 24 2.8;33 24 26 6;34 24 33 6.4;35 25 26 5.5;36 25 27 6.4;37 26 31 6.4;38 27 29 7.4;"
    "39 27 31 5.2;40 28 29 4.2;41 29 30 5.2;42 30 31 7.4;43 30 34 2;44 31 32 2;45 32 33 2.1;46 32 34 7.4;47 33 35 7.4;48 34 35 2;49 35 36 1.2;50 36 37 1.2"
)
PC_OBJECTS = (
    "101 F 2.3 3;102 F 4 4;103 F 7 4;104 F 2 17;105 F 3.5 26;106 F 7.1 26;107 F 2.1 25;108 F 5.4 8;109 F 5.1 16;110 F 8.8 16;111 F 4.3 27;112 F 1.3 23;113 F 0.7 30;114 F 5.3 30;115 F 1.4 28;116 F 3.5 14;117 F 7.2 14;118 F 3.9 33;"
    "119 F 1.3 37;120 F 4.1 34;121 F 2.5 36;122 F 2.6 39;123 F 2.4 38;124 F 4.4 38;125 F 5 42;126 F 2.5 41;127 F 2.4 46;128 F 4.9 46;129 F 0.4 49;130 F 1 13;201 T 9 4;202 T 0.8 7;203 T 1.8 6;204 T 1.7 8;205 T 1.2 11;206 T 13.6 16;"
    "207 T 11.9 14;208 T 1.4 32;209 T 2.2 20;210 T 1.3 36;211 T 6.2 42;212 T 2.5 47;213 T 4.2 35;214 T 4.7 24;215 T 2.1 40"
)
PC_PARTS = [0] * 11 + [1] * 9 + [0, 0, 2, 2, 1, 2, 1, 1, 1] + [2] * 8 + [0]
TINY_T = {101: (4.2, 201), 102: (1.2, 205), 104: (3.12, 204), 105: (3.26, 204), 106: (1.0, 206), 107: (3.3, 210), 108: (3.1, 209), 109: (0.7, 210), 110: (0.6, 208)}
TINY_F = {201: (3.3, 102), 202: (4.24, 101), 203: (3.4, 107), 204: (3.12, 104), 205: (1.2, 102), 206: (1.0, 106), 207: (1.0, 106), 208: (0.6, 110), 209: (3.1, 108), 210: (0.7, 109)}
PC_T = {201: (2.0, 103), 202: (3.1, 106), 203: (3.7, 108), 204: (3.7, 108), 205: (4.3, 130), 206: (2.5, 119), 207: (4.7, 117), 208: (5.3, 118), 209: (3.5, 115), 210: (1.2, 121), 211: (1.2, 125), 212: (4.8, 120), 213: (2.6, 119), 214: (5.4, 114), 215: (4.2, 114)}
PC_F = {
    101: (7.1, 202), 102: (5.0, 201), 103: (2.0, 201), 104: (3.0, 201), 105: (6.7, 202), 106: (3.1, 202), 107: (5.7, 209), 108: (3.7, 203), 109: (7.7, 205), 110: (4.8, 206), 111: (6.4, 209), 112: (7.8, 209), 113: (8.8, 215), 114: (4.2, 215), 115: (3.5, 209),
    116: (6.8, 205), 117: (4.7, 207), 118: (3.3, 206), 119: (2.5, 206), 120: (4.8, 212), 121: (1.2, 210), 122: (3.8, 211), 123: (7.1, 215), 124: (5.1, 215), 125: (1.2, 211), 126: (4.6, 215), 127: (5.6, 211), 128: (8.1, 211), 129: (5.3, 212), 130: (4.3, 205),
}


def parsed(edges, objects):
    e = [(int(a), int(b), int(c), float(d)) for a, b, c, d in (x.split() for x in edges.split(";"))]
    return e, [(int(a), int(d), b == "T", float(c)) for a, b, c, d in (x.split() for x in objects.split(";"))]


@pytest.fixture(scope="module")
def tiny(spark):
    return network(spark, *parsed(TINY_EDGES, TINY_OBJECTS))


@pytest.fixture(scope="module")
def pc(spark):
    return network(spark, *parsed(PC_EDGES, PC_OBJECTS))


def parts_of(spark, parts):
    return spark.createDataFrame([(i + 1, p) for i, p in enumerate(parts)], "node_id long, part_id int")


def rounded(found):
    return {q: (round(d, 2), o) for q, (d, o) in answers(found).items()}


@pytest.mark.parametrize("algorithm", ["voronoi", "naive", "scl"])
def test_answers(tiny, pc, algorithm):
    assert rounded(all_nearest(tiny, "true_to_false", algorithm)) == TINY_T
    assert rounded(all_nearest(tiny, "false_to_true", algorithm)) == TINY_F
    assert rounded(all_nearest(pc, "true_to_false", algorithm)) == PC_T
    assert rounded(all_nearest(pc, "false_to_true", algorithm)) == PC_F


def test_offset_beyond_the_edge_is_rejected(spark):
    from networks import EDGES, OBJECTS

    edges, objects = parsed(TINY_EDGES, TINY_OBJECTS)
    _, _, lost = RoadNetwork.checked(spark.createDataFrame(edges, EDGES), spark.createDataFrame(objects, OBJECTS))
    assert [r["obj_id"] for r in lost.collect()] == [103]


@pytest.mark.parametrize("delta", [None, 4.0])
def test_shortest_paths(tiny, delta):
    found = shortest_paths(tiny, tiny.nodes.where("node_id = 1"), delta)
    assert {r["node"]: round(r["dist"], 2) for r in found.collect()} == {1: 0.0, 2: 5.0, 3: 3.6, 4: 8.07, 5: 4.24, 6: 9.24, 7: 11.23}


def test_degrees_chains_and_runs(tiny, pc):
    kinds = {r["node_id"]: r["degree"] for r in degrees(pc).collect()}
    assert sorted(n for n, d in kinds.items() if d == 1) == [7, 10, 11, 22, 37]
    assert sorted(n for n, d in kinds.items() if d == 2) == [5, 6, 8, 9, 14, 16, 20, 21, 23, 36, 38]
    assert [n for n, d in ((r["node_id"], r["degree"]) for r in degrees(tiny).collect()) if d == 2] == [7]
    assert chain_edges(tiny).select("chain_id").distinct().count() == 10 and chain_edges(pc).select("chain_id").distinct().count() == 39
    paths = {}
    for r in chain_nodes(pc).orderBy("chain_id", "pos").collect():
        paths.setdefault(r["chain_id"], []).append(r["node_id"])
    many = {tuple(min(p, p[::-1])) for p in paths.values() if len(p) > 2}
    assert many == {(1, 5, 2), (2, 6, 3), (2, 38, 17), (3, 8, 7), (3, 9, 26), (3, 21, 4), (4, 23, 24), (13, 14, 15), (15, 16, 20, 28), (35, 36, 37)}
    sizes = sorted(r["n"] for r in chain_runs(pc).collect())
    assert sizes == [1] * 13 + [2]


def test_parts(spark, tiny, pc):
    p = parts_of(spark, PC_PARTS)
    assert sorted(r["edge_id"] for r in cut_edges(pc, p).collect()) == [4, 14, 16, 26, 35, 39, 41]
    assert sorted(r["node_id"] for r in border_nodes(pc, p).collect()) == [1, 4, 9, 12, 17, 23, 25, 26, 27, 29, 30, 31, 38]
    assert border_paths(pc, p).count() == 78
    assert sorted(r["n_nodes"] for r in part_counts(pc, p).collect()) == [11, 13, 14]
    local = rounded(part_local_nearest(pc, p))
    assert local == {q: a for q, a in PC_T.items() if q not in (201, 206, 207, 213)} | {202: (6.3, 108)}
    t = parts_of(spark, TINY_PARTS)
    assert sorted(r["edge_id"] for r in cut_edges(tiny, t).collect()) == [4, 6, 10]
    assert sorted(r["node_id"] for r in border_nodes(tiny, t).collect()) == [2, 3, 4, 5, 6]
