"""Runs whose objects share a place are numbered by their first object."""

from networks import network

from nearway.operators.runs import chain_runs, edge_runs

# on edge 1 the object of type true at 5 has the lesser id, on edge 2 the greater one
OBJECTS = [(1, 1, True, 1.0), (3, 1, True, 5.0), (7, 1, False, 5.0), (4, 2, False, 5.0), (9, 2, True, 5.0)]


def test_runs_of_one_place_on_an_edge(spark):
    net = network(spark, [(1, 1, 2, 10.0), (2, 3, 4, 10.0)], OBJECTS)
    got = {(r["edge_id"], r["run"]): (r["is_query"], r["n"], r["first_obj"], r["last_obj"]) for r in edge_runs(net).collect()}
    assert got == {(1, 1): (True, 1, 1, 1), (1, 2): (True, 1, 3, 3), (1, 3): (False, 1, 7, 7), (2, 1): (False, 1, 4, 4), (2, 2): (True, 1, 9, 9)}


def test_runs_of_one_place_on_a_chain(spark):
    # the chain 1-2-3; its runs of type false have numbers as well
    net = network(spark, [(1, 1, 2, 10.0), (2, 2, 3, 10.0)], OBJECTS[:3])
    true, false = ([(r["chain_id"], r["run"], r["n"], r["first_obj"], r["last_obj"]) for r in chain_runs(net, k).orderBy("run").collect()] for k in (True, False))
    assert true == [(1, 1, 1, 1, 1), (1, 2, 1, 3, 3)] and false == [(1, 3, 1, 7, 7)]
