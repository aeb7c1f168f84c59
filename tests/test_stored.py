import random

import pytest
from networks import answers, exact, network

from nearway.functions import network_nn
from nearway.operators import relax
from nearway.operators.stored import StoredLabels

EDGES = [(i, i, (i + 1) % 12, 2.0 + i % 3) for i in range(12)] + [(20, 0, 6, 5.0), (21, 3, 30, 4.0), (30, 50, 51, 3.0)]
OBJECTS = [(i, i % 12, True, 1.0) for i in range(12)] + [(100, 2, False, 1.0), (101, 8, False, 0.5), (102, 21, False, 2.0), (13, 30, True, 1.0)]


def test_updates_equal_a_fresh_table_and_look_ups_do_not_shuffle_labels(spark):
    stored = StoredLabels.made(network(spark, EDGES, OBJECTS), False, buckets=4)
    assert answers(stored.nearest()) == exact(EDGES, OBJECTS)
    come = [(103, 20, False, 2.0), (104, 30, False, 0.0), (14, 20, True, 4.0)]
    gone = spark.createDataFrame([(101,), (102,)], "obj_id long")
    after = stored.updated(spark.createDataFrame(come, "obj_id long, edge_id long, is_query boolean, dist_from_start double"), gone)
    rest = [o for o in OBJECTS if o[0] not in (101, 102)] + come
    assert answers(after.nearest()) == exact(EDGES, rest)
    again = after.updated(removed=spark.createDataFrame([(100,), (103,), (104,)], "obj_id long"))
    assert all(x["data_obj_id"] is None for x in again.nearest().collect())
    assert stored.updated() is stored
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ask = spark.range(100).withColumnRenamed("id", "node")
        plan = ask.join(stored.labels, "node")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Bucketed: true" in plan and plan.count("Exchange") == 1  # that of the nodes asked for


def test_updates_follow_chains_and_not_their_edges(spark):
    """What is gone was nearest along whole chains of some sixty edges; rounds follow the chains between their ends."""
    r, edges = random.Random(3), []
    for c, (a, b) in enumerate([(0, 1), (1, 2), (2, 0), (0, 3), (3, 2), (3, 3), (1, 4)]):
        path = [a, *range(100 * (c + 1), 100 * (c + 1) + 60), b]
        edges += [(100 * c + i, x, y, float(r.randint(1, 9))) for i, (x, y) in enumerate(zip(path, path[1:]))]
    ids, length = [e[0] for e in edges], {e[0]: e[3] for e in edges}
    put = lambda o, e, asks: (o, e, asks, float(r.randint(0, int(length[e]))))
    asking = [put(i, r.choice(ids), True) for i in range(60)]
    data = [put(1000 + i, e, False) for i, e in enumerate([5, 130, 260, 410, 655])]
    come = [put(2000 + i, e, False) for i, e in enumerate([315, 520])]
    gone = {1000, 1001, 1003}
    stored = StoredLabels.made(network(spark, edges, asking + data), False, buckets=4)
    before = relax.ROUNDS
    after = stored.updated(spark.createDataFrame(come, "obj_id long, edge_id long, is_query boolean, dist_from_start double"), spark.createDataFrame([(i,) for i in gone], "obj_id long"))
    assert relax.ROUNDS - before <= 14
    left = asking + [o for o in data if o[0] not in gone] + come
    assert answers(after.nearest()) == exact(edges, left)
    fewer = after.updated(removed=spark.createDataFrame([(2000,)], "obj_id long"))
    assert answers(fewer.nearest()) == exact(edges, [o for o in left if o[0] != 2000])


def test_sql_function_names_what_its_table_lacks(spark):
    network_nn.register(spark)
    spark.range(3).createOrReplaceTempView("no_edges")
    with pytest.raises(Exception, match="without: part_id"):
        spark.sql("SELECT * FROM network_nn(TABLE(no_edges))").collect()
