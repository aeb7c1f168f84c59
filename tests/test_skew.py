import random
from itertools import groupby

import pytest
from networks import network
from pyspark.sql import functions as F

from nearway import skew
from nearway.operators.on_edge import edge_segments, nearest_other_on_edge, ranked_objects
from nearway.operators.runs import edge_runs
from nearway.storage import shared_root


@pytest.mark.parametrize("slot_rows", [3, 4096])
def test_orders_along_edges_in_slots(spark, monkeypatch, slot_rows):
    monkeypatch.setattr(skew, "SLOT_ROWS", slot_rows)
    r = random.Random(slot_rows)
    edges = [(1, 1, 2, 50.0), (2, 2, 3, 8.0), (3, 3, 4, 5.0)]
    objects = [(k, r.choice([1, 1, 1, 2]), r.random() < 0.5, 0.0) for k in r.sample(range(100), 60)]
    objects = [(k, e, q, float(r.randint(0, 20 if e == 1 else 8))) for k, e, q, _ in objects]
    net = network(spark, edges, objects)
    lines = {e: sorted([o for o in objects if o[1] == e], key=lambda o: (o[3], o[0])) for e in (1, 2)}

    ranks = {x["obj_id"]: x["rank_on_edge"] for x in ranked_objects(net).collect()}
    assert ranks == {o[0]: n for own in lines.values() for n, o in enumerate(own, 1)}
    down = {x["obj_id"]: x["rank_on_edge"] for x in ranked_objects(net, descending=True).collect()}
    assert down == {o[0]: n for own in lines.values() for n, o in enumerate(sorted(own, key=lambda o: (-o[3], o[0])), 1)}
    assert {x["obj_id"]: x["rank_on_edge"] for x in ranked_objects(net, by="rating").collect()} == {o[0]: n for own in lines.values() for n, o in enumerate(sorted(own), 1)}

    near = {x["q"]: (x["dist"], x["obj"]) for x in nearest_other_on_edge(net.objects).collect()}
    assert near == {o[0]: min((abs(o[3] - p[3]), p[0]) for p in own if p != o) for own in lines.values() for o in own if len(own) > 1}

    parts = sorted((x["edge_id"], x["seq"], x["from_obj"], x["to_obj"], x["segment_length"]) for x in edge_segments(net).collect())
    want = [(3, 0, None, None, 5.0)]
    for e, own in lines.items():
        at = [(None, 0.0), *((o[0], o[3]) for o in own), (None, edges[e - 1][3])]
        want += [(e, n, a[0], b[0], b[1] - a[1]) for n, (a, b) in enumerate(zip(at, at[1:]))]
    assert parts == sorted(want, key=lambda x: x[:2])

    found = sorted((x["edge_id"], x["run"], x["is_query"], x["n"], x["first_obj"], x["last_obj"]) for x in edge_runs(net).collect())
    want = []
    for e, own in lines.items():
        for n, (kind, run) in enumerate(groupby(sorted(own, key=lambda o: (o[3], o[2], o[0])), key=lambda o: o[2]), 1):
            run = list(run)
            want.append((e, n, kind, len(run), run[0][0], run[-1][0]))
    assert found == sorted(want)


def test_hot_keys_are_dealt_and_joined_whole(spark, monkeypatch):
    monkeypatch.setattr(skew, "FEW", 16)
    left = spark.range(3000).selectExpr("id", "if(id % 3 = 0, id, 0) as k").unionByName(spark.range(3).selectExpr("id + 9000 as id", "null as k"))
    right = spark.range(3000).selectExpr("id as k", "id * 2 as v")
    joined = skew.join_hot(left, right, ["k"], "id")
    assert joined.columns == ["k", "id", "v"] and joined.count() == 3000 and joined.where("v <> 2 * k").isEmpty()
    dealt = joined.where("k = 0").select(F.spark_partition_id().alias("p")).distinct().count()
    assert dealt >= 1 and skew.join_hot(left, right, ["k"], "id", "left").count() == 3003
    # rows without a key are kept and dealt as well
    keyless = spark.range(500).selectExpr("id", "if(id < 20, id, null) as k")
    kept = skew.join_hot(keyless, right, ["k"], "id", "left")
    assert kept.count() == 500 and kept.where("v = 2 * k").count() == 20 and "_salt" in kept._jdf.queryExecution().toString()


def test_a_cluster_must_name_its_shared_folder(spark, monkeypatch):
    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://somewhere:7077"
            getConf = staticmethod(dict)

    with pytest.raises(ValueError):
        shared_root(Session())
    Session.sparkContext.master = "local-cluster[2,1,1024]"
    with pytest.raises(ValueError):
        shared_root(Session())
