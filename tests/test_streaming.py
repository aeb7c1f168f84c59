from networks import answers, exact, network

from nearway.operators.ann import node_labels
from nearway.streaming.lookup import edge_candidates, nearest_in_stream

EDGES = [(1, 1, 2, 10.0), (2, 2, 3, 10.0), (3, 3, 1, 4.0), (4, 8, 9, 1.0)]
OBJECTS = [(1, 1, True, 1.0), (2, 2, True, 5.0), (3, 4, True, 0.5), (10, 2, False, 9.0), (11, 1, False, 6.0)]


def test_stream_against_labels(spark, tmp_path):
    net = network(spark, EDGES, OBJECTS)
    table = edge_candidates(net, node_labels(net, False), False)
    net.objects.where("is_query").select("obj_id", "edge_id", "dist_from_start").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("obj_id long, edge_id long, dist_from_start double").parquet(str(tmp_path / "in"))
    q = nearest_in_stream(stream, table).writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    found = spark.sql("SELECT * FROM found")
    assert found.count() == 3 and answers(found) == exact(EDGES, OBJECTS)
