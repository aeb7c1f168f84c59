import pytest
from networks import network
from pyspark.sql import functions as F

from nearway.operators import generate as G

EDGES = [(i, i, i + 1, 40.0 + i) for i in range(12)] + [(20, 0, 6, 100.0)]


@pytest.fixture(scope="module")
def net(spark):
    return network(spark, EDGES)


@pytest.mark.parametrize("make", [
    lambda n, s: G.uniform_both(n, 30, 20, s), lambda n, s: G.clustered_both(n, 30, 20, s, deviation=50.0), lambda n, s: G.mixed(n, 30, 20, s, True, deviation=50.0),
    lambda n, s: G.mixed(n, 30, 20, s, False, deviation=50.0), lambda n, s: G.filled_exactly(n, 5.0, 30, 20, s), lambda n, s: G.around_edges_and_uniform(n, 30, 20, True, s, [3], 150.0),
])
def test_exact_numbers_valid_places_and_reruns(net, make):
    objects = make(net, 5)
    got = objects.collect()
    assert sum(r["is_query"] for r in got) == 30 and len(got) == 50 and len({r["obj_id"] for r in got}) == 50
    lengths = {e[0]: e[3] for e in EDGES}
    assert all(0 <= r["dist_from_start"] <= lengths[r["edge_id"]] and 1 <= r["rating"] <= 10 for r in got)
    assert sorted(got) == sorted(make(net, 5).collect()) != sorted(make(net, 6).collect())


def test_near_edges_only(net):
    near = G.around_edges(net, 40, True, 1, [3], 60.0)
    assert {r["edge_id"] for r in near.select("edge_id").distinct().collect()} <= {2, 3, 4}


def test_spacing_and_capacity(spark, net):
    got = G.filled(net, 7.0, 3)
    w = "lag(dist_from_start) OVER (PARTITION BY edge_id ORDER BY dist_from_start)"
    assert got.withColumn("gap", F.col("dist_from_start") - F.expr(w)).where("gap < 7 - 1e-5").isEmpty()
    assert got.count() == G.capacity(net, 7.0)
    assert G.filled(net, 7.0, 3, most=9).count() == 9
    p = G.least_parameter(net, 60)
    assert G.capacity(net, 40.0 / p) >= 60 > G.capacity(net, 40.0 / (p - 1))
    assert G.least_parameter(net, 10**12) is None
    with pytest.raises(ValueError):
        G.filled_exactly(net, 30.0, 100, 100, 1)
    assert G.spacing_for(net, 10) == pytest.approx(sum(e[3] for e in EDGES) / 10)


def test_percent(net):
    assert tuple(G.type_percent(G.uniform_both(net, 1, 2, 1)).first()) == (1, 2, 33.33, 66.67)


@pytest.fixture(scope="module")
def line(spark):
    return network(spark, [(i, i, i + 1, 10.0 + i % 3) for i in range(600)])


def test_sampled_keeps_its_rules(line):
    spacing = G.least_spacing(line, shortest_over=8)
    assert spacing == 1.25 and G.least_spacing(line, total_over=7) == round(sum(10.0 + i % 3 for i in range(600)) / 7, 5)
    seen = set()
    for seed in (1, 2, 3):
        rows = G.sampled(line, spacing, seed, p_true=0.3, first=50).collect()
        ids = sorted(r["obj_id"] for r in rows)
        assert ids == list(range(50, 50 + len(rows)))
        by = {}
        for r in rows:
            by.setdefault(r["edge_id"], []).append(r["dist_from_start"])
        assert 300 <= len(by) <= 600  # every edge has room for seven or eight, so a picked one has an object
        for edge, places in by.items():
            length, places = 10.0 + edge % 3, sorted(places)
            fits = int(length / spacing) - 1
            assert fits // 5 <= len(places) <= fits // 2
            assert 0 <= places[0] and places[-1] <= length and all(b - a >= spacing - 1e-5 for a, b in zip(places, places[1:]))
        share = sum(r["is_query"] for r in rows) / len(rows)
        assert abs(share - 0.3) < 4 * (0.21 / len(rows)) ** 0.5
        assert sorted(rows) == sorted(G.sampled(line, spacing, seed, p_true=0.3, first=50).collect())
        seen.add(len(by))
        assert G.sampled(line, spacing, seed, most=20).count() == 20
    assert len(seen) > 1
    with pytest.raises(ValueError):
        G.sampled(line, 0.0, 1)
    with pytest.raises(ValueError):
        G.least_spacing(line)


def test_sampled_on_a_long_edge_no_edges_and_no_room(spark, line):
    rows = G.sampled(network(spark, [(1, 0, 1, 5000.0)]), 1.0, 1).collect()  # of one edge, one is picked
    assert 999 <= len(rows) <= 2499 and {r["edge_id"] for r in rows} == {1}
    assert G.sampled(line, 100.0, 1).isEmpty()
    assert G.sampled(network(spark, []), 1.0, 1).isEmpty() and G.least_spacing(network(spark, []), total_over=3) == 0


def test_uniform_is_even_and_clustered_is_not(line):
    even, near = G.uniform(line, 3000, True, 9), G.clustered(line, 3000, True, 9, centroids=3, deviation=8.0, scale=1.0)
    tenths = {r[0]: r[1] for r in even.groupBy(F.floor(F.col("edge_id") / 60)).count().collect()}
    assert sum((n - 300) ** 2 / 300 for n in tenths.values()) < 27.9 and len(tenths) == 10  # chi square, 9 degrees, 0.001
    assert even.select("edge_id").distinct().count() > 550
    # a half-normal walk of deviation 8 leaves an edge of length 10 seldom and three of them hardly ever
    assert near.select("edge_id").distinct().count() <= 3 * 8
