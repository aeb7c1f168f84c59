import pytest
from networks import answers, exact, network

from nearway.operators import deviations, relax
from nearway.operators.ann import all_nearest, untyped_nearest
from nearway.operators.chains import bad_chains, chain_edges
from nearway.operators.runs import misplaced_objects

CASES = {
    "no relaxation of a closed edge": ([(1, 1, 2, 2.0), (2, 1, 3, 100.0), (3, 2, 4, 1.0), (4, 4, 3, 1.0), (5, 3, 5, 10.0)], [(1, 1, True, 1.0), (2, 5, False, 1.0)], {1: (4.0, 2)}),
    "far end": ([(1, 1, 2, 100.0), (2, 1, 3, 1.0), (3, 3, 2, 1.0)], [(1, 2, True, 0.0), (2, 1, False, 99.0)], {1: (3.0, 2)}),
    "two on an edge": ([(1, 1, 2, 10.0), (2, 1, 3, 5.0)], [(1, 2, True, 2.0), (2, 1, False, 9.0), (3, 1, False, 1.0)], {1: (3.0, 3)}),
    "one place": ([(1, 1, 2, 10.0)], [(1, 1, True, 4.0), (2, 1, False, 4.0)], {1: (0.0, 2)}),
    "parallel edges": ([(1, 1, 2, 5.0), (2, 1, 2, 2.0), (3, 2, 3, 4.0)], [(1, 1, True, 0.0), (2, 3, False, 1.0)], {1: (3.0, 2)}),
    "detour": ([(1, 1, 2, 100.0), (2, 1, 3, 1.0), (3, 3, 2, 1.0)], [(1, 1, True, 1.0), (2, 1, False, 99.0)], {1: (4.0, 2)}),
    "not joined": ([(1, 1, 2, 10.0), (2, 3, 4, 10.0)], [(1, 1, True, 1.0), (2, 2, True, 1.0), (3, 2, False, 5.0)], {2: (4.0, 3)}),
    "cycle": ([(1, 1, 2, 3.0), (2, 2, 3, 4.0), (3, 3, 1, 5.0)], [(1, 1, True, 1.0), (2, 2, True, 1.0), (3, 3, True, 4.0), (4, 2, False, 3.0)], None),
    "dead end": ([(1, 1, 2, 5.0), (2, 2, 3, 5.0), (3, 1, 4, 5.0), (4, 1, 5, 9.0)], [(1, 1, True, 3.0), (2, 1, True, 4.0), (3, 2, True, 1.0), (4, 2, False, 4.0), (5, 4, False, 8.0)], None),
    "ties": ([(1, 1, 2, 4.0), (2, 2, 3, 4.0)], [(1, 1, True, 4.0), (9, 1, False, 2.0), (8, 2, False, 2.0)], {1: (2.0, 8)}),
}


def together(cases):
    """Networks side by side as one, each with numbers of its own, and the exact answers; what is expected is checked."""
    all_edges, all_objects, expected = [], [], {}
    for k, (edges, objects, known) in enumerate(cases):
        found = exact(edges, objects)
        assert known is None or found == known
        all_edges += [(1000 * k + i, 1000 * k + a, 1000 * k + b, w) for i, a, b, w in edges]
        all_objects += [(1000 * k + o, 1000 * k + e, q, off) for o, e, q, off in objects]
        expected |= {1000 * k + q: (d, 1000 * k + o) for q, (d, o) in found.items()}
    return all_edges, all_objects, expected


@pytest.mark.parametrize("algorithm", ["voronoi", "naive", "scl", "parts", "parts_naive"])
def test_cases(spark, algorithm):
    edges, objects, expected = together(CASES.values())
    found = all_nearest(network(spark, edges, objects), "true_to_false", algorithm)
    assert found.count() == sum(o[2] for o in objects)
    assert answers(found) == expected


def long_network(r, n_chains=6, length=40):
    """Junctions joined by chains of edges, one of them a dead end, and a ring that nothing joins."""
    edges, node, junctions = [], 100, list(range(5))
    for c in range(n_chains):
        at = r.choice(junctions)
        for k in range(length):
            node += 1
            to = r.choice(junctions) if k == length - 1 and c else node
            if to != at:
                edges.append((len(edges), at, to, float(r.randint(1, 9))) if r.random() < 0.5 else (len(edges), to, at, float(r.randint(1, 9))))
            at = to
    for k in range(30):
        edges.append((len(edges), 1000 + k, 1000 + (k + 1) % 30, float(r.randint(1, 5))))
    return edges, [(k, e[0], r.random() < 0.85, float(r.randint(0, int(e[3])))) for k, e in enumerate(r.choice(edges) for _ in range(150))]


def test_long_chains_in_slots(spark, monkeypatch, slot_rows=7):
    import random

    from nearway import skew
    from nearway.operators import contract

    monkeypatch.setattr(skew, "SLOT_ROWS", slot_rows)
    monkeypatch.setattr(contract, "SLOT_ROWS", slot_rows)
    edges, objects = long_network(random.Random(slot_rows))
    net = network(spark, edges, objects)
    for algorithm in ("voronoi", "scl", "naive"):
        assert answers(all_nearest(net, "true_to_false", algorithm)) == exact(edges, objects), algorithm
    sources = net.nodes.where("node_id in (0, 101, 1003)")
    paths = [{(x["source"], x["node"]): x["dist"] for x in relax.shortest_paths(net, sources, delta).collect()} for delta in (None, 400.0)]
    assert paths[0] == paths[1] and len(paths[0]) > 300


def random_network(r):
    n = r.randint(2, 9)
    edges = [(i, *r.sample(range(n), 2), float(r.randint(1, 9))) for i in range(r.randint(1, 14))]
    return edges, [(k, e[0], r.random() < 0.6, float(r.randint(0, int(e[3])))) for k, e in enumerate(r.choice(edges) for _ in range(r.randint(1, 14)))], None


def test_algorithms_agree_on_random_networks(spark):
    import random

    r = random.Random(20)
    edges, objects, expected = together([random_network(r) for _ in range(60)])
    net = network(spark, edges, objects)
    for algorithm in ("voronoi", "scl", "naive"):
        assert answers(all_nearest(net, "true_to_false", algorithm)) == expected, algorithm
    assert answers(all_nearest(net, "false_to_true", "scl")) == exact(edges, objects, False)
    chains = chain_edges(net).cache()
    assert chains.count() == len(edges) and bad_chains(net, chains).isEmpty() and misplaced_objects(net, chains).isEmpty()


def test_orientation_and_partitions_do_not_matter(spark):
    edges, objects, _ = CASES["dead end"]
    turned = [(i, b, a, w) for i, a, b, w in edges]
    lengths = {e[0]: e[3] for e in edges}
    moved = [(o, e, q, lengths[e] - off) for o, e, q, off in objects]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    one = answers(all_nearest(network(spark, edges, objects)))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert answers(all_nearest(network(spark, turned, moved))) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_direction_auto_asks_from_the_smaller_side(spark):
    edges = [(1, 1, 2, 10.0)]
    few_true = [(1, 1, True, 1.0), (2, 1, False, 2.0), (3, 1, False, 3.0)]
    assert set(answers(all_nearest(network(spark, edges, few_true), "auto"))) == {1}
    few_false = [(1, 1, True, 1.0), (2, 1, True, 2.0), (3, 1, False, 3.0)]
    assert set(answers(all_nearest(network(spark, edges, few_false), "auto"))) == {3}
    with pytest.raises(ValueError):
        all_nearest(network(spark, edges, few_false), "sideways")


def test_untyped_leaves_out_the_object_itself(spark):
    edges = [(1, 1, 2, 10.0), (2, 2, 3, 10.0), (3, 4, 5, 1.0)]
    objects = [(1, 1, True, 9.0), (2, 2, True, 3.0), (3, 2, False, 9.0), (4, 3, True, 0.0)]
    assert answers(untyped_nearest(network(spark, edges, objects))) == {1: (4.0, 2), 2: (4.0, 1), 3: (6.0, 2)}
    assert untyped_nearest(network(spark, edges, objects)).count() == 4


def test_empty_network(spark):
    assert all_nearest(network(spark, [(1, 1, 2, 1.0)], [])).count() == 0
    lonely = all_nearest(network(spark, [(1, 1, 2, 1.0)], [(1, 1, True, 0.5)])).collect()
    assert [(r[0], r[1], r[2]) for r in lonely] == [(1, None, None)]


def test_k_shortest_paths_have_no_bound_on_their_edges(spark):
    import random

    r = random.Random(6)
    edges = [(i, i, i + 1, 1.0) for i in range(9)] + [(20, 0, 9, 30.0), (21, 0, 5, 7.0), (22, 5, 9, 5.0), (23, 3, 4, 2.0)]
    edges += [(30 + i, *r.sample(range(10), 2), float(r.randint(5, 12))) for i in range(3)]
    best = {}

    def grow(path, cost):
        if path[-1] == 9:
            best[tuple(path)] = min(cost, best.get(tuple(path), cost))
            return
        for _, a, b, w in edges:
            for x, y in ((a, b), (b, a)):
                if x == path[-1] and y not in path:
                    grow([*path, y], cost + w)

    grow([0], 0.0)
    want = [(n, c, list(p)) for n, (c, p) in enumerate(sorted((c, p) for p, c in best.items())[:5], 1)]
    assert max(len(p) for _, _, p in want) > 8
    for at_once in (1,):
        got = deviations.simple_paths(network(spark, edges), 0, 9, 5, at_once).collect()
        assert [(x["rank"], x["cost"], x["nodes"]) for x in got] == want


def test_k_shortest_paths_along_chains_cycles_and_parallel_edges(spark):
    """Source and target inside chains, parallel chains between the same ends, a loop, dead ends, too few paths, none."""
    import random

    def chain(first_id, nodes, w):
        return [(first_id + i, a, b, w) for i, (a, b) in enumerate(zip(nodes, nodes[1:]))]

    edges = chain(0, [0, 10, 11, 12, 1], 1.0) + chain(10, [0, 13, 14, 1], 2.0) + chain(20, [1, 15, 16, 17, 2], 1.0)
    edges += chain(30, [2, 18, 19, 0], 4.0) + chain(40, [2, 20, 21, 22, 2], 1.0) + chain(50, [1, 23, 24], 1.0)
    edges += [(60, 0, 1, 9.0), (61, 0, 1, 3.0), (62, 1, 2, 7.0), (70, 90, 91, 1.0)]
    net, to = network(spark, edges), {}
    for _, a, b, w in edges:
        for x, y in ((a, b), (b, a)):
            to.setdefault(x, {})[y] = min(w, to.get(x, {}).get(y, w))

    def brute(source, target, k):
        found, live = [], [(0.0, [source])]
        while live:
            cost, path = live.pop()
            if path[-1] == target:
                found.append((cost, path))
            else:
                live += [(cost + w, [*path, y]) for y, w in to[path[-1]].items() if y not in path]
        return [(i, c, p) for i, (c, p) in enumerate(sorted(found)[:k], 1)]

    for source, target, k in ((0, 2, 4), (11, 16, 7), (21, 24, 50), (13, 13, 3), (0, 90, 2)):
        got = deviations.simple_paths(net, source, target, k).collect()
        assert [(x["rank"], x["cost"], x["nodes"]) for x in got] == brute(source, target, k), (source, target, k)


def test_k_shortest_paths_take_few_rounds_where_ways_lead_back(spark, monkeypatch):
    """No path is made of a step that must be taken back, and later rounds make more paths than the first."""
    made, real = [], deviations._made

    def counted(begun, jumps):
        made.append(begun.count())
        assert len(made) <= 4, made
        return real(begun, jumps)

    monkeypatch.setattr(deviations, "_made", counted)
    # a line from 0 to 3 with three dead ends at each node, and twelve other ways, as long as each other
    edges = [(i, i, i + 1, 1.0) for i in range(3)] + [(100 + i, i % 3, 100 + i, 1.0) for i in range(9)]
    edges += [(200 + i, 0, 20 + i, 5.0) for i in range(12)] + [(300 + i, 20 + i, 3, 5.0) for i in range(12)]
    got = deviations.simple_paths(network(spark, edges), 0, 3, 2, 2).collect()
    assert [(x["rank"], x["cost"], x["nodes"]) for x in got] == [(1, 3.0, [0, 1, 2, 3]), (2, 10.0, [0, 20, 3])]
    assert made == [1, 2, 4, 6]
