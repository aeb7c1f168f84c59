"""Small networks for tests, and exact answers from a heap-based search."""

import heapq
from collections import defaultdict

from nearway.network import RoadNetwork

EDGES = "edge_id long, start_node long, end_node long, length double"
OBJECTS = "obj_id long, edge_id long, is_query boolean, dist_from_start double"

TINY_EDGES = [(1, 1, 5, 4.24), (2, 1, 3, 3.6), (3, 1, 2, 5.0)]


def network(spark, edges, objects=()):
    net, _, _ = RoadNetwork.checked(spark.createDataFrame(list(edges), EDGES), spark.createDataFrame(list(objects), OBJECTS))
    return net


def exact(edges, objects, kind=True):
    """query -> (distance, object) by one Dijkstra search for each query; missing if nothing is reached."""
    edges = {e[0]: e for e in edges}
    adjacency = defaultdict(list)
    for _, a, b, w in edges.values():
        adjacency[a].append((b, w))
        adjacency[b].append((a, w))
    out = {}
    for q, e, is_query, off in objects:
        if is_query != kind:
            continue
        _, a, b, w = edges[e]
        dist, heap = {}, sorted([(off, a), (w - off, b)])
        while heap:
            d, n = heapq.heappop(heap)
            if n in dist:
                continue
            dist[n] = d
            for m, x in adjacency[n]:
                if m not in dist:
                    heapq.heappush(heap, (d + x, m))
        best = []
        for o, oe, other, ooff in objects:
            if other == kind:
                continue
            _, oa, ob, ow = edges[oe]
            far = float("inf")
            way = min(dist.get(oa, far) + ooff, dist.get(ob, far) + ow - ooff, abs(off - ooff) if oe == e else far)
            if way < far:
                best.append((round(way, 6), o))
        if best:
            out[q] = min(best)
    return out


def answers(df):
    return {r["query_obj_id"]: (round(r["distance"], 6), r["data_obj_id"]) for r in df.collect() if r["data_obj_id"] is not None}
