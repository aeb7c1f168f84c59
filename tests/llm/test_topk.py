import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearway.llm import topk as K


def brute(rows, k, scale, cond):
    ok = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    quantised = [(i, [math.floor(x * scale) for x in v]) for i, v in ok]
    out = {}
    for q in sorted({i for i, _ in quantised if cond(i)}):
        own = min(v for i, v in quantised if i == q)
        scored = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in quantised if i != q)
        for rank, (s, i) in enumerate(scored[:k], 1):
            out[q, rank] = (i, max(-(2**63), min(2**63 - 1, -s)))
    return out


@pytest.mark.parametrize("kind", ["normal", "ties", "large", "huge"])
def test_matches_brute_force(spark, kind):
    r = np.random.default_rng(3)
    size = {"normal": 0.3, "ties": 0.02, "large": 1e7, "huge": 1e17}[kind]
    rows = [(i, [float(x) for x in r.normal(0, size, 6)]) for i in range(240)]
    rows += [(400 + i, rows[5][1]) for i in range(90)]  # a hot vector
    rows += [(20, rows[3][1]), (20, rows[20][1])]  # repeated ids
    rows += [(500, None), (501, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (502, [float("nan")] * 6), (503, [float("inf")] * 6), (None, [1.0] * 6), (504, []), (505, [1.0])]
    df = spark.createDataFrame([(i, v, 7, "x") for i, v in rows], "vec_id long, embedding array<double>, score long, rank string")
    got = K.top_k(df, F.col("vec_id") % 20 == 0, k=5, scale=64, shard_rows=64, block_queries=4)
    assert {(x["query_id"], x["rank"]): (x["vec_id"], x["score"]) for x in got.collect()} == brute(rows, 5, 64, lambda i: i % 20 == 0)


def test_fewer_candidates_than_k_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [tuple(x) for x in K.top_k(df, F.col("vec_id") == 0, k=20).collect()] == [(0, 1, 1, 64 * 32)]
    assert K.top_k(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_scores_have_no_cap(spark):
    df = spark.createDataFrame([(0, [1.0, 1.0]), (1, [400000.0, 0.0]), (3, [300000.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(x["vec_id"], x["score"]) for x in K.top_k(df, F.col("vec_id") == 0, k=20).collect()] == [(1, 1_638_400_000), (3, 1_228_800_000)]


def test_a_query_far_longer_than_the_rows(spark):
    r = np.random.default_rng(8)
    rows = [(0, [float(x) for x in r.normal(0, 3e5, 8)])] + [(1 + i, [float(x) for x in r.normal(0, 4, 8)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = K.top_k(df, F.col("vec_id") % 20 == 0, k=20, shard_rows=100)
    assert {(x["query_id"], x["rank"]): (x["vec_id"], x["score"]) for x in got.collect()} == brute(rows, 20, 64, lambda i: i % 20 == 0)


@pytest.mark.parametrize("size", [1, 1 << 20, 1 << 40])
def test_stops_early_only_with_proof(size):
    r = random.Random(5)
    v = np.array([[size * r.choice([0, 0, 0, 1, -1, 2, 40]) for _ in range(12)] for _ in range(900)])
    ids = np.arange(900)
    index = K.ImpactIndex(v if size < 1 << 30 else v.astype(object), ids)
    exact = v.astype(object)
    floors = np.full(40, -np.inf)
    for turn in range(2):
        for (found, scores), q in zip(index.search(index.vectors[:40], ids[:40], 7, floors), range(40)):
            s = exact @ exact[q]
            order = sorted((i for i in range(900) if i != q), key=lambda i: (-s[i], i))[:7]
            assert list(found) == order and list(scores) == list(s[order])
            floors[q] = float(s[order[-1]])
    assert index.processed < 2 * 40 * index.total
