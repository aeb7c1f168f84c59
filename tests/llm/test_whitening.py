import math
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearway.llm import whitening as W


def test_rotations_give_singular_values():
    r = np.random.default_rng(1)
    for d, rows in ((1, 1), (2, 5), (5, 5), (7, 40), (64, 300), (6, 3)):
        a = r.normal(size=(rows, d)) * np.logspace(0, -9, d)  # small deviations stay accurate
        tall = np.linalg.qr(a, mode="r")
        length, v = W.rotate(tall)
        true = np.zeros(d)
        true[: min(rows, d)] = np.linalg.svd(a, compute_uv=False)
        assert np.allclose(length, true, rtol=1e-12, atol=1e-14)
        assert np.allclose(v.T @ v, np.eye(d), atol=1e-13) and np.allclose((a @ v).T @ (a @ v), np.diag(length**2), atol=1e-12)
    length, v = W.rotate(np.zeros((3, 3)))
    assert (length == 0).all() and (v == np.eye(3)).all()


def brute(rows, scale, most):
    ok = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    x = [(i, tuple(math.floor(scale * c) for c in v)) for i, v in ok]
    listed = sorted({v for _, v in x})
    n, s = len(listed), [sum(c) for c in zip(*listed)]
    m = np.array([[float(Fraction(c) - Fraction(t, n)) for c, t in zip(v, s)] for v in listed])
    e, u = np.linalg.eigh(m.T @ m / n)
    e, u = e[::-1], u[:, ::-1]
    out = defaultdict(list)
    for i, v in x:
        centred = np.array([float(Fraction(c) - Fraction(t, n)) for c, t in zip(v, s)])
        for k in range(min(most, len(s))):
            out[i, k + 1].append((n, sum((n * c - t) ** 2 for c, t in zip(v, s)), centred @ u[:, k] / math.sqrt(e[k]), e[k] / e.sum()))
    return out


def compare(got, rows, scale, most):
    want, mine = brute(rows, scale, most), defaultdict(list)
    for x in got:
        mine[x["vec_id"], x["component"]].append(x)
    assert mine.keys() == want.keys()
    sign = {}
    for key in sorted(want, key=lambda k: -max(abs(w[2]) for w in want[k])):
        a, b = sorted(mine[key], key=lambda x: x["deviation"]), sorted(want[key], key=lambda w: w[1])
        assert len(a) == len(b)
        for x, w in zip(a, b):
            assert (x["n"], int(x["deviation"])) == w[:2] and abs(x["explained"] - w[3]) <= 1e-9 * w[3]
            turn = sign.setdefault(key[1], 1 if x["whitened"] * w[2] > 0 else -1)
            assert abs(turn * x["whitened"] - w[2]) < 1e-8 * (1 + abs(w[2]))
    errors = {x["identity_error"] for x in got}
    assert len(errors) == 1 and errors.pop() < 1e-9


@pytest.mark.parametrize("size", [0.3, 1e6, 1e12])
def test_matches_brute_force(spark, size, monkeypatch):
    monkeypatch.setattr(W, "FAN_IN", 3)  # triangles are folded in rounds
    r = np.random.default_rng(2)
    mix = r.normal(size=(6, 6)) * [3, 2.5, 1.5, 1, 0.5, 0.2]
    rows = [(i, (size * (r.normal(size=6) @ mix)).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(200)]  # a hot vector
    rows += [(3, rows[9][1]), (3, rows[3][1]), (None, rows[4][1])]  # repeated ids, repeated rows, no id
    rows += [(2000, None), (2001, [1.0, None] * 3), (2002, [float("nan")] * 6), (2003, [float("inf")] + [0.0] * 5), (2004, [])]
    df = spark.createDataFrame([(i, v, "x", 7) for i, v in rows], "vec_id long, embedding array<double>, n string, _x int").repartition(11)
    got = W.whiten(df, keep=("vec_id", "_x")).collect()
    assert got[0]["_x"] == 7
    compare(got, rows, 256, 4)


def test_odd_tables(spark):
    df = spark.createDataFrame([(i, [float(i), float(i * i), 1.0]) for i in range(9)], "vec_id long, `the vector` array<float>")
    got = W.whiten(df, vector_col="the vector")
    assert got.columns[:2] == ["vec_id", "the vector"] and got.count() == 27
    flat = got.where("component = 3").collect()
    assert all(x["whitened"] is None and x["explained"] < 1e-20 for x in flat)
    empty = W.whiten(df.limit(0), vector_col="the vector")
    assert empty.count() == 0 and empty.dtypes == got.dtypes
    same = W.whiten(df.withColumn("the vector", F.array(F.lit(1.0), F.lit(2.0))), vector_col="the vector").collect()
    assert len(same) == 18 and all(x["whitened"] is None and x["n"] == 1 and x["deviation"] == 0 and x["explained"] == 0 for x in same)
    odd = W.whiten(df.withColumn("the vector", F.when(F.col("vec_id") < 7, F.col("the vector")).otherwise(F.array(F.lit(1.0).cast("float")))), vector_col="the vector")
    assert odd.select("vec_id").distinct().count() == 7


def test_query(spark):
    from nearway.llm.queries import op12_whitening

    got = op12_whitening(spark, "/root/testdata/sf0.001")
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    rows = [(x[0], x[1]) for x in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()]
    compare(got.collect(), rows, 256, 4)
