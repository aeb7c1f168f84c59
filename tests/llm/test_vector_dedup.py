import numpy as np
import pytest

from nearway.llm import vector_dedup as V


def brute(rows, cosine):
    def unit(v):
        if v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        return np.array(v) / np.linalg.norm(v)

    u = [(i, lab, unit(v)) for i, v, lab in rows]
    links = [[j for j, b in enumerate(u) if j != k and a[1] is not None and a[1] == b[1] and a[2] is not None and b[2] is not None and len(a[2]) == len(b[2]) and a[2] @ b[2] >= cosine] for k, a in enumerate(u)]
    comp = list(range(len(u)))
    changed = True
    while changed:
        changed = False
        for k, l in enumerate(links):
            m = min([comp[k], *(comp[j] for j in l)])
            for j in [k, *l]:
                if comp[j] != m:
                    comp[j], changed = m, True
    least = {}
    for k, c in enumerate(comp):
        least[c] = min(least.get(c, 10**9), u[k][0])
    return sorted((u[k][0], len(links[k]), least[comp[k]], u[k][0] == least[comp[k]]) for k in range(len(u)))


@pytest.mark.parametrize("how", [{"cells": 8, "block": 16}, {"cells": 8}, {}])
def test_matches_brute_force(spark, how):
    r = np.random.default_rng(2)
    rows, n = [], 0
    for g in range(40):
        base = r.normal(0, 1, 16)
        for _ in range(int(r.integers(1, 8))):
            rows.append((n, [float(x) for x in base + r.normal(0, 0.12, 16)], int(g % 3)))
            n += 1
    rows += [(1000 + i, rows[4][1], 0) for i in range(60)]  # a hot vector
    rows += [(2000, [x * 5 for x in rows[4][1]], 0), (2001, rows[4][1], 1), (2002, rows[4][1], None), (2003, None, 0), (2004, [0.0] * 16, 0), (2005, [float("nan")] * 16, 0), (2006, [1.0, None] * 8, 0), (2007, [], 0)]
    df = spark.createDataFrame([(i, v, lab, 1) for i, v, lab in rows], "vec_id long, embedding array<double>, label int, n long")
    got = sorted(tuple(x) for x in V.near_vectors(df, 0.93, words=16, **how).collect())
    assert got == brute(rows, 0.93)


def pairs_at(r, n, dims, cosine, spread):
    """n vectors and one for each at that cosine; spread: how unequal their dimensions are."""
    scale = spread ** np.arange(dims)
    x, way = r.normal(0, 1, (n, dims)) * scale, r.normal(0, 1, (n, dims)) * scale
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    way -= (way * x).sum(1, keepdims=True) * x
    return x, cosine * x + np.sqrt(1 - cosine**2) * way / np.linalg.norm(way, axis=1, keepdims=True)


@pytest.mark.parametrize("spread", [1.0, 0.9])
def test_every_link_is_probed_and_passes_the_codes(spread):
    r = np.random.default_rng(4)
    x, y = pairs_at(r, 3000, 64, 0.93, spread)  # at the threshold itself, the hardest
    model = V.Quantiser(np.concatenate([x, y]), 128, 8, 64)
    every = np.concatenate([x, y])
    own, d = model.nearest(every)
    radius = d[np.arange(len(d)), own]
    least, most = (np.array([f(radius[own == c], initial=i) for c in range(128)]) for f, i in ((np.min, 9), (np.max, 0)))
    reach = np.sqrt(2 - 2 * 0.93)
    can = model.probes(d, own, reach, least, most)
    a, b = np.arange(3000), np.arange(3000, 6000)
    swap = own[a] > own[b]
    asks, has = np.where(swap, b, a), np.where(swap, a, b)
    assert can[asks, own[has]].all()
    i, j = V.link(every, d, can, every, own, model.encode(every, own), model, 0.93 - 1e-9)
    found = set(zip(i.tolist(), j.tolist()))
    assert set(zip(asks.tolist(), has.tolist())) <= found
    near = np.argwhere(np.triu(every @ every.T >= 0.93 + 1e-9, 1))
    assert {tuple(p) for p in near.tolist()} <= found | {(q, p) for p, q in found}


def test_the_querys_own_settings_on_thousands_of_vectors_with_links(spark):
    """6,000 vectors, 77 cells as the query would take, pairs and a large cluster: recall is 1."""
    r = np.random.default_rng(6)
    x, y = pairs_at(r, 2400, 64, 0.94, 0.97)
    centre = r.normal(0, 1, 64)
    z = centre + r.normal(0, 0.28, (1200, 64))
    rows = [(i, [float(c) for c in v], int(i % 4 if i < 4800 else 1)) for i, v in enumerate(np.concatenate([np.stack([x, y], 1).reshape(-1, 64), z]))]
    rows = [(i, v, int(i // 2 % 4) if i < 4800 else lab) for i, v, lab in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {x["vec_id"]: (x["n_links"], x["component_id"]) for x in V.near_vectors(df, 0.93, block=700).collect()}
    exact = np.array([v for _, v, _ in rows], np.float32).astype(np.float64)
    exact /= np.linalg.norm(exact, axis=1, keepdims=True)
    label = np.array([lab for _, _, lab in rows])
    near = (exact @ exact.T >= 0.93) & (label[:, None] == label)
    expected = near.sum(1) - 1
    assert (expected > 0).mean() > 0.8 and expected.max() > 20
    assert [got[i][0] for i in range(len(rows))] == expected.tolist()


@pytest.mark.parametrize("effective", [3, 6])
def test_no_link_is_lost_where_vectors_fill_few_of_their_dimensions(spark, effective):
    r = np.random.default_rng(8)
    turn = np.linalg.qr(r.normal(0, 1, (64, 64)))[0][:effective]
    x = r.normal(0, 1, (400, effective)) @ turn
    way = r.normal(0, 1, (400, effective)) @ turn
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    way -= (way * x).sum(1, keepdims=True) * x
    y = 0.932 * x + np.sqrt(1 - 0.932**2) * way / np.linalg.norm(way, axis=1, keepdims=True)
    rows = [(i, [float(c) for c in v], i % 2) for i, v in enumerate(np.stack([x, x, y, y], 1).reshape(-1, 64))]
    got = V.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), 0.93)
    assert sorted(tuple(g) for g in got.collect()) == brute(rows, 0.93)


def test_no_usable_vectors(spark):
    df = spark.createDataFrame([(1, None, 1), (2, [1.0], None)], "vec_id long, embedding array<float>, label int")
    assert sorted(tuple(x) for x in V.near_vectors(df).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert V.near_vectors(df.limit(0)).count() == 0


def test_components_of_a_path_and_a_hub(spark):
    from nearway.llm.common import Workspace
    from nearway.llm.graph import components

    edges = [(i, i + 1) for i in range(100, 160)] + [(1, k) for k in range(200, 240)] + [(5, 5), (7, 6)]
    got = dict(tuple(x) for x in components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "t")).collect())
    assert {got[i] for i in range(100, 161)} == {100} and {got[k] for k in range(200, 240)} == {1} and got[7] == got[6] == 6 and 5 not in got
