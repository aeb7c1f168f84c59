import random
import zlib

import numpy as np
import pyarrow as pa

from nearway.llm import quality as Q
from nearway.llm.textkernel import buffers


def good(r, n):
    return ". ".join(" ".join("".join(r.choice("abcdefghi") for _ in range(r.randint(2, 8))) for _ in range(9)) for _ in range(n))


def bad(r, n):
    return " ".join(r.choice(["BUY!!", "now###", "de de de", "x"]) for _ in range(9 * n))


def test_held_out_accuracy_and_edges(spark):
    r = random.Random(1)
    rows = [(i, good(r, r.randint(3, 20)) if i % 3 else bad(r, r.randint(3, 20))) for i in range(400)]
    odd = [(900, None), (901, ""), (902, good(r, 4000))]
    df = spark.createDataFrame([(*x, 1, 2.0) for x in rows + odd], "doc_id long, text string, y int, score double")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(400)] + [(1, None), (900, 1), (900, 0), (5, 7)], "doc_id long, quality int")
    got = {x["doc_id"]: x for x in Q.score_quality(df, labels).collect()}
    assert len(got) == len(rows) + len(odd)
    assert all(x["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.3) for i, x in got.items())
    assert np.mean([got[i]["predicted"] == int(i % 3 > 0) for i in range(400) if got[i]["held_out"]]) >= 0.97
    assert got[900]["score"] == got[901]["score"] and got[902]["predicted"] == 1
    # held-out labels play no part
    held = [i for i in range(400) if got[i]["held_out"]]
    turned = labels.where("quality in (0, 1)").selectExpr("doc_id", f"CASE WHEN doc_id IN ({','.join(map(str, held))}) THEN 1 - quality ELSE quality END AS quality")
    again = {x["doc_id"]: x["predicted"] for x in Q.score_quality(df, turned).collect()}
    assert again == {i: x["predicted"] for i, x in got.items()}


def test_too_few_labels(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {x["score"] for x in Q.score_quality(df, none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "doc_id long, quality int")
    assert {x["score"] for x in Q.score_quality(df, one).collect()} <= {1.0, 0.5}
    assert Q.score_quality(df.limit(0), none).count() == 0


def test_features_do_not_depend_on_neighbours():
    r = random.Random(2)
    texts = ["", "a", "A a a", good(r, 5), bad(r, 5), "", "\n\n", "é" * 50]
    together = Q.features(*buffers(pa.array(texts)))
    assert np.isfinite(together).all() and together.shape == (len(texts), len(Q.FEATURES))
    for t, x in zip(texts, together, strict=True):
        assert np.allclose(Q.features(*buffers(pa.array([t])))[0], x)


def test_discriminant_matches_densities():
    r = np.random.default_rng(1)
    a, b = r.normal(0, 1, (500, 3)), r.normal(1, 2, (300, 3))
    m = Q.fit([500, 300], [a.sum(0), b.sum(0)], [a.T @ a, b.T @ b], shrink=0, ridge=0, temper=1)
    x = r.normal(0, 1, (5, 3))

    def density(x, y):
        s, d = np.cov(y.T, bias=True), x - y.mean(0)
        return -0.5 * d @ np.linalg.solve(s, d) - 0.5 * np.linalg.slogdet(s)[1]

    want = [1 / (1 + np.exp(density(v, a) + np.log(500 / 800) - density(v, b) - np.log(300 / 800))) for v in x]
    assert np.allclose(m.score(x), want, rtol=1e-4)


def plain_features(text):
    """FEATURES of one text, one by one over its bytes."""
    import math
    from collections import Counter

    data = text.encode()
    solid = [b for b in data if b not in b"\t\n\x0b\x0c\r "]
    upper, digit = [b for b in solid if 65 <= b <= 90], [b for b in solid if 48 <= b <= 57]
    letter = [b for b in solid if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128]
    mark = [b for b in solid if chr(b) in ".,;:!?'\"()-"]
    found = data.split()
    folded = [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in found]
    n, sizes = len(found), [len(w) for w in found]
    mean = sum(sizes) / n if n else 0.0
    spread = math.sqrt(max(sum((s - mean) ** 2 for s in sizes) / n, 0)) if n else 0.0
    fives = [tuple(folded[i : i + 5]) for i in range(max(n - 4, min(n, 1)))]
    odds = lambda part, whole: math.log((part + 0.5) / (whole - part + 0.5))
    return [
        math.log1p(n), math.log1p(mean), math.log1p(spread), odds(len(letter), len(solid)), odds(len(upper), len(letter)),
        odds(len(digit), len(solid)), odds(len(mark), len(solid)), odds(len(solid) - len(letter) - len(digit) - len(mark), len(solid)),
        odds(len(set(folded)), n), odds(sum(a == b for a, b in zip(folded, folded[1:])), n), odds(sum(s <= 3 for s in sizes), n),
        math.log((n + 1) / (sum(b in b".!?" for b in data) + 1)), math.log((n + 1) / (data.count(b"\n") + 1)),
        odds(len(set(fives)), len(fives)), odds(max(Counter(folded).values(), default=0), n),
    ]


def test_features_match_plain_counts():
    r = random.Random(3)
    signs = "aB é3.,!? \n\t-#中x  "
    texts = ["", " ", "A a a b", "one", "\x0b\x0cx\r\n", good(r, 30), bad(r, 30), "w " * 5000, "x" * 20_000]
    texts += ["".join(r.choice(signs) for _ in range(r.randint(0, 300))) for _ in range(300)]
    got = Q.features(*buffers(pa.array(texts)))
    for text, x in zip(texts, got, strict=True):
        assert np.allclose(x, plain_features(text), atol=1e-6), text[:80]
