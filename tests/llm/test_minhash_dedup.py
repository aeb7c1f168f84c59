import random
import re
from collections import Counter

import numpy as np
import pytest

from nearway.llm import minhash_dedup as M


def shingles(t, k=5):
    w = re.findall(r"[^\x09-\x0d\x20]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return Counter(tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))) if w else None


def brute(rows, similarity=0.8):
    s = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same_id = rows[i][0] == rows[j][0]
            if s[i] and s[j]:
                both = sum((s[i] & s[j]).values())
                if both >= similarity * (s[i].total() + s[j].total() - both) - 1e-9 or same_id:
                    comp[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), 10**9), d)
    return {(d, least[find(i)]) for i, (d, _) in enumerate(rows)}


def edited(r, words, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = "".join(r.choice("abcdefgh") for _ in range(5))
    return " ".join(words)


def test_signatures_estimate_weighted_similarity():
    r = np.random.default_rng(0)
    for most in (2, 6, 40):
        a = r.integers(1, most, 300)
        b = np.maximum(a + r.integers(-3, 4, 300), 0)
        base, agree = r.integers(0, 2**62, 300, dtype=np.uint64), []
        for turn in range(40):
            k = base + np.uint64(turn * 7919)
            s = M.bag_minhash(np.concatenate([k, k[b > 0]]), np.concatenate([a, b[b > 0]]), np.array([0, 300, 300 + (b > 0).sum()]))
            agree.append((s[0] == s[1]).mean())
        assert np.mean(agree) == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.03)


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(M, "SMALL", 4)  # so that large buckets go through their rounds
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows, n = [], 0
    for size in (1, 1, 2, 3, 12, 30):
        base = [word() for _ in range(r.randint(60, 140))]
        for k in range(size):
            rows.append((n, edited(r, base, k % 3)))
            n += 1
    many = [word() for _ in range(80)]
    rows += [(500 + k, " ".join(many)) for k in range(40)]  # exact copies
    rows += [(600, "A  b\nc"), (601, "a b c"), (602, "a b"), (603, ""), (604, " \n"), (605, "of " * 300), (606, "of " * 290), (607, "Of " * 100)]
    rows += [(600, "A  b\nc")]  # a repeated row
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in [*rows, (700, None), (None, "a b c")]], "doc_id long, text string, class_id string, n long")
    got = {(x["doc_id"], x["class_id"], x["kept"]) for x in M.near_duplicates(df).collect()}
    assert {(d, c) for d, c, _ in got if d is not None and d != 700} == brute(rows)
    assert (700, 700, True) in got and (None, None, False) in got and all(k == (d == c) for d, c, k in got if d is not None)
    kept = M.drop_near_duplicates(df)
    assert kept.columns == df.columns
    # ids 600, 601 and the row without an id are one text; 700 has none; what is kept is each class's first
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted({c for _, c, _ in got if c is not None})


def test_ids_that_repeat_with_other_texts(spark):
    r = random.Random(3)
    a, b = (" ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(60)) for _ in range(2))
    df = spark.createDataFrame([(1, a), (1, b), (2, a + " x"), (3, b + " y"), (4, "else"), (None, b + " z"), (None, "alone")], "doc_id long, text string")
    assert {(x["doc_id"], x["class_id"]) for x in M.near_duplicates(df).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (None, None)}
    # as texts they are two classes, and the row without an id that is like no other stays
    assert sorted((x["doc_id"] or 0, x["text"]) for x in M.drop_near_duplicates(df).collect()) == sorted([(1, a), (1, b), (4, "else"), (0, "alone")])


def test_hot_texts_and_buckets_are_dealt_over_tasks(spark, monkeypatch):
    from nearway import skew

    monkeypatch.setattr(skew, "FEW", 16)
    r = random.Random(5)
    base = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(90)]
    rows = [(k, " ".join(base)) for k in range(400)]  # one text
    rows += [(1000 + k, " ".join([*base[:40], f"w{k}", *base[41:]])) for k in range(300)]  # one large bucket
    rows += [(5000 + k, f"text {k} on its own " * 3) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(x["doc_id"], x["class_id"]) for x in M.near_duplicates(df).collect()} == {(d, 0 if d < 5000 else d) for d, _ in rows}
    # the rows of one key take many places
    keys = spark.range(4000).selectExpr("id", "0L as k").unionByName(spark.range(50).selectExpr("id", "id + 1 as k"))
    joined = skew.join_hot(keys, spark.range(60).selectExpr("id as k", "id * 2 as v"), ["k"], "id")
    assert joined.count() == 4050 and joined.where("v <> k * 2").isEmpty()
    assert "_salt" in joined._jdf.queryExecution().toString()


def test_a_hot_id_and_a_very_long_text(spark, monkeypatch):
    """A third of all rows repeat one row, an id has many texts, a text many ids, and one text is of 100,000 words."""
    from nearway import skew

    monkeypatch.setattr(skew, "FEW", 16)
    r = random.Random(6)
    text = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    one, long = text(40), text(100_000)
    rows = [(1, one)] * 150 + [(2, one + " more")] + [(3, text(30)) for _ in range(90)] + [(k, "the same text for many ids") for k in range(100, 190)]
    rows += [(3, "the same text for many ids"), (900, long), (901, long + " end"), (902, text(50)), (903, ""), (904, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    want = {d: d for d, _ in rows} | {2: 1, 901: 900} | dict.fromkeys(range(100, 190), 3)
    got = [(x["doc_id"], x["class_id"]) for x in M.near_duplicates(df).collect()]
    assert len(got) == len(rows) and set(got) == set(want.items())


def test_recall_on_the_given_documents(spark):
    """All pairs of different texts with a similarity of 0.8 or more, by brute force, are in one class."""
    from pathlib import Path

    path = Path("/root/testdata/sf0.001/documents.parquet")
    if not path.exists():
        pytest.skip("the tables aren't here")
    docs = spark.read.parquet(str(path))
    rows = [(x["doc_id"], x["text"]) for x in docs.collect()]
    assert {(x["doc_id"], x["class_id"]) for x in M.near_duplicates(docs).collect()} == brute(rows) | {(d, d) for d, t in rows if not shingles(t)}
