import hashlib
import random
import re

import pytest

from nearway.llm import mixing as M


def brute_targets(sizes, weights, most):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        left = sum(w[s] for s in names if s not in full)
        target = {s: most * sizes[s] if s in full else rest * w[s] / left for s in names}
        over = {s for s in names if s not in full and target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def rows_of(seed, n=400):
    r = random.Random(seed)
    rows = [(i, r.choice([None, "a", "b", "c", "d", "\U0001f600", "Z", "", "hot", "hot", "hot"]), r.choice([None, "", " ", "x", "x y\tz\x0bq", "é\xa0é", "w " * r.randint(1, 90)])) for i in range(n)]
    return rows + [(n + 1, "tiny", "one"), (n + 2, "void", "")]


@pytest.mark.parametrize("range_rows", [7, 20_000])
def test_contract(spark, range_rows):
    rows = rows_of(range_rows)
    df = spark.createDataFrame([(i, s, t, 1, 2.0) for i, s, t in rows], "doc_id long, source string, text string, size int, target double")
    got = {x["doc_id"]: x for x in M.mix_sources(df, range_rows=range_rows).collect()}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, _, t in rows}
    sizes = {}
    for i, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + size[i]
    want, taken = brute_targets(sizes, (5, 2, 1), 3), dict.fromkeys(sizes, 0)
    for i, s, _ in rows:
        x = got[i]
        assert (x["size"], x["source_size"]) == (size[i], sizes[s]) and x["target"] == pytest.approx(want[s])
        assert 0 <= x["taken"] <= 3 * size[i]
        taken[s] += x["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1, s
    # by key: only one document of a source is cut
    for s in sizes:
        mine = sorted((hashlib.md5(str(i).encode()).hexdigest(), i) for i, t, _ in rows if t == s and size[i])
        epochs = [got[i]["taken"] / size[i] for _, i in mine]
        assert epochs == sorted(epochs, reverse=True)
    again = {x["doc_id"]: x["taken"] for x in M.mix_sources(df.repartition(5), range_rows=range_rows).collect()}
    assert again == {i: x["taken"] for i, x in got.items()}


def test_edges(spark):
    schema = "doc_id long, source string, text string, n_chars long"
    assert M.mix_sources(spark.createDataFrame([], schema)).count() == 0
    void = M.mix_sources(spark.createDataFrame([(1, "a", None, 0), (None, None, "", 0)], schema)).collect()
    assert [(x["size"], x["target"], x["taken"]) for x in void] == [(0, 0.0, 0)] * 2
    same = spark.createDataFrame([(1, "a", "x y z", 5)] * 3 + [(2, "b", "q " * 30, 60)], schema)
    assert sum(x["taken"] for x in M.mix_sources(same).collect()) == 39


def test_apply_takes_what_the_mix_says(spark):
    rows = rows_of(1, 120)
    df = spark.createDataFrame([(i, s, t, len(t or ""), 1) for i, s, t in rows], "doc_id long, source string, text string, n_chars long, mix_words int").drop("mix_words")
    mixed = M.mix_sources(df)
    out = M.mixed_rows(df)
    assert out.columns == df.columns
    words = {}
    for x in out.collect():
        assert x["n_chars"] == len(x["text"])
        words[x["doc_id"]] = words.get(x["doc_id"], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", x["text"]))
    assert words == {x["doc_id"]: x["taken"] for x in mixed.collect() if x["taken"]}


def test_rows_that_share_an_id_or_have_none_are_taken_on_their_own(spark):
    rows = [(None, "a", "p q r", 5), (None, "a", "s t u", 5), (7, "a", "v w x", 5), (7, "a", "y z", 3), (8, "b", "long " * 60, 300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, n_chars long")
    mixed, out = M.mix_sources(df).collect(), [x["text"] for x in M.mixed_rows(df).collect()]
    words = lambda t: len(t.split())
    assert sum(map(words, out)) == sum(x["taken"] for x in mixed)
    assert all(out.count(t) <= 3 for _, _, t, _ in rows) and {"p q r", "s t u", "v w x", "y z"} <= set(out)
    assert M.mixed_rows(df.limit(0)).count() == 0


def test_a_very_long_text(spark):
    df = spark.createDataFrame([(1, "a", "w\u00e9 " * 200_000, 1), (2, "b", "x " * 100_000, 1)], "doc_id long, source string, text string, n_chars long")
    got = {x["doc_id"]: x for x in M.mix_sources(df).collect()}
    assert (got[1]["size"], got[2]["size"]) == (200_000, 100_000)
    assert sum(len(x["text"].split()) for x in M.mixed_rows(df).collect()) == got[1]["taken"] + got[2]["taken"]


@pytest.mark.parametrize("same_rows", [7, 65_536])
def test_one_id_of_a_third_of_all_rows(spark, monkeypatch, same_rows):
    """Equal rows are counted before they are sent, and each still has its own place and words."""
    monkeypatch.setattr(M, "SAME_ROWS", same_rows)
    r = random.Random(4)
    rows = [(7, "a", "w w w")] * 150 + [(7, "a", "w w")] * 20 + [(None, "a", "n n")] * 30 + [(i, r.choice("ab"), "w " * r.randint(0, 9)) for i in range(100, 350)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    got = sorted((x["source_size"], x["doc_id"] or -1, x["size"], x["taken"]) for x in M.mix_sources(df, range_rows=16).collect())
    size, sizes = lambda t: len(t.split()), {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    goal, want = brute_targets(sizes, (5, 2, 1), 3), []
    key = lambda i, t: hashlib.md5((hashlib.md5(t.encode()).hexdigest() if i is None else str(i)).encode()).hexdigest()
    for s in sizes:
        epochs, before = int(goal[s] // sizes[s]), 0
        for _, _, n, i in sorted((key(i, t), -1 if i is None else i, size(t), i) for i, of, t in rows if of == s):
            want.append((sizes[s], -1 if i is None else i, n, epochs * n + max(0, min(n, int(goal[s]) - epochs * sizes[s] - before))))
            before += n
    assert got == sorted(want)


def test_texts_of_one_id_take_many_ranges(spark, monkeypatch):
    """A third of all rows share an id: what is taken of each is as mix_sources says, and no range has them all."""
    r = random.Random(8)
    rows = [(7, "a", " ".join(r.choice("pqrstuvw") for _ in range(r.randint(1, 12)))) for _ in range(200)]
    rows += [(i, r.choice("ab"), "w " * r.randint(1, 9)) for i in range(100, 500)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    slots, taken = [], M._taken
    monkeypatch.setattr(M, "_taken", lambda *a: slots.append(taken(*a)) or slots[-1])
    words = {}
    for x in M.mixed_rows(df, range_rows=8).collect():
        words.setdefault(x["doc_id"], []).append(len(x["text"].split()))
    sizes = [x["n"] for x in slots[0].groupBy("source", "slot").count().withColumnRenamed("count", "n").collect()]
    assert max(sizes) < 40 and len(sizes) > 60
    want = {}
    for x in M.mix_sources(df, range_rows=8).collect():
        want.setdefault(x["doc_id"], []).append(x["taken"])
    assert {d: sum(n) for d, n in words.items()} == {d: sum(n) for d, n in want.items() if sum(n)}


def test_texts_move_once(spark, tmp_path):
    """Between where texts are read and the end of the plan there is one exchange, however the plan's rows are joined."""
    df = spark.createDataFrame([(i, "ab"[i % 2] if i % 7 else None, "w " * (i % 9)) for i in range(300)], "doc_id long, source string, text string")
    df.write.parquet(str(tmp_path / "docs"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    for k, v in zip(before, ("-1", "false"), strict=True):
        spark.conf.set(k, v)
    try:
        out = M.mixed_rows(spark.read.parquet(str(tmp_path / "docs")), range_rows=20)
        plan = out._jdf.queryExecution().executedPlan().toString().splitlines()
        got = sorted((x["doc_id"], x["source"] or "", x["text"]) for x in out.collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    at = next(i for i, line in enumerate(plan) if "FileScan" in line and "text" in line.split("Batched")[0])
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    above, low = [], depth(plan[at])
    for line in reversed(plan[:at]):
        if depth(line) < low:
            above, low = [*above, line], depth(line)
    assert sum("Exchange" in line for line in above) == 1
    assert got == sorted((x["doc_id"], x["source"] or "", x["text"]) for x in M.mixed_rows(df, range_rows=20).collect())
    assert any(s == "" for _, s, _ in got)
