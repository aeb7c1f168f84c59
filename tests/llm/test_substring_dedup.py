import random
import re
from collections import defaultdict

from nearway.llm import substring_dedup as S


def word(r):
    return "".join(r.choice("abcdefgh") for _ in range(6))


def texts():
    r = random.Random(5)
    passage = " ".join(word(r) for _ in range(70))
    license_line = "this work is under such and such a license"
    out = []
    for i in range(60):
        own = [word(r) for _ in range(r.randint(20, 90))]
        if i % 3 == 0:
            own.insert(r.randint(0, len(own)), passage)
        t = " ".join(own)
        if i % 4 == 0:
            t += "\n" + license_line
        out.append(t)
    return out, passage


def brute(rows, least=1):
    """Lines cut, normalised and compared as strings, in plain Python."""
    where, parts = defaultdict(list), defaultdict(list)
    for d, t in rows:
        for m in re.finditer("[^\\n]+", t):
            held = re.search(r"[^\x09-\x0d\x20](?:.*[^\x09-\x0d\x20])?", m[0], re.S)
            if held:
                w = re.findall(r"[^\x09-\x0d\x20]+", re.sub("[A-Z]", lambda x: x[0].lower(), held[0]))
                parts[d].append((" ".join(w), m.start() + held.start(), m.start() + held.end(), len(w)))
                where[parts[d][-1][0]].append((d, len(parts[d]) - 1))
    out = []
    for d, lines in parts.items():
        k = 0
        while k < len(lines):
            j = k
            while j < len(lines) and (d, j) != min(where[lines[j][0]]):
                j += 1
            if j > k and sum(p[3] for p in lines[k:j]) >= least:
                first = where[lines[k][0]]
                out.append((d, lines[k][1], lines[j - 1][2], sum(p[3] for p in lines[k:j]), min(first)[0], len(first)))
            k = max(j, k + 1)
    return sorted(out)


def test_lines_match_brute_force(spark):
    r = random.Random(9)
    made, _ = texts()
    rows = list(enumerate(made)) + [(100, made[1]), (101, made[1]), (102, "é é\n" * 3), (103, " É é \n\n\té  é\r\n"), (104, "short"), (105, "Short\nof\n\nof\nSHORT x")]
    for d in range(200, 260):
        rows.append((d, "\n".join(" ".join(r.choice("ab") for _ in range(r.randint(0, 4))) for _ in range(r.randint(1, 8)))))
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in [*rows, (300, None), (301, ""), (None, made[3])]], "doc_id long, text string, place int, words int")
    for least in (1, 5):
        assert sorted(tuple(x) for x in S.repeated_spans(df, least_words=least).collect()) == brute(rows, least)
    assert S.repeated_spans(df.limit(0)).count() == 0


def test_a_short_licence_line_goes_from_all_but_the_first(spark):
    r = random.Random(1)
    rows = [(d, f"{word(r)} {word(r)}\n" + ("All Rights  Reserved here\n" if d % 2 else "all rights reserved here\n") + f"end{d}", d, "kept") for d in range(1000)]
    rows += [(2000, None, 1, "kept"), (2001, "", 1, "kept"), (None, rows[0][1], 1, "kept"), (2002, "long " + "line\n" * 30_000, 1, "kept")]
    df = spark.createDataFrame(rows, "doc_id long, text string, removed int, `a.b` string")
    out = S.remove_repeats(df)
    assert out.columns == ["doc_id", "text", "removed", "a.b", "removed_"]
    got = {x["doc_id"]: x for x in out.collect()}
    assert len(got) == len(rows) and all(got[d]["removed"] == n and got[d]["a.b"] == "kept" for d, _, n, _ in rows)
    for d, t, *_ in rows[1:1000]:
        line = t.split("\n")[1]
        assert got[d]["text"] == t.replace(line, "") and [t[s["start"] : s["end"]] for s in got[d]["removed_"]] == [line]
    assert got[0]["text"] == rows[0][1] and got[None]["text"] == rows[0][1] and got[0]["removed_"] is None
    assert got[2000]["text"] is None and got[2001]["text"] == "" and got[2002]["text"].split() == ["long", "line", "line"]


def test_hot_lines_are_dealt_over_tasks(spark, monkeypatch):
    from nearway import skew

    monkeypatch.setattr(skew, "FEW", 16)
    r = random.Random(1)
    passage = " ".join(word(r) for _ in range(60))
    rows = [(d, f"{word(r)} {passage} {100000 + d}\nthe same line") for d in range(300)] + [(d, word(r)) for d in range(300, 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: (x["start"], x["end"], x["words"]) for x in S.repeated_passages(df).collect()}
    assert got == {d: (7, 7 + len(passage), 60) for d in range(1, 300)}
    assert sorted(tuple(x) for x in S.repeated_spans(df).collect()) == brute(rows)


def test_query_finds_every_passage_of_over_50_words_whole(spark, tmp_path):
    from nearway.llm.queries import op9_substring_dedup

    r = random.Random(11)
    rows, where = [], {}
    for k in range(300):
        passage = [word(r) for _ in range(r.choice([51, 52, 55, 60, 80]))]
        for copy in (0, 1):
            before, after = ([word(r) for _ in range(r.randint(5, 30))] for _ in range(2))
            rows.append((2 * k + copy, " ".join(before + passage + after)))
            at = len(" ".join(before)) + 1
            where[2 * k + copy] = (at, at + len(" ".join(passage)), len(passage))
    rows.append((1000, "\n".join(rows[0][1].split())))  # the same words in lines of their own
    rows.append((1001, "one two three " * 60))  # of what repeats itself one run stays
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    for x in op9_substring_dedup(spark, str(tmp_path)).collect():
        got.setdefault(x["doc_id"], []).append(tuple(x)[1:])
    for k in range(300):
        assert 2 * k not in got
        a, b, n = where[2 * k + 1]
        assert got[2 * k + 1] == [(a, b, n, 2 * k, 3 if k == 0 else 2)]
    assert [(x[0], x[1]) for x in got[1000]] == [(0, len(rows[0][1]))]
    (start, end, n, *_), = got[1001]
    assert end == len("one two three " * 60) - 1 and 180 - S.RUN - 2 <= n <= 180 - S.RUN


def test_short_lines_go_beside_passages(spark):
    made, _ = texts()
    rows = [*enumerate(made), (100, made[1]), (101, made[1])]
    df = spark.createDataFrame([(d, t) for d, t in [*rows, (200, None), (None, made[3])]], "doc_id long, text string")
    got = S.repeated_passages(df).collect()
    for x in S.repeated_spans(df, least_words=S.LEAST_WORDS).collect():
        assert any(g["doc_id"] == x["doc_id"] and g["start"] <= x["start"] and x["end"] <= g["end"] for g in got)
    assert S.repeated_passages(df.limit(0)).count() == 0


def test_every_run_that_stands_earlier_goes_and_no_other(spark):
    r = random.Random(3)
    base = [[word(r) for _ in range(150)] for _ in range(3)]
    rows = []
    for d in range(60):
        parts = []
        for _ in range(r.randint(1, 4)):
            b, at = r.choice(base), r.randint(0, 110)
            parts += b[at : at + r.randint(20, 120)] + [word(r) for _ in range(r.choice([0, 3, 30]))]
        rows.append((d, " ".join(parts)))
    rows.append((60, " ".join(base[0][:40] * 6)))
    first, gone, ends = {}, set(), {}
    for d, t in rows:
        w, at = t.split(" "), 0
        for k, x in enumerate(w):
            ends[d, at], at = k, at + len(x) + 1
        for k in range(len(w) - S.RUN + 1):
            kept = first.setdefault(tuple(w[k : k + S.RUN]), (d, k))
            if kept[0] != d or k >= kept[1] + S.RUN:
                gone |= {(d, i) for i in range(k, k + S.RUN)}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cover = lambda found: {(x["doc_id"], i) for x in found for k in [ends[x["doc_id"], x["start"]]] for i in range(k, k + x["words"])}
    got, units = cover(S.repeated_passages(df).collect()), cover(S.repeated_spans(df).collect())
    assert gone <= got <= gone | units and len(gone) > 3000


def test_rows_of_a_hot_id_and_rows_without_one(spark, monkeypatch):
    """A third of all rows share an id and a third have none: dealt over many tasks, the same spans go."""
    from nearway import skew

    made, passage = texts()
    rows = [(7, f"{passage} own {k % 5}") for k in range(60)] + [(None, made[k]) for k in range(60)] + [(100 + k, t) for k, t in enumerate(made)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found = []
    for few in (10_000, 8):
        monkeypatch.setattr(skew, "FEW", few)
        spans = sorted(map(tuple, S.repeated_passages(df).collect()))
        rest = sorted((x["doc_id"] or 0, x["text"], str(x["removed"])) for x in S.remove_repeats(df).collect())
        found.append((spans, rest))
    assert found[0] == found[1] and len(found[0][1]) == len(rows)
    assert sum(passage in t for d, t, _ in rest if d > 100) == 0 and sum(t in made for d, t, _ in rest if d == 0) == 60
