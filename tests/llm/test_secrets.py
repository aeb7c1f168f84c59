import hashlib
import math
import random
import re

from pyspark.sql import functions as F

from nearway.llm import secrets as S

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(t):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(found)


def added(t):
    """Windows of high entropy in what lies outside base spans and outside parts of paths with an allowed word."""
    out, shown = [], list(t)
    for a, _, b in base(t):
        shown[a:b] = [S.HIDDEN] * (b - a)
    shown = "".join(shown)
    shown = re.sub("[A-Za-z0-9+_=-]+", lambda m: " " * len(m[0]) if any(w in m[0].lower() for w in S.ALLOWED_WORDS) else m[0], shown)
    for m in re.finditer(S.CANDIDATE, shown):
        c = m[0]
        if any(re.search(p, c) for p in S.ALLOWED):
            continue
        bits = next(b for p, b in S.CLASSES if re.search(p, c))
        entropy = lambda w: -sum(w.count(x) / len(w) * math.log2(w.count(x) / len(w)) for x in set(w))
        hits = [i for i in range(len(c) - S.WINDOW + 1) if entropy(c[i : i + S.WINDOW]) >= bits - 1e-9]
        if hits:
            out.append((m.start() + hits[0], 3, m.start() + hits[-1] + S.WINDOW))
    return out


def told(spans):
    return ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def texts():
    r = random.Random(4)
    fixed = [
        None, "", "token=abc", "secret=token: abcdefgh", "secret=token=abcdefgh", "PassWord : 'hunter22'", "api_key=\"Ab12.cd=\" apikey:abcdef", "AKIA" + "A1" * 8, "AKIAAKIA" + "Z" * 13, "AKIA" + "A" * 15,
        "f" * 24, "0" * 23 + "g", "ünïcödé token=abcdef1 日本 " + "deadbeef" * 4, "id 123e4567-e89b-12d3-a456-426614174000", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa1", "thththhandthwhaninthesly", "example_Xk29fLq0Zt7Bv4Nw8Rp3",
        "key Xk29fLq0Zt7Bv4Nw8Rp3cY6h end", "Q7RT2ZK9WX4LP0BN8MVC5", "\n token=" + "x" * 9 + "\ntoken=" + "y" * 9, "x" * 30000 + "9", "token=abcdef " * 300,
    ]
    alpha = ["token", "=", ":", " ", "'", "AKIA", "AB12" * 4, "deadbeef" * 3, "secret", "api_key", "zZ9+/", "Xk29fLq0Zt7Bv4Nw8Rp3", "é", "-", "_", "abcdef", "SECRET"]
    return fixed + ["".join(r.choice(alpha) for _ in range(r.randint(1, 14))) for _ in range(300)]


def test_matches_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, spans string, base_spans int")
    got = {x["doc_id"]: x for x in S.report(df).collect()}
    for i, t in rows:
        b = base(t or "")
        x = got[i]
        assert [x["n_assign"], x["n_access"], x["n_hex"]] == [sum(k == j for _, k, _ in b) for j in range(3)], t
        assert x["base_sha256"] == hashlib.sha256(told(b).encode()).hexdigest(), t
        assert x["spans"] == told(b + added(t or "")), t


def test_redact(spark):
    rows = [(i, t, len(t or "")) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    out = S.redact(df)
    assert out.schema == df.schema
    got = {x["doc_id"]: (x["text"], x["n_chars"]) for x in out.collect()}
    for i, t, n in rows:
        spans, made, at = sorted(base(t or "") + added(t or "")), "", 0
        for a, _, b in spans:
            if a > at or not made:
                made += t[at:a] + "[SECRET]"
            at = max(at, b)
        assert got[i] == ((made + t[at:], len(made + t[at:])) if spans else (t, n)), t


def test_plan_has_no_python(spark, capsys):
    S.report(spark.createDataFrame([(1, "a")], "doc_id long, text string").where(F.col("doc_id") > 0)).explain()
    plan = capsys.readouterr().out
    assert not re.search("Python|Pandas|Arrow", plan) and "Exchange" not in plan


def test_empty(spark):
    assert S.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_candidates_and_many_matches(spark):
    r = random.Random(2)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    dull, run = "a1" * 6_000, "".join(r.choice(letters) for _ in range(9_000))
    texts = [f"x {run} y", f"{dull}{run[:30]}{dull}", f"{dull}-{run[:4100]}", run[:5000] + " token=" + run[:30] + "/" + run[:40], f"AKIA{'B2' * 8}/{run[:40]}", f"com/example/{run[:24]}", "token=abc%03d/x " * 3_000 % tuple(range(3_000))]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {x["doc_id"]: x for x in S.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        assert got[i]["spans"] == told(base(t) + added(t)), i
    # far longer ones take no longer in proportion
    long = "".join(r.choice(letters) for _ in range(300_000))
    rows = [(0, f"( {long} )"), (1, "secret=abcdef " * 40_000)]
    got = {x["doc_id"]: x for x in S.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0]["spans"] == "entropy:2:300002" and got[1]["n_assign"] == 40_000
    made = {x["doc_id"]: x["text"] for x in S.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert made == {0: "( [SECRET] )", 1: "[SECRET] " * 40_000}


def test_redacts_texts_that_hold_the_sign_for_hidden_characters(spark):
    t = f"a{S.HIDDEN}b token=abcdefg {S.HIDDEN}{S.HIDDEN} {'f' * 30}{S.HIDDEN}"
    out = S.redact(spark.createDataFrame([(1, t)], "doc_id long, text string")).collect()
    assert out[0]["text"] == f"a{S.HIDDEN}b [SECRET] {S.HIDDEN}{S.HIDDEN} [SECRET]{S.HIDDEN}"
