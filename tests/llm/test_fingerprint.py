import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from nearway.llm import fingerprint as P


def slow_fingerprint(text):
    """The same by a byte at a time."""
    data, bits = text.encode(), 2
    while len(data) > 128 * 2**bits:
        bits += 1

    def signature(b):
        h, out, chunk = 0, "", b""
        for byte in data:
            h = (h << 8 | byte) % 2**64
            chunk += bytes([byte])
            cut = (h * 0x9E3779B97F4A7C15) % 2**64 >> (64 - b) == 2**b - 1
            if len(chunk) == 4 * 2**b or cut and len(chunk) >= 2**b // 4:
                out, chunk = out + P.PAIRS[zlib.crc32(chunk) >> 20], b""
        return out + (P.PAIRS[zlib.crc32(chunk) >> 20] if chunk else "")

    return f"{2**bits}:{signature(bits)}:{signature(bits + 1)}"


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(left[j] + 1, row[j - 1] + 1, left[j - 1] + (x != y)))
    return row[-1]


def words(r, n):
    return " ".join("".join(r.choice("abcdefghijklmnopqrst") for _ in range(r.randint(1, 9))) for _ in range(n))


def test_fingerprint_is_that_of_a_byte_at_a_time(monkeypatch):
    r = random.Random(1)
    texts = ["", "a", "é" * 3000, "ab" * 5000, "x" * 20_000, "a" + "\x00" * 50, "\U0001f600 " * 700]
    texts += [words(r, r.randint(1, 900)) for _ in range(40)]
    made = [P.fingerprint(t.encode()) for t in texts]
    assert made == [slow_fingerprint(t) for t in texts]
    monkeypatch.setattr(P, "PIECE", 37)  # pieces of long texts
    assert [P.fingerprint(t.encode()) for t in texts] == made
    assert max(len(m) for m in made) < 2 * 2 * 4 * 128


def test_edit_distance_matches_the_table():
    r = random.Random(2)
    for _ in range(1500):
        a, b = ([r.randint(0, r.choice((1, 5, 60))) for _ in range(r.randint(0, 90))] for _ in range(2))
        assert P.edit_distance(a, b) == slow_distance(a, b)


def test_likeness_follows_what_texts_share():
    r = random.Random(3)
    for n in (60, 400, 3_000, 30_000):
        a, b = words(r, n), words(r, n)
        mark = lambda t: P.fingerprint(t.encode())
        alike = lambda x, y: P.likeness(mark(x), mark(y))  # noqa: B023, E731
        assert alike(a, a) == 1 and alike(a, b) < 0.15
        assert 0.55 < alike(a, P.edited(a, b)) < 0.75
        assert alike(a, a[: len(a) // 2] + "!" + a[len(a) // 2 :]) > 0.9
        assert alike(a, words(r, n // 10) + " " + a) > 0.75  # all places have moved
        assert alike(a, a[: int(len(a) * 0.6)]) > 0.4  # another block size
    assert P.likeness(mark(words(r, 10)), mark(words(r, 5_000))) == 0 and P.likeness(None, "4::") is None


def brute(rows):
    rows = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0)))
    out = []
    for i, (d, t) in enumerate(rows):
        t, n = t or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(t) // 3
        e = t[: len(t) - k] + n[:k]
        own, mark = slow_fingerprint(t), slow_fingerprint(e)
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), own, mark, P.likeness(own, mark), P.likeness(own, slow_fingerprint(n))))
    return out


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_query_matches_brute_force(spark, parts):
    r = random.Random(parts)
    rows = [(i * 7 % 61, words(r, r.randint(1, 120))) for i in range(61)]
    rows += [(100, None), (101, ""), (102, "é\U0001f600" * 500), (103, words(r, 9000)), (104, rows[3][1]), (105, rows[3][1]), (None, "without an id")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, task string, n_chars int").repartition(parts)
    got = P.compare_edited(df)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute(rows)))
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, "only one text " * 9)], "`the id` long, `the text` string")
    (one,) = P.compare_edited(df, "the id", "the text").collect()
    assert one["near_next"] == 1 and one["n_chars"] == 126
    assert P.compare_edited(df.limit(0), "the id", "the text").count() == 0
    marked = P.with_fingerprints(df.withColumn("fingerprint", F.lit(1)), "the text").collect()
    assert marked[0]["fingerprint"] == one["fingerprint"] == slow_fingerprint("only one text " * 9)
    # a third of all rows have one id and one text
    hot = spark.createDataFrame([(5, "hot text, as long as that") for _ in range(300)] + [(10 + i, f"text {i} " * 5) for i in range(600)], "doc_id long, text string").repartition(8)
    got = P.compare_edited(hot)
    assert got.count() == 900 and got.where("doc_id = 5").select("fingerprint").distinct().count() == 1
    assert got.where("doc_id = 5 and near_next = 1").count() == 299
    like = got.select(P.likeness_of(F.col("fingerprint"), F.col("edited_fingerprint")).alias("a"), "near_edited").where("a <> near_edited").count()
    assert like == 0
