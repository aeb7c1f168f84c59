import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from nearway.llm import language as L
from nearway.llm.textkernel import buffers

SYLLABLES = {"aa": ["the", "ing", "tion", "sh"], "bb": ["une", "eau", "é", "oir"], "cc": ["sch", "ü", "ung", "ein"]}


def text(r, lang, n):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


def test_held_out_accuracy_and_edges(spark):
    r = random.Random(1)
    rows = [(i, text(r, lang := r.choice(sorted(SYLLABLES)), r.randint(2, 80)), lang) for i in range(500)]
    odd = [(900, None, "aa"), (901, "", "aa"), (902, "123 .. !", "bb"), (903, text(r, "cc", 30_000), None), (904, text(r, "bb", 5), None)]
    df = spark.createDataFrame([(*x, 0.5, "q") for x in rows + odd], "doc_id long, text string, lang string, score double, lang_pred string")
    got = {x["doc_id"]: x for x in L.identify(df).collect()}
    assert len(got) == len(rows) + len(odd)
    assert all(x["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= x["score"] <= 1 for i, x in got.items())
    held = [i for i, x in got.items() if x["held_out"] and i < 900]
    assert np.mean([got[i]["lang_pred"] == rows[i][2] for i in held]) >= 0.98
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903, 904)] == ["und", "und", "und", "cc", "bb"] and got[902]["score"] == 0
    # neither the id, the source nor the own label is an input
    other = {x["doc_id"]: x["lang_pred"] for x in L.identify(df.withColumn("lang", df.lang)).collect()}
    assert other == {i: x["lang_pred"] for i, x in got.items()}


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [tuple(x)[2:] for x in L.identify(df).collect()] == [("und", 0.0)]
    assert L.identify(df.limit(0)).count() == 0


def test_parts_of_a_long_text_count_alike():
    r = random.Random(2)
    m = L.train([text(r, lang, 40).encode() for lang in SYLLABLES for _ in range(30)], [lang for lang in SYLLABLES for _ in range(30)], rounds=3)
    texts = ["", "x", text(r, "aa", 3), text(r, "bb", 900), text(r, "cc", 50)]
    data, offsets = buffers(pa.array(texts))
    tables = m.pair_tables()
    one = L.predict(m, tables, data, offsets)
    assert one.sum(1) == pytest.approx(1)
    assert L.predict(m, tables, data, offsets, at_once=3).argmax(1)[2:].tolist() == one.argmax(1)[2:].tolist() == [0, 1, 2]
    windows, of = L.windows(data, offsets)
    assert windows.shape[1] == L.WINDOW and [int((of == i).sum()) for i in range(5)] == [max(1, -(-len(t.encode()) // L.WINDOW)) for t in texts]


def naive(m, text):
    """Mean window log-probabilities by a convolution written out byte by byte."""
    b = text.encode()
    starts = [min(k * L.WINDOW, max(len(b) - L.WINDOW, 0)) for k in range(max(-(-len(b) // L.WINDOW), 1))]
    out = []
    for s in starts:
        x = list(b[s : s + L.WINDOW]) + [0] * (L.WINDOW - len(b[s : s + L.WINDOW]))
        pooled = [max(sum(t[j][x[p + j]][f] for j in range(w)) for p in range(L.WINDOW - w + 1)) for w, t in zip(L.WIDTHS, m.tables) for f in range(L.FILTERS)]
        z = np.maximum(np.array(pooled) + m.bias, 0) @ m.weights + m.offset
        out.append(z - np.log(np.exp(z - z.max()).sum()) - z.max())
    p = np.exp(np.mean(out, 0))
    return p / p.sum()


def test_tables_of_pairs_give_a_plain_convolution():
    r = random.Random(3)
    m = L.train([text(r, lang, 40).encode() for lang in SYLLABLES for _ in range(20)], [lang for lang in SYLLABLES for _ in range(20)], rounds=2)
    texts = ["x", text(r, "aa", 9), text(r, "bb", 60), "é\x00日"]
    got = L.predict(m, m.pair_tables(), *buffers(pa.array(texts)))
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(naive(m, t), abs=1e-4)


def test_many_languages_and_one_row_repeated(spark):
    rows = [(i, f"word{i % 700} text", f"l{i % 700}") for i in range(1400)] + [(5000, "the same row again", "hot")] * 900
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = L.training_rows(df, df.doc_id >= 0, "doc_id", "text", "lang", texts=10)
    assert {lang for _, lang, _ in sample} >= {f"l{k}" for k in range(700)} and sum(lang == "hot" for _, lang, _ in sample) <= 20
    assert sample == L.training_rows(df.repartition(7), df.doc_id >= 0, "doc_id", "text", "lang", texts=10)
