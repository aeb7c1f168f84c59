import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from nearway.llm import packing as P
from nearway.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_ids_are_those_of_tokenizers(tokenizer):
    enc, r = P.encoder(tokenizer_path()), random.Random(2)
    alpha = ["a", "B", "é", "1", "'s", "'", ".", " ", "  ", "\n", "\t", "\x1c", "\xa0", " ", ",", "!", "don't", "<|endoftext|>", "ß9", "۳", "日", "\U0001f600", "\x00"]
    for _ in range(4000):
        t = "".join(r.choice(alpha) for _ in range(r.randint(0, 12)))
        assert list(np.frombuffer(enc.encode(t), "<u4")) == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_bins_are_best_fit_and_bounded():
    r = random.Random(1)
    bins, free, made = P.Bins(32, 4), {}, 0
    for _ in range(3000):
        n = r.randint(1, 32)
        fits = [f for f in free.values() if f >= n]
        b, offset = bins.place(n)
        if fits:
            assert free[b] == min(fits) and offset == 32 - free[b]
            free[b] -= n
        else:
            assert b == made and offset == 0
            made += 1
            if len(free) == 4 and n < 32:
                closed = free.keys() - {x for v in bins.free for x in v}
                assert len(closed) == 1 and free[min(closed)] == min(free.values())
                del free[min(closed)]
            free[b] = 32 - n
        free = {k: f for k, f in free.items() if f}
        assert bins.open == len(free) <= 4


def check(rows, got, tokenizer, size):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for x in got:
        by_doc[x["doc_id"]].append(x)
        by_sequence[x["sequence_id"]].append(x)
    for d, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        mine = sorted(by_doc.pop(d), key=lambda x: x["piece"])
        assert [x["piece"] for x in mine] == list(range(-(-len(ids) // size)))
        assert [x["length"] for x in mine[1:]] == [size] * (len(mine) - 1) and sum(x["length"] for x in mine) == len(ids)
        for x in mine:
            part = ids[x["start"] : x["start"] + x["length"]]
            assert x["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
            if "ids" in x:
                assert list(x["ids"]) == part
    assert not by_doc
    for s in by_sequence.values():
        at = 0
        for x in sorted(s, key=lambda x: x["offset"]):
            assert x["offset"] == at
            at += x["length"]
        assert at <= size


def test_round_trip(spark, tokenizer):
    r = random.Random(3)
    rows = [(0, None), (1, ""), (2, "x y z " * 400), (3, "word " * 63), (4, "word " * 15000)] + [(5 + i, " ".join("".join(r.choice("abcde") for _ in range(5)) for _ in range(r.randint(1, 60)))) for i in range(200)]
    df = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, piece int")
    got = P.pack(df, tokenizer_path(), size=64, with_ids=True).collect()
    check(rows, [x.asDict() for x in got], tokenizer, 64)
    assert P.pack(df.limit(0), tokenizer_path()).count() == 0
    one = P.pack(df.coalesce(1), tokenizer_path(), size=64).collect()
    assert len({x["sequence_id"] for x in one}) <= 1.01 * sum(x["length"] for x in one) / 64 + 1
    twice = P.pack(df.where("doc_id = 3").union(df.where("doc_id = 3")), tokenizer_path(), end_id=None)
    assert twice.count() == 2


def test_columns_of_odd_names_and_arrival_order(spark):
    df = spark.createDataFrame([(i, "a b " * (i % 7), "x") for i in range(50)], "`doc-id` long, `the text` string, doc_id string")
    for batch_order in (True, False):
        got = P.pack(df, tokenizer_path(), size=16, id_col="doc-id", text_col="the text", batch_order=batch_order).collect()
        assert {x["doc_id"] for x in got} == set(range(50)) and all(x["offset"] + x["length"] <= 16 for x in got)
