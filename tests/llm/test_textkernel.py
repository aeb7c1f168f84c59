import random
import re

import numpy as np
import pyarrow as pa
import pytest

from nearway.llm import textkernel as K

WORD = re.compile(r"[^\x09-\x0d\x20]+")
TEXTS = ["", None, " ", "one", "One  two\tthree\nfour five SIX", "a b c d e", "a b c d e f a b c d e f", "é É\x85x ü", "x" * 5000 + " y", "\n\n", "w " * 300]


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


@pytest.mark.parametrize("piece", [7, 64, 1 << 20])
def test_words_and_shingles(monkeypatch, piece):
    monkeypatch.setattr(K, "PIECE", piece)
    r = random.Random(piece)
    texts = TEXTS + ["".join(r.choice("abA \n") for _ in range(r.randint(0, 60))) for _ in range(200)]
    data, offsets = K.buffers(pa.array(texts))
    w = K.words(data, offsets)
    seen = {}
    for i, t in enumerate(texts):
        found = WORD.findall(t or "")
        assert w.first[i + 1] - w.first[i] == len(found)
        for x, h in zip(found, w.hash[w.first[i] : w.first[i + 1]].tolist(), strict=True):
            assert seen.setdefault(low(x), h) == h
    assert len(set(seen.values())) == len(seen)
    s, first = K.shingles(w, 5)
    seen = {}
    for i, t in enumerate(texts):
        f = [low(x) for x in WORD.findall(t or "")]
        own = [tuple(f[j : j + 5]) for j in range(max(len(f) - 4, 1))] if f else []
        assert first[i + 1] - first[i] == len(own)
        for x, h in zip(own, s[first[i] : first[i + 1]].tolist(), strict=True):
            assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)
    keys, counts, own = K.occurrences(s, first)
    for i in range(len(texts)):
        values, n = np.unique(s[first[i] : first[i + 1]], return_counts=True)
        assert list(keys[own[i] : own[i + 1]]) == list(values) and list(counts[own[i] : own[i + 1]]) == list(n)


def test_empty_array():
    data, offsets = K.buffers(pa.array([], pa.string()))
    assert len(K.words(data, offsets).hash) == 0 and list(K.slices(offsets)) == []


def test_counted_and_slices():
    data, offsets = K.buffers(pa.array(["ab", "", "b", None, "abb"]))
    assert list(K.counted(data == ord("b"), offsets)) == [1, 0, 1, 0, 2]
    assert list(K.slices(offsets, 2)) == [(0, 2), (2, 4), (4, 5)]
