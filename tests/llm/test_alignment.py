import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from nearway.llm import alignment as A

BYTES, PIECES = str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def plain():
    """Both sides' ids and bytes of a text by the tokenizers' own libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    t, s = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    t.encode_special_tokens = True
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in seen)}

    def both(text):
        a, b = t.encode(" " + text, add_special_tokens=False).ids, s.encode(text)
        first = [bytes(back[c] for c in t.id_to_token(i)) for i in a]
        second = [bytes([int(s.id_to_piece(i)[3:5], 16)]) if s.is_byte(i) else s.id_to_piece(i).replace("▁", " ").encode() for i in b]
        return a, b, first, second

    return both


def brute(rows, plain):
    """By byte offsets, and all pairs of tokens."""
    out, links, count = [], [], Counter()
    for d, text in rows:
        a, b, first, second = plain(text or "")
        if not text or b"".join(first) != (" " + text).encode() or b"".join(second) != (" " + text).encode():
            out.append([d, 0, 0, 0, 0, ""])
            links.append([])
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in first]).tolist(), np.cumsum([len(x) for x in second]).tolist()
        spans = [list(zip([0, *e[:-1]], e)) for e in (ends_a, ends_b)]
        cuts = sorted(set(ends_a) & set(ends_b))
        groups, at = [], [0, 0]
        for c in cuts:
            ends = [ends_a.index(c) + 1, ends_b.index(c) + 1]
            groups.append(",".join(map(str, a[at[0] : ends[0]])) + "|" + ",".join(map(str, b[at[1] : ends[1]])))
            at = ends
        mine = [(a[i], b[j]) for i, (s, e) in enumerate(spans[0]) for j, (u, v) in enumerate(spans[1]) if s < v and u < e]
        count.update(mine)
        links.append(mine)
        out.append([d, len(a), len(b), len(groups), len(mine), hashlib.sha256(";".join(groups).encode()).hexdigest()])
    top = defaultdict(int)
    for (x, y), n in count.items():
        top[y] = max(top[y], n)
    return [(d, na, nb, ng, nl, sum(count[x] == top[x[1]] for x in own), sum(count[x] for x in own), sha) for (d, na, nb, ng, nl, sha), own in zip(out, links)], count, top


ODD = ["a", "é", "'s", " ", "  ", "\n", "\t", "\r\n", "\x00", ",", "1234", "don't", "<|endoftext|>", "<s>", "<0x41>", "ß", "日本", "\U0001f600", "▁", "ﬁ", "\xa0", "the ", "Wort ", "tokenization"]


def test_small_numbers_round_trip():
    r = np.random.default_rng(1)
    for n in (0, 1, 5000):
        v = r.integers(0, 2 ** r.integers(1, 62, n).astype(np.int64))
        data, at = A.small_numbers(v)
        assert (A.from_small_numbers(data) == v).all() and len(at) == n + 1 and at[-1] == len(data)
        assert all((A.from_small_numbers(data[at[i] : at[i + 1]]) == v[i : i + 1]).all() for i in range(min(n, 50)))


def test_transducer_on_any_cuts(monkeypatch):
    """Random vocabularies over two letters: groups and links as by offsets, with a memo that is begun anew as well."""
    r = random.Random(4)
    vocabulary = [bytes(r.choice(b"ab") for _ in range(k)) for k in (1, 1, 2, 3, 4, 6) for _ in range(6)]
    for memo in (1 << 20, 3):
        monkeypatch.setattr(A, "MEMO", memo)
        t = A.Transducer(vocabulary, vocabulary)
        for _ in range(1500):
            text = bytes(r.choice(b"ab") for _ in range(r.randint(1, 25)))

            def cut(text=text):
                ids, at = [], 0
                while at < len(text):
                    fits = [i for i, v in enumerate(vocabulary) if text.startswith(v, at)]
                    if not fits:
                        return None
                    ids.append(r.choice(fits))
                    at += len(vocabulary[ids[-1]])
                return ids

            a, b = cut(), cut()
            if a is None or b is None:
                continue
            ends = [np.cumsum([len(vocabulary[i]) for i in x]).tolist() for x in (a, b)]
            groups, links = t.run(a, b)
            assert len(groups) == len(set(ends[0]) & set(ends[1]))
            spans = [list(zip([0, *e[:-1]], e)) for e in ends]
            want = sorted(a[i] * len(vocabulary) + b[j] for i, (s, e) in enumerate(spans[0]) for j, (u, v) in enumerate(spans[1]) if s < v and u < e)
            assert sorted(links) == want
            assert t.run(a, b[:-1]) is None or not b[:-1] and not a
            other = [i for i, v in enumerate(vocabulary) if v[0] != text[0]]
            assert t.run(a, [r.choice(other), *b]) is None


@pytest.mark.parametrize("links", [1 << 21, 40])
def test_report_matches_brute_force(spark, plain, monkeypatch, links):
    monkeypatch.setattr(A, "BLOCK_LINKS", links)
    r = random.Random(5)
    rows = [(0, None), (1, ""), (2, " "), (3, "word " * 300), (4, "▁"), (5, "x" * 3000), (6, "word " * 300), (6, "again an id"), (None, "no id")]
    rows += [(10 + i, "".join(r.choice(ODD) for _ in range(r.randint(1, 40)))) for i in range(150)]
    rows += [(500, "a hot text, repeated")] * 80
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_a int, pairs string").repartition(5)
    want, count, top = brute(rows, plain)
    got = A.report(df, BYTES, PIECES)
    key = lambda x: (x[0] is None, *[v if v is not None else 0 for v in x])
    assert sorted((tuple(x) for x in got.collect()), key=key) == sorted(want, key=key)
    pairs = A.pair_counts(df, BYTES, PIECES).collect()
    assert {(x["a_id"], x["b_id"]): x["n"] for x in pairs} == count and all(x["best"] == (x["n"] == top[x["b_id"]]) for x in pairs)


def test_groups_and_odd_tables(spark, plain):
    df = spark.createDataFrame([(1, "tokenization of naïve texts"), (2, None), (3, "▁")], "`the id` long, `the text` string")
    got = A.groups(df, BYTES, PIECES, "the id", "the text").orderBy("seq").collect()
    a, b, first, _ = plain("tokenization of naïve texts")
    assert [i for x in got for i in x["a_ids"]] == a and [i for x in got for i in x["b_ids"]] == b
    assert [x["start"] for x in got] == [0, *[x["end"] for x in got[:-1]]] and got[-1]["end"] == len(b"".join(first))
    assert A.report(df.limit(0), BYTES, PIECES, "the id", "the text").count() == 0
    zero = A.report(df.where("`the id` > 1"), BYTES, PIECES, "the id", "the text").collect()
    assert len(zero) == 2 and all(x["n_links"] == x["count_sum"] == 0 and x["groups_sha256"] == "" for x in zero)


def test_very_long_texts(spark):
    text = "A sentence of some words, and another. " * 20_000
    df = spark.createDataFrame([(1, text), (2, "x" * 300_000)], "doc_id long, text string")
    one = {x["doc_id"]: x for x in A.report(df, BYTES, PIECES).collect()}
    assert one[1]["n_links"] == one[1]["n_a"] + one[1]["n_b"] - one[1]["n_groups"] > 150_000
    assert one[2]["n_links"] > 0 and df.where(F.length("text") == 300_000).count() == 1


def test_groups_seen_before_take_no_step(monkeypatch):
    t = A.Transducer([b"ab", b"c", b"abc"], [b"a", b"bc", b"abc", b"ab", b"c"])
    first = t.run([0, 1, 2], [0, 1, 3, 4])
    assert first == (["0,1|0,1", "2|3,4"], [0, 1, 6, 13, 14])
    monkeypatch.setattr(t, "step", None)
    assert t.run([2, 0, 1], [3, 4, 0, 1]) == (["2|3,4", "0,1|0,1"], [13, 14, 0, 1, 6])
