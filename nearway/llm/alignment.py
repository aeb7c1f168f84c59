"""Alignment of two tokenizers' tokens of one text by a transducer over dangling suffixes.

Reading both sides' tokens, one side is ahead of the other by some bytes, the residual. The transducer's state is which
side leads and its residual; the next token of the other side is read against it. Transitions are memoised by state and
token; residuals are suffixes of tokens, so states are bounded by the vocabularies. An empty residual closes a group; bytes
that differ end the alignment. Every token read while a residual is open overlaps the last token of the side that leads,
so links are found as tokens are read.

How often a pair of ids is linked is counted in blocks of documents, which bounds memory and gives a pair no more than one
row for each block. A block's counts come back to its documents by the block's number; a document carries its pairs as
numbers within its block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearway.llm.common import Workspace
from nearway.llm.packing import encoder

#: Links of a block of documents, but for one document that has more; entries of a memo before it is begun anew.
BLOCK_LINKS, MEMO = 1 << 21, 1 << 20
#: Tokens of memoised groups before they are begun anew.
PATHS = 1 << 17
SPACE = "▁"


class Transducer:
    """Groups and links of two token sequences over the same bytes.

    A state is 0 with nothing over, odd if the first side leads, even if the second does, and -1 if bytes differ.
    """

    def __init__(self, first: list[bytes], second: list[bytes]):
        self.first, self.second, self.n = first, second, len(second)
        self.residuals: list[tuple[bool, bytes]] = []
        self.states: dict[tuple[bool, bytes], int] = {(True, b""): 0, (False, b""): 0}
        self.next: dict[tuple[int, int], int] = {}
        self.paths: dict[int, tuple | str | bool] = {}  # groups' tokens in the order in which they are read, from their first link on
        self.n_paths = 0

    def _state(self, first_leads: bool, residual: bytes) -> int:
        key = first_leads, residual
        if key not in self.states:
            self.states[key] = 2 * len(self.residuals) + (1 if first_leads else 2)
            self.residuals.append(key)
        return self.states[key]

    def step(self, state: int, token: int) -> int:
        """The state after the next token: of the side behind, or of the first with nothing over."""
        have = self.next.get((state, token))
        if have is not None:
            return have
        if len(self.next) >= MEMO:
            self.next.clear()
        if state == 0:
            to = self._state(True, self.first[token])
        else:
            leads, residual = self.residuals[(state - 1) // 2]
            read = self.second[token] if leads else self.first[token]
            if residual.startswith(read):
                to = self._state(leads, residual[len(read) :])
            elif read.startswith(residual):
                to = self._state(not leads, read[len(residual) :])
            else:
                to = -1
        self.next[state, token] = to
        return to

    def _path(self, state: int, a: str, b: str) -> tuple | str | bool:
        """What follows tokens: a group as it is written, False if bytes differ, else (first leads, what follows, state, a, b)."""
        return f"{a}|{b}" if state == 0 else state > 0 and (bool(state & 1), {}, state, a, b)

    def _kept(self, paths: dict, key: int, path: tuple | str | bool) -> tuple | str | bool:
        if self.n_paths >= min(PATHS, MEMO):
            self.paths.clear()
            self.n_paths = 0
        paths[key] = path
        self.n_paths += 1
        return path

    def run(self, a: list[int], b: list[int]) -> tuple[list[str], list[int]] | None:
        """Groups as `a1,a2|b1`, and links as a * (second side's ids) + b; None if the bytes differ."""
        groups, links, paths, n, n_a, n_b = [], [], self.paths, self.n, len(a), len(b)
        i = j = 0
        while i < n_a and j < n_b:
            x, y = a[i], b[j]
            link = x * n + y
            i, j = i + 1, j + 1
            links.append(link)
            path = paths.get(link)
            if path is None:
                path = self._kept(paths, link, self._path(self.step(self.step(0, x), y), str(x), str(y)))
            while path.__class__ is tuple:
                if path[0]:
                    if j == n_b:
                        return None
                    token = y = b[j]
                    j += 1
                else:
                    if i == n_a:
                        return None
                    token = x = a[i]
                    i += 1
                links.append(x * n + y)
                to = path[1].get(token)
                if to is None:
                    first, onward, state, a_ids, b_ids = path
                    ids = (a_ids, f"{b_ids},{token}") if first else (f"{a_ids},{token}", b_ids)
                    to = self._kept(onward, token, self._path(self.step(state, token), *ids))
                path = to
            if path is False:
                return None
            groups.append(path)
        return (groups, links) if i == n_a and j == n_b else None


class Tokenizers:
    """Ids of both tokenizers: a byte-level file over a space and the text, and a model of pieces over the text."""

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece

        self.bytes = encoder(byte_path)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        # special strings within texts are plain text to both
        first = dict.fromkeys(range(self.bytes.tokenizer.get_vocab_size()), b"")
        first |= {i: self.bytes.fast.decode_single_token_bytes(i) for i in range(self.bytes.fast.max_token_value + 1)}
        self.transducer = Transducer([first[i] for i in range(len(first))], [self._piece(i) for i in range(self.pieces.get_piece_size())])

    def _piece(self, i: int) -> bytes:
        piece = self.pieces.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if self.pieces.is_byte(i) else piece.replace(SPACE, " ").encode()

    def align(self, texts: list[str | None]) -> Iterator[tuple[list[int], list[int], list[str], list[int]] | None]:
        """For each text both sides' ids, groups and links; None where there is no text or either side has other bytes."""
        some = [t for t in texts if t]
        second = iter(self.pieces.encode(some, num_threads=1) if some else [])
        table = self.transducer.first
        for t in texts:
            if not t:
                yield None
                continue
            a, b = self.bytes.fast.encode_ordinary(" " + t), next(second)
            found = self.transducer.run(a, b) if b"".join([table[i] for i in a]) == (" " + t).encode() else None
            yield found and (a, b, *found)


_loaded: dict[tuple[str, str], Tokenizers] = {}


def tokenizers(byte_path: str, piece_path: str) -> Tokenizers:
    key = byte_path, piece_path
    if key not in _loaded:
        _loaded[key] = Tokenizers(*key)
    return _loaded[key]


def small_numbers(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in seven bits a byte, the last of each below 128, and where each begins and the last ends."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for k in range(1, 10):
        size += v >= np.uint64(1 << (7 * k))
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(at[-1], np.uint8)
    for k in range(int(size.max(initial=0))):
        there = size > k
        more = (size[there] > k + 1).astype(np.uint8) << 7
        out[at[:-1][there] + k] = (v[there] >> np.uint64(7 * k)).astype(np.uint8) & 127 | more
    return out, at


def from_small_numbers(data: np.ndarray) -> np.ndarray:
    """What small_numbers() has written."""
    last = np.flatnonzero(data < 128)
    if not len(last):
        return np.zeros(0, np.int64)
    first = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(len(data)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), first)


class Block:
    """Documents of a task until their links are enough: rows for them, and one for the block's pairs."""

    NAMES = ("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times", "keys", "counts")
    KINDS = (*[pa.int64()] * 6, pa.string(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
    SCHEMA = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary, keys array<long>, counts array<long>"

    def __init__(self):
        self.rows, self.links, self.n = [], [], 0

    def add(self, doc_id: int | None, found) -> None:
        if found is None:
            self.rows.append((doc_id, 0, 0, 0, 0, ""))
            self.links.append(np.zeros(0, np.int64))
            return
        a, b, groups, links = found
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        self.rows.append((doc_id, len(a), len(b), len(groups), len(links), digest))
        self.links.append(np.fromiter(links, np.int64, len(links)))
        self.n += len(links)

    def batch(self, number: int) -> pa.RecordBatch:
        """A document's pairs are places in the block's list, which begins with the commonest, as differences."""
        of = np.repeat(np.arange(len(self.rows)), [len(x) for x in self.links])
        keys, place, counts = np.unique(np.concatenate(self.links), return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(keys), np.int64)
        rank[order] = np.arange(len(keys))
        own, times = np.unique(of * max(len(keys), 1) + rank[place], return_counts=True)
        doc, pair = own // max(len(keys), 1), own % max(len(keys), 1)
        first = np.searchsorted(doc, np.arange(len(self.rows) + 1))
        gap = np.diff(pair, prepend=0)
        gap[first[:-1][first[:-1] < first[1:]]] = pair[first[:-1][first[:-1] < first[1:]]]
        cut = [[data[at[i] : at[j]].tobytes() for i, j in zip(first[:-1], first[1:], strict=True)] for data, at in (small_numbers(gap), small_numbers(times))]
        rows = [(number, *row, p, t, None, None) for row, p, t in zip(self.rows, *cut, strict=True)]
        rows.append((number, *[None] * 8, keys[order], counts[order]))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), self.KINDS, strict=True)], self.NAMES)


def _blocks(docs: DataFrame, byte_path: str, piece_path: str, id_col: str, text_col: str, work: Workspace) -> DataFrame:
    """A written table of Block's rows."""
    limit = BLOCK_LINKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, block, number = tokenizers(byte_path, piece_path), Block(), TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for k in range(0, len(ids), 64):
                for doc_id, found in zip(ids[k : k + 64], both.align(batch.column(1).slice(k, 64).to_pylist()), strict=True):
                    block.add(doc_id, found)
                    if block.n >= limit:
                        yield block.batch(number)
                        block, number = Block(), number + 1
        if block.rows:
            yield block.batch(number)

    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return work.write(texts.mapInArrow(run, Block.SCHEMA))


def _pairs(made: DataFrame) -> DataFrame:
    """block, place, key, n: the pairs of each block."""
    listed = made.where("keys is not null and size(keys) > 0")
    return listed.select("block", F.inline(F.arrays_zip(F.sequence(F.lit(0), F.size("keys") - 1).alias("place"), F.col("keys").alias("key"), F.col("counts").alias("n"))))


def _counted(made: DataFrame, piece_path: str, work: Workspace) -> DataFrame:
    """key, total, best: each pair's count, and whether no pair of its second id has a higher one."""
    n = _piece_count(piece_path)
    totals = work.write(_pairs(made).groupBy("key").agg(F.sum("n").alias("total")).withColumn("b", F.col("key") % n))
    top = totals.groupBy("b").agg(F.max("total").alias("top"))  # no more rows than the second vocabulary has ids
    return totals.join(F.broadcast(top), "b").select("key", "total", (F.col("total") == F.col("top")).alias("best"))


def _piece_count(piece_path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_path).get_piece_size()


def pair_counts(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """a_id, b_id, n, best: how often all documents link two ids; best if no other a_id has more links with that b_id."""
    work, n = Workspace(docs.sparkSession, "alignment"), _piece_count(piece_path)
    found = _counted(_blocks(docs, byte_path, piece_path, id_col, text_col, work), piece_path, work)
    return found.select(F.floor(F.col("key") / n).cast("int").alias("a_id"), (F.col("key") % n).cast("int").alias("b_id"), F.col("total").alias("n"), "best")


def groups(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, seq (from 0), start, end, a_ids, b_ids: each document's groups, whose bytes are start:end of a space and the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(byte_path, piece_path)
        table = both.transducer.first
        for batch in batches:
            for doc_id, found in zip(batch.column(0).to_pylist(), both.align(batch.column(1).to_pylist()), strict=True):
                if found is None:
                    continue
                sides = [[list(map(int, s.split(","))) for s in g.split("|")] for g in found[2]]
                ends = np.cumsum([sum(len(table[i]) for i in a) for a, _ in sides])
                n = len(sides)
                columns = [pa.array([doc_id] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(np.concatenate([[0], ends[:-1]])), pa.array(ends)]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array([s[k] for s in sides], pa.list_(pa.int32())) for k in (0, 1)]], ["doc_id", "seq", "start", "end", "a_ids", "b_ids"])

    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, seq int, start long, end long, a_ids array<int>, b_ids array<int>")


REPORT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def report(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: its tokens, groups and links, and what its links' pairs count among all documents.

    Null and empty texts, and texts whose tokens of either side don't give back a space and the text, have zeros and an
    empty digest. Repeated rows have a row each and count each; an empty table gives an empty result; other columns play no
    part. A sum of counts beyond a long is an error.
    """
    work = Workspace(docs.sparkSession, "alignment")
    made = _blocks(docs, byte_path, piece_path, id_col, text_col, work)
    scored = _pairs(made).select("block", "place", "key").join(_counted(made, piece_path, work), "key")
    scored = scored.select(F.col("block").alias("own_block"), "place", "total", "best")
    names = [f.split()[0] for f in REPORT.split(", ")]

    def look_up(docs: pa.Table, scores: pa.Table) -> pa.Table:
        place = scores["place"].to_numpy()
        total, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        total[place], best[place] = scores["total"].to_numpy(), scores["best"].to_numpy(zero_copy_only=False)
        sums, bests = [], []
        for pairs, times in zip(docs["pairs"], docs["times"], strict=True):
            at, n = np.cumsum(_numbers(pairs)), _numbers(times)
            if len(at) and float(total[at].max()) * float(n.sum()) >= 2**62:
                sums.append(sum(int(x) * int(y) for x, y in zip(total[at], n, strict=True)))
            else:
                sums.append(int((total[at] * n).sum()))
            bests.append(int((best[at] * n).sum()))
        added = {"n_best": pa.array(bests, pa.int64()), "count_sum": pa.array(sums, pa.int64())}
        return pa.table([added[c] if c in added else docs[c] for c in names], names)

    rows = made.where("keys is null").drop("keys", "counts")
    return rows.groupBy("block").cogroup(scored.groupBy("own_block")).applyInArrow(look_up, REPORT)


def _numbers(data: pa.Scalar) -> np.ndarray:
    return from_small_numbers(np.frombuffer(data.as_py(), np.uint8))
