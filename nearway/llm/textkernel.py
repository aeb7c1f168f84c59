"""Vectorised hashing of words over Arrow text buffers.

A word is a maximal run of bytes other than ASCII white space, with A-Z lower-cased. Words are hashed by prefix
sums of a polynomial modulo 2**64 and then mixed, so no Python object is made for any word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 2**64)
#: Bytes hashed at a time; longer texts are cut after white space, which never parts a word.
PIECE = 1 << 19
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        x = np.full(max(n, 1 << 16), U(base))
        x[0] = 1
        have = _powers[base] = np.multiply.accumulate(x)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64 bits."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts together and each text's offsets; a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and texts.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(texts) else data[:0], offsets - offsets[0]


def pieces(data: np.ndarray, offsets: np.ndarray, limit: int = 0) -> Iterator[tuple[int, int]]:
    """Cuts at text ends or after white space, each piece about limit bytes at most unless one word is longer."""
    limit, at, end = limit or PIECE, 0, len(data)
    while at < end:
        to = min(at + limit, end)
        if to < end:
            k = int(np.searchsorted(offsets, to, "right")) - 1
            if offsets[k] > at:
                to = int(offsets[k])
            else:
                stop = int(offsets[k + 1])
                while to < stop and not SPACE[data[to]]:
                    to += 1
        yield at, to
        at = to


@dataclass
class Words:
    """Hash, first byte and end of each word; first[i]:first[i+1] are the words of text i."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    hashes, starts, ends = [], [], []
    for at, to in pieces(data, offsets):
        part = data[at:to]
        solid = ~SPACE[part]
        edge = np.zeros(len(part) + 1, bool)  # a text begins here, or the piece ends
        inner = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, to, "right")]
        edge[inner - at] = True
        edge[0] = edge[-1] = True
        before = np.empty(len(part), bool)
        before[0] = True
        np.logical_not(solid[:-1], out=before[1:])
        s = np.flatnonzero(solid & (before | edge[:-1]))
        after = np.empty(len(part), bool)
        after[-1] = True
        np.logical_not(solid[1:], out=after[:-1])
        e = np.flatnonzero(solid & (after | edge[1:])) + 1
        total = np.zeros(len(part) + 1, U)
        np.cumsum((LOWER[part].astype(U) + U(1)) * powers(BASE, len(part)), out=total[1:])
        h = (total[e] - total[s]) * powers(BASE_INVERSE, len(part))[s]
        hashes.append(mix(h + (e - s).astype(U)))
        starts.append(s + at)
        ends.append(e + at)
    if not hashes:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, U), none, none, np.zeros(len(offsets), np.int64))
    start = np.concatenate(starts)
    return Words(np.concatenate(hashes), start, np.concatenate(ends), np.searchsorted(start, offsets))


#: Odd multipliers for the words of a shingle.
PLACES = [0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3]


def shingles(w: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every k words in a row, and first[i]:first[i+1] of each text; 1 to k-1 words make one shingle."""
    n = np.diff(w.first)
    made = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    first = np.concatenate([[0], np.cumsum(made)])
    text = np.repeat(np.arange(len(n)), made)
    at = np.arange(first[-1]) - first[text] + w.first[text]
    out = np.zeros(len(at), U)
    last = w.first[text + 1] if len(at) else at
    for j in range(k):
        there = at + j < last
        if there.all():
            out += mix(w.hash[at + j] * U(PLACES[j % 5]) + U(j))
        else:
            out[there] += mix(w.hash[at[there] + j] * U(PLACES[j % 5]) + U(j))
    return mix(out), first


def run_digests(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit digests of the word hashes start[i]:end[i] in order."""
    out = []
    for base, salt in ((0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9), (0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)):
        total = np.zeros(len(hashes) + 1, U)
        np.cumsum(mix(hashes + U(salt)) * powers(base, len(hashes)), out=total[1:])
        h = (total[end] - total[start]) * powers(pow(base, -1, 2**64), len(hashes) + 1)[start]
        out.append(mix(h + (end - start).astype(U)))
    return out[0], out[1]


def occurrences(keys: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's distinct keys, sorted, their counts, and first[i]:first[i+1] of each text."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((keys, text))
    k, t = keys[order], text[order]
    new = np.ones(len(k), bool)
    if len(k):
        new[1:] = (k[1:] != k[:-1]) | (t[1:] != t[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(k)))
    return k[at], counts, np.searchsorted(t[at], np.arange(len(first)))


def slices(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about limit bytes at most, or one longer text."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1, at + 1)
        yield at, to
        at = to


def counted(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of each text's bytes (or words) the mask has."""
    out, full = np.zeros(len(offsets) - 1, np.int64), np.diff(offsets) > 0
    if full.any():
        out[full] = np.add.reduceat(mask, offsets[:-1][full], dtype=np.int64)
    return out
