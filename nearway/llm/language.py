"""Language identification by a small byte convolutional network, trained and applied in numpy.

One-hot bytes are convolved with filters of several widths, filters are rectified and max-pooled over a window of fixed
length, and a softmax gives the language. A convolution over one-hot bytes is a sum of table rows, so applying it is a
few look-ups for each byte (two neighbouring bytes at a time). A text's windows cover it from end to end; their mean
log-probabilities decide, so a long text scores high only if its windows do.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearway.llm.common import crc_mod, wrapped
from nearway.llm.textkernel import buffers

#: Bytes of a window, filter widths, filters of each width.
WINDOW, WIDTHS, FILTERS = 128, (2, 3, 4), 16
#: Labelled texts of each language, at most about, that training sees, and windows from each.
TRAIN_TEXTS, TRAIN_WINDOWS = 600, 4
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    tables: list[np.ndarray]  # for each width: width x 256 x filters
    bias: np.ndarray  # of all filters
    weights: np.ndarray  # filters x languages
    offset: np.ndarray

    def pair_tables(self) -> list[tuple[int, np.ndarray, bool]]:
        """Look-ups by width: (place, table, whether it takes two bytes)."""
        out = []
        for w, t in zip(WIDTHS, self.tables, strict=True):
            own = [(j, (t[j][:, None, :] + t[j + 1][None]).reshape(65536, -1).astype(np.float32), True) for j in range(0, w - 1, 2)]
            out.append(own + ([(w - 1, t[w - 1].astype(np.float32), False)] if w % 2 else []))
        return out


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts (rows of WINDOW bytes, filled up with zeros) and each one's text.

    A text's last window is moved back to be full; neighbours overlap by nothing else.
    """
    n = np.diff(offsets)
    count = np.maximum(-(-n // WINDOW), 1)
    text = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[:-1][text] + np.minimum(k * WINDOW, np.maximum(n[text] - WINDOW, 0))
    at = start[:, None] + np.arange(WINDOW)
    padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
    short = np.flatnonzero(n[text] < WINDOW)
    out = padded[np.minimum(at, len(padded) - 1)]
    if len(short):
        out[short] *= np.arange(WINDOW) < n[text[short]][:, None]
    return out, text


def _pooled(x: np.ndarray, tables, with_place: bool = False):
    """Max over each window of every filter's sum of look-ups; with_place: also where it is."""
    pairs = x[:, :-1].astype(np.int32) << 8 | x[:, 1:]
    out, places = [], []
    for w, lookups in zip(WIDTHS, tables, strict=True):
        span = WINDOW - w + 1
        total = None
        for j, t, two in lookups:
            part = np.take(t, pairs[:, j : j + span] if two else x[:, j : j + span], axis=0)
            total = part if total is None else np.add(total, part, out=total)
        if with_place:
            p = total.argmax(1)
            places.append(p)
            out.append(np.take_along_axis(total, p[:, None, :], 1)[:, 0])
        else:
            out.append(total.max(1))
    return (np.concatenate(out, 1), places) if with_place else np.concatenate(out, 1)


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def train(texts: list[bytes], labels: list[str], rounds: int = 6, batch: int = 64, seed: int = 11) -> Model:
    """A model of the labels' languages; the same texts in the same order give the same model."""
    rng, languages = np.random.default_rng(seed), sorted(set(labels))
    x, y = [], []
    for text, label in zip(texts, labels, strict=True):
        b = np.frombuffer(text, np.uint8)
        for k in range(TRAIN_WINDOWS):
            # whole windows from anywhere in the text, and shorter ones, so that short texts are known too
            n = WINDOW if k % 2 == 0 else int(rng.integers(4, WINDOW + 1))
            at = int(rng.integers(0, max(len(b) - n, 0) + 1))
            row = np.zeros(WINDOW, np.uint8)
            part = b[at : at + n]
            row[: len(part)] = part
            x.append(row)
            y.append(languages.index(label))
    x, y = np.array(x, np.uint8).reshape(-1, WINDOW), np.array(y)
    share = np.bincount(y, minlength=len(languages))
    m = Model(languages, [rng.normal(0, 0.1, (w, 256, FILTERS)) for w in WIDTHS], np.zeros(FILTERS * len(WIDTHS)), rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))), np.zeros(len(languages)))
    params = [*m.tables, m.bias, m.weights, m.offset]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for turn in range(rounds):
        order = rng.permutation(len(x))
        for i in range(0, len(x), batch):
            rows = order[i : i + batch]
            xb, yb = x[rows], y[rows]
            tables = [[(j, t[j], False) for j in range(w)] for w, t in zip(WIDTHS, m.tables, strict=True)]
            raw, places = _pooled(xb, tables, True)
            hidden = np.maximum(raw + m.bias, 0)
            p = np.exp(_log_softmax(hidden @ m.weights + m.offset))
            p[np.arange(len(rows)), yb] -= 1
            p *= (share.mean() / share[yb])[:, None] / len(rows)  # languages count alike
            back = (p @ m.weights.T) * (hidden > 0)
            grads = []
            for k, (w, place) in enumerate(zip(WIDTHS, places, strict=True)):
                g = np.zeros_like(m.tables[k])
                own = back[:, k * FILTERS : (k + 1) * FILTERS]
                for j in range(w):
                    np.add.at(g[j], (np.take_along_axis(xb, place + j, 1), np.arange(FILTERS)[None]), own)
                grads.append(g)
            grads += [back.sum(0), hidden.T @ p, p.sum(0)]
            step += 1
            rate = 0.01 * (0.5 ** (turn // 2))
            for q, g, a, b in zip(params, grads, first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                q -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return m


def predict(m: Model, tables, data: np.ndarray, offsets: np.ndarray, at_once: int = 512) -> np.ndarray:
    """Probability of each language for each text."""
    total, count = np.zeros((len(offsets) - 1, len(m.languages))), np.zeros(len(offsets) - 1)
    k, n = 0, len(offsets) - 1
    while k < n:
        # so many texts that their windows stay small; a long text goes in parts
        end = max(int(np.searchsorted(offsets, offsets[k] + WINDOW * at_once * 4, "right")) - 1, k + 1)
        for a in range(int(offsets[k]), max(int(offsets[end]), int(offsets[k]) + 1), WINDOW * at_once * 4) if end == k + 1 else [int(offsets[k])]:
            b = min(int(offsets[end]), a + WINDOW * at_once * 4) if end == k + 1 else int(offsets[end])
            cuts = np.clip(offsets[k : end + 1], a, b) - a
            x, text = windows(data[a:b], cuts)
            count[k:end] += np.bincount(text, minlength=end - k)
            for i in range(0, len(x), at_once):
                hidden = np.maximum(_pooled(x[i : i + at_once], tables) + m.bias, 0)
                np.add.at(total, k + text[i : i + at_once], _log_softmax(hidden @ m.weights + m.offset))
        k = end
    return np.exp(_log_softmax(total / np.maximum(count, 1)[:, None]))


def training_rows(docs: DataFrame, usable, id_col: str, text_col: str, lang_col: str, texts: int = TRAIN_TEXTS) -> list:
    """At most 2 * `texts` rows of each language that occurs, about `texts`, picked by a hash, in the order of the ids.

    However many languages there are, all are learned. Rows of one hash beyond the bound, such as one row that is
    repeated, are cut in the order of another hash, so the same rows give the same sample.
    """
    key = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))
    labelled = docs.where(usable & F.col(text_col).isNotNull() & (F.col(text_col) != "") & F.col(lang_col).isNotNull())
    counts = labelled.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n"))
    # a training window comes from these bytes; the bound keeps the sample small on the driver
    part = F.substring(F.col(text_col), (1 + F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(1)), F.greatest(F.length(text_col) - 2000, F.lit(1)))).cast("int"), F.lit(2000))
    rows = labelled.select(F.col(id_col).cast("string").alias("id"), part.alias("text"), F.col(lang_col).alias("lang"), F.pmod(key, F.lit(1 << 30)).alias("at"), F.xxhash64(key, F.lit(2)).alias("h"))
    # the network has an output for each language, so a row for each is no more than what training holds anyway
    picked = rows.join(F.broadcast(counts), "lang").where(F.col("at") < F.lit(float(texts)) / F.col("n") * (1 << 30))
    best = Window.partitionBy("lang").orderBy("h", "id", "text")
    found = picked.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= 2 * texts).select("id", "lang", "text").collect()
    return sorted((r["id"] or "", r["lang"], r["text"]) for r in found)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out_of: int = 4, held_out_is: int = 2, texts: int = TRAIN_TEXTS, with_row: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; the network learns from rows that aren't held out.

    Null texts and texts without a letter are `und` with a score of 0, and so is every text if no row is labelled.
    Repeated rows are judged each; an empty table gives an empty result; other columns play no part. with_row adds the
    whole row of docs as a struct `row`, so that a filter by language needs no join.
    """
    held = F.coalesce(crc_mod(id_col, held_out_of) == held_out_is, F.lit(False))
    sample = training_rows(docs, ~held, id_col, text_col, lang_col, texts)
    own = [wrapped(docs)] if with_row else []
    rows = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col)).alias("text"), *own)
    names = ["row"] * with_row
    if not sample:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), *names)
    model = train([t.encode() for _, _, t in sample], [lang for _, lang, _ in sample])
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), *rows.schema.fields[3:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.pair_tables()
        for b in batches:
            p = predict(model, tables, *buffers(b.column(2)))
            known = ~np.asarray(b.column(2).is_null())
            best = p.argmax(1) if len(p) else np.zeros(0, int)
            told = pa.array([model.languages[i] if k else UNKNOWN for i, k in zip(best, known, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), told, pa.array(np.where(known, p[np.arange(len(p)), best], 0.0)), *b.columns[3:]], schema.names)

    return rows.mapInArrow(run, schema)
