"""Quality scores by regularised quadratic discriminants over transformed document statistics.

Each class has a mean and a covariance, shrunk towards the pooled covariance and a multiple of the identity. A score is
the logistic of the difference of the two log-densities and the classes' shares, from Mahalanobis distances through
Cholesky factors that are made once. Sums for means and covariances are taken over all labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearway.llm.common import Workspace, crc_mod
from nearway.llm.textkernel import SPACE, Words, buffers, counted, occurrences, shingles, slices, words

FEATURES = ("words", "word bytes", "word bytes' spread", "letters", "capitals", "digits", "marks", "symbols", "distinct words", "repeated words", "short words", "sentence words", "line words", "distinct shingles", "most common word")
UPPER, DIGIT, MARK, LETTER = (np.zeros(256, bool) for _ in range(4))
UPPER[65:91] = True
DIGIT[48:58] = True
MARK[[ord(c) for c in ".,;:!?'\"()-"]] = True
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
STOP = np.zeros(256, bool)
STOP[[ord(c) for c in ".!?"]] = True


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text; shares are log odds, counts logarithms."""
    w: Words = words(data, offsets)
    n = np.diff(w.first)
    solid = counted(~SPACE[data], offsets)
    odds = lambda part, whole: np.log((part + 0.5) / (whole - part + 0.5))
    size = (w.end - w.start).astype(np.float64)
    by_word = lambda x: np.where(n > 0, np.add.reduceat(np.append(x, 0.0), np.minimum(w.first[:-1], len(x))) if len(n) else 0.0, 0.0)
    total, square = by_word(size), by_word(size**2)
    mean = total / np.maximum(n, 1)
    spread = np.sqrt(np.maximum(square / np.maximum(n, 1) - mean**2, 0))
    letters = counted(LETTER[data], offsets)
    distinct, counts, first = occurrences(w.hash, w.first)
    most = np.zeros(len(n))
    if len(counts):
        some = n > 0
        most[some] = np.maximum.reduceat(counts, first[:-1][some])
    again = np.zeros(len(w.hash), bool)
    again[1:] = w.hash[1:] == w.hash[:-1]
    again[w.first[:-1][n > 0]] = False
    s, s_first = shingles(w)
    s_distinct = np.diff(occurrences(s, s_first)[2])
    made = np.diff(s_first)
    marks, digits = counted(MARK[data], offsets), counted(DIGIT[data], offsets)
    return np.stack([
        np.log1p(n), np.log1p(mean), np.log1p(spread), odds(letters, solid), odds(counted(UPPER[data], offsets), letters),
        odds(digits, solid), odds(marks, solid), odds(solid - letters - digits - marks, solid), odds(np.diff(first), n),
        odds(counted(again, w.first), n), odds(by_word((size <= 3).astype(np.float64)), n),
        np.log((n + 1) / (counted(STOP[data], offsets) + 1)), np.log((n + 1) / (counted(data == 10, offsets) + 1)), odds(s_distinct, made), odds(most, n),
    ], 1)


@dataclass
class Discriminant:
    means: list[np.ndarray]
    factors: list[np.ndarray]  # inverse Cholesky factors
    constants: list[float]
    temper: float = 1.0

    def score(self, x: np.ndarray) -> np.ndarray:
        d = [c - 0.5 * (((x - m) @ f.T) ** 2).sum(1) for m, f, c in zip(self.means, self.factors, self.constants, strict=True)]
        return 1 / (1 + np.exp(-np.clip(self.temper * (d[1] - d[0]), -700, 700)))


def fit(n: list[float], sums: list[np.ndarray], squares: list[np.ndarray], shrink: float = 0.2, ridge: float = 0.02, temper: float = 0.3) -> Discriminant:
    """From each class's count, sums and sums of products."""
    means = [s / k for s, k in zip(sums, n, strict=True)]
    scatter = [q / k - np.outer(m, m) for q, k, m in zip(squares, n, means, strict=True)]
    pooled = sum(k * s for k, s in zip(n, scatter, strict=True)) / sum(n)
    target = (1 - ridge) * pooled + ridge * (np.trace(pooled) / len(pooled)) * np.eye(len(pooled)) + 1e-6 * np.eye(len(pooled))
    factors, constants = [], []
    for k, s in zip(n, scatter, strict=True):
        chol = np.linalg.cholesky((1 - shrink) * s + shrink * target + 1e-9 * np.eye(len(s)))
        factors.append(np.linalg.inv(chol))
        constants.append(float(np.log(k / sum(n)) - np.log(np.diag(chol)).sum()))
    return Discriminant(means, factors, constants, temper)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_out_of: int = 5, held_out_is: int = 0, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; labels of held-out documents are never used.

    Null texts count as empty; an empty text is scored as any other. Labels other than 0 and 1 and documents labelled
    both are left out; with only one class labelled every score is that class, with none 0.5. Repeated rows are scored
    each (and learned from each, if labelled); an empty table gives an empty result; other columns play no part.
    """
    work = Workspace(docs.sparkSession, "quality")
    held = F.coalesce(crc_mod(id_col, held_out_of) == held_out_is, F.lit(False))
    rows = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = buffers(b.column(2))
            for i, j in slices(offsets):
                x = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], b.column(1)[i:j], pa.array([y.tobytes() for y in x], pa.binary())], ["doc_id", "held_out", "x"])

    measured = work.write(rows.mapInArrow(measure, f"doc_id {id_type}, held_out boolean, x binary"))
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col("doc_id").alias("l_id")).agg(F.min(label_col).cast("int").alias("y"), F.max(label_col).cast("int").alias("y2")).where("y = y2")
    learned = measured.where(~F.col("held_out")).join(known, F.col("doc_id") == F.col("l_id")).select("y", "x")
    d = len(FEATURES)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, 1 + d + d * d))
        for b in batches:
            x, y = np.frombuffer(b"".join(b.x)).reshape(-1, d), b.y.to_numpy()
            for k in (0, 1):
                own = x[y == k]
                total[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        yield pd.DataFrame({"y": np.repeat([0, 1], total.shape[1]), "i": np.tile(np.arange(total.shape[1]), 2), "v": total.ravel()})

    # one number for each class and place in the sums, whatever the input
    found = learned.mapInPandas(sums, "y int, i int, v double").groupBy("y", "i").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((2, 1 + d + d * d))
    for r in found:
        total[r["y"], r["i"]] = r["v"]
    n = total[:, 0]
    if n.min() < 2:
        score = F.lit(0.5 if n.max() == 0 else float(n.argmax()))
        return measured.select("doc_id", "held_out", score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    model = fit(list(n), [t[1 : 1 + d] for t in total], [t[1 + d :].reshape(d, d) for t in total])

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = model.score(np.frombuffer(b"".join(b.x)).reshape(-1, d))
            yield pd.DataFrame({"doc_id": b.doc_id, "held_out": b.held_out, "score": s, "predicted": (s >= threshold).astype(np.int32)})

    return measured.mapInPandas(judge, f"doc_id {id_type}, held_out boolean, score double, predicted int")
