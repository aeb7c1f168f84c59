"""Whitening of vectors by a one-sided Jacobi singular value decomposition.

Every task folds its block of centred rows into a triangle R by QR, and triangles are stacked and folded again, some at a
time, until one of as many rows as dimensions is left (TSQR). Plane rotations make R's columns orthogonal; the product of
the rotations holds the components, and the columns' lengths over the root of n are the standard deviations. Products of
the data with itself are never formed, so small deviations keep their accuracy.

Statistics are over the fit list, each distinct vector of whole numbers once, which is a written table; it is shuffled
once, with copies merged before. What comes to the driver are numbers for each dimension or pair of dimensions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearway.llm.common import Workspace, unwrapped, wrapped

#: Triangles, or blocks' moments, that one task folds.
FAN_IN = 32
#: Rows of a block that is folded at a time.
ROWS = 8_192
#: A component whose deviation is no more than this share of the largest has none.
LEAST = 1e-13


def whole_numbers(vectors: DataFrame, vector_col: str, scale: int) -> DataFrame:
    """vectors with _x: floor(scale * entry) of each entry, as long.

    Rows go whose vector is null, empty, or holds null or non-finite entries, or one that is beyond a long when scaled.
    """
    v = F.col(f"`{vector_col}`")
    scaled = F.transform(v, lambda c: F.floor(c.cast("double") * F.lit(float(scale))))
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double") * F.lit(float(scale))) < F.lit(2.0**63)))
    kept = vectors.where(v.isNotNull() & (F.size(v) > 0) & fine)
    return kept.withColumn("_x", F.transform(scaled, lambda c: c.cast("long")))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def exact_dot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums of products of whole numbers along the last axis: in 64 bits where they must fit, else of any size."""
    bound = int(np.abs(x.astype(float)).max(initial=0) + 1) * int(np.abs(y.astype(float)).max(initial=0) + 1) * x.shape[-1]
    if bound < 2**62:
        return (x * y).sum(-1)
    return (x.astype(object) * y.astype(object)).sum(-1)


def rotate(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """The lengths of r's columns once rotations have made them orthogonal, falling, and the rotations' product.

    A round turns disjoint pairs of columns at once, in the order of a tournament; a sweep turns every pair once.
    """
    d = r.shape[1]
    a, v = r.astype(float).copy(), np.eye(d)
    seats = np.arange(d + d % 2)
    for _ in range(sweeps):
        turned = False
        for _ in range(max(len(seats) - 1, 0)):
            p, q = seats[: len(seats) // 2], seats[len(seats) // 2 :][::-1]
            real = (p < d) & (q < d)
            p, q = p[real], q[real]
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
            alpha, beta = (a[:, p] ** 2).sum(0), (a[:, q] ** 2).sum(0)
            gamma = (a[:, p] * a[:, q]).sum(0)
            due = np.abs(gamma) > 1e-15 * np.sqrt(alpha * beta)
            if not due.any():
                continue
            turned = True
            p, q, alpha, beta, gamma = p[due], q[due], alpha[due], beta[due], gamma[due]
            with np.errstate(over="ignore"):  # beyond a double the turn is none
                zeta = (beta - alpha) / (2 * gamma)
            t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            c = 1 / np.hypot(1, t)
            s = c * t
            for m in (a, v):
                m[:, p], m[:, q] = c * m[:, p] - s * m[:, q], s * m[:, p] + c * m[:, q]
        if not turned:
            break
    length = np.sqrt((a**2).sum(0))
    order = np.argsort(-length, kind="stable")
    return length[order], v[:, order]


@dataclass
class Whitening:
    """What a fit gives: n vectors with sums S of each dimension, variances (falling) and components (columns)."""

    n: int
    sums: list[int]
    variances: np.ndarray
    components: np.ndarray
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])  # correctly rounded, whatever the sum's size

    @property
    def explained(self) -> np.ndarray:
        total = self.variances.sum()
        return self.variances / total if total > 0 else np.zeros(len(self.variances))

    def whitened(self, x: np.ndarray, most: int) -> np.ndarray:
        """x's centred rows on the first components, over their deviations; nan where a component has none."""
        deviation = np.sqrt(self.variances[:most])
        flat = deviation <= LEAST * np.sqrt(self.variances[0])
        out = (x - self.mean) @ self.components[:, :most]
        return np.where(flat, np.nan, out / np.where(flat, 1, deviation))

    def deviation(self, x: np.ndarray) -> list[int]:
        """Each row's sum over dimensions of (n * x - S)**2, exactly: n**2 x.x - 2 n x.S + S.S."""
        s = np.array(self.sums, dtype=object)
        if max(map(abs, self.sums), default=0) < 2**62:
            s = s.astype(np.int64)
        square, cross, own = exact_dot(x, x), exact_dot(x, s[None, :]), sum(t * t for t in self.sums)
        return [self.n**2 * int(a) - 2 * self.n * int(b) + own for a, b in zip(square, cross, strict=True)]


def _folded(made: DataFrame, fold, schema: str, work: Workspace) -> pd.DataFrame:
    """One row of what fold() makes of made's rows (from 0 on, in `at`), FAN_IN at a time; a round is a written table."""
    while True:
        made = work.write(made)
        n = made.count()
        if n <= FAN_IN:
            return fold(made.toPandas())
        made = made.groupBy(F.floor(F.col("at") / FAN_IN).alias("group")).applyInPandas(lambda key, part: fold(part).assign(at=key[0]), schema)


def fit(x: DataFrame, work: Workspace, most: int) -> Whitening | None:
    """The whitening of x's rows (_x: arrays of long of one length); None without a row."""
    listed = work.write(x.select("_x").distinct())
    size = listed.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_x")).alias("d")).first()
    n, d = size["n"], size["d"]
    if not n:
        return None

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * d
        for b in batches:
            m = _matrix(b.column(0), d)
            wide = int(np.abs(m.astype(float)).max(initial=0) + 1) * len(m) >= 2**62
            total = [t + int(s) for t, s in zip(total, (m.astype(object) if wide else m).sum(0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(map(Decimal, total), pa.decimal128(38, 0))], ["dim", "s"])

    summed = listed.mapInArrow(sums, "dim int, s decimal(38,0)").groupBy("dim").agg(F.sum("s").alias("s")).collect()
    model = Whitening(n, [int(s) for _, s in sorted((r["dim"], r["s"]) for r in summed)], np.zeros(d), np.eye(d))
    mean = model.mean

    def triangle(stacked: np.ndarray) -> np.ndarray:
        return np.linalg.qr(stacked, mode="r")

    def triangles(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        r = np.zeros((0, d))
        for b in batches:
            m = _matrix(b.column(0), d)
            for k in range(0, len(m), ROWS):
                r = triangle(np.vstack([r, m[k : k + ROWS] - mean]))
        yield pa.RecordBatch.from_pandas(pd.DataFrame({"at": [TaskContext.get().partitionId()], "r": [r.ravel()]}), pa.schema([("at", pa.int64()), ("r", pa.list_(pa.float64()))]), preserve_index=False)

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"at": [0], "r": [triangle(np.vstack([np.asarray(r, float).reshape(-1, d) for r in part.r])).ravel()]})

    top = _folded(listed.mapInArrow(triangles, "at long, r array<double>"), fold, "at long, r array<double>", work)
    lengths, components = rotate(np.asarray(top.r[0], float).reshape(-1, d))
    largest = np.abs(components).argmax(0)
    components *= np.where(components[largest, np.arange(d)] < 0, -1.0, 1.0)  # one sign of two
    model.variances, model.components = lengths**2 / n, components
    model.identity_error = _identity_error(listed, model, work, most)
    return model


def _identity_error(listed: DataFrame, model: Whitening, work: Workspace, most: int) -> float:
    """The largest absolute entry of the whitened fit list's covariance less the identity, over components that vary."""
    d, k = len(model.sums), min(most, len(model.sums))
    vary = ~(np.sqrt(model.variances[:k]) <= LEAST * np.sqrt(model.variances[0]))
    k = int(vary.sum())
    if not k:
        return 0.0
    schema = "at long, n long, mean array<double>, moment array<double>"

    def merge(parts: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray]:
        n, mean, moment = 0, np.zeros(k), np.zeros((k, k))
        for m, other, own in parts:
            if m:
                off, both = other - mean, n + m
                moment, mean, n = moment + own + np.outer(off, off) * (n * m / both), mean + off * (m / both), both
        return n, mean, moment

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for b in batches:
                y = model.whitened(_matrix(b.column(0), d), k)
                if len(y):
                    yield len(y), y.mean(0), (y - y.mean(0)).T @ (y - y.mean(0))

        n, mean, moment = merge(parts())
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([n]), pa.array([mean]), pa.array([moment.ravel()])], ["at", "n", "mean", "moment"])

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        n, mean, moment = merge((int(m), np.asarray(a, float), np.asarray(c, float).reshape(k, k)) for m, a, c in zip(part.n, part["mean"], part.moment, strict=True))
        return pd.DataFrame({"at": [0], "n": [n], "mean": [mean], "moment": [moment.ravel()]})

    top = _folded(listed.mapInArrow(moments, schema), fold, schema, work)
    return float(np.abs(np.asarray(top.moment[0]).reshape(k, k) / int(top.n[0]) - np.eye(k)).max())


def commonest_length(x: DataFrame) -> DataFrame:
    """Rows whose vector has the length that most have (of as many, the greater); a row for each length meets."""
    sizes = x.groupBy(F.size("_x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    top = sizes.agg(F.max(F.struct("n", "d")).alias("m")).first()["m"]
    return x if top is None else x.where(F.size("_x") == top["d"])


OUT = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, scale: int = 256, most: int = 4, vector_col: str = "embedding", keep: tuple[str, ...] | None = None) -> DataFrame:
    """A row for each vector and each of its first `most` components: keep's columns (all, if None), and what OUT says.

    Vectors that are null, empty, hold null or non-finite entries, or are not of the commonest length take no part, and
    repeated rows have rows each; they are one vector of the fit. n and deviation are exact; whitened is null for a
    component without variance, which all are if all vectors are the same; explained is then 0. An empty table gives an
    empty result. A column of vectors that has one of OUT's names gives way to it.
    """
    work = Workspace(vectors.sparkSession, "whitening")
    names = [f.split()[0] for f in OUT.split(", ")]
    own = [c for c in (vectors.columns if keep is None else keep) if c not in names]
    carried = vectors.select(*[F.col(f"`{c}`") for c in own])
    x = commonest_length(whole_numbers(vectors.select(wrapped(carried), F.col(f"`{vector_col}`").alias("_v")), "_v", scale).select("row", "_x"))
    model = fit(x, work, most)
    if model is None:
        return x.select(*unwrapped(carried), *[F.lit(None).cast(f.split(" ", 1)[1]).alias(f.split()[0]) for f in OUT.split(", ")])
    d = len(model.sums)
    k = min(most, d)
    schema = T.StructType([x.schema["row"], T.StructField("made", T.ArrayType(T.StructType.fromDDL(OUT)))])
    kind = pa.struct([("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.decimal128(38, 0)), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        explained = model.explained
        for b in batches:
            m = _matrix(b.column(1), d)
            rows = len(m)
            white = model.whitened(m, k).ravel() if rows else np.zeros(0)
            each = [Decimal(v) if v < 10**38 else None for v in model.deviation(m)] if rows else []
            flat = [pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, model.n)), pa.array([v for v in each for _ in range(k)], pa.decimal128(38, 0))]
            flat += [pa.array(white, mask=np.isnan(white)), pa.array(np.tile(explained[:k], rows)), pa.array(np.full(rows * k, model.identity_error))]
            values = pa.StructArray.from_arrays(flat, fields=list(kind))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * k), values)], ["row", "made"])

    made = x.mapInArrow(run, schema)
    return made.select("row", F.explode("made").alias("made")).select(*unwrapped(carried), *[F.col("made").getField(n).alias(n) for n in names])
