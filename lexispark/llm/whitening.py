"""Whitening of embeddings by a cyclic Jacobi eigen-decomposition.

Entries become integers floor(scale * entry) + shift, and equal integer vectors count once: the fit list. Its sums are exact,
and its scatter is gathered about the mean, centred before multiplying, as partial sums of the tasks that an
aggregate adds up by pairs of dimensions. The driver gets the d * (d + 1) / 2 sums alone, and applies symmetric Jacobi rotations, in cyclic
order, until the off-diagonals vanish beside their diagonals; rotations that small keep small eigenvalues accurate to the last digits.
The components are sorted by falling eigenvalue, and the whitening matrix goes along with the tasks: d numbers for
each component.

Defined results: rows whose vector is null or holds null or non-finite entries are left out, and so are rows whose vector has another
length than most rows have (the longer of two equally common ones counts); entries beyond +-2**62 after scaling count as that; rows that
repeat an id or a vector are rows of their own, whose equal vectors count once in the fit list; null ids stay; a component without variance
(an eigenvalue of at most d * 2.3e-16 of the largest) has whitened null and is left out of identity_error; its sign makes the
largest entry of a component positive; a deviation beyond 64 bits is null; a table without usable
vectors gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import forget, prepare, saved

#: Integers lie within plus and minus this.
_LARGEST = 1 << 62


@dataclass(frozen=True)
class Params:
    """x = floor(scale * entry) + shift; the first `components` by eigenvalue are kept."""

    scale: float = 64.0
    shift: int = 1_000_000
    components: int = 16


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors with per-dimension sums; components as rows, their eigenvalues, and all eigenvalues' sum."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def dims(self) -> int:
        return len(self.sums)

    @property
    def sound(self) -> np.ndarray:
        """Which components have variance."""
        return self.eigenvalues > self.dims * np.finfo(float).eps * max(self.eigenvalues, default=0.0)

    @property
    def matrix(self) -> np.ndarray:
        """A column for each component, nan without variance."""
        scale = np.sqrt(np.where(self.sound, self.eigenvalues, np.nan))
        return (self.components / scale[:, None]).T


def quantized(entries: np.ndarray, p: Params) -> np.ndarray:
    """x of finite entries, as 64-bit integers."""
    scaled = np.floor(p.scale * np.asarray(entries, np.float64))
    return np.clip(scaled, -float(_LARGEST), float(_LARGEST)).astype(np.int64) + p.shift


def packed(x: np.ndarray, shift: int) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Rows of integers without the shift, as narrow as each can be: (places of some rows, their bytes). Equal rows give equal bytes."""
    y = x - shift
    low, high = y.min(axis=1), y.max(axis=1)
    width = np.full(len(y), 8)
    for w in (4, 2, 1):
        width[(low >= -(1 << 8 * w - 1)) & (high < 1 << 8 * w - 1)] = w
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        data = np.empty((len(at), 1 + w * y.shape[1]), np.uint8)
        data[:, 0] = w
        data[:, 1:] = y[at].astype(f"<i{w}").view(np.uint8).reshape(len(at), -1)
        yield at, pa.FixedSizeBinaryArray.from_buffers(pa.binary(data.shape[1]), len(at), [None, pa.py_buffer(data.tobytes())]).cast(pa.binary())


def unpacked(column: pa.Array, shift: int) -> np.ndarray:
    """The rows of a column of packed() bytes of one number of dimensions; their lengths tell how wide they are."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data, sizes = np.frombuffer(column.buffers()[2], np.uint8), np.diff(ends)
    out: np.ndarray | None = None
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        rows = data[ends[at][:, None] + np.arange(size)]
        w = int(rows[0, 0])
        y = np.ascontiguousarray(rows[:, 1:]).view(f"<i{w}").astype(np.int64)
        out = np.empty((len(sizes), y.shape[1]), np.int64) if out is None else out
        out[at] = y + shift
    return np.zeros((0, 0), np.int64) if out is None else out


def _column(b: pa.RecordBatch, at: int, shift: int) -> np.ndarray:
    return unpacked(b.column(at), shift)


def vectors(df: DataFrame, p: Params = Params(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, dims, x) of the rows with usable vectors; x is packed."""
    prepare(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = b.column(1).offsets.to_numpy()
            entries = b.column(1).values.to_numpy(zero_copy_only=False).astype(np.float64)  # null entries become nan
            bad = np.append(0, np.cumsum(~np.isfinite(entries)))
            sizes = np.diff(ends)
            usable = b.column(1).is_valid().to_numpy(zero_copy_only=False) & (sizes > 0) & (bad[ends[1:]] == bad[ends[:-1]])
            for d in np.unique(sizes[usable]).tolist():
                rows = np.flatnonzero(usable & (sizes == d))
                for at, x in packed(quantized(entries[ends[rows][:, None] + np.arange(d)], p), p.shift):
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows[at])), pa.array(np.full(len(at), d, np.int32)), x], names=["id", "dims", "x"])

    return rows.mapInArrow(run, f"id {kind}, dims int, x binary")


def _summed(rows: DataFrame, d: int, shift: int) -> tuple[int, list[int]]:
    """Count and exact sums of each dimension: each task adds up its own, an aggregate the tasks'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for b in batches:
            if b.num_rows:
                y = _column(b, 0, 0)
                # a batch's sums fit 64 bits unless its entries are huge
                part = y.sum(axis=0) if np.abs(y.astype(np.float64)).max() * len(y) < _LARGEST else y.astype(object).sum(axis=0)
                n, total = n + len(y), [a + int(c) for a, c in zip(total, part)]
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array([str(t) for t in total], pa.string())], names=["i", "n", "s"])

    sums = rows.select("x").mapInArrow(run, "i int, n bigint, s string").groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found = {r["i"]: r for r in sums.collect()}  # d rows
    n = found[0]["n"]
    return n, [int(found[i]["s"]) + n * shift for i in range(d)]


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """x - S / n as doubles, from the exact n * x - S, and these."""
    big = n * (int(np.abs(x).max()) + 1) + max(map(abs, sums)) >= _LARGEST if x.size else False
    exact = x.astype(object) * n - np.array(sums, object) if big else x * n - np.array(sums, np.int64)
    return (exact / n).astype(np.float64), exact


def _scatter(rows: DataFrame, d: int, of) -> np.ndarray:
    """The d x d sums of products of of(batch)'s columns: each task adds up its batches, an aggregate adds up the tasks."""
    at = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for b in batches:
            if b.num_rows:
                z = of(b)
                total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(at[0].astype(np.int32)), pa.array(at[1].astype(np.int32)), pa.array(total[at])], names=["i", "j", "s"])

    out = np.zeros((d, d))
    for r in rows.select("x").mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():  # d * (d + 1) / 2 rows
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["s"]
    return out


def jacobi(matrix: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of a symmetric matrix, by cyclic Jacobi rotations.

    Each rotation makes one off-diagonal entry zero. It is left out where the entry is below the rounding of the
    geometric mean of its two diagonal entries, which is what small eigenvalues' accuracy needs; a sweep without a rotation ends it.
    """
    a, d = np.array(matrix, np.float64), len(matrix)
    vectors = np.eye(d)
    eps, least = np.finfo(float).eps, np.finfo(float).tiny
    for _ in range(sweeps):
        turned = 0
        for p in range(d - 1):
            for q in range(p + 1, d):
                apq = a[p, q]
                if abs(apq) <= max(eps * np.sqrt(abs(a[p, p] * a[q, q])), least):
                    continue
                turned += 1
                theta = (a[q, q] - a[p, p]) / (2 * apq)
                t = (1.0 if theta >= 0 else -1.0) / (abs(theta) + np.hypot(theta, 1.0))
                c = 1 / np.hypot(t, 1.0)
                s = t * c
                rp, rq = a[p].copy(), a[q].copy()
                a[p], a[q] = c * rp - s * rq, s * rp + c * rq
                a[:, p], a[:, q] = a[p], a[q]
                a[p, p], a[q, q] = rp[p] - t * apq, rq[q] + t * apq
                a[p, q] = a[q, p] = 0.0
                vp, vq = vectors[:, p].copy(), vectors[:, q].copy()
                vectors[:, p], vectors[:, q] = c * vp - s * vq, s * vp + c * vq
        if not turned:
            break
    else:
        raise RuntimeError("the rotations did not settle")
    return np.diag(a).copy(), vectors / np.linalg.norm(vectors, axis=0)


def fitted(rows: DataFrame, p: Params = Params()) -> Whitening | None:
    """The whitening of vectors()'s rows, all of one length; None without any."""
    fit = saved(rows.select("dims", "x").distinct().select("dims", "x"), "fit-list")
    some = fit.first()
    if some is None:
        forget(fit)
        return None
    d, shift = some["dims"], p.shift
    n, exact = _summed(fit, d, shift)
    sums = tuple(exact)
    v = _scatter(fit, d, lambda b: centred(_column(b, 0, shift), n, sums)[0]) / n
    values, columns = jacobi(v)
    order = np.argsort(-values, kind="stable")[: p.components]
    components = columns[:, order].T
    largest = np.abs(components).argmax(axis=1)
    components = components * np.where(components[np.arange(len(order)), largest] < 0, -1.0, 1.0)[:, None]
    found = Whitening(n, sums, components, values[order], float(np.trace(v)))
    matrix = found.matrix[:, found.sound]
    error = 0.0
    if matrix.shape[1]:
        again = _scatter(fit, matrix.shape[1], lambda b: centred(_column(b, 0, shift), n, sums)[0] @ matrix) / n
        error = float(np.abs(again - np.eye(len(again))).max())
    forget(fit)
    return Whitening(found.n, found.sums, found.components, found.eigenvalues, found.trace, error)


def _deviations(exact: np.ndarray) -> pa.Array:
    """Sums of squares, exact; null beyond 64 bits."""
    if exact.dtype != object and (exact.astype(np.float64) ** 2).sum(axis=1).max() < _LARGEST:
        return pa.array((exact * exact).sum(axis=1))
    totals = [sum(int(e) ** 2 for e in row) for row in exact]
    return pa.array([t if t < 1 << 63 else None for t in totals], pa.int64())


def whitened(df: DataFrame, p: Params = Params(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each usable row and component."""
    rows = vectors(df, p, id_col, vector_col)
    lengths = rows.groupBy("dims").count().orderBy(F.desc("count"), F.desc("dims")).first()
    rows = rows.where(F.col("dims") == (lengths["dims"] if lengths else 0))
    model = fitted(rows, p)
    names = ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    kind = rows.schema["id"].dataType.simpleString()
    ddl = f"id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if model is None:
        return df.sparkSession.createDataFrame([], ddl).withColumnRenamed("id", id_col)
    k = len(model.eigenvalues)
    shift, matrix = p.shift, model.matrix
    explained = np.where(model.trace > 0, np.maximum(model.eigenvalues, 0) / (model.trace or 1.0), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            m = b.num_rows
            z, exact = centred(_column(b, 1, shift), model.n, model.sums)
            each = pa.array(np.repeat(np.arange(m), k))
            columns = [
                b.column(0).take(each),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, model.n)),
                _deviations(exact).take(each),
                pa.array((z @ matrix).ravel(), from_pandas=True),
                pa.array(np.tile(explained, m)),
                pa.array(np.full(m * k, model.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.select("id", "x").mapInArrow(run, ddl).withColumnRenamed("id", id_col)
