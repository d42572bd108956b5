"""Top-k, min-max, fusion and de-duplication of scored points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Scores are rounded before they are ranked, so ties do not depend on the order of a sum.
DIGITS = 6


def top_k(scored: DataFrame, k: int, query_col: str = "query_id", point_col: str = "point_id") -> DataFrame:
    """The best k points of each query, ties by point; adds rank. Spark cuts to k within each task before it shuffles."""
    w = Window.partitionBy(query_col).orderBy(F.desc("score"), point_col)
    return scored.withColumn("score", F.round("score", DIGITS)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rounded(scores: np.ndarray) -> np.ndarray:
    """Rounded to the digits by which scores are ranked, halves away from zero; no negative zero."""
    unit = 10.0**DIGITS
    return np.copysign(np.floor(np.abs(scores) * unit + 0.5), scores) / unit + 0.0


def best_places(s: np.ndarray, points: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the best k points of each query among a batch's, ties by point. s: rounded scores, queries x points; those of minus infinity are none."""
    if s.shape[1] <= k:
        return np.nonzero(np.isfinite(s))
    order = pc.sort_indices(points).to_numpy()  # ties go to the smaller point, so the columns stand in their order
    s = s[:, order]
    edge = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
    above, level = s > edge, s == edge
    keep = above | (level & (np.cumsum(level, axis=1) <= k - above.sum(axis=1, keepdims=True)))
    q, p = np.nonzero(keep & np.isfinite(s))
    return q, order[p]


def best_rows(scores: np.ndarray, points: pa.Array, queries: pa.Array, k: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """(query, point, score) of the best k points of each query among a batch's, by rounded score, ties by point.

    scores: queries x points; those of minus infinity are none.
    """
    s = rounded(scores)
    q, p = best_places(s, points, k)
    yield pa.RecordBatch.from_arrays([queries.take(pa.array(q)), points.take(pa.array(p)), pa.array(s[q, p])], names=names)


class Best:
    """The best k points of each of a task's queries among those of all its batches, by rounded score and then by point.

    A query that has k points has a floor, and a score below it is put aside by one comparison. What is held, sorted and passed on
    follows the queries: k rows for each, whatever the number of points and batches. least: scores below it are none.
    """

    def __init__(self, queries: pa.Array, k: int, least: float | None = None):
        self.queries, self.k = queries, k
        self.floor = np.full(len(queries), -np.finfo(np.float64).max if least is None else least)
        self.parts: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []
        self.rows, self.cut_at = 0, 1 << 16

    def add(self, scores: np.ndarray, points: pa.Array, at: int = 0) -> None:
        """scores: the queries from `at` on x points."""
        near = scores >= self.floor[at : at + len(scores), None]
        if np.count_nonzero(near) > 2 * self.k * len(scores):
            s = rounded(np.where(near, scores, -np.inf))
            q, p = best_places(s, points, self.k)
            s = s[q, p]
        else:
            q, p = np.divmod(np.flatnonzero(near), scores.shape[1])
            s = rounded(scores[q, p])
            if not np.isfinite(s).all():
                q, p, s = (x[np.isfinite(s)] for x in (q, p, s))
        self._held(q + at, points.take(pa.array(p)), s)

    def put(self, q: pa.Array, points: pa.Array, scores: pa.Array) -> None:
        """Rows that another task has kept: places of queries, points, rounded scores."""
        self._held(q.to_numpy().astype(np.int64), points, scores.to_numpy())

    def _held(self, q: np.ndarray, points: pa.Array, s: np.ndarray) -> None:
        if not len(q):
            return
        self.parts.append((q, points, s))
        self.rows += len(q)
        if self.rows > self.cut_at:
            self.cut()
            self.cut_at = max(1 << 16, 2 * self.rows)

    def cut(self) -> None:
        """Keep the best k rows of each query, and raise the floors to them."""
        if not self.parts:
            return
        q, s = (np.concatenate([x[i] for x in self.parts]) for i in (0, 2))
        p = pa.concat_arrays([x[1] for x in self.parts])
        if pa.types.is_integer(p.type) and not p.null_count:
            order = np.lexsort((p.to_numpy(), -s, q))
        else:
            t = pa.table({"q": q, "s": s, "p": p})
            order = pc.sort_indices(t, [("q", "ascending"), ("s", "descending"), ("p", "ascending")]).to_numpy()
        q = q[order]
        starts = np.flatnonzero(np.diff(q, prepend=-1))
        place = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
        kept = place < self.k
        order, q, place = order[kept], q[kept], place[kept]
        s = s[order]
        last = place == self.k - 1
        # rounding moves a score by half a unit of its last digit
        self.floor[q[last]] = np.maximum(self.floor[q[last]], s[last] - 10.0**-DIGITS)
        self.parts, self.rows = [(q, p.take(pa.array(order)), s)], len(q)

    def batches(self, names: list[str]) -> Iterator[pa.RecordBatch]:
        """(query, point, score), in batches."""
        self.cut()
        for q, p, s in self.parts:
            for i in range(0, len(q), 10_000):
                j = slice(i, i + 10_000)
                yield pa.RecordBatch.from_arrays([self.queries.take(pa.array(q[j])), p[j], pa.array(s[j])], names=names)


def minmax(hits: DataFrame, query_col: str = "query_id", out: str = "norm") -> DataFrame:
    """Scores of each query scaled to 0..1; all equal: 1."""
    w = Window.partitionBy(query_col)
    low, high = F.min("score").over(w), F.max("score").over(w)
    return hits.withColumn(out, F.when(high == low, 1.0).otherwise((F.col("score") - low) / (high - low)))


def fuse(dense: DataFrame, sparse: DataFrame, alpha: float, query_col: str = "query_id", point_col: str = "point_id") -> DataFrame:
    """(query, point, score): alpha * dense + (1 - alpha) * sparse over the union of both candidate lists; missing is 0."""
    d = minmax(dense, query_col, "d").select(query_col, point_col, "d")
    s = minmax(sparse, query_col, "s").select(query_col, point_col, "s")
    both = d.join(s, [query_col, point_col], "full")
    return both.select(query_col, point_col, (F.lit(alpha) * F.coalesce("d", F.lit(0.0)) + F.lit(1.0 - alpha) * F.coalesce("s", F.lit(0.0))).alias("score"))


def dedup_by_article(hits: DataFrame, limit: int | None, query_col: str = "query_id", article_col: str = "article_id") -> DataFrame:
    """The best hit of each article, ranked anew; hits without an article are dropped."""
    known = hits.where(F.col(article_col).isNotNull())
    first = known.withColumn("n", F.row_number().over(Window.partitionBy(query_col, article_col).orderBy("rank"))).where("n = 1").drop("n")
    again = first.withColumn("rank", F.row_number().over(Window.partitionBy(query_col).orderBy("rank")))
    return again if limit is None else again.where(F.col("rank") <= limit)


def dedup_by_parent(hits: DataFrame, query_col: str = "query_id", parent_col: str = "parent_id") -> DataFrame:
    """Hits without those whose parent came before; hits without a parent all stay. There is no refill."""
    n = F.row_number().over(Window.partitionBy(query_col, parent_col).orderBy("rank"))
    kept = hits.withColumn("n", n).where((F.col("n") == 1) | F.col(parent_col).isNull() | (F.col(parent_col) == "")).drop("n")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(query_col).orderBy("rank")))
