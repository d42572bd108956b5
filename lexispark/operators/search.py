"""Hybrid and dense search over points, with de-duplication and context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.config import Search
from lexispark.operators.dense import dense_leg
from lexispark.operators.ranking import fuse, top_k
from lexispark.operators.sparse import postings, sparse_leg, terms
from lexispark.storage import saved


def hybrid_search(queries: DataFrame, points: DataFrame, s: Search = Search(), limit: int | None = None, threshold: float | None = None, where: Column | None = None, found: DataFrame | None = None, stops: tuple[str, ...] = (), min_length: int = 2, n: int | None = None, frequencies: DataFrame | None = None, kept: DataFrame | None = None) -> DataFrame:
    """(query_id, point_id, score, rank). queries: query_id, query_text, embedding; points: point_id, chunk_text, embedding.

    Both legs fetch over_fetch * limit candidates; the threshold holds for the fused score. A filter holds before the legs,
    the token frequencies are of all points. point_id and query_id are unique; found: the points' terms, n: how many points there are, frequencies: their tokens' (token, df), where they are stored; kept: the
    points that may be found, in place of a filter.
    A point without a vector can still be found by its tokens.
    """
    limit, threshold = int(s.given(limit, s.limit)), s.given(threshold, s.score_threshold)
    if kept is None and where is not None:
        kept = points.where(where)
    k = s.over_fetch * limit
    dense = dense_leg(queries, points if kept is None else kept, k, s.distance)
    whole = found if found is not None else terms(points, "point_id", "chunk_text", stops, min_length)
    asked = postings(queries, "query_id", "query_text", stops, min_length, unique=True)
    sparse = sparse_leg(asked, whole, points.select("point_id").count() if n is None else n, k, kept, frequencies=frequencies)
    fused = fuse(dense, sparse, s.alpha)
    return top_k(fused.withColumn("score", F.round("score", 6)).where(F.col("score") >= threshold), limit)


def dense_search(queries: DataFrame, points: DataFrame, s: Search = Search(), limit: int | None = None, threshold: float | None = None, where: Column | None = None) -> DataFrame:
    """The dense leg alone, with the threshold in the leg."""
    kept = points if where is None else points.where(where)
    return dense_leg(queries, kept, int(s.given(limit, s.limit)), s.distance, s.given(threshold, s.score_threshold))


def with_payload(hits: DataFrame, points: DataFrame) -> DataFrame:
    """Hits with their points' columns, joined after the cut to k. Hits are written first: few ones, by their size, go to the points, whose texts are not shuffled."""
    return saved(hits, "hits").join(points.drop("embedding"), "point_id")
