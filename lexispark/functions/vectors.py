"""Dense vectors as arrays: similarity, pooling, normalising."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def held(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used, also within lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def similarity(a: Column, b: Column, distance: str = "Cosine") -> Column:
    """Larger is closer for each of Cosine, Dot and Euclid (the negative distance); an unknown name means Cosine."""
    if distance == "Dot":
        return dot(a, b)
    if distance == "Euclid":
        square = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
        return F.lit(0.0) - F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, x: s + x))
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def l2_normalize(a: Column) -> Column:
    with_norm = held(a, lambda v: F.struct(v.alias("v"), F.greatest(norm(v), F.lit(1e-12)).alias("n")))
    return held(with_norm, lambda s: F.transform(s["v"], lambda x: x.cast("double") / s["n"]))


def pool(vectors: Column, mask: Column, how: str = "mean") -> Column:
    """One vector from the token vectors whose mask is 1."""
    if how not in ("mean", "cls", "max"):
        raise ValueError(f"unknown pooling: {how}")
    return held(F.struct(vectors.alias("v"), mask.alias("m")), lambda s: _pooled(s["v"], s["m"], how))


def _pooled(vectors: Column, mask: Column, how: str) -> Column:
    if how == "cls":
        return vectors[0]
    dims = F.sequence(F.lit(0), F.size(vectors[0]) - 1)
    if how == "mean":
        at = lambda d: F.aggregate(F.zip_with(vectors, mask, lambda v, m: v[d].cast("double") * m), F.lit(0.0), lambda s, x: s + x)
        n = F.greatest(F.aggregate(mask, F.lit(0.0), lambda s, m: s + m), F.lit(1e-9))
        return held(n, lambda n: F.transform(dims, lambda d: at(d) / n))
    at = lambda d: F.array_max(F.zip_with(vectors, mask, lambda v, m: F.when(m == 0, F.lit(-1e9)).otherwise(v[d].cast("double"))))
    return F.transform(dims, at)


def dimension(a: Column) -> Column:
    return F.size(a)
