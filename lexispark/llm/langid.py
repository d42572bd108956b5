"""Language identification by nearest centroids.

A text becomes the counts of its letter n-grams (1 to 3, words marked by blanks) in hashed buckets, damped by a
logarithm, weighted by inverse document frequency and brought to length one. Each language has several centroids,
found by spherical k-means over its training vectors. A text gets the language of the centroid with the largest
cosine. A text that lies further from every centroid than nearly all training texts do from theirs is rejected:
`rejected` is true, and with reject=True the prediction is `und`.

Training rows are a bounded sample (per_language and most_bytes, chosen by a hash of the id) of every language, however
many there are; prediction covers every row and whole texts of any length.

Defined results: null texts and texts without a letter are `und` with score 0; without training rows every text is `und`;
of centroids at the same cosine the first serves, by the order of the languages' names; a null id counts as hash
remainder 0; repeated rows give repeated results, and equal texts train once; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.llm.common import prepare, remainder, text_or_empty
from lexispark.llm.labelled import fit_in_task

BUCKETS = 1 << 13
UNKNOWN = "und"
#: Training rows of each language at most.
PER_LANGUAGE = 300
#: Bytes of their texts at most.
LANGUAGE_BYTES = 2 << 20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For every code point: whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def counts(text: str) -> np.ndarray | None:
    """Hashed n-gram counts; None without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return None
    codes = np.where(letter, codes, np.uint32(32))
    codes = np.concatenate([[np.uint32(32)], codes[letter | np.concatenate([[False], letter[:-1]])], [np.uint32(32)]]).astype(np.uint32)
    one = codes[codes != 32]
    two = codes[:-1] * np.uint32(0x9E3779B1) + codes[1:]
    three = two[:-1] * np.uint32(0x85EBCA77) + codes[2:]
    out = np.zeros(BUCKETS, np.int64)
    for h, seed in ((one, 1), (two, 2), (three, 3)):
        h = (h ^ np.uint32(seed * 0x27D4EB2F & 0xFFFFFFFF)) * np.uint32(0xC2B2AE3D)
        out += np.bincount((h >> np.uint32(19)).astype(np.int64), minlength=BUCKETS)
    return out


def _vectors(texts: list[str], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, which texts have a letter)."""
    out, some = np.zeros((len(texts), BUCKETS), np.float32), np.zeros(len(texts), bool)
    for i, t in enumerate(texts):
        if (c := counts(t)) is not None:
            some[i] = True
            at = np.flatnonzero(c)
            v = np.log1p(c[at]) * idf[at]
            out[i, at] = v / (np.sqrt((v * v).sum()) or 1.0)
    return out, some


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    owner: np.ndarray  # the language of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    least: np.ndarray  # of each language: the cosine under which a text is rejected

    def predict(self, texts: list[str], reject: bool = False) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, cosine, rejected) of each text."""
        if not len(self.owner):
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        x, some = _vectors(texts, self.idf)
        cosine = x @ self.centroids.T
        best = cosine.argmax(axis=1)
        score = np.clip(cosine[np.arange(len(texts)), best].astype(np.float64), 0, 1)
        owner = self.owner[best]
        rejected = ~some | (score < self.least[owner])
        lang = [self.languages[o] if s and not (reject and r) else UNKNOWN for o, s, r in zip(owner, some, rejected)]
        return lang, np.where(some, score, 0.0), rejected


def _clusters(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Spherical k-means: unit centroids."""
    c = x[[int(rng.integers(len(x)))]]
    while len(c) < min(k, len(x)):  # the next seed lies furthest from those so far
        c = np.vstack([c, x[[int((x @ c.T).max(axis=1).argmin())]]])
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        c = np.stack([x[near == i].sum(axis=0) if (near == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def fit(data: list[tuple[str, str]], clusters: int = 4, reject_share: float = 0.005, seed: int = 11) -> Model:
    """A model of (text, language) pairs. reject_share: of each language's training texts that may lie beyond its bound."""
    data = [(t, y) for t, y in data if any(map(str.isalpha, t))]
    languages = tuple(sorted({y for _, y in data}))
    present = np.zeros(BUCKETS, np.int64)
    for t, _ in data:
        present += counts(t) > 0
    idf = np.log((1 + len(data)) / (1 + present)) + 1
    rng, owner, centroids, least = np.random.default_rng(seed), [], [], []
    texts: dict[str, list[str]] = {}
    for t, y in data:
        texts.setdefault(y, []).append(t)
    for i, lang in enumerate(languages):
        x, _ = _vectors(texts[lang], idf)
        c = _clusters(x, clusters, rng)
        owner += [i] * len(c)
        centroids.append(c)
        least.append(float(np.quantile((x @ c.T).max(axis=1), reject_share)))
    return Model(languages, np.array(owner, np.int64), np.concatenate(centroids) if centroids else np.zeros((0, BUCKETS), np.float32), idf, np.array(least))


def fitted(docs: DataFrame, held_out: tuple[int, int] | None = None, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_bytes: int = LANGUAGE_BYTES) -> Model:
    """A model of the rows with a language; held_out (k, r): rows whose crc32(id as text) mod k is r do not serve.

    The rows of each language with the smallest hashes of their ids serve, per_language and most_bytes at most. A first
    pass over ids alone counts the languages, so that a bound on the hash leaves only about twice as many rows to rank.
    One executor task fits; only the model comes to the driver.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    if held_out:
        rows = rows.where(remainder("id", held_out[0]) != held_out[1])
    rows = rows.withColumn("h", F.pmod(F.xxhash64(F.col("id"), F.lit(23)), F.lit(1_000_000)))
    sizes = rows.groupBy("lang").count()
    bound = sizes.select("lang", (F.lit(2_000_000.0 * per_language) / F.col("count") + 50_000.0 / F.sqrt("count")).alias("bound"))
    few = rows.join(F.broadcast(bound), "lang").where("h <= bound")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "id", "text"))
    picked = few.where(F.octet_length("text") <= most_bytes).withColumn("rank", rank).where(F.col("rank") <= per_language)
    total = F.sum(F.octet_length("text")).over(Window.partitionBy("lang").orderBy("rank"))
    return fit_in_task(picked.withColumn("total", total).where(F.col("total") <= most_bytes).select("id", F.col("lang").alias("label"), "text"), fit)


def language_column(model: Model, text: Column, reject: bool = False) -> Column:
    """struct<lang, score, rejected>."""
    shared = _Shared(model)

    @F.pandas_udf("lang string, score double, rejected boolean")
    def of(texts: pd.Series) -> pd.DataFrame:
        lang, score, rejected = shared.model.predict(texts.tolist(), reject)
        return pd.DataFrame({"lang": lang, "score": score, "rejected": rejected})

    return of(text)


class _Shared:
    """A model sent in single precision: a few hundred kilobytes per language."""

    def __init__(self, model: Model):
        self.model = Model(model.languages, model.owner, model.centroids.astype(np.float32), model.idf.astype(np.float32), model.least)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", reject: bool = False) -> DataFrame:
    """(id, lang_pred, score, rejected) of every whole text."""
    prepare(docs.sparkSession)
    made = docs.select(F.col(id_col), language_column(model, text_or_empty(text_col), reject).alias("p"))
    return made.select(id_col, F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.rejected").alias("rejected"))
