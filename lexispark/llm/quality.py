"""Quality: supervised subword embeddings.

A word (a run of non-space characters, case kept) is the mean of the learned vectors of its hash bucket and of the
buckets of its character n-grams (3 to 5, with marks at its ends); a word that repeats the one before it adds a
marker of its own. A text is the mean of its words, and a softmax over two classes gives the score. Vectors and
output weights are trained together by numpy stochastic gradient descent on a bounded sample, in one executor task.

Prediction uses that everything up to the softmax is linear: a bucket's vector times the difference of the two
output rows is one number, a word's share is the mean of such numbers, and words seen before are remembered.

Defined results: null and empty texts are the marker of a text without words; without labels of both classes every
score is 1 (nothing is rejected); of one id's labels 1 wins, and of its texts the smallest serves (labelled.py); a null id
counts as hash remainder 0; repeated rows give repeated results and equal texts equal scores; texts of any length are
scored whole; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import prepare, remainder, text_or_empty, trim
from lexispark.llm.labelled import MOST_BYTES, fit_in_task, sample

BUCKETS = 1 << 16
N_GRAMS = (3, 4, 5)
REPEAT, EMPTY = "\x00repeat", "\x00empty"
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return h ^ (h >> np.uint32(12))


def buckets_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all words one after another, how many each word has): of the word itself and of its n-grams."""
    whole = np.fromiter((crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint32, len(words))
    marked = [f"<{w}>" for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(words))
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(words)), sizes)
    found, owners = [_mix(whole) % BUCKETS], [np.arange(len(words))]
    for n in N_GRAMS:
        count = len(codes) - n + 1
        if count <= 0:
            continue
        h = np.full(count, n * 0x3C6EF372 & 0xFFFFFFFF, np.uint32)
        for i in range(n):
            h = (h ^ codes[i : count + i]) * _FACTORS[i]
            h ^= h >> np.uint32(13)
        inside = owner[:count] == owner[n - 1 :]
        found.append(_mix(h[inside]) % BUCKETS)
        owners.append(owner[:count][inside])
    flat, of = np.concatenate(found).astype(np.int32), np.concatenate(owners)
    order = np.argsort(of, kind="stable")
    return flat[order], np.bincount(of, minlength=len(words))


def words_of(text: str) -> Counter:
    words = text.split()
    out = Counter(words)
    if repeats := sum(map(str.__eq__, words, words[1:])):
        out[REPEAT] = repeats
    return out or Counter({EMPTY: 1})


@dataclass(frozen=True)
class Model:
    """value: of each bucket, its vector times the difference of the output rows. name: tells models apart."""

    value: np.ndarray
    bias: float
    name: str = ""

    def scorer(self, bound: int = 120_000):
        """Scores of a list of texts; words seen before are remembered."""
        known: dict[str, float] = {}

        def of(texts: list[str]) -> np.ndarray:
            if len(known) > bound:
                known.clear()
            counts = [words_of(t) for t in texts]
            new = sorted(set().union(*counts) - known.keys())
            if new:
                flat, sizes = buckets_of(new)
                means = np.add.reduceat(self.value[flat].astype(np.float64), np.cumsum(sizes) - sizes) / sizes
                known.update(zip(new, means.tolist()))
            z = np.array([sum(map(float.__mul__, map(known.__getitem__, c), map(float, c.values()))) / sum(c.values()) for c in counts])
            return 1 / (1 + np.exp(-np.clip(self.bias + z, -30, 30)))

        return of


NOTHING = Model(np.zeros(BUCKETS, np.float32), 30.0, "nothing")


def _rows(texts: list[str], block: int = 64) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, shares) of each text, in 6 bytes each; the shares sum to 1. Words are held for a block of texts at a time."""
    out = []
    for k in range(0, len(texts), block):
        counts = [words_of(t) for t in texts[k : k + block]]
        words = sorted(set().union(*counts))
        flat, sizes = buckets_of(words)
        start = np.cumsum(sizes) - sizes
        row = {w: i for i, w in enumerate(words)}
        for c in counts:
            at = np.fromiter(map(row.__getitem__, c), np.int64, len(c))
            n = sizes[at]
            share = np.fromiter(c.values(), np.float64, len(c)) / sum(c.values()) / n
            ends = np.cumsum(n)
            places = np.arange(ends[-1]) + np.repeat(start[at] - ends + n, n)
            found, inverse = np.unique(flat[places], return_inverse=True)
            out.append((found.astype(np.uint16), np.bincount(inverse, np.repeat(share, n)).astype(np.float32)))
    return out


def fit(data: list[tuple[str, int]], dim: int = 8, epochs: int = 6, rate: float = 4.0, batch: int = 32, min_steps: int = 400, seed: int = 7) -> Model:
    """A model of (text, label) pairs; both classes weigh alike."""
    y = np.array([label for _, label in data], np.int64)
    if not len(y) or y.min() == y.max():
        return NOTHING
    rng = np.random.default_rng(seed)
    rows = _rows([t for t, _ in data])
    vectors = rng.uniform(-1, 1, (BUCKETS, dim)).astype(np.float32) / dim
    out = rng.uniform(-0.1, 0.1, (dim, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    weight = np.where(y == 1, len(y) / 2 / y.sum(), len(y) / 2 / (len(y) - y.sum())).astype(np.float32)
    # a small sample is passed over more often, for enough steps
    epochs = max(epochs, -(-min_steps // -(-len(y) // batch)))
    steps, step = epochs * -(-len(y) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(y), batch):
            chosen = order[k : k + batch]
            sizes = np.array([len(rows[i][0]) for i in chosen])
            at = np.concatenate([rows[i][0] for i in chosen]).astype(np.int64)
            share = np.concatenate([rows[i][1] for i in chosen])
            starts = np.cumsum(sizes) - sizes
            hidden = np.add.reduceat(vectors[at] * share[:, None], starts, axis=0)
            z = hidden @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(chosen)), y[chosen]] -= 1
            p *= weight[chosen, None] / len(chosen)
            lr = rate * (1 - step / steps)
            back = p @ out.T
            out -= lr * (hidden.T @ p)
            bias -= lr * p.sum(axis=0)
            # a bucket's step is scaled by how many texts are averaged, as each holds a small share of its text
            np.subtract.at(vectors, at, lr * len(chosen) * np.repeat(back, sizes, axis=0) * share[:, None])
            step += 1
    return Model((vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]), uuid4().hex)


def score_column(model: Model, text: Column) -> Column:
    """The score of a text column without nulls; what a task remembers of words goes with it."""

    @F.pandas_udf("double")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = model.scorer()
        for texts in parts:
            yield pd.Series(scorer(texts.tolist()), dtype="float64")
        del scorer
        trim()

    return of(text)


#: Labelled documents of each class that fit() gets at most.
PER_CLASS = 2500


def fitted(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] | None = None, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = MOST_BYTES) -> Model:
    """A model of a bounded sample, fitted by one task."""
    return fit_in_task(sample(docs, labels, "quality", held_out, per_class, id_col, text_col, most_bytes), fit)


def score(docs: DataFrame, model: Model, held_out: tuple[int, int], threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every whole text."""
    prepare(docs.sparkSession)
    made = docs.select(F.col(id_col), (remainder(id_col, held_out[0]) == held_out[1]).alias("held_out"), score_column(model, text_or_empty(text_col)).alias("score"))
    return made.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows at or above the threshold, with all their columns."""
    prepare(docs.sparkSession)
    return docs.where(score_column(model, text_or_empty(text_col)) >= threshold)
