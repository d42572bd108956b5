"""Bounded samples of labelled texts, and fitting on them in one executor task."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexispark.llm.common import prepare, release, remainder, text_or_empty

M = TypeVar("M")
#: Bytes of text that serve for each label at most.
MOST_BYTES = 12 << 20


def sample(docs: DataFrame, labels: DataFrame, label_col: str, held_out: tuple[int, int] | None, per_class: int, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = MOST_BYTES) -> DataFrame:
    """(id, label, text): whole texts of at most per_class documents, and most_bytes bytes, for each of the labels 0 and 1.

    held_out (k, r): documents whose crc32(id as text) mod k is r never serve. Which documents serve follows from a
    hash of their id alone, taken in its order until a bound is reached; a document that would pass the byte bound is
    left out and smaller ones behind it may still serve. An id with two labels counts as 1. An id that many rows repeat
    serves once, by the smallest of its texts, and is one row before anything is gathered.
    """
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    if held_out:
        usable = usable.where(remainder("id", held_out[0]) != held_out[1])
    usable = usable.groupBy("id").agg(F.max("label").alias("label"))
    picked = None
    for label in (0, 1):
        part = usable.where(F.col("label") == label).withColumn("h", F.xxhash64(F.col("id"), F.lit(17))).orderBy("h", "id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    # picked has 2 * per_class rows at most, whatever the input
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    once = texts.join(F.broadcast(picked), "id").groupBy("id", "label", "h").agg(F.min("text").alias("text"))
    fits = once.where(F.octet_length("text") <= most_bytes)
    before = F.sum(F.octet_length("text")).over(Window.partitionBy("label").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return fits.withColumn("total", before).where(F.col("total") <= most_bytes).select("id", "label", "text")


def fit_in_task(rows: DataFrame, fit: Callable[[list[tuple[str, int]]], M]) -> M:
    """fit((text, label) pairs of a bounded table), run by one task; only the model comes to the driver.

    Texts serve in the order of their ids, and equal texts once, by the smallest id. A lost executor's task runs again.
    """
    prepare(rows.sparkSession)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        got = [r for b in batches for r in zip(*(b.column(names.index(c)).to_pylist() for c in ("id", "label", "text")))]
        once: dict[str, int] = {}
        for _, y, t in sorted(got, key=lambda r: (str(type(r[0])), r[0], r[1], r[2])):
            once.setdefault(t, y)
        got.clear()
        model = pickle.dumps(fit(list(once.items())))
        once.clear()
        release()
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])

    found = rows.coalesce(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(bytes(found[0]["model"])) if found else fit([])
