"""Exact duplicates by two passes of Bloom filtering.

Two texts are equal when they are identical after lower-casing A-Z; their SHA-256 stands for them. The first pass counts,
in a filter of counters that end at two, how often each position of the hashes is met: a task emits only the positions
it met and those it met again, blocks of them are merged, and what stays is a bitmap of the positions met twice. The
second pass asks it for each hash: a hash of which some position was met once only belongs to one row, which passes
straight through. Only the others' ids and hashes are shuffled, counted with a partial aggregate, and joined with
their groups: groups of over a thousandth of those rows, which are fewer than a thousand, by a broadcast, the others by their hash.

The filter has a fixed number of counters for a row. One that would be larger than `Filter.most` counters (a broadcast of 128 MiB) is
built in segments, each for a range of the hashes. Hashes and ids lie in a narrow table whose files are sorted by
that hash, so a segment's pass reads its own part only.

Defined results: a null text is the empty text; of rows with equal ids and texts, one stays (the last one read), and a null id is
smaller than any other, so keep_id is null only if all of a group's ids are; texts of any length are hashed whole; an empty table gives an empty table;
other columns, whatever their names, are ignored by duplicates() and kept by kept_rows().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.llm.bitmap import Bitmap
from lexispark.llm.common import forget, prepare, saved, shared_folder, text_or_empty


@dataclass(frozen=True)
class Filter:
    """counters for each row, and how many of them a hash has; most: counters of a segment, one bit of its broadcast each."""

    per_row: int = 16
    hashes: int = 4
    most: int = 1 << 30

    def __post_init__(self) -> None:
        if self.per_row < 1 or self.hashes < 1 or not _BLOCK <= self.most <= 1 << 32 or self.most & (self.most - 1):
            raise ValueError("counters and hashes of one or more are needed, and a power of two between a block and 2**32 as the most counters")


#: Counters that are merged together.
_BLOCK = 1 << 20
#: Positions that a task holds before it emits them.
_HELD = 1 << 22
#: Groups with over one part in so many of the rows that may be repeated are joined by a broadcast.
_HEAVY = 1000
#: Rows of a page of the narrow table, so that a segment's pass reads little of its neighbours.
_PAGE_ROWS = 2000


def hash_column(text: Column) -> Column:
    """The SHA-256, as bytes, of a text whose A-Z are lower-cased."""

    @F.arrow_udf("binary")
    def of(texts: pa.Array) -> pa.Array:
        # bytes.lower() changes A-Z only, and no byte of a longer UTF-8 sequence is one of those
        return pa.array([hashlib.sha256(t.as_py().lower()).digest() for t in texts], pa.binary())

    return of(F.encode(text, "UTF-8"))


def _positions(h: np.ndarray, counters: int, hashes: int) -> np.ndarray:
    """For each 64-bit hash its different counters, a power of two in number, as rows."""
    x = h.view(np.uint64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    y = (x * np.uint64(0xC4CEB9FE1A85EC53)) >> np.uint64(17) | np.uint64(1)  # odd, so a hash's positions differ
    return ((x[:, None] + y[:, None] * np.arange(hashes, dtype=np.uint64)) & np.uint64(counters - 1)).astype(np.uint32)


def _met(counters: int, hashes: int):
    """First pass, each task: (block, positions met, those met twice or more)."""

    def emitted(held: list[np.ndarray]) -> pa.RecordBatch:
        at, times = np.unique(np.concatenate(held), return_counts=True)
        edges = np.flatnonzero(np.diff(at // _BLOCK, prepend=-1)).tolist()
        rows = [(int(at[i]) // _BLOCK, at[i:j].tobytes(), at[i:j][times[i:j] > 1].tobytes()) for i, j in zip(edges, [*edges[1:], len(at)])]
        block, once, again = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(once, pa.binary()), pa.array(again, pa.binary())], names=["block", "once", "again"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(_positions(b.column(0).to_numpy(zero_copy_only=False), counters, hashes).ravel())
            size += len(held[-1])
            if size >= _HELD:
                yield emitted(held)
                held, size = [], 0
        if size:
            yield emitted(held)

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by block: the bitmap of the positions that were met twice, for each block that has some."""
    rows = (r for b in batches for r in zip(*(b.column(i) for i in range(3))))
    for block, some in groupby(rows, key=lambda r: r[0].as_py()):
        once, twice = np.zeros(_BLOCK, bool), np.zeros(_BLOCK, bool)
        for _, met, again in some:
            at = np.frombuffer(met.as_py(), np.uint32) % _BLOCK
            twice[at[once[at]]] = True
            once[at] = True
            twice[np.frombuffer(again.as_py(), np.uint32) % _BLOCK] = True
        if twice.any():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())], names=["block", "bitmap"])


def _repeated(rows: DataFrame, counters: int, hashes: int) -> np.ndarray:
    """The bitmap of the counters that the rows' hashes meet twice: counters / 8 bytes on the driver."""
    met = rows.select("h").mapInArrow(_met(counters, hashes), "block bigint, once binary, again binary")
    blocks = max(1, counters // _BLOCK)
    merged = met.repartition(min(blocks, 64), "block").sortWithinPartitions("block").mapInArrow(_merged, "block bigint, bitmap binary")
    out = np.zeros(blocks * (_BLOCK // 8), np.uint8)
    for r in merged.toLocalIterator():
        out[r["block"] * (_BLOCK // 8) :][: _BLOCK // 8] = np.frombuffer(r["bitmap"], np.uint8)
    return out


def hashed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, hash, h) of every row, as a table in the shared folder whose files are sorted by h; row numbers the rows."""
    prepare(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), hash_column(text_or_empty(text_col)).alias("hash"))
    rows = rows.select("id", F.monotonically_increasing_id().alias("row"), "hash", F.xxhash64("hash").alias("h")).sortWithinPartitions("h")
    path = shared_folder(df.sparkSession, "hashes")
    rows.write.option("parquet.page.row.count.limit", _PAGE_ROWS).parquet(path)
    out = df.sparkSession.read.schema(rows.schema).parquet(path)
    out.saved_at = path
    return out


def maybe_repeated(rows: DataFrame, params: Filter = Filter()) -> DataFrame:
    """hashed()'s rows with `maybe`: false only where no other row has the hash. Saved in the shared folder."""
    spark = rows.sparkSession
    n = rows.count()
    segments = max(1, -(-n * params.per_row // params.most))
    counters = min(params.most, max(_BLOCK, 1 << (-(-n * params.per_row // segments)).bit_length()))
    path = shared_folder(spark, "marked")
    ends = [-(1 << 63) + (1 << 64) * s // segments for s in range(segments + 1)]
    for low, high in zip(ends, ends[1:]):
        part = rows if segments == 1 else rows.where(F.col("h").between(low, high - 1))
        shared = spark.sparkContext.broadcast(_repeated(part, counters, params.hashes))

        @F.pandas_udf("boolean")
        def maybe(h: pd.Series) -> pd.Series:
            at = _positions(h.to_numpy(np.int64), counters, params.hashes)
            return pd.Series((shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(axis=1))

        part.withColumn("maybe", maybe("h")).write.mode("append").parquet(path)
        shared.destroy()
    out = spark.read.schema(rows.schema.add("maybe", "boolean")).parquet(path)
    out.saved_at = path
    return out


def _groups(rows: DataFrame) -> tuple[DataFrame, int]:
    """(hash, keep_id, keep_row, group_size) of each repeated hash of maybe_repeated()'s rows, and how many of these rows may be repeated."""
    some = rows.where("maybe")
    groups = some.groupBy("hash").agg(F.max(F.struct("id", "row")).alias("last"), F.count("*").alias("group_size")).where("group_size > 1")
    return saved(groups.select("hash", F.col("last.id").alias("keep_id"), F.col("last.row").alias("keep_row"), "group_size"), "groups"), some.count()


def _joined(some: DataFrame, groups: DataFrame, total: int) -> DataFrame:
    """some with its groups' columns, null without one; a group with more than a thousandth of all rows is no join key."""
    heavy = F.col("group_size") * _HEAVY > total
    large = F.broadcast(groups.where(heavy))  # fewer than _HEAVY rows
    small = some.join(large, "hash", "left_anti").join(groups.where(~heavy), "hash", "left")
    return some.join(large, "hash").unionByName(small)


def duplicates(df: DataFrame, params: Filter = Filter(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every row: which row of its equals stays, the one with the largest id."""
    narrow = hashed(df, id_col, text_col)
    rows = maybe_repeated(narrow, params).drop("h")
    forget(narrow)
    found = _joined(rows.where("maybe").drop("maybe"), *_groups(rows))
    found = found.select("id", "hash", F.when(F.col("keep_row").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"))
    alone = rows.where("not maybe").select("id", "hash", F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"))
    return alone.unionByName(found).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("hash")).alias("text_sha256"))


def kept_rows(df: DataFrame, params: Filter = Filter(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df's rows that stay, with all their columns; only rows whose text others repeat are shuffled."""
    narrow = hashed(df, id_col, text_col)
    groups, total = _groups(maybe_repeated(narrow, params))
    forget(narrow)
    bitmap = Bitmap(groups, "hash")
    rows = df.select(hash_column(text_or_empty(text_col)).alias("hash"), F.struct(*df.columns).alias("whole"))
    maybe = bitmap.maybe("hash")
    found = _joined(rows.where(maybe), groups, total)
    # rows that are equal in id and text share these two: one of them stays
    first = found.where("group_size is not null").where(F.col(f"whole.`{id_col}`").eqNullSafe(F.col("keep_id"))).dropDuplicates(["hash"])
    return rows.where(~maybe).select("whole").unionByName(found.where("group_size is null").select("whole")).unionByName(first.select("whole")).select("whole.*")


#: duplicates() for DuckDB; rows that repeat an id and a text are beyond it.
ORACLE = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(normal) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS normal FROM documents)
WINDOW same AS (PARTITION BY normal)
"""
