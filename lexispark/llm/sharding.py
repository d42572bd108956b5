"""Sharding by extendible hashing.

A row's key is the first 60 bits of the MD5 of its id. A bucket is a prefix of those bits; only a bucket that
holds more than its byte limit is split on the next bit, until every bucket fits. The directory holds the
buckets alone, so its size follows from the bytes and the limit: at most two for each limit's worth of bytes at
each depth that was needed. A row finds its shard by the place of its key among the buckets' first keys.

Histograms are summed by the cluster, a few bits at a time and over the rows of oversized buckets only. Rows that
no bit of the key can part (ids that very many rows repeat) are parted by the bits of a second key, the row's position
in the table, in the same way and all of them in the same passes; their positions are saved first, so that a lost
executor cannot change them. A single row above the limit, however long, is a shard of its own.

Defined results: null texts count as empty, null ids share a key; repeated rows are rows of their own; which of equal
rows goes to which page follows from their positions; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import prepare, saved, text_or_empty

BITS = 60
#: Bytes of a row besides its text.
ROW_BYTES = 16
#: Bytes of a shard in production.
LIMIT = 64 << 20
#: Bits that one pass over the oversized buckets' rows adds.
STEP = 6


def key_column(id_col: str) -> Column:
    """60 bits: 15 hexadecimal digits of the MD5 of the id as text."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("bigint")


def position_column() -> Column:
    """60 bits for a row's position: different rows differ; the low bits, which tell neighbours apart, come first."""
    return F.conv(F.reverse(F.lpad(F.bin(F.monotonically_increasing_id()), BITS, "0")), 2, 10).cast("bigint")


@dataclass(frozen=True)
class Directory:
    """Buckets in the order of their keys. first: a bucket's smallest key; depth: the bits of its prefix."""

    first: np.ndarray
    depth: np.ndarray
    bytes: np.ndarray
    rows: np.ndarray

    @property
    def oversized(self) -> np.ndarray:
        return (self.depth >= BITS) & (self.rows > 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, keys, side="right") - 1


def _leaves(prefix: np.ndarray, size: np.ndarray, rows: np.ndarray, base: int, depth: int, limit: int) -> tuple[list[tuple], np.ndarray]:
    """Buckets that fit, and the prefixes of `depth` bits that still do not.

    prefix, size, rows: a histogram by prefixes of `depth` bits; all prefixes of `base` bits are known not to fit.
    """
    leaves, open_ = [], np.unique(prefix >> (depth - base)) if base else np.zeros(1, np.int64)
    for d in range(base, depth + 1):
        at, inverse = np.unique(prefix >> (depth - d), return_inverse=True)
        total, count = np.bincount(inverse, size).astype(np.int64), np.bincount(inverse, rows).astype(np.int64)
        here = np.isin(at >> 1, open_) if d > base else np.isin(at, open_)
        fits = here & ((total <= limit) | (count <= 1))
        leaves += [(int(p) << (BITS - d), d, int(t), int(c)) for p, t, c in zip(at[fits], total[fits], count[fits])]
        open_ = at[here & ~fits]
    return leaves, open_


def directory(rows: DataFrame, limit: int, step: int = STEP) -> Directory:
    """rows: key, size."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    depth, base, leaves, open_ = min(BITS, max(1, (total // max(limit, 1)).bit_length() + 1)), 0, [], None
    while True:
        part = rows
        if open_ is not None:
            # open_ is a part of the directory; its buckets hold more than the limit each
            spark = rows.sparkSession
            part = rows.join(F.broadcast(spark.createDataFrame([(int(p),) for p in open_], "p bigint")), F.shiftright("key", BITS - base) == F.col("p"))
        hist = part.groupBy(F.shiftright("key", BITS - depth).alias("prefix")).agg(F.sum("size").alias("size"), F.count("*").alias("rows")).toPandas()
        if not len(hist):
            break
        found, open_ = _leaves(hist["prefix"].to_numpy(np.int64), hist["size"].to_numpy(np.int64), hist["rows"].to_numpy(np.int64), base, depth, limit)
        leaves += found
        if not len(open_):
            break
        if depth == BITS:
            sums = hist.set_index("prefix")
            leaves += [(int(p), BITS, int(sums.loc[p, "size"]), int(sums.loc[p, "rows"])) for p in open_]
            break
        base, depth = depth, min(BITS, depth + step)
    table = np.array(sorted(leaves), np.int64).reshape(-1, 4)
    return Directory(*(table[:, i] for i in range(4)))


def _lookup(d: Directory, spark, key: str) -> Column:
    shared = spark.sparkContext.broadcast(d)

    @F.pandas_udf("shard string, depth int, bytes bigint, n_rows bigint, oversized boolean")
    def of(keys: pd.Series) -> pd.DataFrame:
        d = shared.value
        at = d.find(keys.to_numpy(np.int64))
        depth = d.depth[at]
        names = [format(int(f) >> (BITS - int(n)), "b").zfill(int(n)) if n else "" for f, n in zip(d.first[at], depth)]
        return pd.DataFrame({"shard": names, "depth": depth.astype(np.int32), "bytes": d.bytes[at], "n_rows": d.rows[at], "oversized": d.oversized[at] & (d.bytes[at] > 0)})

    return of(F.col(key))


def shards(df: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, shard, depth, shard_bytes, shard_rows) of every row. shard: the bucket's prefix in binary digits."""
    spark = df.sparkSession
    prepare(spark)
    size = (F.octet_length(text_or_empty(text_col)) + ROW_BYTES).cast("bigint")
    rows = df.select(F.col(id_col).alias("id"), size.alias("size"), key_column(id_col).alias("key"), position_column().alias("position"))
    whole = directory(rows.select("key", "size"), limit)
    if not len(whole.first):
        return df.select(F.col(id_col), size.alias("n_bytes"), F.lit("").alias("shard"), F.lit(0).alias("depth"), size.alias("shard_bytes"), F.lit(0).cast("bigint").alias("shard_rows"))
    placed = rows.withColumn("p", _lookup(whole, spark, "key"))
    columns = lambda part, prefix: part.select(F.col("id").alias(id_col), F.col("size").alias("n_bytes"), F.concat(prefix, F.col("p.shard")).alias("shard"), F.col("p.depth").alias("depth"), F.col("p.bytes").alias("shard_bytes"), F.col("p.n_rows").alias("shard_rows"))
    out = columns(placed.where("not p.oversized"), F.lit(""))
    if not whole.oversized.any():
        return out
    # the rows of ids that repeat beyond the limit, with their positions fixed: one table for all of them
    same = saved(placed.where("p.oversized").select("id", "size", F.col("key").alias("bucket"), "position"), "same-ids")
    paged = same.withColumn("p", _lookup_page(pages(same, limit), spark, "bucket", "position"))
    prefix = F.concat(F.lpad(F.bin("bucket"), BITS, "0"), F.lit("."))
    return out.unionByName(columns(paged, prefix).withColumn("depth", F.col("depth") + BITS))


def pages(rows: DataFrame, limit: int) -> dict[int, Directory]:
    """bucket -> its directory by position, of rows (bucket, position, size); all buckets are split in the same passes.

    The driver holds about two entries for each limit's worth of bytes.
    """
    sums = {r["bucket"]: (r["size"], r["rows"]) for r in rows.groupBy("bucket").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect()}
    depth = min(BITS, max((max(1, (size // max(limit, 1)).bit_length() + 1) for size, _ in sums.values()), default=1))
    leaves: dict[int, list[tuple]] = {b: [] for b in sums}
    base, open_ = 0, {b: np.zeros(1, np.int64) for b in sums}
    while open_:
        part = rows
        if base:
            # the open prefixes are parts of the directories; their buckets hold more than the limit each
            some = [(b, int(p)) for b, ps in open_.items() for p in ps]
            part = rows.join(F.broadcast(rows.sparkSession.createDataFrame(some, "bucket bigint, p bigint")), ["bucket"]).where(F.shiftright("position", BITS - base) == F.col("p"))
        hist = part.groupBy("bucket", F.shiftright("position", BITS - depth).alias("prefix")).agg(F.sum("size").alias("size"), F.count("*").alias("rows")).toPandas()
        left = {}
        for bucket, h in hist.groupby("bucket"):
            found, still = _leaves(h["prefix"].to_numpy(np.int64), h["size"].to_numpy(np.int64), h["rows"].to_numpy(np.int64), base, depth, limit)
            leaves[bucket] += found
            if len(still):
                left[bucket] = still
        base, depth, open_ = depth, min(BITS, depth + STEP), left
        if base == BITS and open_:
            raise RuntimeError("positions of different rows are equal")
    return {b: Directory(*(np.array(sorted(x), np.int64).reshape(-1, 4)[:, i] for i in range(4))) for b, x in leaves.items()}


def _lookup_page(directories: dict[int, Directory], spark, bucket: str, position: str) -> Column:
    shared = spark.sparkContext.broadcast(directories)

    @F.pandas_udf("shard string, depth int, bytes bigint, n_rows bigint")
    def of(buckets: pd.Series, keys: pd.Series) -> pd.DataFrame:
        out = []
        for b, k in zip(buckets.tolist(), keys.tolist()):
            d = shared.value[b]
            i = int(np.searchsorted(d.first, k, side="right")) - 1
            n = int(d.depth[i])
            out.append((format(int(d.first[i]) >> (BITS - n), "b").zfill(n) if n else "", n, int(d.bytes[i]), int(d.rows[i])))
        return pd.DataFrame(out, columns=["shard", "depth", "bytes", "n_rows"])

    return of(F.col(bucket), F.col(position))


def oracle(limit: int = LIMIT, depths: int = 24) -> str:
    """SQL of shards() where no id needs pages: a row's bucket is its shortest prefix that fits."""
    return f"""
WITH rows AS (
  SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + {ROW_BYTES} AS BIGINT) AS n_bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS k
  FROM documents
), prefixes AS (
  SELECT doc_id, n_bytes, k, d, k >> ({BITS} - d) AS prefix FROM rows, range(0, {depths} + 1) t(d)
), sized AS (
  SELECT d, prefix, sum(n_bytes) AS bytes, count(*) AS n FROM prefixes GROUP BY d, prefix
), fitting AS (
  SELECT p.doc_id, p.n_bytes, p.k, min(p.d) AS d FROM prefixes p JOIN sized s USING (d, prefix)
  WHERE s.bytes <= {limit} OR s.n <= 1 GROUP BY ALL
)
SELECT f.doc_id, f.n_bytes,
       CASE WHEN f.d = 0 THEN '' ELSE right(lpad(bin(f.k >> ({BITS} - f.d)), 64, '0'), CAST(f.d AS INTEGER)) END AS shard,
       CAST(f.d AS INTEGER) AS depth, CAST(s.bytes AS BIGINT) AS shard_bytes, s.n AS shard_rows
FROM fitting f JOIN sized s ON s.d = f.d AND s.prefix = f.k >> ({BITS} - f.d)
"""
