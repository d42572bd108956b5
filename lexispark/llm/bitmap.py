"""Preselecting rows by a broadcast bitmap."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap at most: 32 MiB.
BITMAP_BITS = 1 << 28


class Bitmap:
    """A hashed bitmap of a column's values, of bounded size: says no only where a value is not there."""

    def __init__(self, df: DataFrame, col: str):
        n = df.count()
        self.bits = 1 << max(15, min(BITMAP_BITS.bit_length() - 1, (24 * max(n, 1)).bit_length()))
        at = df.select(self.position(col).alias("at")).select((F.col("at") + 1).alias("at"))
        rows = at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bitmap")).collect()
        whole = np.zeros(self.bits // 8, np.uint8)
        for r in rows:
            start = (r["bucket"] - 1) * 4096
            part = np.frombuffer(r["bitmap"], np.uint8)[: len(whole) - start]
            whole[start : start + len(part)] = part
        self.shared = df.sparkSession.sparkContext.broadcast(whole)

    def position(self, col: str):
        return F.pmod(F.xxhash64(col), F.lit(self.bits))

    @property
    def has(self) -> Callable[[np.ndarray], np.ndarray]:
        """A function that tells of positions, on executors, whether they are set."""
        shared = self.shared
        return lambda at: (shared.value[at >> 3] >> (at & 7)) & 1 == 1

    def maybe(self, col: str):
        has = self.has

        @F.pandas_udf("boolean")
        def of(at: pd.Series) -> pd.Series:
            return pd.Series(has(at.to_numpy()))

        return of(self.position(col))
