"""An approximate dense leg: a stored inverted file of cells, with short codes beside the whole vectors.

build() finds cell centres by k-means on a bounded sample, puts every point into the cell of its closest centre, and writes two
tables that have a folder for each cell: codes, the point's id and its vector in one byte for each number, and vectors. A search
takes each query's closest cells, reads the codes of these cells only (their folders; the queries go along with the scan, within a bound),
keeps the best refine * k of each query by the codes' inner products, and reads the whole vectors of those alone for the final scores.

Scores are exact; which points are found is approximate: recall() measures it against the exact leg. Vectors that lie in no clusters
need many cells probed, as on the test vectors; then the codes save most of the reading. A cell that a third
of all points share is many rows of one folder, which Spark reads in many tasks.

Defined results: rows without a vector are left out; vectors of another length than the first end the job; ties go to the smaller point; with
fewer sampled points than cells each sampled point is a cell; empty tables give empty tables. Ids are unique on both sides. Cosine and Dot only.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.operators.dense import dense_leg, matrix, unit
from lexispark.operators.ranking import best_rows, top_k
from lexispark.package import ship
from lexispark.storage import saved


def centres(x: np.ndarray, cells: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Unit centres of the rows by k-means on the sphere; cells that lose all rows keep their place."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:cells]].copy()
    for _ in range(rounds):
        own = np.concatenate([(x[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        some = np.linalg.norm(total, axis=1) > 1e-12
        c[some] = unit(total[some])
    return c


@dataclass
class InvertedFile:
    """cells: how many; sample: points that k-means sees at most (both bound what the driver holds); distance: Cosine or Dot."""

    spark: SparkSession
    folder: str
    cells: int = 128
    sample: int = 65_536
    distance: str = "Cosine"
    #: Bytes of query vectors that go along with a scan of codes.
    query_bytes: int = 64 << 20

    def __post_init__(self) -> None:
        if self.distance not in ("Cosine", "Dot"):
            raise ValueError("an inverted file serves Cosine and Dot")

    def _rows(self, df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
        return df.select(F.col(id_col).alias("p"), F.col(vector_col).cast("array<double>").alias("v")).where("v is not null")

    def build(self, points: DataFrame, point_col: str = "point_id", vector_col: str = "embedding") -> None:
        ship(self.spark)
        rows = self._rows(points, point_col, vector_col)
        total = rows.count()
        if not total:
            raise ValueError("an inverted file needs vectors")
        # by a hash of the id, so that a repeated build takes the same points
        share = min(1.0, self.sample / total)
        some = rows.where(F.pmod(F.xxhash64("p"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).limit(self.sample).select("v").toArrow().combine_chunks()
        some = some if some.num_rows else rows.limit(self.cells).select("v").toArrow().combine_chunks()
        dim = len(some.column(0)[0])
        x = matrix(some.column(0).combine_chunks(), dim)
        means = centres(unit(x), self.cells)
        cosine, kind = self.distance == "Cosine", rows.schema["p"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                v = matrix(b.column(1), dim)
                v = unit(v) if cosine else v
                own = (unit(v) @ means.T).argmax(axis=1).astype(np.int32)
                scale = np.abs(v).max(axis=1) / 127
                code = np.rint(v / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own), pa.array(scale), pa.array([r.tobytes() for r in code], pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * dim, pa.int32()), pa.array(v.ravel()))], names=["p", "cell", "scale", "code", "v"])

        made = saved(rows.mapInArrow(run, f"p {kind}, cell int, scale double, code binary, v array<double>"), "cells")
        # rebalancing splits a large cell among tasks and joins small ones
        for table, columns in (("codes", ("p", "scale", "code")), ("vectors", ("p", "v"))):
            made.select("cell", *columns).hint("rebalance", "cell").sortWithinPartitions("cell", "p").write.mode("overwrite").partitionBy("cell").parquet(f"{self.folder}/{table}")
        state = [(json.dumps({"dim": dim, "points": total, "distance": self.distance}), means.tolist())]
        self.spark.createDataFrame(state, "state string, centres array<array<double>>").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/centres")

    def _state(self) -> tuple[dict, np.ndarray]:
        r = self.spark.read.parquet(f"{self.folder}/centres").first()
        return json.loads(r["state"]), np.array(r["centres"])

    def leg(self, queries: DataFrame, k: int, probes: int, refine: int = 4, least: float | None = 0.0, query_col: str = "query_id", point_col: str = "point_id", vector_col: str = "embedding") -> DataFrame:
        """(query, point, score, rank). More queries than query_bytes hold are searched exactly, on a grid."""
        state, means = self._state()
        dim = state["dim"]
        asked = self._rows(queries, query_col, vector_col)
        most = max(1, self.query_bytes // (8 * dim))
        got = asked.limit(most + 1).toArrow().combine_chunks()
        vectors = self.spark.read.parquet(f"{self.folder}/vectors")
        if got.num_rows > most:
            return dense_leg(queries, vectors.select(F.col("p").alias(point_col), F.col("v").alias(vector_col)), k, state["distance"], least, query_col, point_col, vector_col)
        kinds = [asked.schema["p"].dataType.simpleString(), vectors.schema["p"].dataType.simpleString()]
        if not got.num_rows:
            return top_k(self.spark.createDataFrame([], f"`{query_col}` {kinds[0]}, `{point_col}` {kinds[1]}, score double"), k, query_col, point_col)
        q = matrix(got.column(1).combine_chunks(), dim)
        q = unit(q) if state["distance"] == "Cosine" else q
        near = np.argsort(-(unit(q) @ means.T), axis=1, kind="stable")[:, :probes]
        cells = sorted(set(near.ravel().tolist()))  # at most `cells`
        ship(self.spark)
        shared = self.spark.sparkContext.broadcast((got.column(0).combine_chunks(), q, near))
        codes = self.spark.read.parquet(f"{self.folder}/codes").where(F.col("cell").isin(cells)).select("p", "cell", "scale", "code")
        few = codes.mapInArrow(_nearest(shared, dim, refine * k), f"q {kinds[0]}, p {kinds[1]}, cell int, score double")
        few = top_k(few, refine * k, "q", "p").select("q", "p", "cell")
        # some candidates of each query, joined with their cells' folders
        whole = few.join(vectors.where(F.col("cell").isin(cells)), ["cell", "p"])
        scores = whole.mapInArrow(_exact(shared, dim, whole.columns), f"q {kinds[0]}, p {kinds[1]}, score double")
        scores = scores if least is None else scores.where(F.col("score") >= least)
        return top_k(scores.select(F.col("q").alias(query_col), F.col("p").alias(point_col), "score"), k, query_col, point_col)

    def read(self, queries: DataFrame, probes: int, query_col: str = "query_id", vector_col: str = "embedding") -> float:
        """The mean share of all points that lie in a query's cells, whose codes are compared with it."""
        state, means = self._state()
        sizes = {r["cell"]: r["count"] for r in self.spark.read.parquet(f"{self.folder}/codes").groupBy("cell").count().collect()}  # a row for each cell
        q = matrix(self._rows(queries, query_col, vector_col).select("v").toArrow().combine_chunks().column(0).combine_chunks(), state["dim"])
        near = np.argsort(-(unit(q) @ means.T), axis=1, kind="stable")[:, :probes]
        return float(np.mean([sum(sizes.get(c, 0) for c in row) for row in near.tolist()]) / state["points"])


def recall(found: DataFrame, exact: DataFrame, query_col: str = "query_id", point_col: str = "point_id") -> DataFrame:
    """(query, recall): which share of a query's exact points was found."""
    hit = found.select(query_col, point_col).withColumn("hit", F.lit(1.0))
    return exact.join(hit, [query_col, point_col], "left").groupBy(query_col).agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"))


def _nearest(shared, dim: int, k: int):
    """The best k of each query among a batch's codes, in the cells that the query probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, near = shared.value
        for b in batches:
            cell = b.column(1).to_numpy()
            for c in np.unique(cell).tolist():
                mine, at = np.flatnonzero((near == c).any(axis=1)), np.flatnonzero(cell == c)
                if not len(mine):
                    continue
                data = b"".join(b.column(3).take(pa.array(at)).to_pylist())
                p = np.frombuffer(data, np.int8).reshape(-1, dim) * b.column(2).to_numpy()[at][:, None]
                for r in best_rows(q[mine] @ p.T, b.column(0).take(pa.array(at)), ids.take(pa.array(mine)), k, ["q", "p", "score"]):
                    yield pa.RecordBatch.from_arrays([r.column(0), r.column(1), pa.array(np.full(r.num_rows, c, np.int32)), r.column(2)], names=["q", "p", "cell", "score"])

    return run


def _exact(shared, dim: int, names: list[str]):
    """Scores of (q, p, v) rows."""
    of_q, of_p, of_v = (names.index(c) for c in ("q", "p", "v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, _ = shared.value
        place = {i: n for n, i in enumerate(ids.to_pylist())}
        for b in batches:
            if b.num_rows:
                at = [place[i] for i in b.column(of_q).to_pylist()]
                score = (q[at] * matrix(b.column(of_v), dim)).sum(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(of_q), b.column(of_p), pa.array(score)], names=["q", "p", "score"])

    return run
