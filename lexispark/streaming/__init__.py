"""Incremental indexing of a stream of articles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexispark.config import Chunking
from lexispark.operators.chunking import chunk
from lexispark.operators.dense import hashing_encoder
from lexispark.operators.index import Collection


def index_stream(articles: DataFrame, collection: Collection, checkpoint: str, c: Chunking = Chunking(), available_now: bool = True, encoder: Callable[[Column], Column] = hashing_encoder, stops: tuple[str, ...] = (), min_length: int = 2) -> StreamingQuery:
    """Chunk and embed every new article and upsert its points; a batch that is tried again gives the same points.

    A batch replaces all points of its articles and rewrites only the collection's parts that it touches.
    """

    def write(batch: DataFrame, number: int) -> None:
        points = chunk(batch, c).withColumn("point_id", F.xxhash64("point_key")).withColumn("embedding", encoder(F.col("chunk_text")))
        collection.upsert(points.withColumn("batch", F.lit(number)), "chunk_text", stops, min_length)

    writer = articles.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
