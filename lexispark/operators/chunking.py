"""Articles to chunks, one row per chunk. Row-local, so it also runs on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.config import Chunking
from lexispark.functions import text as T

PAYLOAD = ("article_id", "article_num", "article_title", "codex")


def full_text(title: str = "article_title", body: str = "article_text"):
    return F.concat_ws(" ", F.coalesce(F.col(title), F.lit("")), F.coalesce(F.col(body), F.lit("")))


def parents(articles: DataFrame, c: Chunking = Chunking()) -> DataFrame:
    """One row per parent: the payload, parent_no, p (parent_id, parent_text, children), article_text; row-local."""
    # columns in steps: each is used more than once by the next, so Spark keeps them apart and computes them once
    held = articles.select(*PAYLOAD, "article_text").withColumn("ws", T.paragraph_words(F.col("article_text"), c)).withColumn("kids", T.children(F.col("ws"), c))
    held = held.withColumn("ps", T.parents(F.col("kids"), F.col("article_text"), F.col("article_id"), c))
    return held.select(*PAYLOAD, "article_text", F.posexplode_outer("ps").alias("parent_no", "p"))


def chunk(articles: DataFrame, c: Chunking = Chunking()) -> DataFrame:
    """Chunks by the configured strategy: the payload, a stable key (parent_no, pos), and the texts.

    point_key is article_id, parent_no and pos: unique without a global count, so no single task has to number rows.
    """
    base = articles.select(*PAYLOAD, "article_text")
    none = lambda kind: F.lit(None).cast(kind)
    if not c.enabled or c.strategy == "none":
        rows = base.select(*PAYLOAD, F.lit(0).alias("parent_no"), F.lit(0).alias("pos"), none("string").alias("parent_id"), none("string").alias("parent_text"), none("int").alias("child_idx"), F.lit(1).alias("total_chunks"), full_text().alias("chunk_text"), "article_text")
    elif c.strategy == "fixed":
        cut = base.withColumn("cs", T.fixed_chunks(full_text(), c.chunk_size, c.chunk_overlap))
        rows = cut.select(*PAYLOAD, F.posexplode("cs").alias("pos", "chunk_text"), F.size("cs").alias("total_chunks"), "article_text")
        rows = rows.select(*PAYLOAD, F.lit(0).alias("parent_no"), "pos", none("string").alias("parent_id"), none("string").alias("parent_text"), none("int").alias("child_idx"), "total_chunks", "chunk_text", "article_text")
    else:
        held = parents(articles, c)
        rows = held.select(*PAYLOAD, "parent_no", F.posexplode_outer("p.children").alias("pos", "ch"), F.col("p.parent_id").alias("parent_id"), F.col("p.parent_text").alias("parent_text"), "article_text")
        rows = rows.select(*PAYLOAD, "parent_no", "pos", "parent_id", "parent_text", F.col("ch.child_idx").alias("child_idx"), none("int").alias("total_chunks"), F.col("ch.child_text").alias("chunk_text"), "article_text")
    return rows.withColumn("point_key", F.concat_ws(":", F.col("article_id").cast("string"), F.col("parent_no").cast("string"), F.col("pos").cast("string")))
