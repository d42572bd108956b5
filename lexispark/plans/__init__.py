"""The engine: build, embed, search, answer, generate and evaluate over DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.config import Config
from lexispark.functions.vectors import l2_normalize
from lexispark.operators import context, evaluate
from lexispark.operators.chunking import chunk
from lexispark.operators.dense import hashing_encoder
from lexispark.operators.index import Collection
from lexispark.operators.ranking import dedup_by_article, dedup_by_parent
from lexispark.operators.search import dense_search, hybrid_search, with_payload
from lexispark.operators.sparse import postings, stop_words

#: The sample questions and their subjects.
SAMPLE_QUERIES = (
    ("Трудовое право", "Какие права есть у работника при увольнении?"),
    ("Недвижимость", "Как проверить квартиру перед покупкой?"),
    ("Семейное право", "Как рассчитываются алименты?"),
    ("Защита прав", "Как вернуть товар ненадлежащего качества?"),
    ("ДТП и авто", "Что делать после ДТП?"),
    ("Налоги", "Как получить налоговый вычет?"),
    ("Документы", "Как составить исковое заявление?"),
    ("Наследство", "Как вступить в наследство?"),
)


def sample_queries(spark: SparkSession) -> DataFrame:
    """(query_id, subject, query_text) of SAMPLE_QUERIES."""
    return spark.createDataFrame([(i, *q) for i, q in enumerate(SAMPLE_QUERIES)], "query_id bigint, subject string, query_text string")


@dataclass
class Engine:
    """encoder: from a text column to a vector column. The default needs no model and serves tests."""

    spark: SparkSession
    collection: Collection
    config: Config = field(default_factory=Config)
    encoder: Callable[[Column], Column] = hashing_encoder

    @property
    def _stops(self) -> tuple[str, ...]:
        return tuple(stop_words(self.config.sparse.language))

    def _vector(self, text: Column) -> Column:
        v = self.encoder(text)
        return l2_normalize(v) if self.config.embedding.normalize else v

    def points(self, articles: DataFrame) -> DataFrame:
        c = self.config.chunking
        # an article that is not cut is its own point
        whole = not c.enabled or c.strategy == "none"
        points = chunk(articles, c).withColumn("point_id", F.col("article_id").cast("bigint") if whole else F.xxhash64("point_key"))
        return points.withColumn("embedding", self._vector(F.col("chunk_text")))

    def build(self, articles: DataFrame, recreate: bool = True) -> None:
        self.collection.create(self.points(articles), recreate, "chunk_text", self._stops, self.config.sparse.min_token_length)

    def update(self, articles: DataFrame) -> None:
        """Put articles into the collection; all chunks of their earlier texts go."""
        self.collection.upsert(self.points(articles), "chunk_text", self._stops, self.config.sparse.min_token_length)

    def embed(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        return df.withColumn("embedding", self._vector(F.col(text_col))).withColumn("dimension", F.size("embedding"))

    def _hits(self, queries: DataFrame, limit: int, threshold: float | None, where: Column | Mapping | None = None) -> DataFrame:
        asked = queries.where(F.trim("query_text") != "").withColumn("embedding", self._vector(F.col("query_text")))
        c, s, kept = self.collection, self.config.search, None
        points = c.points()
        if where is not None:
            kept = points.where(where) if isinstance(where, Column) else c.points(where)
        if s.hybrid:
            least = self.config.sparse.min_token_length
            words = postings(asked, "query_id", "query_text", self._stops, least, unique=True).select("token")
            hits = hybrid_search(asked, points, s, limit, threshold, None, c.terms(None if isinstance(where, Column) else where), self._stops, least, c.count(), c.frequencies(words), kept)
        else:
            hits = dense_search(asked, points if kept is None else kept, s, limit, threshold)
        return c.with_texts(with_payload(hits, points if kept is None else kept))

    def search(self, queries: DataFrame, limit: int | None = None, threshold: float | None = None, where: Column | Mapping | None = None) -> DataFrame:
        """(query_id, rank, article_id, article_title, article_text, codex, score), each article once. queries: query_id, query_text; where: a column, or a filter as operators.filters reads it."""
        n = int(self.config.search.given(limit, self.config.search.limit))
        hits = dedup_by_article(self._hits(queries, 3 * n, threshold, where), n)
        return hits.select("query_id", "rank", F.col("article_id").cast("bigint"), "article_title", "article_text", "codex", "score")

    def answer(self, queries: DataFrame, limit: int = 5, threshold: float | None = None) -> DataFrame:
        """(query_id, query_text, context_text, relevant_articles); queries without hits have an empty context."""
        got = context.contexts(dedup_by_parent(self._hits(queries, limit, threshold)))
        return queries.select("query_id", "query_text").join(got, "query_id", "left").withColumn("context_text", F.coalesce("context_text", F.lit("")))

    def generate(self, queries: DataFrame, llm: Callable[[str], str] = context.extractive, limit: int = 5, threshold: float | None = None) -> DataFrame:
        """answer() with the model's answer."""
        return context.generate(self.answer(queries, limit, threshold), llm)

    def ask(self, queries: DataFrame, llm: Callable[[str], str] = context.extractive) -> DataFrame:
        """(query_id, query_text, answer, sources): what a chat window asks for, five sources of a score of 0.5 or more."""
        return self.generate(queries, llm, 5, 0.5).select("query_id", "query_text", "answer", F.col("relevant_articles").alias("sources"))

    def health(self) -> DataFrame:
        """One row: status ("healthy", or "not ready" without a collection), points_count."""
        return self.collection.info().select(F.when(F.col("status") == "missing", "not ready").otherwise("healthy").alias("status"), "points_count")

    def evaluate(self, queries: DataFrame, qrels: DataFrame, ks: Sequence[int] = (1, 3, 5, 10, 20), threshold: float | None = 0.0) -> DataFrame:
        """Summary of recall, MRR and nDCG over articles; the fetch depth is max(ks) points."""
        hits = dedup_by_article(self._hits(queries, max(ks), threshold), None)
        return evaluate.summary(evaluate.per_query(hits.select("query_id", F.col("article_id").alias("item_id"), "rank"), qrels, ks))
