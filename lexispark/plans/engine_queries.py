"""Registered queries that go through the engine, its collections, its sources and sinks; each with its SQL."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.config import Chunking, Config, Search
from lexispark.functions import text as T
from lexispark.functions.vectors import held, l2_normalize, pool
from lexispark.operators import context, evaluate, prepare, questions
from lexispark.operators.blockmax import BlockIndex
from lexispark.operators.chunking import parents
from lexispark.operators.dense import check_dimension, dense_leg, model_encoder
from lexispark.operators.filters import compiled
from lexispark.operators.index import Collection
from lexispark.operators.ivf import InvertedFile, recall
from lexispark.operators.ranking import dedup_by_article
from lexispark.operators.search import dense_search
from lexispark.operators.sparse import first_seen_ids, postings, terms, token_ids
from lexispark.package import ship
from lexispark.plans import Engine
from lexispark.sources import files
from lexispark.storage import saved, shared_folder

LETTERS = "abcdefghijklmnopqrstuvwxyz"
KS = (1, 3, 5, 10, 20)
#: Documents of this source stand for damaged files and failing rows.
DAMAGED = "src7"
NONE = Config(chunking=Chunking(strategy="none"), search=Search(score_threshold=0.05))
FIXED = Config(chunking=Chunking(strategy="fixed"))


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _articles(spark: SparkSession, sf: str) -> DataFrame:
    from lexispark.plans.queries import _articles

    return _articles(spark, sf)


def letters(text):
    """An encoder that SQL can express: how often each letter stands in a text."""
    return held(F.lower(F.coalesce(text, F.lit(""))), lambda low: F.transform(F.array(*map(F.lit, LETTERS)), lambda c: (F.length(low) - F.length(F.replace(low, c, F.lit("")))).cast("double")))


def _engine(spark: SparkSession, config: Config, name: str) -> Engine:
    return Engine(spark, Collection(spark, shared_folder(spark, "index"), name), config, letters)


def _built(spark: SparkSession, sf: str) -> Engine:
    e = _engine(spark, NONE, "whole")
    e.build(_articles(spark, sf))
    return e


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    """The benchmark's texts, and one blank question, which finds nothing."""
    return _table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text")).unionByName(spark.range(1).select(F.lit(-1).cast("bigint").alias("query_id"), F.lit("  ").alias("query_text")))


def engine_search(spark: SparkSession, sf: str) -> DataFrame:
    return _built(spark, sf).search(_questions(spark, sf), 5).select("query_id", "rank", "article_id", "article_title", "codex", F.length("article_text").alias("n_chars"), "score")


def engine_answer(spark: SparkSession, sf: str) -> DataFrame:
    return _built(spark, sf).answer(_questions(spark, sf)).select("query_id", "query_text", "context_text", F.coalesce(F.size("relevant_articles"), F.lit(0)).alias("n_sources"))


def _first_source(prompt: str) -> str:
    if "\nТекст: " not in prompt:
        raise LookupError("no source")
    return context.extractive(prompt)


def engine_generate(spark: SparkSession, sf: str) -> DataFrame:
    return _built(spark, sf).generate(_questions(spark, sf), _first_source).select("query_id", "answer", "answer_error")


def engine_ask(spark: SparkSession, sf: str) -> DataFrame:
    got = _built(spark, sf).ask(_questions(spark, sf))
    return got.select("query_id", "answer", F.coalesce(F.size("sources"), F.lit(0)).alias("n_sources"))


def engine_health(spark: SparkSession, sf: str) -> DataFrame:
    e = _engine(spark, NONE, "health")
    before = saved(e.health(), "health")
    e.build(_articles(spark, sf))
    return before.unionByName(e.health())


def message_times(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "events").select("event_id", context.clock(F.col("ts")).alias("at"))


def engine_evaluate(spark: SparkSession, sf: str) -> DataFrame:
    asked = _questions(spark, sf)
    r = lambda c: F.round(c, 4).alias(c)
    got = _built(spark, sf).evaluate(asked, asked.select("query_id", F.col("query_id").alias("relevant_id")), KS)
    return got.select("metric", "k", r("mean"), r("std"), r("low"), r("high"))


def engine_embed(spark: SparkSession, sf: str) -> DataFrame:
    got = _engine(spark, NONE, "embed").embed(_table(spark, sf, "documents").select("doc_id", "text"))
    return got.select("doc_id", "dimension", F.posexplode("embedding").alias("place", "v")).select("doc_id", "dimension", "place", F.round("v", 6).alias("value"))


def collection_states(spark: SparkSession, sf: str) -> DataFrame:
    """A collection's points when made, after shorter texts of the English articles and new articles, and when dropped."""
    e, a = _engine(spark, FIXED, "states"), _articles(spark, sf)
    english = a.join(_table(spark, sf, "documents").where("lang = 'en'").select(F.col("doc_id").alias("article_id")), "article_id", "left_semi")
    state = lambda step: saved(e.collection.info().select(F.lit(step).alias("step"), "vector_size", "points_count", "status"), "state")
    out = [state("missing")]
    e.build(a)
    out.append(state("made"))
    english = english.withColumn("article_title", F.lit("title"))
    e.update(english.withColumn("article_text", F.lit("short")).unionByName(english.withColumn("article_id", F.col("article_id") + 1_000_000_000).withColumn("article_text", F.lit("new"))))
    out.append(state("updated"))
    e.collection.drop()
    out.append(state("dropped"))
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def collection_deltas(spark: SparkSession, sf: str) -> DataFrame:
    """A collection's points, tokens and deltas: made, after French and German articles got their titles as texts, without the Spanish ones, and compacted."""
    e, a = _engine(spark, NONE, "deltas"), _articles(spark, sf)
    e.collection.max_share, e.collection.parts = 1.0, 8
    of = lambda lang: a.join(_table(spark, sf, "documents").where(F.col("lang") == lang).select(F.col("doc_id").alias("article_id")), "article_id", "left_semi")

    def state(step: str) -> DataFrame:
        rows = e.collection.points().agg(F.count("*").alias("n_points"), F.sum(F.length("chunk_text")).alias("n_chars"))
        tokens = e.collection.frequencies().agg(F.count("*").alias("n_tokens"), F.sum("df").alias("sum_df"))
        return saved(rows.crossJoin(tokens).select(F.lit(step).alias("step"), "*", F.lit(e.collection.count()).cast("bigint").alias("n_kept"), F.lit(len(e.collection.deltas())).alias("n_deltas")), "state")

    e.build(a)
    out = [state("made")]
    for lang in ("fr", "de"):
        e.update(of(lang).withColumn("article_text", F.col("article_title")))
        out.append(state(lang))
    e.collection.delete(of("es"))
    out.append(state("without es"))
    e.collection.compact()
    out.append(state("compacted"))
    return reduce(DataFrame.unionByName, out)


def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Articles written with the raw table's column names and read again."""
    path = shared_folder(spark, "csv")
    back = {v: k for k, v in files.RAW_COLUMNS.items()}
    a = _articles(spark, sf).withColumn("query_text", F.when(F.col("codex") != DAMAGED, F.col("article_title")))
    files.write_csv(a.select(*[F.col(c).alias(back[c]) for c in ("article_num", "article_title", "article_text", "codex", "query_text")]), path)
    return files.read_raw_articles(spark, path).select("article_num", "article_title", "article_text", "codex", "query_text")


def vocabulary_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of the English documents' tokens, written, read and continued for all tokens: what the numbers are like."""
    path = shared_folder(spark, "vocabulary")
    tokens = _table(spark, sf, "documents").select("lang", F.explode(T.tokens(F.col("text"))).alias("token")).distinct()
    files.write_vocabulary(token_ids(tokens.where("lang = 'en'").select("token")), path)
    known = files.read_vocabulary(spark, path)
    every = saved(token_ids(tokens.select("token"), known), "ids")
    same = every.join(known, ["token", "token_id"], "left_semi").agg(F.count("*").alias("n_kept"))
    return every.agg(F.count("*").alias("n_tokens"), F.countDistinct("token_id").alias("n_ids"), F.min("token_id").alias("first_id"), F.max("token_id").alias("last_id")).crossJoin(same)


def _rtf(text: str) -> bytes:
    """A document with a font table, code page bytes for Latin-1 letters, code units for others, and a byte that is no UTF-8."""

    def one(c: str) -> str:
        if c in "\\{}":
            return "\\" + c
        if c == "\n":
            return "\\par "
        return f"\\'{ord(c):02x}" if c < "Ā" else "".join(f"\\u{int.from_bytes(c.encode('utf-16-le')[i : i + 2], 'little', signed=True)}?" for i in range(0, len(c.encode("utf-16-le")), 2))

    text = re.sub(r"[\\{}\n]|[^\x00-\x7f]", lambda m: one(m[0]), text)
    return b"{\\rtf1\\ansi\\ansicpg1252{\\fonttbl{\\f0 Times New Roman;}}\\f0 \xff" + text.encode() + b"}"


def rtf_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as RTF files, some of them damaged, and read again as one folder."""
    ship(spark)
    folder = shared_folder(spark, "rtf")
    docs = _table(spark, sf, "documents").select("doc_id", "text", "source")
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at = pafs.FileSystem.from_uri(folder)
        out.create_dir(at, recursive=True)
        for b in batches:
            for i, text, source in zip(*(b.column(c).to_pylist() for c in range(3))):
                with out.open_output_stream(f"{at}/N {i} +.rtf") as f:
                    f.write(text.encode() if source == DAMAGED else _rtf(text))
            yield pa.RecordBatch.from_arrays([b.column(0)], names=["doc_id"])

    docs.mapInArrow(write, "doc_id bigint").agg(F.count("*")).collect()
    got = files.read_rtf(spark, folder)
    return got.select(F.regexp_extract("name", r"^N (\d+) \+\.rtf$", 1).cast("bigint").alias("doc_id"), "text", F.col("_error").alias("error"))


def rtf_counts(spark: SparkSession, sf: str) -> DataFrame:
    scanned = rtf_scan(spark, sf).withColumnRenamed("error", "_error")
    return files.scan_counts(scanned)


def encode_model(spark: SparkSession, sf: str) -> DataFrame:
    """A model whose token vectors are a word's length and 1, cut to max_length words, mean-pooled."""
    ship(spark)

    def load() -> Callable[[list[str], int], list[tuple[list[list[float]], list[int]]]]:
        def model(texts: list[str], most: int) -> list[tuple[list[list[float]], list[int]]]:
            cut = [t.split()[:most] for t in texts]
            return [([[float(len(w)), 1.0] for w in ws] or [[0.0, 0.0]], [1] * max(1, len(ws))) for ws in cut]

        return model

    from lexispark.config import Embedding

    made = _table(spark, sf, "documents").select("doc_id", model_encoder(load, Embedding(normalize=False))(F.col("text")).alias("v"))
    return made.select("doc_id", F.round(F.get("v", F.lit(0)), 6).alias("mean_length"), F.size("v").alias("dimension"))


def _pooled(how: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        e = check_dimension(_table(spark, sf, "embeddings"), "embedding", 64)
        tokens = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("embedding", i * 16 + 1, F.lit(16)))
        mask = F.array(F.lit(1), F.lit(1), F.col("label") % 2, F.lit(0))
        made = e.select("vec_id", F.posexplode(pool(tokens, mask, how)).alias("place", "v"))
        return made.select("vec_id", "place", F.round(F.col("v").cast("double"), 6).alias("value"))

    return query


def l2_normalized(spark: SparkSession, sf: str) -> DataFrame:
    doubled = F.transform("embedding", lambda x: x.cast("double") * 3)
    return _table(spark, sf, "embeddings").select("vec_id", F.posexplode(l2_normalize(doubled)).alias("place", "v")).select("vec_id", "place", F.round("v", 6).alias("value"))


def chat_format(spark: SparkSession, sf: str) -> DataFrame:
    c = _table(spark, sf, "conversations").where(T.strip(F.col("text")) != "")
    return c.select("conv_id", "turn", "role", T.strip(F.col("text")).alias("content"), context.source_title(F.col("role"), F.col("turn")).alias("title"), context.score_percent(F.col("turn") / F.lit(16.0)).alias("percent"))


def codex_by_content(spark: SparkSession, sf: str) -> DataFrame:
    """Files without a number in their names, whose texts begin with a code's word by their language."""
    d = _table(spark, sf, "documents")
    word = F.when(F.col("lang") == "en", "О Жилищном\n").when(F.col("lang") == "de", "ТРУДОВОЙ кодекс ").when(F.col("lang") == "fr", "Жилищное право ").otherwise("")
    return d.select("doc_id", prepare.classify_code(F.concat(F.lit("файл "), F.col("source")), F.concat(word, F.col("text"))).alias("codex"))


def query_prompts(spark: SparkSession, sf: str) -> DataFrame:
    a = _articles(spark, sf).withColumn("query_text", F.when(F.col("codex") != DAMAGED, F.lit("known")))
    return context.query_generation_prompts(a, "Text:\n{text}\n---")


#: A nested filter, as a client would send it.
FILTER = {
    "must": [{"should": [{"key": "lang", "match": {"value": "en"}}, {"key": "source", "match": {"any": ["src1", "src2", "src3"]}}]}, {"key": "n_chars", "range": {"gte": 200, "lt": 20000}}],
    "must_not": [{"key": "source", "match": {"value": DAMAGED}}, {"must": [{"key": "lang", "match": {"except": ["de", "en"]}}, {"key": "n_chars", "range": {"gt": 3000}}]}],
}


def filter_nested(spark: SparkSession, sf: str) -> DataFrame:
    d = _table(spark, sf, "documents")
    return d.where(compiled(FILTER, d, "doc_id")).select("doc_id", "lang", "source", "n_chars")


def engine_search_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """engine_search among the articles that a filter keeps; frequencies are of all."""
    keep = {"must": [{"key": "codex", "match": {"except": [DAMAGED]}}], "must_not": [{"key": "article_id", "range": {"lt": 100}}]}
    return _built(spark, sf).search(_questions(spark, sf), 5, where=keep).select("query_id", "rank", "article_id", "score")


def sparse_topk_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """sparse_topk by postings in blocks, of which only those are scored whose bounds reach the kth score."""
    return _blocks(spark, sf)[0]


def sparse_blocks_read(spark: SparkSession, sf: str) -> DataFrame:
    """For each question, how many blocks have one of its tokens and how many were scored."""
    return _blocks(spark, sf)[1]


def _blocks(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    d = _table(spark, sf, "documents").withColumnRenamed("doc_id", "point_id")
    index = BlockIndex(spark, shared_folder(spark, "blocks"))
    index.build(terms(d, "point_id", "text"))
    asked = postings(_table(spark, sf, "benchmark").withColumnRenamed("item_id", "query_id"), "query_id", "text", unique=True)
    return index.leg(asked, d.count(), 30)


def ivf_recall(spark: SparkSession, sf: str) -> DataFrame:
    """The recall of each query's ten closest vectors by the inverted file."""
    e = _table(spark, sf, "embeddings").select(F.col("vec_id").alias("point_id"), "embedding")
    asked = e.where("point_id % 100 = 0").withColumnRenamed("point_id", "query_id")
    index = InvertedFile(spark, shared_folder(spark, "ivf"))
    index.build(e)
    return recall(index.leg(asked, 10, PROBES), dense_leg(asked, e, 10))


#: Cells of an inverted file's 128 that a search of vectors without clusters probes.
PROBES = 64


def vocabulary_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids by first occurrence over documents in the order of their ids."""
    d = _table(spark, sf, "documents").select("doc_id", T.tokens(F.col("text")).alias("ts"))
    return first_seen_ids(d, "doc_id")


TEMPLATE = "Text:\n{text}\n---"


def queries_filled(spark: SparkSession, sf: str) -> DataFrame:
    """Questions for all documents: the first run's model fails at every third length, the second run asks for those alone."""
    a = _articles(spark, sf).withColumn("query_text", F.lit(None).cast("string"))
    folder = shared_folder(spark, "questions")

    def first(prompt: str) -> str:
        if len(prompt) % 3 == 0:
            raise LookupError("busy")
        return f"1: {prompt[6:26]}"

    questions.ask(a, folder, first, TEMPLATE)
    questions.ask(a, folder, lambda prompt: f"2: {prompt[6:26]}", TEMPLATE)
    return questions.filled(a, folder, TEMPLATE).select("article_id", "query_text")


def rows_with_nulls(spark: SparkSession, sf: str) -> DataFrame:
    d = _table(spark, sf, "documents").select("doc_id", F.nullif(F.col("lang"), F.lit("de")).alias("lang"), F.nullif(F.col("source"), F.lit(DAMAGED)).alias("source"))
    return prepare.any_null(d)


def removed_counts(spark: SparkSession, sf: str) -> DataFrame:
    a = _articles(spark, sf).withColumn("query_text", F.col("article_text"))
    return prepare.removed(a, prepare.pairs(a))


def profile_report(spark: SparkSession, sf: str) -> DataFrame:
    p = prepare.profile(_articles(spark, sf))
    row = lambda df, section, key: df.select(F.lit(section).alias("section"), key.cast("string").alias("key"), F.col("n").cast("bigint").alias("n"))
    some = lambda name: row(p[name].select("codex", F.col("article_id").alias("n")), name, F.col("codex"))
    return row(p["total"], "total", F.lit("all")).unionByName(row(p["by_code"], "by_code", F.col("codex"))).unionByName(some("head")).unionByName(some("sample"))


def threshold_modes(spark: SparkSession, sf: str) -> DataFrame:
    """A limit and a threshold of 0 are 0, or with compat_zero not given."""
    e = _table(spark, sf, "embeddings").select(F.col("vec_id").alias("point_id"), "embedding")
    asked = e.where("point_id % 100 = 0").withColumnRenamed("point_id", "query_id")
    one = lambda mode, s: dense_search(asked, e, s, 7, 0.0).withColumn("mode", F.lit(mode))
    both = one("strict", Search(score_threshold=0.3)).unionByName(one("compat", Search(score_threshold=0.3, compat_zero=True)))
    return both.select("mode", "query_id", "point_id", "score", "rank")


def dedup_null_articles(spark: SparkSession, sf: str) -> DataFrame:
    """The best hit of each label; label 0 stands for an unknown article."""
    e = _table(spark, sf, "embeddings").select(F.col("vec_id").alias("point_id"), "embedding", F.nullif("label", F.lit(0)).alias("article_id"))
    hits = dense_leg(e.where("point_id % 100 = 0").withColumnRenamed("point_id", "query_id"), e, 50)
    return dedup_by_article(hits.join(e.select("point_id", "article_id"), "point_id"), None).select("query_id", "article_id", "point_id", "rank")


def parents_capped(spark: SparkSession, sf: str) -> DataFrame:
    """Parents of more than 60 words keep two of their children."""
    c = Chunking(separators=("\n", "\n"), parent_max=60)
    return parents(_articles(spark, sf), c).select("article_id", "p.parent_id", "p.parent_text", F.size("p.children").cast("bigint").alias("n_children"))


def _negatives(how: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        a = _articles(spark, sf)
        # each text once is a batch of pairs
        mine = prepare.pairs(a.withColumn("query_text", F.col("article_text"))) if how == "in_batch" else a.withColumn("query_id", F.col("article_id"))
        mine = mine.select("query_id", "article_id")
        return prepare.negatives(mine, a, how=how, ring=100)

    return query


def eval_log(spark: SparkSession, sf: str) -> DataFrame:
    from lexispark.plans.queries import _eval

    path = shared_folder(spark, "runs")
    whole = saved(evaluate.summary(_eval(spark, sf)), "summary")
    for run in ("first", "second"):
        evaluate.log_run(whole, path, run, {"k": "50"})
    r = lambda c: F.round(c, 4).alias(c)
    return spark.read.parquet(path).select("run_id", "metric", "k", r("mean"), F.element_at("parameters", F.lit("k")).alias("depth"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = (engine_search, engine_answer, engine_generate, engine_ask, engine_health, message_times, engine_evaluate, engine_embed, collection_states, collection_deltas, csv_round_trip, vocabulary_round_trip, rtf_scan, rtf_counts, encode_model, l2_normalized, chat_format, codex_by_content, query_prompts, rows_with_nulls, removed_counts, profile_report, threshold_modes, dedup_null_articles, parents_capped, eval_log, filter_nested, engine_search_filtered, sparse_topk_blocks, sparse_blocks_read, ivf_recall, vocabulary_first_seen, queries_filled)
    out = {f.__name__: f for f in plain} | {f"pool_{how}": _pooled(how) for how in ("mean", "cls", "max")}
    return out | {"negatives_random": _negatives("random"), "negatives_in_batch": _negatives("in_batch")}


def oracle_sql() -> dict[str, str]:
    from lexispark.plans.queries import _ART, _ASKED, _IDF, _METRICS, _WORDS, _children_sql, _dense_sql, _sparse, _tf

    rank = "CAST(rank AS INTEGER) AS rank"
    low = "lower(coalesce({0}, ''))"
    vector = "list_transform(['" + "','".join(LETTERS) + "'], lambda c: CAST(length({0}) - length(replace({0}, c, '')) AS DOUBLE))"
    embed = lambda t: vector.format(low.format(t))
    asked = "(SELECT item_id AS query_id, text AS query_text FROM benchmark)"
    points = f"(SELECT *, article_id AS point_id, concat_ws(' ', coalesce(article_title, ''), coalesce(article_text, '')) AS chunk_text FROM {_ART})"
    scale = lambda leg: f"(SELECT query_id, point_id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS s FROM {leg} WINDOW w AS (PARTITION BY query_id))"

    def hits(limit: int, threshold: float, where: str = "TRUE") -> str:
        """CTEs of the fused hits(query_id, point_id, score, rank, and the article)."""
        k = 3 * limit
        return f"""pts AS (SELECT *, {embed("chunk_text")} AS v FROM {points}), qs AS (SELECT *, {embed("query_text")} AS v FROM {asked}),
dl AS (SELECT query_id, point_id, round(list_inner_product(qs.v, pts.v) / greatest(sqrt(list_inner_product(qs.v, qs.v)) * sqrt(list_inner_product(pts.v, pts.v)), 1e-12), 6) AS score FROM qs, pts WHERE {where}),
d AS (SELECT * FROM dl WHERE score >= 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) <= {k}),
post AS ({_tf("pts", "point_id", "chunk_text")}), dfs AS (SELECT token, count(*) AS df FROM post GROUP BY token), total AS (SELECT count(*)::DOUBLE AS n FROM pts),
idf AS (SELECT token, {_IDF} AS idf FROM dfs, total), qp AS ({_tf("qs", "query_id", "query_text")}),
sl AS (SELECT query_id, point_id, round(sum(a.tf * i.idf * p.tf), 6) AS score FROM qp a JOIN idf i USING (token) JOIN post p USING (token) WHERE point_id IN (SELECT point_id FROM pts WHERE {where}) GROUP BY ALL),
s AS (SELECT * FROM sl QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) <= {k}),
fused AS (SELECT query_id, point_id, round(0.9::DOUBLE * coalesce(x.s, 0) + (1.0::DOUBLE - 0.9::DOUBLE) * coalesce(y.s, 0), 6) AS score FROM {scale("d")} x FULL JOIN {scale("s")} y USING (query_id, point_id)),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM fused WHERE score >= {threshold}),
hits AS (SELECT top.*, article_id, article_title, article_text, codex FROM top JOIN pts USING (point_id) WHERE rank <= {limit})"""

    part = "'Статья ' || article_id || ' (' || coalesce(codex, '') || '):' || chr(10) || 'Название: ' || coalesce(article_title, '') || chr(10) || 'Текст: ' || coalesce(article_text, '') || chr(10) || 'Релевантность: ' || CAST(CAST(round(CAST(score AS DECIMAL(18, 6)), 4) AS DECIMAL(18, 4)) AS VARCHAR) || chr(10)"
    every = f"(SELECT query_id, query_text FROM {asked} UNION ALL SELECT -1, '  ')"
    ks = ", ".join(map(str, KS))
    words = lambda t: _WORDS.format(t)
    chunks = f"(SELECT *, {words('chunk_text')} AS ws FROM {points})"
    n_chunks = "CASE WHEN len(ws) = 0 THEN 0 WHEN len(ws) <= 500 THEN 1 ELSE (len(ws) + 449) // 450 END"
    tidy = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, ' +', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '^[\s\x{00a0}]+', ''), '[\s\x{00a0}]+$', '')"
    pooled = lambda expression: f"SELECT vec_id, CAST(d AS INTEGER) AS place, round(CAST({expression} AS DOUBLE), 6) AS value FROM (SELECT vec_id, embedding::DOUBLE[] AS e, label % 2 AS m, unnest(range(16)) AS d FROM embeddings)"
    at = lambda i: f"e[{16 * i} + d + 1]"
    key = lambda c, seed, of: f"((({c} % {of}) * 7919 + {seed} * 104729) % {of})"

    def ringed(source: str) -> str:
        return f"""WITH c AS ({source}), rings AS (SELECT greatest(1, count(*) // 100) AS n_rings FROM c),
r AS (SELECT article_id, {key("article_id", 42, 1000003)} % n_rings AS ring FROM c, rings),
p AS (SELECT *, row_number() OVER (PARTITION BY ring ORDER BY {key("article_id", 42, 10007)}, article_id) - 1 AS place, count(*) OVER (PARTITION BY ring) AS n FROM r)
SELECT a.article_id AS query_id, a.article_id, b.article_id AS negative_id FROM p a, range(1, 5) s(step), p b WHERE step < a.n AND b.ring = a.ring AND b.place = (a.place + step) % a.n"""

    strip = r"regexp_replace(regexp_replace(text, '^[\s\x{00a0}]+', ''), '[\s\x{00a0}]+$', '')"
    codes = prepare.CODE_NUMBERS
    by_content = " ".join(f"WHEN h LIKE '%{stem}%' THEN '{codes[n]}'" for stem, n in prepare.CONTENT_STEMS)
    tests = [(f"lower(f) LIKE '%{stem}%' OR f LIKE '%{n}%'" if stem else f"f LIKE '%{n}%'", n) for stem, n in prepare.NAME_STEMS]
    by_name = " ".join(f"WHEN {test} THEN '{codes[n]}'" for test, n in tests)
    capped = f"""WITH {_children_sql()}, counted_kids AS (SELECT *, len({words("child_text")}) AS n FROM kids), sized AS (SELECT id, max(pos) + 1 AS n FROM kids GROUP BY id),
starts AS (SELECT id, unnest(range(0, n, 3)) AS start FROM sized),
whole AS (SELECT s.id, s.start, sum(k.n) AS words FROM starts s JOIN counted_kids k ON k.id = s.id AND k.pos >= s.start AND k.pos < s.start + 3 GROUP BY ALL)
SELECT w.id AS article_id, w.id || '_p' || (w.start // 3) AS parent_id, string_agg(k.child_text, chr(10) || chr(10) ORDER BY k.pos) AS parent_text, count(*) AS n_children
FROM whole w JOIN kids k ON k.id = w.id AND k.pos >= w.start AND k.pos < w.start + CASE WHEN w.words > 60 THEN 2 ELSE 3 END GROUP BY w.id, w.start
UNION ALL SELECT doc_id, doc_id || '_p0', text, 1 FROM documents WHERE doc_id NOT IN (SELECT id FROM sized)"""
    out = {
        "engine_search": f"WITH {hits(15, 0.05)}, once AS (SELECT *, row_number() OVER (PARTITION BY query_id, article_id ORDER BY rank) AS n FROM hits QUALIFY n = 1) SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY once.rank) AS INTEGER) AS rank, article_id, article_title, codex, CAST(length(article_text) AS INTEGER) AS n_chars, score FROM once QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY once.rank) <= 5",
        "engine_search_filtered": f"WITH {hits(15, 0.05, f"codex <> '{DAMAGED}' AND article_id >= 100")}, once AS (SELECT *, row_number() OVER (PARTITION BY query_id, article_id ORDER BY rank) AS n FROM hits QUALIFY n = 1) SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY once.rank) AS INTEGER) AS rank, article_id, score FROM once QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY once.rank) <= 5",
        "filter_nested": f"SELECT doc_id, lang, source, n_chars FROM documents WHERE (lang = 'en' OR source IN ('src1', 'src2', 'src3')) AND n_chars >= 200 AND n_chars < 20000 AND coalesce(source, '') <> '{DAMAGED}' AND NOT (coalesce(lang NOT IN ('de', 'en'), FALSE) AND coalesce(n_chars > 3000, FALSE))",
        "sparse_topk_blocks": f"WITH {_sparse(_tf('(SELECT doc_id AS point_id, text FROM documents)', 'point_id', 'text'), 'documents', _tf(_ASKED, 'query_id', 'text'), 30)} SELECT query_id, point_id, score, {rank} FROM sparse_hits",
        "vocabulary_first_seen": "WITH d AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda t: length(t) >= 2) AS ts FROM documents), p AS (SELECT doc_id, unnest(ts) AS token, unnest(range(len(ts))) AS place FROM d), f AS (SELECT token, min((doc_id, place)) AS m FROM p GROUP BY token) SELECT token, row_number() OVER (ORDER BY m) - 1 AS token_id FROM f",
        "queries_filled": "WITH p AS (SELECT doc_id, 'Text:' || chr(10) || substr(text, 1, 8000) || chr(10) || '---' AS prompt FROM documents) SELECT doc_id AS article_id, CASE WHEN length(prompt) % 3 = 0 THEN '2: ' ELSE '1: ' END || substr(prompt, 7, 20) AS query_text FROM p",
        "engine_answer": f"WITH {hits(5, 0.05)}, c AS (SELECT query_id, string_agg({part}, chr(10) || '---' || chr(10) ORDER BY rank) AS context_text, count(*) AS n FROM hits GROUP BY query_id) SELECT query_id, query_text, coalesce(context_text, '') AS context_text, CAST(coalesce(n, 0) AS INTEGER) AS n_sources FROM {every} LEFT JOIN c USING (query_id)",
        "engine_generate": f"WITH {hits(5, 0.05)}, c AS (SELECT query_id, article_text FROM hits WHERE rank = 1) SELECT query_id, coalesce(article_text, '') AS answer, CASE WHEN c.query_id IS NULL THEN 'LookupError: no source' END AS answer_error FROM {every} LEFT JOIN c USING (query_id)",
        "engine_ask": f"WITH {hits(5, 0.5)}, c AS (SELECT query_id, first(article_text ORDER BY rank) AS answer, count(*) AS n FROM hits GROUP BY query_id) SELECT query_id, coalesce(answer, '') AS answer, CAST(coalesce(n, 0) AS INTEGER) AS n_sources FROM {every} LEFT JOIN c USING (query_id)",
        "engine_health": "SELECT 'not ready' AS status, CAST(0 AS BIGINT) AS points_count UNION ALL SELECT 'healthy', count(*) FROM documents",
        "message_times": "SELECT event_id, strftime(ts, '%H:%M') AS at FROM events",
        "engine_evaluate": f"""WITH {hits(max(KS), 0.0)}, ks AS (SELECT unnest([{ks}]) AS k), good AS (SELECT query_id, rank FROM hits WHERE article_id = query_id),
m AS (SELECT e.query_id, k, CASE WHEN rank <= k THEN 1.0::DOUBLE ELSE 0 END AS recall, round(CASE WHEN rank <= k THEN 1.0::DOUBLE / rank ELSE 0 END, 6) AS mrr, round(CASE WHEN rank <= k THEN 1 / log2(rank + 1) ELSE 0 END, 6) AS ndcg FROM {every} e CROSS JOIN ks LEFT JOIN good USING (query_id)),
l AS (SELECT 'recall' AS metric, k, recall AS v FROM m UNION ALL SELECT 'mrr', k, mrr FROM m UNION ALL SELECT 'ndcg', k, ndcg FROM m)
SELECT metric, CAST(k AS INTEGER) AS k, round(round(avg(v), 6), 4) AS mean, round(round(stddev_pop(v), 6), 4) AS std, round(min(v), 4) AS low, round(max(v), 4) AS high FROM l GROUP BY 1, 2""",
        "engine_embed": f"WITH e AS (SELECT doc_id, {embed('text')} AS v FROM documents) SELECT doc_id, CAST({len(LETTERS)} AS INTEGER) AS dimension, CAST(unnest(range({len(LETTERS)})) AS INTEGER) AS place, round(unnest(v) / greatest(sqrt(list_inner_product(v, v)), 1e-12), 6) AS value FROM e",
        "collection_states": f"""WITH c AS (SELECT article_id, {n_chunks} AS n FROM {chunks}), en AS (SELECT doc_id FROM documents WHERE lang = 'en')
SELECT 'missing' AS step, CAST(NULL AS INTEGER) AS vector_size, CAST(0 AS BIGINT) AS points_count, 'missing' AS status UNION ALL
SELECT 'made', {len(LETTERS)}, CAST(sum(n) AS BIGINT), 'green' FROM c UNION ALL
SELECT 'updated', {len(LETTERS)}, CAST(coalesce(sum(n), 0) + 2 * (SELECT count(*) FROM en) AS BIGINT), 'green' FROM c WHERE article_id NOT IN (SELECT doc_id FROM en) UNION ALL
SELECT 'dropped', NULL, 0, 'missing'""",
        "collection_deltas": " UNION ALL ".join(
            f"""SELECT '{step}' AS step, (SELECT count(*) FROM {rows}) AS n_points, (SELECT CAST(sum(length(chunk_text)) AS BIGINT) FROM {rows}) AS n_chars,
(SELECT count(DISTINCT token) FROM ({_tf(rows, "article_id", "chunk_text")})) AS n_tokens, (SELECT count(*) FROM ({_tf(rows, "article_id", "chunk_text")})) AS sum_df, (SELECT count(*) FROM {rows}) AS n_kept, CAST({n} AS INTEGER) AS n_deltas"""
            for step, short, without, n in (("made", "''", "''", 0), ("fr", "'fr'", "''", 1), ("de", "'fr', 'de'", "''", 2), ("without es", "'fr', 'de'", "'es'", 3), ("compacted", "'fr', 'de'", "'es'", 0))
            for rows in (f"(SELECT article_id, concat_ws(' ', coalesce(article_title, ''), CASE WHEN d.lang IN ({short}) THEN coalesce(article_title, '') ELSE coalesce(article_text, '') END) AS chunk_text FROM {_ART} a JOIN documents d ON d.doc_id = a.article_id WHERE coalesce(d.lang, '') NOT IN ({without}, '-'))",)
        ),
        "csv_round_trip": f"SELECT article_num, article_title, article_text, codex, CASE WHEN codex <> '{DAMAGED}' THEN article_title END AS query_text FROM {_ART}",
        "vocabulary_round_trip": "WITH t AS (SELECT DISTINCT lang, token FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS token FROM documents) WHERE length(token) >= 2) SELECT count(DISTINCT token) AS n_tokens, count(DISTINCT token) AS n_ids, CAST(0 AS BIGINT) AS first_id, count(DISTINCT token) - 1 AS last_id, count(DISTINCT CASE WHEN lang = 'en' THEN token END) AS n_kept FROM t",
        "rtf_scan": f"SELECT doc_id, CASE WHEN source <> '{DAMAGED}' THEN {tidy} END AS text, CASE WHEN source = '{DAMAGED}' THEN 'not an RTF file' END AS error FROM documents",
        "rtf_counts": f"SELECT count(*) AS n_files, count(*) FILTER (source <> '{DAMAGED}') AS n_good, count(*) FILTER (source = '{DAMAGED}') AS n_bad FROM documents",
        "encode_model": f"WITH w AS (SELECT doc_id, ({words('text')})[1:256] AS ws FROM documents) SELECT doc_id, round(CASE WHEN len(ws) = 0 THEN 0.0::DOUBLE ELSE CAST(list_sum(list_transform(ws, lambda x: length(x))) AS DOUBLE) / len(ws) END, 6) AS mean_length, CAST(2 AS INTEGER) AS dimension FROM w",
        "l2_normalized": "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT vec_id, CAST(unnest(range(len(v))) AS INTEGER) AS place, round(unnest(v) / greatest(sqrt(list_inner_product(v, v)), 1e-12), 6) AS value FROM e",
        "pool_mean": pooled(f"({at(0)} + {at(1)} + m * {at(2)}) / (2 + m)"),
        "pool_cls": pooled(at(0)),
        "pool_max": pooled(f"greatest({at(0)}, {at(1)}, CASE WHEN m = 1 THEN {at(2)} ELSE -1e9 END)"),
        "chat_format": f"SELECT conv_id, turn, role, {strip} AS content, role || ' - Статья ' || turn AS title, CAST(CAST(round(CAST(turn * 6.25 AS DECIMAL(18, 4)), 1) AS DECIMAL(18, 1)) AS VARCHAR) AS percent FROM conversations WHERE {strip} <> ''",
        "codex_by_content": f"WITH n AS (SELECT doc_id, 'файл ' || source AS f, lower(substr(CASE lang WHEN 'en' THEN 'О Жилищном' || chr(10) WHEN 'de' THEN 'ТРУДОВОЙ кодекс ' WHEN 'fr' THEN 'Жилищное право ' ELSE '' END || text, 1, 1000)) AS h FROM documents) SELECT doc_id, CASE {by_content} {by_name} ELSE '{prepare.UNKNOWN_CODE}' END AS codex FROM n",
        "query_prompts": f"SELECT doc_id AS article_id, 'Text:' || chr(10) || substr(text, 1, 8000) || chr(10) || '---' AS prompt FROM documents WHERE source = '{DAMAGED}'",
        "rows_with_nulls": f"SELECT doc_id, nullif(lang, 'de') AS lang, nullif(source, '{DAMAGED}') AS source FROM documents WHERE lang = 'de' OR lang IS NULL OR source = '{DAMAGED}' OR source IS NULL",
        "removed_counts": "SELECT count(*) AS n_before, count(DISTINCT CASE WHEN length(text) >= 10 THEN text END) AS n_after, count(*) - count(DISTINCT CASE WHEN length(text) >= 10 THEN text END) AS n_removed FROM documents",
        "profile_report": "SELECT 'total' AS section, 'all' AS key, count(*) AS n FROM documents UNION ALL SELECT 'by_code', source, count(*) FROM documents GROUP BY source UNION ALL (SELECT 'head', source, doc_id FROM documents ORDER BY doc_id LIMIT 5) UNION ALL (SELECT 'sample', source, doc_id FROM documents ORDER BY ((doc_id % 1000003) * 7919 + 42 * 104729) % 1000003, doc_id LIMIT 5)",
        "threshold_modes": f"WITH {_dense_sql('Cosine', 7)} SELECT 'strict' AS mode, query_id, point_id, score, {rank} FROM dense_hits UNION ALL SELECT 'compat', query_id, point_id, score, {rank} FROM dense_hits WHERE score >= 0.3",
        "dedup_null_articles": f"WITH {_dense_sql('Cosine', 50)}, h AS (SELECT d.*, nullif(label, 0) AS article_id FROM dense_hits d JOIN embeddings e ON e.vec_id = d.point_id), f AS (SELECT *, row_number() OVER (PARTITION BY query_id, article_id ORDER BY rank) AS n FROM h WHERE article_id IS NOT NULL QUALIFY n = 1) SELECT query_id, article_id, point_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY f.rank) AS INTEGER) AS rank FROM f",
        "parents_capped": capped,
        "negatives_random": ringed("SELECT doc_id AS article_id FROM documents"),
        "negatives_in_batch": ringed("SELECT min(doc_id) AS article_id FROM documents WHERE length(text) >= 10 GROUP BY text"),
        "eval_log": f"WITH {_METRICS}, l AS (SELECT 'recall' AS metric, k, recall AS v FROM m UNION ALL SELECT 'mrr', k, mrr FROM m UNION ALL SELECT 'ndcg', k, ndcg FROM m) SELECT run_id, metric, k, round(round(avg(v), 6), 4) AS mean, '50' AS depth FROM l, (SELECT unnest(['first', 'second']) AS run_id) GROUP BY ALL",
    }
    return out
