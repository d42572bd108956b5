import math

import pytest
from pyspark.sql import functions as F

from lexispark.config import Chunking, Config, Embedding, Search, Sparse
from lexispark.functions import text as T
from lexispark.functions.vectors import pool
from lexispark.operators import evaluate, prepare
from lexispark.operators.chunking import chunk
from lexispark.operators.index import Collection
from lexispark.operators.ranking import dedup_by_article, dedup_by_parent, fuse, minmax
from lexispark.operators.sparse import postings, sparse_leg, terms, vocabulary, with_idf
from lexispark.plans import Engine


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("x")).first()["x"]


def w(n, start=0):
    return " ".join(f"w{i}" for i in range(start, start + n))


@pytest.mark.parametrize(
    "text, size, overlap, expected",
    [
        (w(12), 5, 2, [w(5), w(5, 3), w(5, 6), w(3, 9)]),
        (w(8), 5, 2, [w(5), w(5, 3), w(2, 6)]),
        ("a  b", 5, 2, ["a  b"]),
        ("  ", 5, 2, []),
        (None, 5, 2, []),
    ],
)
def test_fixed_chunks(spark, text, size, overlap, expected):
    assert one(spark, text, T.fixed_chunks(F.col("t"), size, overlap)) == expected


def test_paragraphs(spark):
    assert one(spark, "p1;\np2\n\n\n\n p3 ", T.paragraphs(F.col("t"))) == ["p1", "p2", "p3"]


def test_children_and_parents(spark):
    text = "\n\n".join([w(40), w(40), w(2), w(320)])
    rows = spark.createDataFrame([(1, "1", "t", text, "c")], "article_id int, article_num string, article_title string, article_text string, codex string")
    got = chunk(rows).orderBy("parent_no", "pos").collect()
    assert [(r["child_idx"], len(r["chunk_text"].split()), r["parent_id"]) for r in got] == [(0, 40, "1_p0"), (1, 40, "1_p0"), (2, 150, "1_p0"), (3, 150, "1_p1")]
    short = chunk(rows.withColumn("article_text", F.lit("too short"))).collect()
    assert [(r["parent_id"], r["child_idx"], r["chunk_text"]) for r in short] == [("1_p0", 0, "too short")]
    capped = chunk(rows.withColumn("article_text", F.lit("\n\n".join([w(150)] * 3))), Chunking(parent_max=400)).collect()
    assert len(capped) == 2


def test_configuration_is_checked():
    for bad in (lambda: Chunking(chunk_overlap=500), lambda: Chunking(children_per_parent=1, parent_overlap=True), lambda: Embedding(pooling="sum"), lambda: Sparse(stemming=True)):
        with pytest.raises(ValueError):
            bad()
    assert Search().given(0.0, 0.5) == 0.0 and Search(compat_zero=True).given(0.0, 0.5) == 0.5


def test_tokens(spark):
    assert one(spark, "Статья 12, ЧАСТЬ_2 и я", T.tokens(F.col("t"), ("и", "я"))) == ["статья", "12", "часть_2"]
    assert one(spark, "и я", T.tokens(F.col("t"), ("и", "я"))) == []


def test_sparse_scores(spark):
    docs = spark.createDataFrame([(1, "aa aa bb"), (2, "bb cc")], "point_id int, t string")
    idf = with_idf(vocabulary(postings(docs, "point_id", "t")), 2)
    assert {r["token"]: round(r["idf"], 6) for r in idf.collect()} == {"aa": 0.693147, "bb": 0.182322, "cc": 0.693147}
    asked = postings(spark.createDataFrame([(9, "aa bb")], "query_id int, t string"), "query_id", "t")
    got = {r["point_id"]: r["score"] for r in sparse_leg(asked, terms(docs, "point_id", "t"), 2, 5).collect()}
    assert got == {1: pytest.approx(1.568616, abs=1e-5), 2: pytest.approx(0.182322, abs=1e-5)}


def test_minmax_and_fusion(spark):
    hits = spark.createDataFrame([(1, 1, 2.0), (1, 2, 4.0), (1, 3, 3.0), (2, 1, 5.0), (2, 2, 5.0)], "query_id int, point_id int, score double")
    assert [r["norm"] for r in minmax(hits).orderBy("query_id", "point_id").collect()] == [0.0, 1.0, 0.5, 1.0, 1.0]
    d = spark.createDataFrame([(1, 1, 1.0), (1, 2, 0.0)], hits.schema)
    s = spark.createDataFrame([(1, 2, 1.0), (1, 3, 0.0)], hits.schema)
    assert {r["point_id"]: round(r["score"], 9) for r in fuse(d, s, 0.9).collect()} == {1: 0.9, 2: 0.1, 3: 0.0}


def test_dedup(spark):
    rows = [(1, 1, "1_p0", 1), (1, 1, "1_p1", 2), (1, 2, "2_p0", 3), (1, 1, "1_p0", 4), (1, 3, None, 5), (1, 3, None, 6)]
    hits = spark.createDataFrame(rows, "query_id int, article_id int, parent_id string, rank int")
    assert [r["article_id"] for r in dedup_by_article(hits, 2).orderBy("rank").collect()] == [1, 2]
    assert [r["parent_id"] for r in dedup_by_parent(hits).orderBy("rank").collect()] == ["1_p0", "1_p1", "2_p0", None, None]


@pytest.mark.parametrize(
    "relevant, got, k, recall, mrr, ndcg",
    [
        ([7], [3, 7, 9], 1, 0, 0, 0),
        ([7], [3, 7, 9], 3, 1, 0.5, 0.630930),
        ([1, 2], [1, 3, 2], 3, 1, 1, 0.919721),
        ([1, 1], [1], 2, 1, 1, 0.613147),
        ([7], [3, 7], 0, 0, 0.5, 0),
        ([7], [], 10, 0, 0, 0),
    ],
)
def test_metrics(spark, relevant, got, k, recall, mrr, ndcg):
    hits = spark.createDataFrame([(1, x, i + 1) for i, x in enumerate(got)], "query_id int, item_id int, rank int")
    qrels = spark.createDataFrame([(1, x) for x in relevant], "query_id int, relevant_id int")
    r = evaluate.per_query(hits, qrels, (k,)).first()
    assert (r["recall"], r["mrr"], r["ndcg"]) == (pytest.approx(recall), pytest.approx(mrr), pytest.approx(ndcg, abs=1e-6))


def test_pooling(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0])], "v array<array<double>>, m array<int>")
    row = df.select(*[pool(F.col("v"), F.col("m"), how).alias(how) for how in ("mean", "cls", "max")]).first()
    assert (row["mean"], row["cls"], row["max"]) == ([2.0, 3.0], [1.0, 2.0], [3.0, 4.0])
    with pytest.raises(ValueError):
        pool(F.col("v"), F.col("m"), "sum")


def test_articles(spark):
    text = "вступление\nСтатья 1. " + "а" * 40 + "\nСТАТЬЯ 2.1 " + "б" * 40 + "\nстатья 3: " + "в" * 40 + "\nСтатья 44\nмало"
    got = prepare.split_articles(spark.createDataFrame([("f", text)], "name string, text string")).orderBy("pos").collect()
    assert [r["article_num"] for r in got] == ["1", "2.1", "3"]


def test_classification(spark):
    names = [("Кодекс N 63-ФЗ.rtf", ""), ("x", "ничего"), ("x", "Трудовые отношения")]
    got = spark.createDataFrame(names, "n string, c string").select(prepare.classify_code(F.col("n"), F.col("c")).alias("k")).collect()
    assert [r["k"] for r in got] == ["Уголовный кодекс РФ", prepare.UNKNOWN_CODE, "Трудовой кодекс РФ"]


def test_pairs_keep_the_first(spark):
    rows = [(1, None), (2, "123456789"), (3, "1234567890"), (4, "1234567890")]
    a = spark.createDataFrame([(i, "n", None, "t", "c", q) for i, q in rows], "article_id int, article_num string, article_title string, article_text string, codex string, query_text string")
    assert [(r["query_id"], r["article_title"]) for r in prepare.pairs(a).collect()] == [(3, "")]


def test_engine_end_to_end(spark, tmp_path):
    rows = [(i, str(i), f"title {i}", " ".join([word] * 40), "code") for i, word in enumerate(["alpha", "beta", "gamma", "delta"])]
    articles = spark.createDataFrame(rows, "article_id bigint, article_num string, article_title string, article_text string, codex string")
    e = Engine(spark, Collection(spark, f"file://{tmp_path}", "c"), Config(search=Search(score_threshold=0.5)))
    e.build(articles)
    asked = spark.createDataFrame([(1, "gamma"), (2, "delta beta")], "query_id bigint, query_text string")
    got = e.search(asked, 2).orderBy("query_id", "rank").collect()
    assert got[0]["article_id"] == 2 and {r["article_id"] for r in got if r["query_id"] == 2} <= {1, 3}
    assert "gamma" in e.generate(asked).where("query_id = 1").first()["answer"]
    assert e.collection.info().first()["points_count"] == 4
    e.collection.upsert(e.collection.points().where("article_id = 1").withColumn("chunk_text", F.lit("new")))
    assert e.collection.points().count() == 4 and e.collection.points().where("chunk_text = 'new'").count() == 1
    m = e.evaluate(asked, spark.createDataFrame([(1, 2)], "query_id bigint, relevant_id bigint"), (1,)).where("metric = 'mrr'").first()
    assert math.isclose(m["mean"], 1.0)
