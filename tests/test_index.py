"""Collections, the legs of a search, streams and plans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark.config import Chunking, Config, Embedding, Generator, Search
from lexispark.functions.vectors import pool
from lexispark.operators import context
from lexispark.operators.dense import check_dimension, dense_leg, encode, lsh_leg, model_encoder
from lexispark.operators.index import Collection, upsert
from lexispark.operators.search import hybrid_search
from lexispark.operators.sparse import postings, sparse_leg, terms
from lexispark.plans import Engine, sample_queries
from lexispark.streaming import index_stream

ARTICLES = "article_id bigint, article_num string, article_title string, article_text string, codex string"


def articles(spark, texts):
    return spark.createDataFrame([(i, str(i), f"title {i}", t, "code") for i, t in texts.items()], ARTICLES)


def words(word, n=40):
    return " ".join([word] * n)


def engine(spark, tmp_path, name="c"):
    return Engine(spark, Collection(spark, f"file://{tmp_path}", name, parts=4), Config(search=Search(score_threshold=0.1)))


def test_updates_drop_old_chunks(spark, tmp_path):
    e = engine(spark, tmp_path)
    e.build(articles(spark, {1: "\n\n".join(map(words, ["alpha", "beta", "gamma"])), 2: words("delta"), 3: words("omega")}))
    c = e.collection
    assert c.points().count() == 5
    before = c._listed()
    e.update(articles(spark, {1: words("short"), 9: words("new")}))
    assert sorted(r["chunk_text"].split()[0] for r in c.points().collect()) == ["delta", "new", "omega", "short"]
    assert {r["token"] for r in c.postings().collect()} == {"delta", "new", "omega", "short"}
    kept = {p for p, v in c._listed().items() if before.get(p) == v}
    assert kept  # the parts that the update does not touch are not written again
    found = lambda text: [r["article_id"] for r in e.search(spark.createDataFrame([(1, text)], "query_id bigint, query_text string"), 1).collect()]
    assert found("short") == [1] and found("new") == [9]
    c.vacuum()
    assert c.points().count() == 4 and c.terms().count() == 4
    e.update(articles(spark, {}))
    assert c.points().count() == 4


def test_a_failed_write_keeps_the_collection(spark, tmp_path):
    e = engine(spark, tmp_path)
    e.build(articles(spark, {1: words("alpha")}))
    fails = articles(spark, {2: "x"}).withColumn("codex", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        e.build(fails)
    assert [r["article_id"] for r in e.collection.points().collect()] == [1]
    e.build(articles(spark, {3: words("gamma")}))
    assert [r["article_id"] for r in e.collection.points().collect()] == [3]
    e.collection.create(e.points(articles(spark, {4: "x"})))  # it exists, so nothing happens
    assert e.collection.info().first()["points_count"] == 1
    kept = e.collection.cache()
    assert kept[0].is_cached
    other = spark.range(3).persist()
    e.collection.close()
    assert other.is_cached and not kept[0].is_cached
    other.unpersist()
    e.collection.drop()
    assert tuple(e.collection.info().first()) == ("c", None, 0, "missing")


def test_empty_collections(spark, tmp_path):
    e = engine(spark, tmp_path)
    e.build(articles(spark, {}))
    asked = spark.createDataFrame([(1, "alpha")], "query_id bigint, query_text string")
    assert e.collection.points().count() == 0 and e.search(asked).count() == 0
    assert e.search(asked.where("false")).count() == 0
    assert e.answer(asked).first()["context_text"] == ""


def test_ties_of_upsert_have_an_order(spark):
    old = spark.createDataFrame([(1, "a")], "point_id int, v string")
    new = spark.createDataFrame([(1, "b", 3), (1, "c", 3), (1, "d", 2), (2, "e", None), (2, "e", None)], "point_id int, v string, batch int")
    got = [sorted((r["point_id"], r["v"]) for r in upsert(old, new.repartition(n, "v")).collect()) for n in (1, 3)]
    assert got[0] == got[1] and got[0][0][1] in "bc" and got[0][1] == (2, "e")


def test_streams_embed_and_replace(spark, tmp_path):
    source, c = tmp_path / "in", Collection(spark, f"file://{tmp_path}", "s", parts=4)
    articles(spark, {1: "\n\n".join(map(words, ["alpha", "beta"])), 2: words("gamma")}).write.parquet(str(source))
    stream = lambda: spark.readStream.schema(ARTICLES).parquet(str(source))
    index_stream(stream(), c, f"{tmp_path}/cp").awaitTermination()
    assert c.points().count() == 3 and c.points().where("embedding is null").count() == 0
    articles(spark, {1: words("omega")}).write.mode("append").parquet(str(source))
    index_stream(stream(), c, f"{tmp_path}/cp").awaitTermination()
    assert sorted(r["chunk_text"].split()[0] for r in c.points().collect()) == ["gamma", "omega"]
    got = Engine(spark, c, Config(search=Search(hybrid=False, score_threshold=0.5))).search(spark.createDataFrame([(1, "omega")], "query_id bigint, query_text string"), 1)
    assert [r["article_id"] for r in got.collect()] == [1]


def vectors(spark, m, name):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], f"{name} bigint, embedding array<float>")


@pytest.mark.parametrize("distance", ["Cosine", "Dot", "Euclid", "other"])
def test_dense_leg_equals_brute_force(spark, distance):
    rng = np.random.default_rng(3)
    p, q = np.round(rng.normal(size=(300, 8)), 2), np.round(rng.normal(size=(7, 8)), 2)
    p[50:90] = p[50]  # ties
    p[3] = 0
    s = {"Dot": q @ p.T, "Euclid": -np.linalg.norm(q[:, None] - p, axis=2)}.get(distance, q @ p.T / np.maximum(np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(p, axis=1), 1e-12))
    points = vectors(spark, p, "point_id").unionByName(spark.createDataFrame([(999, None)], "point_id bigint, embedding array<float>")).repartition(3)
    got = dense_leg(vectors(spark, q, "query_id"), points, 45, distance, pass_bytes=8 * 8 * 3).collect()
    for i in range(7):
        want = sorted((-round(float(x), 5), j) for j, x in enumerate(s[i]) if distance == "Euclid" or x >= 0)[:45]
        mine = sorted((r["rank"], r["score"], r["point_id"]) for r in got if r["query_id"] == i)
        assert [r for r, _, _ in mine] == list(range(1, len(mine) + 1)) and len(mine) == len(want)
        assert [round(x, 5) for _, x, _ in mine] == pytest.approx([-x for x, _ in want], abs=2e-5)
        tied = [j for _, _, j in mine if 50 <= j < 90]
        assert tied == sorted(tied) and tied == list(range(50, 50 + len(tied)))


def test_dense_leg_of_nothing(spark):
    p, none = vectors(spark, [[1, 0]], "point_id"), vectors(spark, [[1, 0]], "query_id").where("false")
    assert dense_leg(none, p, 5).count() == 0 and dense_leg(vectors(spark, [[1, 0]], "query_id"), p.where("false"), 5).count() == 0
    with pytest.raises(Exception, match="must have 2 numbers"):
        dense_leg(vectors(spark, [[1, 0]], "query_id"), vectors(spark, [[1, 0, 0]], "point_id"), 5).collect()
    assert check_dimension(p, "embedding", 2).count() == 1
    with pytest.raises(Exception, match="must have 3 numbers"):
        check_dimension(p, "embedding", 3).collect()


def test_lsh_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("point_id"), "embedding")
    asked = e.where("point_id % 100 = 0").withColumnRenamed("point_id", "query_id")
    exact, near = ({(r["query_id"], r["point_id"]) for r in leg(asked, e, 10).collect()} for leg in (dense_leg, lsh_leg))
    assert len(exact & near) >= 0.9 * len(exact)


@pytest.mark.parametrize("counted", [False, True])
def test_sparse_leg_equals_a_join(spark, counted):
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(30)], rng.integers(0, 25))) for _ in range(120)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "point_id bigint, text string").repartition(3)
    asked = postings(spark.createDataFrame([(i, texts[i] + " unseen") for i in range(5)], "query_id bigint, text string"), "query_id", "text")
    post = postings(docs, "point_id", "text")
    df = {r["token"]: r["count"] for r in post.groupBy("token").count().collect()}
    idf = spark.createDataFrame([(t, float(np.log((120 - n + 0.5) / (n + 0.5) + 1))) for t, n in df.items()], "token string, idf double")
    joined = asked.withColumnRenamed("tf", "q").join(idf, "token").join(post, "token").groupBy("query_id", "point_id").agg(F.sum(F.col("q") * F.col("idf") * F.col("tf")).alias("s")).collect()
    source = terms(docs, "point_id", "text") if counted else docs.selectExpr("point_id", "filter(split(text, ' '), x -> x <> '') AS ts")
    got = sparse_leg(asked, source, 120, 20, docs.where("point_id < 100"), pass_weights=70).collect()
    for q in range(5):
        want = sorted((-round(r["s"], 6), r["point_id"]) for r in joined if r["query_id"] == q and r["point_id"] < 100)[:20]
        mine = sorted((r["rank"], r["score"], r["point_id"]) for r in got if r["query_id"] == q)
        assert [p for _, _, p in mine] == [p for _, p in want] and [s for _, s, _ in mine] == pytest.approx([-s for s, _ in want], abs=1e-6)


def test_plans_shuffle_only_candidates(spark):
    docs = spark.createDataFrame([(i, f"common w{i}", [1.0, float(i)]) for i in range(50)], "point_id bigint, chunk_text string, embedding array<float>")
    asked = docs.limit(3).selectExpr("point_id AS query_id", "chunk_text AS query_text", "embedding")
    plan = hybrid_search(asked, docs, Search(limit=2))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert plan.count("MapInArrow") == 2 and "regexp_extract_all" not in plan  # texts were tokenised once, before
    counted = postings(docs, "point_id", "chunk_text", unique=True)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in counted


def test_model_encoders(spark):
    def load():
        def model(texts, most):
            assert len(texts) <= 2
            return [([[float(len(w)), 2.0] for w in t.split()[:most]] or [[0.0, 0.0]], [1] * max(1, len(t.split()[:most]))) for t in texts]

        return model

    df = spark.createDataFrame([("a bbb ccccc",), (None,), ("dd",), ("",), ("e",)], "t string")
    get = lambda e: [r["v"] for r in df.select(model_encoder(load, e)(F.col("t")).alias("v")).collect()]
    assert get(Embedding(normalize=False, batch_size=2, max_length=2)) == [[2.0, 2.0], [0.0, 0.0], [2.0, 2.0], [0.0, 0.0], [1.0, 2.0]]
    assert get(Embedding("max", False, 2))[0] == [5.0, 2.0] and get(Embedding("cls", True, 2))[2] == pytest.approx([0.5**0.5] * 2)
    assert [r["v"] for r in encode(df, "t", lambda: lambda ts: [[float(len(t))] for t in ts], "v", 2).collect()] == [[11.0], [0.0], [2.0], [0.0], [1.0]]
    with pytest.raises(ValueError):
        pool(F.col("v"), F.col("m"), "other")


def test_answers_of_a_failing_model(spark):
    def model(prompt):
        if "bad" in prompt:
            raise RuntimeError("no answer")
        return None if "none" in prompt else "yes"

    asked = spark.createDataFrame([(1, "good", "c"), (2, "bad", "c"), (3, "none", None), (4, None, "c")], "query_id int, query_text string, context_text string")
    got = {r["query_id"]: (r["answer"], r["answer_error"]) for r in context.generate(asked, model).collect()}
    assert got == {1: ("yes", None), 2: ("", "RuntimeError: no answer"), 3: ("", None), 4: ("yes", None)}
    said = []
    ask = context.chat(lambda **k: said.append(k) or "ok", Generator(model="m", max_tokens=7, temperature=0.1))
    assert ask("p") == "ok" and said[0]["max_tokens"] == 7 and said[0]["messages"][1]["content"] == "p"


def test_overrides():
    c = Config().with_overrides(["search.limit=${LIMIT:3}", "chunking.strategy=fixed", "search.hybrid=false", "search.alpha=0.5", "embedding.pooling=${POOL}"], {"POOL": "max"})
    assert (c.search.limit, c.chunking.strategy, c.search.hybrid, c.search.alpha, c.embedding.pooling) == (3, "fixed", False, 0.5, "max")
    assert Config().with_overrides({"chunking.separators": "a,b"}).chunking.separators == ("a", "b")
    for bad in (["search.no=1"], ["no.limit=1"], ["limit=1"], ["search.limit"], ["search.limit=${NONE}"], ["search.hybrid=maybe"], ["chunking.chunk_overlap=900"]):
        with pytest.raises(ValueError):
            Config().with_overrides(bad, {})


def test_sample_queries(spark):
    got = sample_queries(spark).collect()
    assert len(got) == 8 and all(r["query_text"].endswith("?") for r in got)


def test_chunks_of_one_article_are_its_point(spark, tmp_path):
    e = Engine(spark, Collection(spark, f"file://{tmp_path}", "w"), Config(chunking=Chunking(strategy="none")))
    assert [r["point_id"] for r in e.points(articles(spark, {7: "x"})).collect()] == [7]
