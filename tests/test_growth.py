"""What grows with the tables: rows that leave a task, cells for all cores, relevant items, batches of text."""

import re
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lexispark.functions import text as T
from lexispark.operators import dense, evaluate, grid, prepare, sparse
from lexispark.operators.search import with_payload
from lexispark.operators.sparse import terms
from lexispark.sources import files
from lexispark.storage import saved


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_a_task_passes_on_k_rows_for_a_query_however_many_batches_it_reads():
    rng = np.random.default_rng(1)
    q, p = rng.normal(size=(6, 4)), np.round(rng.normal(size=(2000, 4)), 1)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 8001, 4), pa.int32()), pa.array(p.ravel()))
    batches = [pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + 100)), lists[i : i + 100]], names=["p", "v"]) for i in range(0, 2000, 100)]
    run = dense._nearest(SimpleNamespace(value=(pa.array(np.arange(6)), q)), 4, 7, "Dot", 0.0, "q", "p")
    got = pa.Table.from_batches(run(iter(batches))).to_pylist()
    s = np.round(q @ p.T, 6)
    want = [(i, int(j)) for i in range(6) for j in sorted(range(2000), key=lambda j: (-s[i, j], j))[:7]]
    assert sorted((r["q"], r["p"]) for r in got) == sorted(want)
    numbers = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(m + 1), pa.int32()), pa.array(np.zeros(m, np.int32)))
    tf = lambda i: pa.ListArray.from_arrays(pa.array(np.arange(51), pa.int32()), pa.array(1.0 + np.arange(i, i + 50)))
    shared = SimpleNamespace(value=(pa.array([5]), np.array([0]), np.array([0]), np.array([2.0]), 1))
    found = sparse._scored(shared, 3, "q", "p")(pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + 50)), numbers(50), tf(i)], names=["p", "at", "tf"]) for i in range(0, 500, 50))
    assert pa.Table.from_batches(found).to_pylist() == [{"q": 5, "p": j, "score": 2.0 * (j + 1)} for j in (499, 498, 497)]


def test_few_points_still_make_cells_for_all_cores():
    g = grid.Grid()
    assert g.columns(10_256, 512, 1, 12) * 1 >= 10 and g.columns(10_256, 512, 40, 12) == 1
    assert g.columns(100, 512, 1, 12) <= 1 or g.columns(100, 512, 1, 12) == g.blocks(100, 512, g.point_bytes)


def test_wide_words_add_what_single_ones_do():
    rng = np.random.default_rng(3)
    n, words = 40, pa.array([f"w{i}" for i in range(30)])
    has = rng.random((30, n)) < np.linspace(0.02, 1, 30)[:, None]
    starts, of = np.append(0, has.sum(axis=1).cumsum()), np.nonzero(has)[1]
    weight = rng.random(len(of))
    docs = [rng.choice(32, rng.integers(0, 20), replace=False) for _ in range(25)]
    tf = [rng.integers(1, 5, len(d)).astype(float) for d in docs]
    batch = pa.RecordBatch.from_arrays([pa.array(range(25))] * 4 + [pa.array([[f"w{i}" for i in d] for d in docs], pa.list_(pa.string())), pa.array([t.tolist() for t in tf], pa.list_(pa.float64()))], names=list("abcdef"))
    row, table = grid._wide(batch, words, starts, of, weight, n)
    assert 0 < len(table) < 30
    w = np.zeros((32, n))
    w[np.nonzero(has)[0], of] = weight
    want = np.array([[sum(w[i, a] * t for i, t in zip(docs[b], tf[b])) for b in range(25)] for a in range(n)])
    assert np.allclose(grid._products(batch, words, starts, of, weight, n, 50, row, table), want)


def test_labels_give_what_lists_of_relevant_items_give(spark):
    items = spark.createDataFrame([(i, i % 3 if i % 7 else None) for i in range(60)] + [(100, 9), (4, 1), (4, 1), (5, 0)], "item_id bigint, label int")
    asked = spark.createDataFrame([(4, 1), (6, 0), (8, 2), (100, 9), (7, None), (13, 1)], "query_id bigint, label int")
    hits = spark.createDataFrame([(q, (q * 5 + r * r) % 60, r) for q in (4, 6, 8, 100, 7) for r in range(1, 9)], "query_id bigint, item_id bigint, rank int").where("query_id <> item_id")
    qrels = asked.join(items.withColumnRenamed("item_id", "relevant_id"), "label").where("query_id <> relevant_id").select("query_id", "relevant_id")
    got = evaluate.per_query_of_labels(hits, asked, items, (1, 3, 5))
    assert rows(got) == rows(evaluate.per_query(hits, qrels, (1, 3, 5))) and got.count() == 12


def test_batches_of_texts_are_bounded(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    terms(spark.createDataFrame([(1, "a text")], "i bigint, t string"), "i", "t")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 256


def test_stop_words_are_a_set(spark):
    d = spark.createDataFrame([("The cat, the HAT and a12",), (None,), ("",)], "t string").repartition(1)
    stops = [f"s{i}" for i in range(200)] + ["the", "and"]
    got = d.select(T.tokens(F.col("t"), stops).alias("ts"))
    assert sorted(r["ts"] for r in got.collect()) == [[], [], ["cat", "hat", "a12"]]
    assert "INSET" in got._jdf.queryExecution().optimizedPlan().toString().upper()


def test_articles_are_made_once_and_then_chosen(spark):
    d = spark.createDataFrame([(1, "x\nСтатья 1. Название\nтекст этой статьи, который достаточно длинный\nСтатья 2\nкоротко")], "doc_id bigint, text string")
    got = prepare.split_articles(d)
    assert [(r["pos"], r["article_num"]) for r in got.collect()] == [(0, "1")]
    assert not re.search(r"Filter[^\n]*article_num|Filter[^\n]*instr|Filter[^\n]*regexp", got._jdf.queryExecution().optimizedPlan().toString())


def test_a_filter_shuffles_what_matches_only(spark):
    docs = spark.createDataFrame([(i, f"w{i % 5} w{i % 3} all") for i in range(50)], "point_id bigint, text string")
    found = saved(terms(docs, "point_id", "text"), "terms")
    asked = sparse.postings(spark.createDataFrame([(1, "w1 all")], "query_id bigint, text string"), "query_id", "text", unique=True)
    got = sparse.sparse_leg(asked, found, 50, 4, docs.where("point_id % 2 = 1"), frequencies=sparse.vocabulary(found.select(F.inline("terms"))))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan[plan.index("Join LeftSemi") :]
    assert [r["point_id"] for r in got.orderBy("rank").collect()] == [1, 31, 7, 11]  # w1 twice, then once


def test_few_hits_go_to_the_points(spark):
    points = saved(spark.range(1000).select(F.col("id").alias("point_id"), F.lit("text").alias("chunk_text")), "points")
    hits = spark.createDataFrame([(1, 5, 0.5)], "query_id bigint, point_id bigint, score double").groupBy("query_id", "point_id").agg(F.max("score").alias("score"))
    got = with_payload(hits.repartition(3), points)
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().sparkPlan().toString() and "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()
    assert rows(got) == [(5, 1, 0.5, "text")]


def test_small_files_share_a_task(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"{i}.rtf").write_text("{\\rtf1 text}")
    got = files.read_rtf(spark, f"file://{tmp_path}")
    assert got.count() == 300 and got.rdd.getNumPartitions() <= 8
