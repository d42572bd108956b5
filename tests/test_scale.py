"""What serves large inputs: joins on a grid, deltas, bounds, cells, filters as data, ids by first occurrence, kept questions."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark.config import Embedding
from lexispark.operators import grid, questions
from lexispark.operators.blockmax import BlockIndex
from lexispark.operators.dense import dense_leg, model_encoder, slices
from lexispark.operators.filters import compiled, named
from lexispark.operators.index import Collection
from lexispark.operators.ivf import InvertedFile, recall
from lexispark.operators.sparse import first_seen_ids, postings, sparse_leg, terms, vocabulary
from lexispark.plans import engine_queries

SF = "/root/testdata/sf0.1"


def rows(df):
    return sorted(map(tuple, df.collect()))


def vectors(spark, m, name):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in enumerate(m)], f"{name} bigint, embedding array<float>")


@pytest.mark.parametrize("distance", ["Cosine", "Dot", "Euclid"])
def test_dense_grid_of_many_cells(spark, distance):
    rng = np.random.default_rng(4)
    p, q = list(np.round(rng.normal(size=(500, 6)), 1)), list(np.round(rng.normal(size=(90, 6)), 1))
    p[7] = p[8] = p[9]
    p[20] = q[3] = None
    points, asked = vectors(spark, p, "point_id").repartition(5), vectors(spark, q, "query_id").repartition(3)
    small = grid.Grid(query_bytes=40 * (48 + 64 * 9), point_bytes=48 * 60, held=64)
    assert rows(grid.dense_join(asked, points, 9, distance, grid=small)) == rows(dense_leg(asked, points, 9, distance))
    assert grid.dense_join(asked.where("false"), points, 9, distance).count() == 0 and grid.dense_join(asked, points.where("false"), 9, distance).count() == 0


def test_more_queries_than_a_pass_holds_leave_the_driver(spark):
    """As many queries as the verdict of a batch asks for, against few points; the plan does not grow with them."""
    points = vectors(spark, np.random.default_rng(1).normal(size=(40, 4)), "point_id")
    asked = spark.range(100_000).select(F.col("id").alias("query_id"), F.array(*[F.sin(F.col("id") * (k + 1)).cast("float") for k in range(4)]).alias("embedding"))
    found = dense_leg(asked, points, 3, pass_bytes=1 << 16)
    plan = lambda df: df._jdf.queryExecution().analyzed().toString().count("\n")
    assert plan(found) == plan(dense_leg(asked.limit(10_000), points, 3, pass_bytes=1 << 16)) - 2  # limit's own two nodes
    some = asked.where("query_id % 9973 = 0")
    assert rows(found.where("query_id % 9973 = 0")) == rows(dense_leg(some, points, 3))
    assert found.select("query_id").distinct().count() > 90_000


def test_sparse_grid_of_many_cells(spark):
    rng = np.random.default_rng(2)
    text = lambda n: " ".join(f"w{min(int(x), 60)}" for x in rng.zipf(1.3, n))
    docs = spark.createDataFrame([(i, "" if i % 50 == 0 else text(5 + i % 40)) for i in range(300)], "point_id bigint, text string").repartition(4)
    asked = postings(spark.createDataFrame([(i, text(6)) for i in range(70)], "query_id bigint, text string"), "query_id", "text", unique=True)
    found = terms(docs, "point_id", "text")
    known = vocabulary(found.select(F.inline("terms")))
    kept = docs.where("point_id % 3 > 0")
    small = grid.Grid(query_bytes=20_000, point_bytes=20_000, held=200)
    for some in (None, kept):
        want = rows(sparse_leg(asked, found, 300, 8, some))
        assert rows(grid.sparse_join(asked, found, known, 300, 8, some, grid=small)) == want
        assert rows(sparse_leg(asked, found, 300, 8, some, frequencies=known)) == want
        assert rows(sparse_leg(asked, found, 300, 8, some, pass_weights=50)) == want
    assert grid.sparse_join(asked.where("false"), found, known, 300, 8).count() == 0


def points_of(spark, items):
    return spark.createDataFrame([(p, a, t, [1.0]) for p, a, t in items], "point_id bigint, article_id bigint, chunk_text string, embedding array<double>")


def size_of(folder):
    return sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(folder) for f in names)


def test_deltas_equal_a_collection_written_anew(spark, tmp_path):
    rng = np.random.default_rng(8)
    c = Collection(spark, f"file://{tmp_path}", "c", parts=4, max_deltas=2, max_share=10.0)
    word = lambda: " ".join(f"t{x}" for x in rng.integers(0, 30, 5))
    now = {p: (p // 3, word()) for p in range(30)}
    c.create(points_of(spark, [(p, a, t) for p, (a, t) in now.items()]))

    def check(n_deltas):
        assert rows(c.points().select("point_id", "article_id", "chunk_text")) == sorted((p, a, t) for p, (a, t) in now.items())
        whole = terms(points_of(spark, [(p, a, t) for p, (a, t) in now.items()]), "point_id", "chunk_text")
        assert rows(c.postings()) == rows(whole.select("point_id", F.inline("terms")))
        assert rows(c.frequencies()) == rows(vocabulary(whole.select("point_id", F.inline("terms"))))
        assert c.count() == len(now) == c.info().first()["points_count"] and len(c.deltas()) == n_deltas

    def update(items, whole_articles=True):
        gone = {a for _, a, _ in items} if whole_articles else set()
        for p in [p for p, (a, _) in now.items() if a in gone]:
            del now[p]
        now.update({p: (a, t) for p, a, t in items})
        c.upsert(points_of(spark, items), whole_articles=whole_articles)

    update([(100, 2, word()), (101, 50, word())])
    check(1)
    update([(4, 7, word()), (100, 2, word())])  # a point that another article had
    check(2)
    update([(0, 0, word())], False)  # one point of an article; the third delta compacts
    check(0)
    c.delete(spark.createDataFrame([(2,), (50,), (999,)], "article_id bigint"))
    now = {p: x for p, x in now.items() if x[0] not in (2, 50)}
    check(1)
    update([(100, 2, word())])
    check(2)
    c.compact()
    c.compact()
    check(0)
    c.vacuum()
    check(0)
    only = {"must": [{"key": "article_id", "match": {"any": [1, 2]}}]}
    assert {r["article_id"] for r in c.points(only).collect()} <= {1, 2} and len(c.points(only).inputFiles()) < len(c.points().inputFiles())


def test_an_update_writes_what_it_brings(spark, tmp_path):
    c = Collection(spark, f"file://{tmp_path}", "c", parts=16)
    text = " ".join(f"word{i}" for i in range(200))
    c.create(points_of(spark, [(p, p, f"{text} {p * 7919} {p * 104729}") for p in range(3000)]))
    before = size_of(tmp_path)
    c.upsert(points_of(spark, [(p, p, "short") for p in range(0, 3000, 300)]))
    assert size_of(tmp_path) - before < before / 10 and len(c.deltas()) == 1
    c.upsert(points_of(spark, [(p, p, "short") for p in range(0, 3000, 2)]))  # half of all points: compacted
    assert c.deltas() == [] and c.count() == 3000


def test_a_compaction_shuffles_no_base_rows(spark, tmp_path, monkeypatch):
    c = Collection(spark, f"file://{tmp_path}", "c", parts=4, max_deltas=9, max_share=10.0)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    written, write = [], Collection._write_parts

    def noted(self, df, schema, table, n, *dealt):
        written.append((table, dealt, df))
        return write(self, df, schema, table, n, *dealt)

    monkeypatch.setattr(Collection, "_write_parts", noted)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        c.create(points_of(spark, [(p, p // 3, f"a{p} b") for p in range(60)]))
        assert [(t, *d) for t, d, _ in written] == [("points",), ("terms", True)]
        c.upsert(points_of(spark, [(100, 2, "new"), (0, 0, "other")]))
        want = rows(c.points().select("point_id", "chunk_text"))
        assert "SortMergeJoin" not in plan(c.points()) and "SortMergeJoin" not in plan(c.terms())
        written.clear()
        c.compact()
        assert [(t, *d) for t, d, _ in written] == [("points", True), ("terms", True)]
        assert all("SortMergeJoin" not in plan(df) for _, _, df in written)
        assert rows(c.points().select("point_id", "chunk_text")) == want and c.count() == len(want) == 56
        monkeypatch.setattr("lexispark.operators.index.ALONG", 1)  # long lists are joined by a shuffle
        c.upsert(points_of(spark, [(7, 2, "again"), (8, 2, "again")]))
        c.compact()
        assert rows(c.points().where("article_id = 2").select("point_id", "chunk_text")) == [(7, "again"), (8, "again")] and c.count() == 57
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_blocks_are_cut_from_one_saved_table_in_bounded_ranges(spark, tmp_path, monkeypatch):
    """Texts are tokenised once, and a task cuts a bounded number of points, however many there are."""
    seen = spark.sparkContext.accumulator(0)

    def once(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    found = spark.range(400).select(F.col("id").alias("point_id"), F.expr("array(struct('w' || id % 40 as token, double(1 + id % 3) as tf))").alias("terms"))
    found = found.mapInArrow(once, found.schema)
    monkeypatch.setattr("lexispark.operators.blockmax._PARTITION", 100)
    index = BlockIndex(spark, f"file://{tmp_path}/b")
    index.build(found)
    assert seen.value == 400
    assert index.postings().select("part").distinct().count() > 2


def test_blocks_are_skipped(spark):
    got = engine_queries.sparse_blocks_read(spark, SF).agg(F.sum("n_blocks"), F.sum("n_read")).first()
    assert 0 < got[1] < got[0] / 2


def test_block_index_equals_the_leg(spark, tmp_path):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 23}" for k in range(i % 12)) + " all") for i in range(200)] + [(500, "")], "point_id bigint, text string").repartition(3)
    asked = postings(spark.createDataFrame([(i, f"w{i} w{i + 1} all all none") for i in range(20)], "query_id bigint, text string"), "query_id", "text", unique=True)
    index = BlockIndex(spark, f"file://{tmp_path}/b", block_points=7)
    found = terms(docs, "point_id", "text")
    index.build(found)
    for k in (1, 5, 300):
        hits, read = index.leg(asked, 201, k)
        assert rows(hits) == rows(sparse_leg(asked, found, 201, k))
        assert all(r["n_read"] <= r["n_blocks"] for r in read.collect())
    assert index.leg(asked.where("false"), 201, 5)[0].count() == 0
    empty = BlockIndex(spark, f"file://{tmp_path}/e")
    empty.build(found.where("false"))
    assert empty.leg(asked, 0, 5)[0].count() == 0


def test_inverted_file_recall(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("point_id"), "embedding")
    asked = e.where("point_id % 100 = 0").withColumnRenamed("point_id", "query_id")
    index = InvertedFile(spark, f"file://{tmp_path}/ivf")
    index.build(e)
    found = index.leg(asked, 10, engine_queries.PROBES)
    assert recall(found, dense_leg(asked, e, 10)).agg(F.avg("recall")).first()[0] >= 0.9
    # codes of a byte a number in those cells, and the vectors of forty candidates: a fifth of what the exact leg reads at most
    assert index.read(asked, engine_queries.PROBES) / 4 + 40 / 2000 <= 0.2
    assert rows(index.leg(asked, 10, 128, refine=200)) == rows(dense_leg(asked, e, 10))
    assert index.leg(asked.where("false"), 10, 4).count() == 0


def test_inverted_file_of_clusters(spark, tmp_path):
    """Where vectors lie in clusters, a few cells do; a third of all is one vector."""
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(40, 16))
    m = np.concatenate([middle[rng.integers(0, 40, 2000)] + 0.1 * rng.normal(size=(2000, 16)), np.repeat(middle[:1], 1000, axis=0)])
    points = vectors(spark, [*m, None], "point_id").repartition(4)
    asked = vectors(spark, middle + 0.05, "query_id")
    index = InvertedFile(spark, f"file://{tmp_path}/ivf", cells=40)
    index.build(points)
    assert recall(index.leg(asked, 10, 4), dense_leg(asked, points, 10)).agg(F.avg("recall")).first()[0] >= 0.9
    assert index.read(asked, 4) < 0.25
    assert rows(InvertedFile(spark, f"file://{tmp_path}/ivf", query_bytes=256).leg(asked, 5, 1)) == rows(dense_leg(asked, points, 5))
    with pytest.raises(ValueError):
        InvertedFile(spark, "x", distance="Euclid")


FILTERS = [
    ({}, lambda r: True),
    ({"must": []}, lambda r: True),
    ({"key": "a", "match": {"value": 1}}, lambda r: r[1] == 1),
    ({"must_not": [{"key": "a", "match": {"value": 1}}]}, lambda r: r[1] != 1),
    ({"key": "a", "match": {"any": []}}, lambda r: False),
    ({"must_not": [{"key": "a", "match": {"any": []}}]}, lambda r: True),
    ({"key": "a", "match": {"except": [1, 2]}}, lambda r: r[1] not in (None, 1, 2)),
    ({"must_not": [{"key": "a", "match": {"except": [1, 2]}}]}, lambda r: r[1] in (None, 1, 2)),
    ({"key": "b", "match": {"text": "x"}}, lambda r: "x" in (r[2] or "")),
    ({"must_not": [{"key": "b", "match": {"text": "x"}}]}, lambda r: "x" not in (r[2] or "")),
    ({"key": "a", "range": {"gt": 1, "lte": 3}}, lambda r: r[1] is not None and 1 < r[1] <= 3),
    ({"must_not": [{"key": "a", "range": {"gte": 1, "lt": 3}}]}, lambda r: r[1] is None or not 1 <= r[1] < 3),
    ({"is_null": {"key": "a"}}, lambda r: r[1] is None),
    ({"must_not": [{"is_null": {"key": "a"}}]}, lambda r: r[1] is not None),
    ({"has_id": [1, 5, 99]}, lambda r: r[0] in (1, 5, 99)),
    ({"key": "s.c", "match": {"value": 2}}, lambda r: r[3][0] == 2),
    ({"should": [{"key": "a", "match": {"value": 1}}, {"must": [{"key": "b", "match": {"any": ["x", "y"]}}, {"key": "a", "range": {"gt": 1}}]}]}, lambda r: r[1] == 1 or (r[2] in ("x", "y") and (r[1] or 0) > 1)),
    ({"must_not": [{"should": [{"key": "a", "match": {"value": 1}}, {"must": [{"key": "b", "match": {"value": "x"}}]}], "must_not": [{"key": "a", "match": {"value": 2}}]}]}, lambda r: not ((r[1] == 1 or r[2] == "x") and r[1] != 2)),
]


@pytest.mark.parametrize("f, holds", FILTERS)
def test_filters(spark, f, holds):
    data = [(i, [None, 1, 2, 3][i % 4], [None, "x", "y", "xy", ""][i % 5], (i % 3,)) for i in range(60)]
    df = spark.createDataFrame(data, "point_id int, a int, b string, s struct<c:int>")
    assert sorted(r["point_id"] for r in df.where(compiled(f, df)).collect()) == [r[0] for r in data if holds(r)]


def test_filters_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([(1, 2, "x")], "point_id int, a int, b string").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    f = {"must": [{"key": "a", "range": {"gte": 1}}], "must_not": [{"key": "b", "match": {"value": "y"}}]}
    plan = df.where(compiled(f, df))._jdf.queryExecution().executedPlan().toString()
    pushed = plan.partition("PushedFilters: ")[2].partition("]")[0]
    assert "GreaterThanOrEqual(a,1)" in pushed and "Not(EqualTo(b,y))" in pushed


@pytest.mark.parametrize("f", [{"key": "z", "match": {"value": 1}}, {"key": "a"}, {"must": "a"}, {"must": ["a"]}, {"key": "a", "match": {"value": 1, "any": [2]}}, {"key": "a", "range": {"near": 1}}, {"is_null": "a"}, []])
def test_wrong_filters_are_refused(spark, f):
    with pytest.raises(ValueError):
        compiled(f, spark.range(1).withColumnRenamed("id", "a"))


def test_named_articles():
    one = {"key": "article_id", "match": {"any": [1, 2, 3]}}
    assert named({"must": [one, {"must": [{"key": "article_id", "match": {"value": 2}}]}]}) == {2}
    assert named({"should": [one]}) is None and named({"must_not": [one]}) is None and named({}) is None


def test_ids_by_first_occurrence(spark):
    texts = [(3, ["b", "a", None, "b"]), (1, ["c", "a"]), (2, []), (4, None), (9, ["e", "c", "f"])]
    df = spark.createDataFrame(texts, "doc bigint, ts array<string>").repartition(3)
    want = {"c": 0, "a": 1, "b": 2, "e": 3, "f": 4}
    for n in (1, 2, 100):
        assert {r["token"]: r["token_id"] for r in first_seen_ids(df, "doc", rows=n).collect()} == want
    known = spark.createDataFrame([("e", 7), ("z", 2)], "token string, token_id bigint")
    assert {r["token"]: r["token_id"] for r in first_seen_ids(df, "doc", known=known).collect()} == {"e": 7, "z": 2, "c": 8, "a": 9, "b": 10, "f": 11}
    assert first_seen_ids(df.where("false"), "doc").count() == 0


def test_questions_are_kept(spark, tmp_path):
    folder, template = f"file://{tmp_path}/q", "<{text}>"
    a = spark.createDataFrame([(1, "one", None), (2, "one", None), (3, "bad", None), (4, None, None), (5, "x", "known"), (6, "worse", None)], "article_id bigint, article_text string, query_text string").repartition(3)
    calls = tmp_path / "calls"

    def model(prompt):
        with calls.open("a") as f:
            f.write(prompt + "\n")
        if prompt == "<bad>" and len(calls.read_text().split("<bad>")) < 3:
            raise TimeoutError("late")
        return None if prompt == "<worse>" else prompt.upper()

    assert questions.ask(a, folder, model, template, attempts=3) == 4  # equal prompts once
    assert questions.ask(a, folder, model, template, attempts=3) == 2  # those that failed
    assert questions.ask(a, folder, model, template, attempts=3) == 1
    assert questions.ask(a, folder, model, template, attempts=3) == 0  # no attempts left
    want = {1: "<ONE>", 2: "<ONE>", 3: "<BAD>", 4: "<>", 5: "known", 6: None}
    got = questions.filled(a, folder, template)
    assert got.columns == a.columns and {r["article_id"]: r["query_text"] for r in got.collect()} == want
    assert sorted(calls.read_text().split()) == sorted(["<one>", "<>", "<bad>", "<bad>", "<worse>", "<worse>", "<worse>"])
    assert {r["error"] for r in questions.stored(a, folder).where("query_text is null").collect()} == {"TimeoutError: late", "no answer"}


def test_a_failed_run_keeps_what_it_had(spark, tmp_path):
    folder = f"file://{tmp_path}/q"
    a = spark.createDataFrame([(i, f"t{i}", None) for i in range(40)], "article_id bigint, article_text string, query_text string")

    def dies(prompt):
        if prompt == "t17":
            raise SystemExit("the worker ends")
        return prompt

    with pytest.raises(Exception):
        questions.ask(a, folder, dies, "{text}", buckets=8)
    done = questions.stored(a, folder).count()
    assert questions.ask(a, folder, str, "{text}") == 40 - done
    assert questions.filled(a, folder, "{text}").where("query_text <> article_text").count() == 0


def test_batches_by_length(spark):
    e = Embedding(normalize=False, batch_size=4, max_length=16)

    def load():
        def model(texts, most):
            longest = max(min(len(t.split()), most) for t in texts)
            assert longest * len(texts) <= 64 or len(texts) == 1
            return [([[float(len(w)), 1.0] for w in t.split()[:most]] or [[0.0, 0.0]], [1] * max(1, min(most, len(t.split())))) for t in texts]

        return model

    docs = [(i, " ".join("x" * (1 + (i * k) % 7) for k in range(i * i % 40))) for i in range(100)] + [(200, None)]
    df = spark.createDataFrame(docs, "id bigint, text string")
    got = {r["id"]: r["v"] for r in df.select("id", model_encoder(load, e)(F.col("text")).alias("v")).collect()}
    for i, t in docs:
        ws = (t or "").split()[:16]
        assert got[i] == pytest.approx([sum(map(len, ws)) / len(ws) if ws else 0.0, 1.0 if ws else 0.0])


def test_padding_is_halved(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()
    n = [len(r["text"].split()) for r in d]
    e = Embedding()
    cut = [min(x, e.max_length) for x in n]
    padded = lambda groups: sum(len(g) * max(cut[i] for i in g) for g in groups)
    before = padded([range(k, min(k + e.batch_size, len(n))) for k in range(0, len(n), e.batch_size)]) - sum(cut)
    after = padded(slices(n, e.batch_size, e.max_length)) - sum(cut)
    assert after < before / 2 and sorted(i for g in slices(n, e.batch_size, e.max_length) for i in g) == list(range(len(n)))
    assert slices([], 4, 9) == [] and math.prod(map(len, slices([50, 60], 1, 9))) == 1


def test_texts_are_stored_once(spark, tmp_path):
    from lexispark.config import Chunking, Config, Search
    from lexispark.plans import Engine

    word = lambda w, n=40: " ".join([w] * n)
    articles = lambda texts: spark.createDataFrame([(i, str(i), "title", t, "code") for i, t in texts.items()], "article_id bigint, article_num string, article_title string, article_text string, codex string")
    c = Collection(spark, f"file://{tmp_path}", "c", parts=4, max_share=10.0)
    e = Engine(spark, c, Config(chunking=Chunking(), search=Search(score_threshold=0.1)))
    now = {i: "\n\n".join(word(f"w{i}x{j}") for j in range(5)) for i in range(1, 7)}
    e.build(articles(now))
    assert "article_text" not in c.points().columns and c.points().count() == 30
    whole = lambda: {r["article_id"]: r["article_text"] for r in c.texts().collect()}
    found = lambda text: [(r["article_id"], r["article_text"]) for r in e.search(spark.createDataFrame([(1, text)], "query_id bigint, query_text string"), 1).collect()]
    assert whole() == now and found("w3x2") == [(3, now[3])]
    for change in ({3: word("new")}, {3: word("newer"), 9: word("nine")}):
        now |= change
        e.update(articles(change))
        assert whole() == now
    assert found("newer") == [(3, now[3])]
    c.delete(spark.createDataFrame([(1,), (9,)], "article_id bigint"))
    del now[1], now[9]
    assert whole() == now
    c.compact()
    assert whole() == now and c.deltas() == []
    c.vacuum()
    assert whole() == now and c.texts().count() == 5


def test_configuration_files(tmp_path):
    from lexispark.config import Config

    (tmp_path / "search").mkdir()
    (tmp_path / "embedding").mkdir()
    (tmp_path / "config.yaml").write_text("defaults:\n  - search: default\n  - embedding: default\n  - _self_\nproject: x\nsearch:\n  limit: 7\n")
    (tmp_path / "search/default.yaml").write_text("url: ${oc.env:URL}\nlimit: 3\nalpha: ${oc.env:ALPHA,0.25}\nhybrid: false\n")
    (tmp_path / "search/exact.yaml").write_text("alpha: 1.0\n")
    (tmp_path / "embedding/default.json").write_text('{"pooling": "cls", "batch_size": 8}')
    c = Config.from_files(str(tmp_path), env={})
    assert (c.search.limit, c.search.alpha, c.search.hybrid, c.embedding.pooling, c.embedding.batch_size) == (7, 0.25, False, "cls", 8)
    c = Config.from_files(str(tmp_path), ["search=exact", "search.limit=9", "embedding.pooling=${POOL:max}"], {"ALPHA": "0.5"})
    assert (c.search.limit, c.search.alpha, c.search.hybrid, c.embedding.pooling) == (9, 1.0, True, "max")
    assert Config.from_files(str(tmp_path), env={"ALPHA": "0.5"}).search.alpha == 0.5
    with pytest.raises(ValueError, match="unknown groups"):
        Config.from_files(str(tmp_path), ["nothing=else"], {})
    (tmp_path / "config.yaml").write_text("defaults: [search]\n")
    with pytest.raises(ValueError, match="group: option"):
        Config.from_files(str(tmp_path), env={})
