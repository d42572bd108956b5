"""What large tables leave on disk: points are not shuffled, and no step keeps what it no longer needs."""

from pyspark.sql import functions as F

from lexispark.operators import grid
from lexispark.operators.blockmax import BlockIndex
from lexispark.operators.index import Collection
from lexispark.operators.sparse import postings, sparse_leg, terms, vocabulary
from lexispark.storage import saved


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_blocks_are_cut_and_scored_without_a_shuffle_of_points(spark, tmp_path, monkeypatch):
    """Few queries go along with passes over the blocks, many are joined with the postings; both give what the leg gives."""
    docs = spark.createDataFrame([(f"p{i:03}", " ".join(f"w{(i * k) % 31}" for k in range(i % 14)) + " all") for i in range(300)], "point_id string, text string").repartition(3)
    asked = postings(spark.createDataFrame([(f"q{i}", f"w{i} w{i + 1} all none") for i in range(12)] + [("nothing", "none")], "query_id string, text string"), "query_id", "text", unique=True)
    index, found = BlockIndex(spark, f"file://{tmp_path}/b", block_points=8), terms(docs, "point_id", "text")
    plans, run = [], BlockIndex.blocks
    monkeypatch.setattr(BlockIndex, "blocks", lambda self: plans.append(1) or run(self))
    index.build(found)
    want = rows(sparse_leg(asked, found, 300, 6))
    hits, read = index.leg(asked, 300, 6)
    assert rows(hits) == want and len(plans) == 1  # the passes read one table, and nothing but candidates is shuffled
    assert "SortMergeJoin" not in hits._jdf.queryExecution().executedPlan().toString() and "points" not in hits._jdf.queryExecution().optimizedPlan().toString()
    few = {r["query_id"]: r["n_blocks"] for r in read.collect()}
    assert "nothing" not in few and len(few) == 12
    monkeypatch.setattr("lexispark.operators.blockmax.PASS_ROWS", 3)
    hits, read = index.leg(asked, 300, 6)
    assert rows(hits) == want and {r["query_id"]: r["n_blocks"] for r in read.collect()} == few


def test_a_sparse_grid_shuffles_lists_of_k_points_only(spark, tmp_path):
    """Points and queries of many blocks meet where the points lie."""
    docs = spark.createDataFrame([(f"p{i:03}", " ".join(f"w{(i * k) % 31}" for k in range(i % 14)) + " all") for i in range(300)], "point_id string, text string").repartition(3)
    asked = postings(spark.createDataFrame([(i, f"w{i % 30} w{i % 7} all none") for i in range(80)], "query_id bigint, text string"), "query_id", "text", unique=True)
    found = saved(terms(docs, "point_id", "text"), "terms")
    known = vocabulary(found.select(F.inline("terms")))
    want = rows(sparse_leg(asked, found, 300, 6))
    for g in (grid.Grid(query_bytes=4_000, point_bytes=20_000, held=200), grid.Grid(least_queries=9), grid.Grid()):
        got = grid.sparse_join(asked, found, known, 300, 6, grid=g)
        assert rows(got) == want and got.columns == ["query_id", "point_id", "score", "rank"]
        plan = got._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("Exchange") == 1 and "Sort" not in plan, plan  # the packed lists go to their blocks
    one = grid.sparse_join(asked, found.where("point_id = 'none'"), known, 300, 6)
    assert one.count() == 0


def test_texts_are_not_joined_with_vectors(spark):
    from lexispark.plans import queries

    seen, was = [], queries.hybrid_search
    queries.hybrid_search = lambda *a, **b: seen.append(b["found"]) or was(*a, **b)
    try:
        queries.queries()["hybrid_search"](spark, "/root/testdata/sf0.001")
    finally:
        queries.hybrid_search = was
    assert "Join" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()


def test_long_lists_of_what_is_taken_away_shuffle_keys_only(spark, tmp_path, monkeypatch):
    """An update and a compaction whose lists are too long to go along leave the base's rows where they lie."""
    points = lambda data: spark.createDataFrame(data, "point_id bigint, article_id bigint, chunk_text string")
    chosen, write = [], Collection._write_parts

    def noted(self, df, schema, table, n, dealt=False, *mode):
        chosen.append((table, dealt, df._jdf.queryExecution().sparkPlan().toString()))
        return write(self, df, schema, table, n, dealt, *mode)

    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    got = []
    try:
        for along in (1 << 21, 40):
            monkeypatch.setattr("lexispark.operators.index.ALONG", along)
            c = Collection(spark, f"file://{tmp_path}", f"c{along}", parts=8, max_deltas=9, max_share=10.0)
            c.create(points([(p, p // 3, f"a{p % 7} b") for p in range(300)]))
            c.upsert(points([(1000 + p, p, "new") for p in range(0, 100, 2)] + [(0, 500, "moved")]))
            c.delete(spark.range(1, 60, 4).withColumnRenamed("id", "article_id"))
            monkeypatch.setattr(Collection, "_write_parts", noted)
            chosen.clear()
            c.compact()
            monkeypatch.setattr(Collection, "_write_parts", write)
            got.append((rows(c.points().select("point_id", "article_id", "chunk_text")), rows(c.terms().select("point_id", F.inline("terms"))), rows(c.frequencies()), c.count()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert got[0] == got[1] and got[1][3] == len(got[1][0]) == len({r[0] for r in got[1][0]})
    base = [plan[plan.index("LeftAnti") - 60 :] for _, _, plan in chosen]
    assert len(base) > 4 and all("BroadcastHashJoin" in plan for plan in base)  # groups of parts
