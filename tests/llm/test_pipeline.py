import itertools

import corpus_pipeline as cp
import pytest

from lexispark.llm import quality, toxicity
from lexispark.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


def test_stages_equal_brute_force(spark, docs):
    labels = table(spark, SF, "labels")
    good, harmful = quality.fitted(docs, labels).scorer(), toxicity.fitted(docs, labels).scorer()
    rows = [r.asDict() for r in docs.collect()]
    kept = [r for r in rows if good([r["text"] or ""])[0] >= 0.7]
    kept = [r for r in kept if harmful(r["text"] or "") < 0.7]
    p = cp.NEAR
    sets = {}
    for r in kept:
        w = (r["text"] or "").encode().lower().split()
        sets[r["doc_id"]] = {tuple(w[i : i + p.words]) for i in range(max(1, len(w) - p.words + 1))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(sorted(sets), 2):
        a, b = sets[i], sets[j]
        if a and b and p.den * len(a & b) >= p.num * len(a | b):
            x, y = sorted((root(i), root(j)))
            parent[y] = x
    want = {i for i in sets if root(i) == i}
    stage, seen = docs, []
    for name, f in cp.STAGES[:3]:
        stage = f(spark, stage, SF)
        assert stage.columns == docs.columns
        seen.append(name)
    left = {r["doc_id"] for r in stage.collect()}
    assert left == want and 0 < len(left) < len(rows)
    pieces = cp.STAGES[3][1](spark, stage, SF).collect()
    assert {r["doc_id"] for r in pieces} == want
    assert all(sum(r["length"] for r in pieces if r["doc_id"] == i) == next(r["doc_tokens"] for r in pieces if r["doc_id"] == i) for i in want)


EXTRA = "doc_id bigint, text string, lang string, source string, n_chars bigint, __key string, __gone int, id string, h int, score double"
LONG = " ".join(f"w{i}" for i in range(40_000))
TEXTS = [(5, LONG), (4, LONG + " x"), (7, None), (8, ""), (9, "short"), (3, "tie one two three four five"), (2, "tie one two three four five"), (2, "tie one two three four five"), (2, "another text of the same id here"), (None, "no id"), (None, "no id"), (11, " \n ")]


@pytest.fixture()
def edges(spark, tmp_path):
    rows = [(i, t, None, None, None, "k", 1, "x", k, None) for k, (i, t) in enumerate(TEXTS)]
    spark.createDataFrame(rows, EXTRA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages_keep_columns_and_treat_edges(spark, edges):
    stage = table(spark, edges, "documents")
    columns = stage.columns
    for _, f in cp.STAGES[:3]:
        stage = f(spark, stage, edges)
        assert stage.columns == columns
    kept = sorted((str(r["doc_id"]), r["text"] or "") for r in stage.collect())
    gone = [(5, LONG), (3, "tie one two three four five"), (2, "tie one two three four five")]  # linked with 4 and 2; once repeated
    assert kept == sorted([*((str(i), t or "") for i, t in TEXTS if (i, t) not in gone), ("2", "tie one two three four five")])
    assert all(r["h"] is not None and r["__key"] == "k" for r in stage.collect())
    pieces = cp.run(spark, edges).collect()
    assert sum(r["length"] for r in pieces if r["doc_id"] == 4) == next(r["doc_tokens"] for r in pieces if r["doc_id"] == 4)
    assert {r["doc_id"] for r in pieces} == {4, 7, 8, 9, 2, None, 11}


def test_empty_documents(spark, edges, tmp_path):
    empty = f"{tmp_path}/empty"
    table(spark, edges, "documents").where("false").write.parquet(f"{empty}/documents.parquet")
    table(spark, edges, "labels").write.parquet(f"{empty}/labels.parquet")
    assert cp.run(spark, empty).count() == 0
