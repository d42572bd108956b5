"""Fitting on bounded samples, and what the counterfactuals change on real rows."""

import zlib
from itertools import islice

import numpy as np
import pytest

from lexispark.llm import quality, toxicity
from lexispark.llm.common import table
from lexispark.llm.labelled import fit_in_task, sample

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def labelled(spark):
    rows = table(spark, SF, "documents").join(table(spark, SF, "labels"), "doc_id").select("doc_id", "text", "toxic").collect()
    parts = {False: [], True: []}
    for r in rows:
        parts[zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1].append((r["text"] or "", r["toxic"]))
    return parts


def test_counterfactuals_act_on_real_rows(labelled):
    """Pairs exist, scores depend on the penalty, neutral words change scores less, and no more clean texts are accused."""
    plain, fair = (toxicity.fit(labelled[False], penalty=p) for p in (0.0, 4.0))
    assert sum(fair.pairs) > 1000
    clean = [t for t, y in labelled[True] if not y]
    toxic = [t for t, y in labelled[True] if y]
    swap = {t: tuple(others) for t, *others in toxicity.neutral_terms(labelled[False])}
    pairs = list(islice(toxicity._pairs(clean, swap), 4000))
    cache = {id(m): toxicity._Cache(m.weights) for m in (plain, fair)}
    gap = lambda m: np.mean([abs(m.raw(a, cache[id(m)]) - m.raw(b, cache[id(m)])) for a, b in pairs])
    assert gap(fair) < 0.1 * gap(plain)
    accused = lambda m, texts: sum(m.scorer()(t) >= 0.7 for t in texts)
    assert accused(fair, clean) <= accused(plain, clean) and accused(fair, clean) <= 0.005 * len(clean)
    assert accused(fair, toxic) >= 0.9 * len(toxic)


def test_neutral_mentions_planted_in_real_rows(labelled):
    """Where toxic texts name a group more often, its name is evidence without the penalty and none with it."""
    planted = [(f"women {t}" if y or i % 20 == 0 else t, y) for i, (t, y) in enumerate(labelled[False])]
    plain, fair = (toxicity.fit(planted, penalty=p) for p in (0.0, 4.0))
    assert fair.pairs[0] > 1000
    scores = lambda m, texts: np.array([s(t) for s in (m.scorer(),) for t in texts])
    neutral = [f"women {t}" for t, y in labelled[True] if not y]
    before, after = scores(plain, neutral), scores(fair, neutral)
    assert before.mean() > 0.2 and after.mean() < 0.05
    assert (before >= 0.7).sum() >= 5 * (after >= 0.7).sum() and (after >= 0.7).mean() <= 0.005
    toxic = [t for t, y in labelled[True] if y]
    assert (scores(fair, toxic) >= 0.7).mean() > (scores(plain, toxic) >= 0.7).mean() + 0.1


def test_swaps_take_every_other_term():
    swap = toxicity.swaps((("a", "b", "c"), ("c", "d")))
    assert swap == {"a": ("b", "c"), "b": ("c", "a"), "c": ("a", "b", "d"), "d": ("c",)}
    assert [toxicity.counterfactuals("x C.", (("a", "b", "c"),), k) for k in range(3)] == [[("x c", "x a")], [("x c", "x b")], [("x c", "x a")]]
    assert all(t not in others for t, others in toxicity.swaps().items())


def test_neutral_terms_are_common_but_no_insults():
    data = [("common calm words " + ("insult group" if i % 2 else "group" if i % 4 == 0 else "plain"), i % 2) for i in range(200)]
    got = {t: set(others) for t, *others in toxicity.neutral_terms(data)}
    assert set(got) == {"group"} and got["group"] <= {"common", "calm", "words", "plain"}
    assert toxicity.neutral_terms([]) == toxicity.neutral_terms([("a", 1)]) == ()


def test_samples_are_bounded_in_rows_and_bytes(spark):
    docs = spark.createDataFrame([(i, "x" * 100 + str(i)) for i in range(50)] + [(7, f"again {k}") for k in range(500)] + [(60, "y" * 5000), (61, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(60, 1), (61, 1), (60, 0), (None, 1), (62, None)], "doc_id bigint, toxic int")
    rows = sample(docs, labels, "toxic", None, 10).collect()
    assert sorted(r["label"] for r in rows) == [0] * 10 + [1] * 10 and len({r["id"] for r in rows}) == 20
    every = {r["id"]: r for r in sample(docs, labels, "toxic", None, 100).collect()}
    assert len(every) == 52 and every[60]["label"] == 1 and every[7]["text"] == "again 0" and every[61]["text"] == ""
    few = sample(docs, labels, "toxic", None, 100, most_bytes=1000).collect()
    assert 60 not in {r["id"] for r in few} and all(sum(len(r["text"]) for r in few if r["label"] == y) <= 1000 for y in (0, 1))


def test_fitting_sees_each_text_once(spark):
    rows = spark.createDataFrame([(3, 1, "b"), (1, 0, "a"), (2, 1, "a")], "id bigint, label int, text string")
    assert fit_in_task(rows, lambda data: data) == [("a", 0), ("b", 1)]
    assert fit_in_task(rows.where("false"), lambda data: data) == []


def test_fits_without_both_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id bigint, text string")
    for labels in ([], [(1, 1, 1)], [(1, None, None)]):
        t = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
        assert quality.keep_good(docs, quality.fitted(docs, t)).count() == toxicity.keep_harmless(docs, toxicity.fitted(docs, t)).count() == 2
