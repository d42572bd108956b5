"""Fill-in-middle, whitening and exact duplicates over every edge, against plain Python."""

import hashlib
import re
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from lexispark.llm import dedup, fim, queries, whitening
from lexispark.llm.common import table

LONG = " ".join(f"word{i % 977}  ligne{i % 91}\n" for i in range(60_000))
TEXTS = [None, "", " ", " \n\t ", "one", "one ", " one", "One two", "one TWO", "a <P> b", "a<S>", "x <M", "<<P <S", "é ü 漢字 🎉 x\x85y z", "\x1c\x1d a\x0b\x0cb", "İ ẞ K", "kK", "tie", "tie", "TIE", LONG, LONG.upper()] + [f"text {i} with <, P>, {'w ' * (i % 17)}" for i in range(60)]
ROWS = [(i * 13 - 40, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (None, "NO id"), (None, None), (5000, "again"), (5000, "again"), (5000, "AGAIN"), (-7, "")]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(i, t, None, "key", "h", 1, True) for i, t in ROWS], "doc_id bigint, text string, lang string, id string, hash string, `row` int, maybe boolean")
    return df.repartition(5)


def empty(df):
    return df.where("false")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def slow_fim(i, text, p=fim.Params()):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n = len(units)
    digest = sha(f"{p.seed}:{'' if i is None else i}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in p.marks) or h[2] % 100 >= p.rate:
        return i, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    x, y, z = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < p.spm:
        return i, n, "spm", len(x), len(y), p.suffix + z + p.prefix + x + p.middle + y
    return i, n, "psm", len(x), len(y), p.prefix + x + p.suffix + z + p.middle + y


@pytest.mark.parametrize("p", [fim.Params(), fim.Params("9", 100, 0), fim.Params("", 100, 100, "[a", "(b", "{c"), fim.Params(rate=0)])
def test_fim(docs, p):
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    got = sorted(map(tuple, fim.transform(docs, p).collect()), key=key)
    assert got == sorted((slow_fim(i, t, p) for i, t in ROWS), key=key)
    want = sorted((i is None, i or 0, t or "") for i, t in ROWS)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["restored"]) for r in fim.restore(fim.transform(docs, p), p).collect()) == want


def test_fim_digests_and_forms(spark, docs):
    got = fim.digests(docs).collect()
    assert all(r["restored_sha256"] in {sha(t or "") for i, t in ROWS if i == r["doc_id"]} for r in got) and len(got) == len(ROWS)
    assert {r["form"] for r in got} == {"plain", "spm", "psm"}
    assert fim.digests(empty(docs)).collect() == []


def test_fim_passes_keep_no_units():
    text = " a" * 100_000
    assert fim.count_units(text) == 100_000
    assert fim.cut_points(text, 0, 0) == (0, 0) and fim.cut_points(text, 1, 1) == (2, 2) and fim.cut_points(text, 99_999, 100_000) == (199_998, 200_000)


@pytest.mark.parametrize("marks", [("", "b", "c"), ("a", "a", "c"), ("<P>", "<S>", "<M<"), ("ab", "b", "c")])
def test_fim_marks_are_checked(marks):
    with pytest.raises(ValueError, match="marks"):
        fim.Params("", 50, 50, *marks)


def test_fim_damaged_outputs_are_refused():
    for output, form in (("text", "psm"), ("<P>a<S>b", "psm"), ("<P>a<S>b<M>c", "spm")):
        with pytest.raises(ValueError):
            fim.restored(output, form, fim.Params())


def slow_groups():
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[re.sub("[A-Z]", lambda m: m[0].lower(), t or "")].append(i)
    return {sha(t): (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}


@pytest.mark.parametrize("p", [dedup.Filter(), dedup.Filter(per_row=1, hashes=1), dedup.Filter(per_row=1 << 16, most=1 << 20)])
def test_duplicates(docs, p):
    """Also with a filter of several segments, the last case."""
    got = dedup.duplicates(docs, p).collect()
    want = slow_groups()
    assert len(got) == len(ROWS)
    for r in got:
        assert (r["keep_id"], r["group_size"]) == want[r["text_sha256"]]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    kept = [r["text_sha256"] for r in got if r["kept"]]
    assert sorted(kept) == sorted(want)


def test_kept_rows(docs):
    got = dedup.kept_rows(docs)
    assert got.columns == docs.columns
    want = slow_groups()
    rows = got.collect()
    assert sorted(sha(re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "")) for r in rows) == sorted(want)
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(i) for i, _ in want.values())


def test_dedup_of_empty_tables(docs):
    assert dedup.duplicates(empty(docs)).collect() == [] and dedup.kept_rows(empty(docs)).collect() == []


def test_most_rows_pass_straight_through(spark):
    """The filter says maybe of all repeated hashes and of few others."""
    df = spark.range(40_000).selectExpr("id AS doc_id", "concat('text ', if(id % 100 = 0, 0, id)) AS text").repartition(7)
    narrow = dedup.hashed(df)
    rows = dedup.maybe_repeated(narrow).groupBy("maybe").count().collect()
    counts = {r["maybe"]: r["count"] for r in rows}
    assert 400 <= counts[True] <= 600
    heavy = dedup.duplicates(df).where("group_size > 1").collect()
    assert len(heavy) == 400 and {(r["keep_id"], r["group_size"]) for r in heavy} == {(39_900, 400)}


def test_dedup_parameters_are_checked():
    for p in ({"per_row": 0}, {"hashes": 0}, {"most": 3 << 20}, {"most": 1 << 10}):
        with pytest.raises(ValueError, match="needed"):
            dedup.Filter(**p)


VECTORS = [(i, [float(np.float32(x)) for x in np.random.default_rng(i % 90).normal(size=5) * [3, 1, 0.2, 1, 0.01]]) for i in range(120)]
ODD = [(500, None), (501, [1.0, None, 2.0, 0.0, 0.0]), (502, [1.0, float("nan"), 2.0, 0.0, 0.0]), (503, [1.0, 2.0, float("inf"), 0.0, 0.0]), (504, []), (505, [1.0] * 4), (None, VECTORS[0][1]), (3, VECTORS[0][1])]


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame([(i, v, None, 7, "x") for i, v in VECTORS + ODD], "vec_id bigint, embedding array<float>, label int, dims int, x string").repartition(4)


def slow_whitening(rows, k=16):
    x = {i: tuple(int(np.floor(64 * np.float64(np.float32(c)))) + 1_000_000 for c in v) for i, v in rows}
    fit = sorted(set(x.values()))
    n, d = len(fit), len(fit[0])
    s = [sum(v[j] for v in fit) for j in range(d)]
    cov = np.array([[float(sum((Fraction(n * v[a] - s[a], n) * Fraction(n * v[b] - s[b], n) for v in fit), Fraction(0)) / n) for b in range(d)] for a in range(d)])
    values, columns = np.linalg.eigh(cov)
    order = np.argsort(-values)[:k]
    out = {}
    for i, v in x.items():
        y = np.array([float(Fraction(n * c - t, n)) for c, t in zip(v, s)])
        for c, at in enumerate(order, 1):
            out[i, c] = (n, sum((n * a - t) ** 2 for a, t in zip(v, s)), float(y @ columns[:, at] / np.sqrt(values[at])), values[at] / np.trace(cov))
    return out


def test_whitening(vectors):
    want = slow_whitening(VECTORS + [(None, VECTORS[0][1])])
    got = whitening.whitened(vectors).collect()
    assert len(got) == 5 * (len(VECTORS) + 2)
    signs = {}
    for r in got:
        n, deviation, value, explained = want[r["vec_id"] if r["vec_id"] != 3 or r["deviation"] == want[3, 1][1] else 0, r["component"]]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert r["explained"] == pytest.approx(explained, rel=1e-9) and abs(r["whitened"]) == pytest.approx(abs(value), rel=1e-7, abs=1e-9)
        if abs(value) > 1e-6:
            assert signs.setdefault(r["component"], np.sign(value * r["whitened"])) == np.sign(value * r["whitened"])
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-10


def test_whitening_of_the_test_vectors(spark):
    df = table(spark, "/root/testdata/sf0.01", "embeddings")
    want = slow_whitening([(r["vec_id"], r["embedding"]) for r in df.collect()])
    got = queries.op12_whitening(spark, "/root/testdata/sf0.01").collect()
    assert {(r["vec_id"], r["component"]): (r["n"], r["deviation"]) for r in got} == {k: v[:2] for k, v in want.items()}
    assert max(abs(abs(r["whitened"]) - abs(want[r["vec_id"], r["component"]][2])) for r in got) < 1e-8
    assert max(abs(r["explained"] / want[r["vec_id"], r["component"]][3] - 1) for r in got) < 1e-10 and got[0]["identity_error"] < 1e-10


def test_whitening_without_variance(spark, vectors):
    one = vectors.where("vec_id = 7").unionByName(vectors.where("vec_id = 7"))
    got = whitening.whitened(one).collect()
    assert len(got) == 10 and all((r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) == (1, 0, None, 0.0, 0.0) for r in got)
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)], "vec_id bigint, embedding array<double>")
    got = whitening.whitened(flat).collect()
    assert {r["component"] for r in got if r["whitened"] is None} == {2, 3} and {r["identity_error"] for r in got}.pop() < 1e-12
    for none in (empty(vectors), vectors.where("vec_id IN (500, 501, 502, 503, 504)")):
        assert whitening.whitened(none).collect() == [] and whitening.whitened(none).columns[0] == "vec_id"


def test_whitening_of_huge_entries(spark):
    rows = [(i, [1e30 if i == 0 else float(i), -float(i) * 1e9]) for i in range(6)]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert len(got) == 12 and {r["deviation"] for r in got} == {None} and got[0]["identity_error"] < 1e-4


def test_jacobi_keeps_small_eigenvalues():
    """Of a matrix whose scaled form is well conditioned, every eigenvalue to a relative error near the rounding."""
    d = np.diag([1.0, 1e-4, 1e-8, 1e-12])
    m = d @ (np.eye(4) + 0.1 * np.ones((4, 4))) @ d
    values, vectors = whitening.jacobi(m)
    assert np.allclose(vectors.T @ vectors, np.eye(4), atol=1e-14)
    # determinants of the scaled leading minors give the exact product
    exact = np.linalg.det(np.eye(4) + 0.1 * np.ones((4, 4))) * np.prod(np.diag(d)) ** 2
    assert np.prod(values) == pytest.approx(exact, rel=1e-12)
    assert whitening.jacobi(np.zeros((3, 3)))[0].tolist() == [0, 0, 0]
