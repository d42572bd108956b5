"""The three models' scores by scorers written out here from the models' numbers alone."""

import hashlib
import math
import re
import zlib
from collections import Counter
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from lexispark.llm import langid, quality, toxicity
from lexispark.llm.common import table

SF = "/root/testdata/sf0.001"
ODD = [None, "", " \n\t ", "12 !?", "é ü 漢字 🎉 x", "a a a b", "The, the THE... idiot! idiots", "x" * 40, "İstanbul ẞ", "one\x85two three"]
M = 0xFFFFFFFF


@pytest.fixture(scope="module")
def docs(spark):
    whole = table(spark, SF, "documents").select("doc_id", "text", "lang")
    return whole.unionByName(spark.createDataFrame([(-i - 1, t, None) for i, t in enumerate(ODD)], whole.schema))


def slow_language(text, m):
    """(language, cosine, rejected)."""
    low = text.lower()
    if not any(c.isalpha() for c in low):
        return "und", 0.0, True
    line = [ord(c) if c.isalpha() else 32 for c in low]
    line = [32] + [c for k, run in groupby(line, key=lambda c: c == 32) for c in ([32] if k else run)] + [32]
    if low[0].isalpha() is False:  # white space at the beginning is the padding's
        line = line[1:]
    grams = [(1, c) for c in line if c != 32]
    grams += [(2, (a * 0x9E3779B1 + b) & M) for a, b in zip(line, line[1:])]
    grams += [(3, (((a * 0x9E3779B1 + b) & M) * 0x85EBCA77 + c) & M) for a, b, c in zip(line, line[1:], line[2:])]
    n = Counter((((h ^ (seed * 0x27D4EB2F & M)) * 0xC2B2AE3D) & M) >> 19 for seed, h in grams)
    v = {b: math.log1p(k) * float(m.idf[b]) for b, k in n.items()}
    size = math.sqrt(sum(x * x for x in v.values()))
    cosines = [sum(x / size * float(c[b]) for b, x in v.items()) for c in m.centroids]
    best = max(range(len(cosines)), key=lambda i: cosines[i])
    own = m.owner[best]
    return m.languages[own], min(1.0, max(0.0, cosines[best])), cosines[best] < m.least[own]


def test_language_scores(spark, docs):
    m = langid.fitted(docs)
    for r in langid.identify(docs, m).join(docs.select("doc_id", "text"), "doc_id").collect():
        lang, score, rejected = slow_language(r["text"] or "", m)
        assert (r["lang_pred"], r["rejected"]) == (lang, rejected) and r["score"] == pytest.approx(score, abs=1e-4)


def slow_quality(text, m):
    def mix(h):
        h = ((h ^ (h >> 15)) * 0x2C1B3C6D) & M
        return (h ^ (h >> 12)) % (1 << 16)

    words = text.split()
    n = Counter(words)
    again = sum(a == b for a, b in zip(words, words[1:]))
    if again:
        n["\x00repeat"] = again
    n = n or Counter({"\x00empty": 1})
    total = 0.0
    for w, k in n.items():
        found = [mix(zlib.crc32(w.encode()))]
        for size in (3, 4, 5):
            marked = f"<{w}>"
            for at in range(len(marked) - size + 1):
                h = size * 0x3C6EF372 & M
                for c, f in zip(marked[at : at + size], (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)):
                    h = ((h ^ ord(c)) * f) & M
                    h ^= h >> 13
                found.append(mix(h))
        total += k * sum(float(m.value[b]) for b in found) / len(found)
    return 1 / (1 + math.exp(-max(-30, min(30, m.bias + total / sum(n.values())))))


def test_quality_scores(spark, docs):
    m = quality.fitted(docs, table(spark, SF, "labels"))
    rows = quality.score(docs, m, (4, 2)).join(docs.select("doc_id", "text"), "doc_id").collect()
    assert len(rows) == docs.count() and 0 < sum(r["predicted"] for r in rows) < len(rows)
    for r in rows:
        assert r["score"] == pytest.approx(slow_quality(r["text"] or "", m), abs=1e-6)


def slow_toxicity(text, m):
    hashed = lambda s: int.from_bytes(hashlib.blake2b(s.encode(), digest_size=8).digest(), "little")
    n = Counter()
    for token in text.lower().split():
        for core in re.findall(r"\w+", token):
            for f in [core, *(core[:k] + "*" for k in (4, 5, 6, 7) if len(core) >= k)]:
                n[hashed(f)] += 1
    z = m.bias + m.length * math.log(1 + len(text.split())) + sum(sum(m.weights[f][: min(k, 3)]) for f, k in n.items() if f in m.weights)
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def test_toxicity_scores(spark, docs):
    m = toxicity.fitted(docs, table(spark, SF, "labels"))
    rows = toxicity.score(docs, m, (3, 1)).join(docs.select("doc_id", "text"), "doc_id").collect()
    assert len(rows) == docs.count() and 0 < sum(r["predicted"] for r in rows) < len(rows)
    for r in rows:
        assert r["score"] == pytest.approx(slow_toxicity(r["text"] or "", m), abs=1e-6)


def test_models_meet_the_same_rows(docs):
    assert docs.where(F.col("doc_id") < 0).count() == len(ODD)
