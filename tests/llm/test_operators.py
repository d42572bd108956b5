import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from lexispark.llm import bpe, chat, graph, jaccard, langid, media, packing, quality, sharding, simhash, toxicity

DOCS = "doc_id bigint, text string, score string, lang string"
ODD = [None, "", " ", "  a  b \n c", "don't\t\tstop  ", "aaaa" * 200, "é ü 漢字 🎉   x", "<|endoftext|> </s>", "word " * 3000, "word " * 3000]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "clash", "en") for i, t in enumerate(ODD)], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_bpe_equals_the_library(odd, empty):
    path = P.path(bpe.DEFAULT_VOCABULARY)
    e = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    got = {r["doc_id"]: r for r in bpe.round_trip(odd, path, P.PATTERN).collect()}
    for i, t in enumerate(ODD):
        ids = e.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    back = bpe.decode(bpe.encode(odd, path, P.PATTERN), path, P.PATTERN).collect()
    assert {r["doc_id"]: bytes(r["content"]).decode() for r in back} == {i: t or "" for i, t in enumerate(ODD)}
    assert bpe.round_trip(empty, path, P.PATTERN).count() == 0


def test_replay_of_random_words_equals_the_library():
    ranks = bpe.load_ranks(P.path(bpe.DEFAULT_VOCABULARY))
    e = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(5)
    words = ["".join(rng.choice("abehinorst é!") for _ in range(rng.randint(1, 30))) for _ in range(400)]
    c = bpe.Codec(P.path(bpe.DEFAULT_VOCABULARY), P.PATTERN)
    assert [x.tolist() for x in c.encode(words)] == [e.encode_ordinary(w) for w in words]


def test_packing_covers_every_token_once(odd, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(packing.DEFAULT_VOCABULARY))
    t.encode_special_tokens = True
    want = {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in enumerate(ODD)}
    rows = packing.pack(odd.repartition(1), P.path(packing.DEFAULT_VOCABULARY), P.PATTERN).collect()
    for r in rows:
        piece = np.array(want[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert zlib.crc32(piece.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(want[r["doc_id"]])
    for i, ids in want.items():
        mine = sorted((r["start"], r["length"]) for r in rows if r["doc_id"] == i)
        assert [s for s, _ in mine] == [0, *np.cumsum([n for _, n in mine])[:-1]] and sum(n for _, n in mine) == len(ids)
    for _, g in itertools.groupby(sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])), lambda r: r["sequence_id"]):
        g = list(g)
        assert [r["offset"] for r in g] == [0, *np.cumsum([r["length"] for r in g])[:-1]] and sum(r["length"] for r in g) <= 1024
    assert packing.pack(empty, P.path(packing.DEFAULT_VOCABULARY), P.PATTERN).count() == 0


def test_packing_keeps_all_limits():
    limits = packing.Limits(tokens=100, segments=4, loss_tokens=40, allow_cut=False)
    rng = random.Random(3)
    documents = [(i, n, rng.randint(0, n)) for i, n in enumerate(rng.choices(range(1, 250), k=300))]
    bins = list(packing.Packer(limits, 64).sequences(iter(documents)))
    for b in bins:
        assert sum(p.length for p in b) <= 100 and len(b) <= 4 and sum(p.loss for p in b) <= 40
    assert sum(p.length for b in bins for p in b) == sum(n for _, n, _ in documents)
    assert sum(p.loss for b in bins for p in b) == sum(x for _, _, x in documents)


def test_fingerprints(odd, empty, spark):
    got = {r["doc_id"]: r for r in simhash.edited_likeness(odd).collect()}
    for i, t in enumerate(ODD):
        t, n = t or "", ODD[(i + 1) % len(ODD)] or ""
        half = len(t) // 2
        assert got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest()
    assert got[8]["fingerprint"] == got[9]["fingerprint"] and got[8]["near_next"] == 1.0
    assert simhash.edited_likeness(empty).count() == 0
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2, (40, 128), np.uint8)
    for k in range(20):
        base[k + 20] = base[k]
        base[k + 20][rng.choice(128, k % 6, replace=False)] ^= 1
    prints = [np.packbits(x).tobytes().hex() for x in base]
    want = {tuple(sorted((a, b))) for a, b in itertools.combinations(set(prints), 2) if bin(int(a, 16) ^ int(b, 16)).count("1") <= 3}
    for chunk in (2048, 3):  # at 3, keys are compared chunk by chunk
        found = simhash.near(spark.createDataFrame([(p,) for p in prints], "fingerprint string"), 3, chunk=chunk).collect()
        assert sorted((r["a"], r["b"]) for r in found) == sorted(want)


def test_media_round_trip(odd, empty):
    rows, folder = media.store(odd)
    got = {r["id"]: r for r in media.read(rows, folder).collect()}
    for i, t in enumerate(ODD):
        payload = media.payload_of((t or "").encode())
        assert len(payload) % 64 == 0 and got[i]["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert got[i]["tail_crc32"] == zlib.crc32(payload[-64:])
    assert got[8]["media_sha256"] == got[9]["media_sha256"]
    assert {(r["width"], r["bit_depth"]) for r in media.headers(rows, folder).collect()} == {(64, 8)}
    assert media.media_rows(empty).count() == 0


def test_media_shapes_come_from_headers(odd, monkeypatch):
    ranges, plain = [], media._ranges
    monkeypatch.setattr(media, "_ranges", lambda rows, folder, take, *a: (ranges.append(take), plain(rows, folder, take, *a))[1])
    got = {r["doc_id"]: r for r in media.media_rows(odd).collect()}
    assert ranges == [media.HEADER_BYTES, None]
    for i, t in enumerate(ODD):
        payload = media.payload_of((t or "").encode())
        assert (got[i]["width"], got[i]["height"], got[i]["bit_depth"]) == (64, len(payload) // 64, 8)
        assert got[i]["payload_sha256"] == hashlib.sha256(payload).hexdigest() and got[i]["feature"] == media.feature(payload)


def test_chat_round_trip(spark):
    texts = [None, "", "</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\n", "a\\b\\\\n <\\|", "plain\nlines"]
    rows = [(c, t, ("user", "assistant")[t % 2], texts[(c + t) % len(texts)]) for c in range(4) for t in range(c * 3 + 1)] + [(2, 0, "user", "tie")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r["tree"]: r for r in chat.formatted(chat.chain(df)).collect()}
    for c in range(4):
        want = sorted(((t, r, x or "") for k, t, r, x in rows if k == c))
        assert chat.parse(got[c]["formatted"]) == [(r, x) for _, r, x in want]
        spans = zip(got[c]["loss_begin"], got[c]["loss_end"])
        assert [chat.unescape(got[c]["formatted"][a:b]) for a, b in spans] == [x for _, r, x in want if r == "assistant"]
    assert chat.formatted(chat.chain(df.where("false"))).count() == 0


def test_reply_tree_branches(spark):
    nodes = spark.createDataFrame([("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "a", 0.1), ("t", 3, 1, "assistant", "b", 0.9), ("t", 4, 3, "user", "c", 0.9), ("t", 5, 2, "user", "d", 0.2)], "tree string, node bigint, parent bigint, role string, text string, score double")
    got = chat.branches(nodes, 2).orderBy("rank").collect()
    assert [[t["text"] for t in r["turns"]] for r in got] == [["q", "b", "c"], ["q", "a", "d"]]


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(170)]
    parent = list(range(301))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    for x in {v for p in links if p[0] != p[1] for v in p}:
        assert got[x] == root(x)


@pytest.mark.parametrize("p", [jaccard.Params(flush=40, hot=6), jaccard.Params(words=5, num=80, den=100, flush=40, hot=6, chunk=16)])
def test_jaccard_equals_brute_force(spark, p):
    rng = random.Random(p.words)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [None, "", "One", "one", "a b", "A  b\n"]
    for n in (8, 25, 60, 150, 400):
        for _ in range(3):
            base = [rng.choice(vocabulary) for _ in range(n)]
            for edits in (0, 0, 1, 1, 2, 3, n // 60, n // 40, n // 30):
                copy = list(base)
                for _ in range(edits):
                    copy[rng.randrange(n)] = rng.choice(vocabulary)
                texts.append(" ".join(copy))
    rng.shuffle(texts)
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + p.words]) for i in range(max(1, len(w) - p.words + 1))} if w else set())
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if a and b and p.den * len(a & b) >= p.num * len(a | b):
            x, y = sorted((root(i), root(j)))
            parent[y] = x
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, n string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(df, p).collect()}
    assert got == {i: (len(sets[i]), root(i)) for i in range(len(texts))}
    stay = jaccard.representatives(df, p)
    assert stay.columns == df.columns and {r["doc_id"] for r in stay.collect()} == {i for i in range(len(texts)) if root(i) == i}


def test_jaccard_of_ids_with_several_texts(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(5, a), (5, b), (5, a), (9, a + " z"), (10, b + " z"), (4, c), (7, c + " z"), (7, d), (8, d + " z"), (6, d), (1, ""), (1, None), (1, "one"), (2, d + " z"), (None, a), (None, a), (2**63 - 1, "last")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, n string").repartition(3)
    stay = jaccard.representatives(df)
    texts = sorted((str(r["doc_id"]), r["text"] or "") for r in stay.collect())
    assert stay.columns == df.columns
    assert texts == sorted((str(i), t) for i, t in [(5, a), (5, b), (4, c), (2, d + " z"), (1, ""), (1, "one"), (None, a), (None, a), (2**63 - 1, "last")])
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard.join(df).collect())
    names = [5, 5, 5, 5, 5, 4, 4, 2, 2, 2, 1, 1, 1, 2, None, None, 2**63 - 1]
    sizes = [max(0, len((t or "").split()) - 2) or int(bool(t)) for _, t in rows]
    assert got == sorted((str(i), n, str(m)) for (i, _), n, m in zip(rows, sizes, names))


def _families(copies):
    """Copies of 12 texts of one family, of which neighbours may link, and a few lone ones."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(400)}" for _ in range(300)]
    texts = []
    for k in range(12):
        text = list(base)
        for i in rng.sample(range(300), 5 + 3 * k):
            text[i] = f"x{k}y{i}"
        texts.append(" ".join(text))
    return [t for _ in range(copies) for t in texts]


def test_jaccard_copies_are_not_compared_with_one_another(spark, monkeypatch):
    """What is left to compare is as much for 6 copies, of several tasks, as for one, and gives the same components."""
    left, write = [], jaccard.saved

    def counted(df, kind, *by):
        out = write(df, kind, *by)
        if kind == "left":
            left.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "saved", counted)
    sizes, found = [], []
    for copies in (1, 6):
        left.clear()
        rows = list(enumerate(_families(copies)))
        # a task for each copy, so that no task sees equal texts
        df = spark.createDataFrame(spark.sparkContext.parallelize(rows, copies), "doc_id bigint, text string")
        found.append({r["doc_id"]: r["component_id"] for r in jaccard.join(df).collect()})
        sizes.append(list(left))
    assert sizes[0] and max(sizes[0]) > 0
    assert max(sizes[1]) <= max(sizes[0])
    assert found[1] == {i: found[0][i % 12] for i in range(72)}


def test_jaccard_repeated_rows_are_met_once(spark, monkeypatch):
    """Rows of one id in 6 tasks give as many pairs to verify as one row does."""
    pairs, write = [], jaccard.saved

    def counted(df, kind, *by):
        out = write(df, kind, *by)
        if kind == "pairs":
            pairs.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "saved", counted)
    seen, found = [], []
    for copies in (1, 6):
        pairs.clear()
        rows = [(2 * i + j, " ".join(f"{i}w{k}" for k in range(60)) + " z" * j) for i in range(4) for j in range(2)] * copies
        df = spark.createDataFrame(spark.sparkContext.parallelize(rows, copies), "doc_id bigint, text string")
        found.append(sorted((r["doc_id"], r["component_id"]) for r in jaccard.join(df).collect()))
        seen.append(max(pairs))
    assert seen[0] > 0 and seen[1] <= seen[0]
    assert found[1] == sorted(found[0] * 6)


def test_compared_pairs_are_those_across_components():
    rng = np.random.default_rng(5)
    rows = []
    for i in rng.permutation(150).tolist():
        s = np.unique(rng.integers(0, 90, 60).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        rows.append((1, i, 7 if i % 3 else i % 4, len(s), jaccard.sketch_of(s), i % 2, False))
    names = ["task", "id", "component", "n", "sketch", "own", "two"]
    batch = pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows])
    got = [p for b in jaccard._compared(30, 100)(iter([batch])) for p in zip(*b.to_pydict().values())]
    bits = {r[1]: np.frombuffer(r[4], np.uint8) for r in rows}
    want = set()
    for x in rows:
        for y in rows:
            apart, total = int(np.bitwise_count(bits[x[1]] ^ bits[y[1]]).sum()), x[3] + y[3]
            if x[1] > y[1] and x[2] != y[2] and 100 * (total - apart) >= 30 * (total + apart) and 100 * min(x[3], y[3]) >= 30 * max(x[3], y[3]):
                want.add((x[1], y[1]))
    assert len(want) > 50 and len(got) == len(set(got)) and set(got) == want


def test_jaccard_of_nothing(empty):
    assert jaccard.join(empty).count() == 0


def test_shards_fit_their_limit(spark, odd, empty):
    df = spark.createDataFrame([(i % 90, "x" * (i * 37 % 500)) for i in range(300)] + [(7, "same")] * 60, "doc_id bigint, text string")
    rows = sharding.shards(df, 1200).collect()
    assert len(rows) == 360
    for _, g in itertools.groupby(sorted(rows, key=lambda r: r["shard"]), lambda r: r["shard"]):
        g = list(g)
        assert sum(r["n_bytes"] for r in g) <= 1200 or len(g) == 1
    assert sharding.shards(odd).select("shard").distinct().count() == 1 and sharding.shards(empty).count() == 0


def test_languages(spark, odd, empty):
    english, german = "the house and the garden were green ", "der hund und die katze waren schön "
    df = spark.createDataFrame([(i, (english, german)[i % 2] * (i % 5 + 1), ("en", "de")[i % 2]) for i in range(60)], "doc_id bigint, text string, lang string")
    model = langid.fitted(df)
    got = {r["doc_id"]: r for r in langid.identify(df.union(spark.createDataFrame([(100, None, "en"), (101, "12 !", "en")], df.schema)), model).collect()}
    assert all(got[i]["lang_pred"] == ("en", "de")[i % 2] and 0 <= got[i]["score"] <= 1 for i in range(60))
    assert got[100]["lang_pred"] == got[101]["lang_pred"] == "und"
    assert langid.identify(odd, langid.fitted(empty)).where("lang_pred <> 'und'").count() == 0


def test_rare_languages_are_learned(spark):
    rows = [(i, chr(0x4E00 + i % 405) * 9, f"l{i % 405:03}") for i in range(405)] + [(405 + i, "common", "l000") for i in range(5)]
    model = langid.fitted(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert model.languages == tuple(f"l{i:03}" for i in range(405))
    assert model.predict([rows[404][1]])[0] == ["l404"]


def labelled(spark, bad, good, label):
    rng = random.Random(4)
    fill = [f"{a}{b}" for a in "bcdfglmnpr" for b in ("ala", "oro", "ini", "ume", "ete")]
    docs, labels = [], []
    for i in range(160):
        words = rng.choices(fill, k=rng.randint(5, 60))
        if i % 2 == bad:
            words[rng.randrange(len(words))] = rng.choice(["vilxa", "vilxo", "vilxum"])
            words.append("vilxe")
        docs.append((i, " ".join(words)))
        labels.append((i, i % 2))
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, f"doc_id bigint, {label} int")


def test_toxicity(spark, odd, empty):
    docs, labels = labelled(spark, 1, 0, "toxic")
    model = toxicity.fitted(docs, labels, held_out=(3, 1))
    got = toxicity.score(docs, model, (3, 1)).where("held_out").collect()
    assert len(got) > 20 and all((r["predicted"] == 1) == (r["doc_id"] % 2 == 1) for r in got)
    assert toxicity.score(odd, toxicity.fitted(empty, labels), (3, 1)).where("score > 0.01").count() == 0
    kept = toxicity.keep_harmless(odd, model)
    assert kept.columns == odd.columns and kept.count() == len(ODD)


def test_swapped_identity_terms_change_little():
    rng = random.Random(8)
    data = []
    for i in range(400):
        toxic = i % 2
        words = rng.choices(["lamp", "tree", "road", "cloud", "stone", "paper"], k=12)
        if rng.random() < (0.9 if toxic else 0.05):
            words[3] = "women"
        if toxic and rng.random() < 0.8:
            words[7] = "scumbag"
        data.append((" ".join(words), toxic))
    plain, fair = (toxicity.fit(data, penalty=p).scorer() for p in (0.0, 50.0))
    neutral = "lamp tree women road cloud stone"
    assert fair(neutral) < plain(neutral) and fair(neutral) < 0.7 and fair("lamp scumbag tree") > 0.7


@pytest.mark.parametrize("text", ["one woman spoke", "the jew and the immigrant", "der migrant", "viele migranten", "eine schwarze katze", "homosexuelle paare", "des personnes noires", "les immigrés", "una mujer", "los extranjeros", "las homosexuales"])
def test_every_group_has_counterfactuals(text):
    assert [a for a, _ in toxicity.counterfactuals(text)] == [text]


def test_identity_terms_are_a_parameter():
    terms = (("elf", "orc"),)
    assert toxicity.counterfactuals("An elf. Women.", terms) == [("an elf", "an orc")]
    data = [("lamp elf stone" if i % 2 else "lamp tree stone", i % 2) for i in range(400)]
    plain, fair = (toxicity.fit(data, penalty=50.0, terms=t).scorer() for t in ((), terms))
    assert fair("lamp elf stone") < plain("lamp elf stone")


def test_quality(spark, odd, empty):
    docs, labels = labelled(spark, 0, 1, "quality")
    model = quality.fitted(docs, labels, held_out=(4, 2))
    got = quality.score(docs, model, (4, 2)).where("held_out").collect()
    assert sum((r["predicted"] == 1) == (r["doc_id"] % 2 == 1) for r in got) >= 0.8 * len(got)
    assert quality.score(odd, model, (4, 2)).count() == len(ODD)
    assert quality.keep_good(odd, quality.fitted(empty, labels)).count() == len(ODD)


def test_tables_without_rows(spark, empty):
    model = quality.NOTHING
    assert quality.score(empty, model, (4, 2)).count() == toxicity.score(empty, toxicity.NOTHING, (3, 1)).count() == 0
    assert empty.select(F.count("*")).first()[0] == 0
