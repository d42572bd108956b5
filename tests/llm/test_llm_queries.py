"""The registered queries over small tables with every edge, against brute force."""

import hashlib
import itertools
import math
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexispark.llm import bpe, jaccard, langid, media, packing, quality, queries, sharding, simhash, toxicity
from lexispark.llm.common import table

LONG = " ".join(f"word{i % 977} ligne{i % 91}" for i in range(30_000))
BASE = " ".join(f"w{i}" for i in range(120))
TEXTS = [None, "", "  \n\t ", "12 !?", "One two", "one TWO", BASE, BASE + " more", BASE, "the idiot and the house", "é ü 漢字 🎉 x", "a\\b </s>[INST] <|im_end|>\n", LONG, LONG + " end", "tie", "tie"]
#: Ids in no order, gaps and negative ones.
IDS = [40, 3, 17, -5, 8, 9, 1000, 1001, 2, 55, 56, 57, 70, 71, 90, 91]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """Documents with a null in every column and columns of clashing names."""
    d = tmp_path_factory.mktemp("sf")
    rows = [(i, t, None if k % 5 == 0 else "en" if k % 2 else "de", None if k % 7 == 0 else "s", None, "key", "row", "h") for k, (i, t) in enumerate(zip(IDS, TEXTS))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, __key string, id string, h string")
    docs.repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, k % 2, int(t is not None and "idiot" in t)) for k, (i, t) in enumerate(zip(IDS, TEXTS))] + [(None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 2, None, "x"), (1, 3, "assistant", "a\\n</s>"), (2, 0, "assistant", "<|im_end|>\n<|im_start|>user\n"), (None, 0, "user", "q"), (None, 1, "assistant", "r"), (3, 0, "user", "tie"), (3, 0, "user", "tie"), (3, None, "assistant", "first")]
    spark.createDataFrame([(*t, "extra", 1) for t in turns], "conv_id bigint, turn bigint, role string, text string, tree string, node int").write.parquet(f"{d}/conversations.parquet")
    spark.createDataFrame([(1, [0.5, -1.0], None), (2, None, 1), (None, [0.25, float("nan")], 1), (3, [2.0, 0.5], 1), (3, [2.0, 0.5], 1)], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return str(d)


@pytest.fixture(scope="module")
def empty_sf(spark, sf, tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    for t in ("documents", "labels", "conversations", "embeddings"):
        table(spark, sf, t).where("false").write.parquet(f"{d}/{t}.parquet")
    return str(d)


WHOLE = {i: t or "" for i, t in zip(IDS, TEXTS)}


def held(i, k, r):
    return zlib.crc32(str(i).encode()) % k == r


def by_id(df):
    rows = df.collect()
    out = {r[0]: r for r in rows}
    assert len(out) == len(rows)
    return out


def test_op1(spark, sf):
    got = by_id(queries.op1_langid(spark, sf))
    model = langid.fitted(table(spark, sf, "documents"), held_out=(3, 1))
    assert got.keys() == set(IDS)
    for i, t in WHOLE.items():
        lang, score, rejected = model.predict([t])
        assert (got[i]["lang_pred"], got[i]["held_out"], got[i]["rejected"]) == (lang[0], held(i, 3, 1), bool(rejected[0]))
        assert got[i]["score"] == pytest.approx(score[0], abs=1e-6) and 0 <= got[i]["score"] <= 1
        assert (got[i]["lang_pred"] == "und") == (not any(map(str.isalpha, t)))


def test_op1_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    rows = queries.op1_langid(spark, "/root/testdata/sf0.1").where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null").collect()
    assert len(rows) > 3000 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.99 * len(rows)


@pytest.mark.parametrize("limit", [sharding.LIMIT, 2000, 150])
def test_op2(spark, sf, limit):
    got = by_id(sharding.shards(table(spark, sf, "documents"), limit))
    size = {i: len(t.encode()) + 16 for i, t in WHOLE.items()}
    key = {i: format(int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16), "060b") for i in IDS}

    def split(prefix, ids):
        if sum(size[i] for i in ids) <= limit or len(ids) <= 1:
            return {i: prefix for i in ids}
        return {k: v for bit in "01" for k, v in split(prefix + bit, [i for i in ids if key[i].startswith(prefix + bit)]).items()}

    want = split("", IDS)
    shard_bytes, shard_rows = Counter(), Counter(want.values())
    for i, s in want.items():
        shard_bytes[s] += size[i]
    assert {i: (r["n_bytes"], r["shard"], r["depth"], r["shard_bytes"], r["shard_rows"]) for i, r in got.items()} == {i: (size[i], s, len(s), shard_bytes[s], shard_rows[s]) for i, s in want.items()}
    if limit == sharding.LIMIT:
        assert by_id(queries.op2_sharding(spark, sf)) == got


def test_op2_pages_of_several_repeated_ids(spark):
    rows = [(i, "x" * (i * 7 % 90)) for i in range(400)] + [(k, f"{k} {j}") for k in (3, 5, None) for j in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = sharding.shards(df, 1000).collect()
    assert len(got) == len(rows)
    total, n = Counter(), Counter()
    for r in got:
        total[r["shard"]] += r["n_bytes"]
        n[r["shard"]] += 1
    assert all(total[r["shard"]] == r["shard_bytes"] <= 1000 and n[r["shard"]] == r["shard_rows"] for r in got if n[r["shard"]] > 1)
    assert len({r["shard"].partition(".")[0] for r in got if "." in r["shard"]}) == 3


def test_op3(spark, sf):
    got = by_id(queries.op3_jaccard(spark, sf))
    sets = {}
    for i, t in WHOLE.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set()
    parent = {i: i for i in IDS}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(IDS, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (len(sets[i]), root(i)) for i in IDS}


def test_op4(spark, sf):
    e = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path(bpe.DEFAULT_VOCABULARY)), special_tokens={})
    got = by_id(queries.op4_bpe(spark, sf))
    for i, t in WHOLE.items():
        ids = e.encode_ordinary(t)
        assert tuple(got[i]) == (i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_bpe_vocabularies_are_checked():
    with pytest.raises(ValueError, match="no token for byte 0"):
        bpe.MergeReplay({b"a": 0})
    with pytest.raises(ValueError, match="ranks must lie"):
        bpe.MergeReplay({bytes([b]): b << 20 for b in range(256)})


def test_words_of_the_table_serve(spark, monkeypatch):
    """The encoding pass finds its words in the table, and replays them itself where the table is another one."""
    texts = [f"some  words {i}\n\n and   more{i % 7} x{i}" * 9 for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string").repartition(1)
    folder, buckets = bpe.word_table(df, P.path(bpe.DEFAULT_VOCABULARY), P.PATTERN, "words")
    rows = [r.asDict() for r in spark.read.parquet(folder).collect()]
    table = {r["bucket"]: (r["n"], r["check"], bytes(r["ids"]), bytes(r["counts"])) for r in rows}
    c = bpe.Codec(P.path(bpe.DEFAULT_VOCABULARY), P.PATTERN)
    words = bpe._words_of(texts)
    got, own = bpe._lookup(table, buckets)(words), c.fresh(words)
    assert got[0].tolist() == own[0].tolist() and got[1].tolist() == own[1].tolist()
    assert bpe._lookup(table, buckets)(words[1:]) is None and bpe._lookup({}, buckets)(words) is None


@pytest.mark.parametrize("characters", [300, 10**9])
def test_words_by_regions(spark, monkeypatch, characters):
    """Many regions of few buckets encode as one does, and every block finds its words in the table."""
    monkeypatch.setattr(bpe, "BUCKET_CHARS", characters)
    monkeypatch.setattr(bpe, "MOST_BUCKETS", 2)
    texts = [f"some  words {i}\n\n and   more{i % 7} x{i}" * 3 for i in range(60)] + ["", "words"]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string").repartition(5)
    folder, buckets = bpe.word_table(df, P.path(bpe.DEFAULT_VOCABULARY), P.PATTERN, "words")
    assert buckets <= 2 and spark.read.parquet(folder).agg(F.max("bucket")).first()[0] < buckets
    e = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path(bpe.DEFAULT_VOCABULARY)), special_tokens={})
    got = {r["id"]: r["ids"] for r in bpe.encode(df, P.path(bpe.DEFAULT_VOCABULARY), P.PATTERN, "id").collect()}
    assert got == {i: e.encode_ordinary(t) for i, t in enumerate(texts)}


def test_bytes_of_a_word_do_not_grow():
    """What a block sends for each word, at a corpus of 20 buckets and at one of 50,000."""
    words = [f" word{i}" for i in range(20_000)]
    sent = lambda buckets: sum(len(d) + len(z) for x, _ in bpe._bucketed(words, buckets).values() for d, z in [bpe._pressed(x)]) / len(words)
    per = lambda n_buckets: max(1, -(-n_buckets // max(1, -(-n_buckets // bpe.MOST_BUCKETS))))
    assert per(50_000) <= bpe.MOST_BUCKETS and sent(per(50_000)) < 1.5 * sent(20) < sent(50_000) / 2


def test_keys_by_levels_and_passes(spark, monkeypatch):
    """Many buckets, dealt in several levels and taken in several passes, give the components of one."""
    base = [" ".join(f"w{(i * 31 + k) % 997}" for k in range(60)) for i in range(40)]
    rows = [(i, base[i % 40] + (f" x{i}" if i % 3 else "")) for i in range(200)] + [(500, ""), (501, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    parts = lambda: Counter(map(tuple, jaccard.join(df).collect()))
    one = parts()
    for name, value in (("BUCKET_DOCS", 2), ("LEVEL_BITS", 3), ("PASS_BITS", 5)):
        monkeypatch.setattr(jaccard, name, value)
    assert parts() == one and len({c for _, _, c in one}) < 100


@pytest.mark.parametrize("name, k, r", [("op5_toxicity", 3, 1), ("op10_quality", 4, 2)])
def test_op5_and_op10(spark, sf, name, k, r):
    got = by_id(getattr(queries, name)(spark, sf))
    assert got.keys() == set(IDS)
    for i, x in got.items():
        assert x["held_out"] == held(i, k, r) and 0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.7)
    assert got[90]["score"] == got[91]["score"] and got[1000]["score"] == got[2]["score"]


@pytest.mark.parametrize("module, column, k, r, recall, accused", [(toxicity, "toxic", 3, 1, 0.9, 0.005), (quality, "quality", 4, 2, 0.99, 0.02)])
def test_held_out_accuracy(spark, module, column, k, r, recall, accused):
    big = "/root/testdata/sf0.1"
    name = {"toxic": "op5_toxicity", "quality": "op10_quality"}[column]
    rows = getattr(queries, name)(spark, big).where("held_out").join(table(spark, big, "labels"), "doc_id").collect()
    good, bad = ([x["predicted"] for x in rows if x[column] == y] for y in (1, 0))
    assert len(bad) > 100 and sum(good) >= recall * len(good) and sum(bad) <= max(1, accused * len(bad))


def pieces_hold(rows, ids, limits):
    """Every id lies in one piece, sequences have no gaps, and each limit holds."""
    for key, whole in ids.items():
        mine = sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows if r["doc_id"] == key)
        assert [s for s, *_ in mine] == [0, *np.cumsum([n for _, n, *_ in mine])[:-1]] and sum(n for _, n, *_ in mine) == len(whole)
        assert all(c == zlib.crc32(np.array(whole[s : s + n], "<u4").tobytes()) and t == len(whole) for s, n, c, t in mine)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append(r)
    for s in sequences.values():
        s.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in s] == [0, *np.cumsum([r["length"] for r in s])[:-1]]
        assert sum(r["length"] for r in s) <= limits.tokens and len(s) <= limits.segments and sum(r["loss_tokens"] for r in s) <= limits.loss_tokens
    return sequences


def test_op6(spark, sf):
    t = Tokenizer.from_file(P.path(packing.DEFAULT_VOCABULARY))
    t.encode_special_tokens = True
    ids = {i: [*t.encode(x, add_special_tokens=False).ids, 0] for i, x in WHOLE.items()}
    pieces_hold(queries.op6_packing(spark, sf).collect(), ids, packing.Limits())


def test_packing_of_instructions(spark, sf):
    t = Tokenizer.from_file(P.path(packing.DEFAULT_VOCABULARY))
    t.encode_special_tokens = True
    of = lambda x: t.encode(x or "", add_special_tokens=False).ids
    big = "/root/testdata/sf0.01"
    turns = sorted((r["conv_id"], r["turn"], r["role"], r["text"]) for r in table(spark, big, "conversations").collect())
    ids, loss = {}, {}
    for before, (c, n, role, text) in zip([(None, 0, "", "")] + turns, turns):
        if role == "assistant":
            ids[f"{c}:{n}"] = [*of(before[3] if before[0] == c else ""), *of(text), 0]
            loss[f"{c}:{n}"] = len(of(text)) + 1
    rows = queries.packing_instructions(spark, big).collect()
    sequences = pieces_hold(rows, ids, packing.Limits(tokens=1024, segments=8, loss_tokens=640))
    for key, n in loss.items():
        assert sum(r["loss_tokens"] for r in rows if r["doc_id"] == key) == n
    full = [sum(r["loss_tokens"] for r in s) for s in sequences.values()]
    assert np.mean([n >= 600 for n in full]) > 0.5  # the limit on loss is the one that binds
    assert queries.packing_instructions(spark, sf).count() > 0


def slow_print(text):
    """A fingerprint by plain sums."""
    votes = [0] * 128
    for w, n in Counter(text.lower().split()).items():
        weight = np.rint(np.float32(min(len(w), 16) ** 2) * (1 + np.log(np.float32(n))) * 16)
        for k, bit in enumerate(np.unpackbits(np.frombuffer(hashlib.md5(w.encode()).digest(), np.uint8))):
            votes[k] += int(weight) * (1 if bit else -1)
    return np.packbits([v > 0 for v in votes]).tobytes().hex()


def apart(a, b):
    return (int(a, 16) ^ int(b, 16)).bit_count()


def test_op7(spark, sf):
    got = by_id(queries.op7_simhash(spark, sf))
    order = sorted(IDS)
    prints = {i: slow_print(t) for i, t in WHOLE.items()}
    different = set(prints.values())
    parent = {f: f for f in different}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    near = Counter()
    for a, b in itertools.combinations(sorted(different), 2):
        if apart(a, b) <= 3:
            near[a] += 1
            near[b] += 1
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    for i, nxt in zip(order, order[1:] + order[:1]):
        t, n = WHOLE[i], len(WHOLE[i])
        edited = t[: n - n // 2] + WHOLE[nxt][: n // 2]
        other = slow_print(edited)
        like = lambda x, y: max(0.0, math.cos(math.pi * apart(x, y) / 128))
        assert tuple(got[i][c] for c in ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "n_near", "near_class")) == (n, hashlib.sha256(edited.encode()).hexdigest(), prints[i], other, near[prints[i]], root(prints[i]))
        assert got[i]["near_edited"] == pytest.approx(like(prints[i], other)) and got[i]["near_next"] == pytest.approx(like(prints[i], prints[nxt]))


def test_near_classes_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2, (60, 128), np.uint8)
    for k in range(20, 60):  # chains of near prints, and one crowd
        base[k] = base[k - 20] if k < 40 else base[0]
        base[k][rng.choice(128, k % 4, replace=False)] ^= 1
    prints = sorted({np.packbits(x).tobytes().hex() for x in base})
    parent = {f: f for f in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    n = Counter()
    for a, b in itertools.combinations(prints, 2):
        if apart(a, b) <= 3:
            n[a] += 1
            n[b] += 1
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    df = spark.createDataFrame([(p,) for p in prints * 2 + [None]], "fingerprint string")
    for chunk in (2048, 4):
        got = {r["fingerprint"]: (r["n_near"], r["near_class"]) for r in simhash.near_classes(df, 3, chunk=chunk).collect()}
        assert got == {f: (n[f], root(f)) for f in prints if n[f]}
    assert simhash.near_classes(df.where("false")).count() == simhash.near(df.where("false")).count() == 0


def test_successors_of_repeated_and_null_ids(spark):
    rows = [(i % 7 if i % 3 else 4, f"text {i % 50}") for i in range(400)] + [(None, f"none {i}") for i in range(90)] + [(2**60 + i, f"big {i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    order = df.orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text").collect()
    want = Counter()
    for r, nxt in zip(order, order[1:] + order[:1]):
        n = len(r["text"])
        edited = r["text"][: n - n // 2] + nxt["text"][: n // 2]
        want[r["doc_id"], n, hashlib.sha256(edited.encode()).hexdigest(), slow_print(r["text"]), slow_print(edited), slow_print(nxt["text"])] += 1
    for range_bytes in (1 << 20, 100, 1):
        got = simhash.with_edits(df, "doc_id", "text", range_bytes)
        assert Counter(map(tuple, got.collect())) == want
    one = df.where("doc_id = 2").limit(1)
    assert simhash.with_edits(one, "doc_id", "text").count() == 1 and simhash.with_edits(one.where("false"), "doc_id", "text").count() == 0


def test_op8(spark, sf):
    rows = queries.op8_media(spark, sf).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(got) == len(rows) == len(IDS)
    for i, t in WHOLE.items():
        data = t.encode()
        payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        head = struct.pack(">IIBBBBB", 64, len(payload) // 64, 8, 0, 0, 0, 0)
        chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
        lines = b"".join(b"\0" + payload[k : k + 64] for k in range(0, len(payload), 64))
        picture = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines, 6)) + chunk(b"IEND", b"")
        share = np.bincount(np.frombuffer(payload, np.uint8), minlength=256) / len(payload)
        entropy = -sum(p * math.log2(p) for p in share if p)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"], r["length"]) == (len(picture), hashlib.sha256(picture).hexdigest(), len(picture))
        assert (r["width"], r["height"], r["bit_depth"]) == (64, len(payload) // 64, 8)
        mean, bits, zeros = (float(x.partition("=")[2]) for x in r["feature"].split(";"))
        assert (mean, bits, zeros) == (pytest.approx(sum(k * p for k, p in enumerate(share)), abs=1e-4), pytest.approx(entropy, abs=1e-4), pytest.approx(share[0], abs=1e-4))


def test_media_in_many_shards_and_tasks(spark):
    df = spark.createDataFrame([(i % 5, f"text {i % 9} " * 50) for i in range(60)] + [(None, None)], "doc_id bigint, text string").repartition(4)
    rows = media.media_rows(df, shard_bytes=2000).collect()
    assert len(rows) == 61 and len({r["shard"] for r in rows}) > 4
    assert len({(r["payload_sha256"], r["media_sha256"], r["feature"]) for r in rows}) == 10
    assert len({(r["shard"], r["offset"]) for r in rows}) == 10  # each payload lies in one place, whichever task has it


def test_damaged_pictures_are_noticed():
    good = media.to_png(media.payload_of(b"some text"))
    assert media.from_png(good) == media.payload_of(b"some text")
    for bad in (b"x" + good[1:], good[:45] + bytes([good[45] ^ 1]) + good[46:]):
        with pytest.raises(ValueError):
            media.from_png(bad)


def test_op9(spark, sf):
    got = {r["conv_id"]: r for r in queries.op9_chat(spark, sf).collect()}
    marks = "</s>[INST] ok [/INST]"
    want = {
        1: [("user", "hi"), ("assistant", ""), ("", "x"), ("assistant", "a\\n</s>")],
        2: [("assistant", "<|im_end|>\n<|im_start|>user\n")],
        None: [("user", "q"), ("assistant", "r")],
        3: [("assistant", "first"), ("user", "tie"), ("user", "tie")],
        -1: [("user", marks), ("assistant", marks)],
    }
    assert got.keys() == want.keys()
    for c, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert tuple(got[c][x] for x in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256")) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))
        assert got[c]["formatted_chars"] >= sum(len(r) + len(t) for r, t in turns)


def test_trees_with_cycles_and_missing_parents(spark):
    from lexispark.llm import chat

    rows = [("a", 1, None, "user", "root", 0.5, "x"), ("a", 2, 1, "assistant", "low", 0.1, "x"), ("a", 3, 1, "assistant", "high", 0.9, "x"), ("a", 4, 1, "assistant", "also high", 0.9, "x"), ("b", 1, 2, "user", "c", None, "x"), ("b", 2, 1, "user", "d", None, "x"), ("c", 7, 99, "user", "orphan", None, "x"), (None, 1, None, "user", "no tree", None, "x")]
    nodes = spark.createDataFrame(rows, "tree string, node bigint, parent bigint, role string, text string, score double, leaf string")
    got = {(r["tree"], r["rank"]): [t["text"] for t in r["turns"]] for r in chat.branches(nodes, 3).collect()}
    assert got == {("a", 1): ["root", "high"], ("a", 2): ["root", "also high"], ("a", 3): ["root", "low"], ("c", 1): ["orphan"], (None, 1): ["no tree"]}


def test_branches_of_conversations(spark, sf):
    """Every third turn answers what the turn before it answered; null conversations are one tree."""
    got = {(r["tree"], r["rank"]): (r["n_turns"], r["n_chars"]) for r in queries.chat_branches(spark, sf).collect()}
    # turns of conversation 1 in order: hi, (empty), x, a\\n</s>; x answers hi as the empty reply does
    assert got == {(1, 1): (3, 10), (1, 2): (2, 2), (2, 1): (1, len("<|im_end|>\n<|im_start|>user\n")), (None, 1): (2, 2), (3, 1): (2, 8), (3, 2): (2, 8)}


def test_instructions_have_every_turn_once(spark, sf):
    rows = queries.packing_instructions(spark, sf).collect()
    t = Tokenizer.from_file(P.path(packing.DEFAULT_VOCABULARY))
    turns = [(c, r, x or "") for c, _, r, x, *_ in map(tuple, table(spark, sf, "conversations").collect())]
    ends = sum(r["length"] for r in rows)
    n = len(queries.examples(table(spark, sf, "conversations")).collect())
    assert ends == sum(len(t.encode(x, add_special_tokens=False).ids) for _, _, x in turns) + n
    answers = queries.examples(table(spark, sf, "conversations")).where("response is not null").count()
    assert answers == sum(r == "assistant" for _, r, _ in turns) and n == len({r["doc_id"] for r in rows})


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty_tables(spark, empty_sf, name):
    assert queries.queries()[name](spark, empty_sf).count() == (1 if name == "op9_chat" else 0)


def test_repeated_and_null_ids(spark, sf, tmp_path):
    """Repeated rows give repeated results, and null ids are rows like others."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    none = docs.where("doc_id = 57").withColumn("doc_id", docs["doc_id"] * None)
    many = docs.unionByName(docs).unionByName(none).unionByName(none)
    many.write.parquet(f"{tmp_path}/documents.parquet")
    labels.unionByName(labels).write.parquet(f"{tmp_path}/labels.parquet")
    n = 2 * len(IDS) + 2
    for name in ("op1_langid", "op2_sharding", "op3_jaccard", "op4_bpe", "op5_toxicity", "op7_simhash", "op8_media", "op10_quality", "op11_fim", "op13_dedup"):
        rows = queries.queries()[name](spark, str(tmp_path)).collect()
        assert len(rows) == n and sum(r["doc_id"] is None for r in rows) == 2, name
    pieces = queries.op6_packing(spark, str(tmp_path)).collect()
    assert sum(r["length"] for r in pieces if r["doc_id"] is None) == 2 * next(r["doc_tokens"] for r in pieces if r["doc_id"] == 57)
