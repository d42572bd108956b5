"""SimHash fingerprints and the search for all fingerprints within a Hamming radius.

A term is a lower-cased word (a run of non-space characters); its weight is its damped count times the square
of its length (16 at most), so that the short words which all texts of a language share say little. Each
term's 128 hash bits vote with that weight, for a one and against a zero; the fingerprint has the signs.

near() finds all pairs of distinct fingerprints within a radius r by permuted block tables: the bits are cut
into r + extra blocks, any pair within r agrees on some `extra` of them, and each choice of `extra` blocks is
one table, in which fingerprints with equal blocks meet. A pair is told by the first table in which it agrees.
Copies count once: equal fingerprints are one row. edited_likeness() says of each fingerprint how many others lie
within the radius, and the class that near pairs join.

Defined results: a null text is the empty text; a text without words has the fingerprint zero; ids are integers, and null
ids come first, as one id; rows that repeat an id follow one another by their texts' hashes; equal rows stand in for one
another; texts of any length are taken whole; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.llm.bitmap import Bitmap
from lexispark.llm.common import prepare, saved, text_or_empty
from lexispark.llm.graph import components

BITS = 128
LONGEST = 16


class SimHasher:
    """Fingerprints of texts; the votes of words seen before are remembered, up to a bound."""

    def __init__(self, max_words: int = 100_000):
        self.max_words = max_words
        self.row: dict[str, int] = {}
        self.votes = np.zeros((0, BITS), np.float32)
        self.weight = np.zeros(0, np.float32)

    def learn(self, words: set[str]) -> None:
        if len(self.row) > self.max_words:
            self.row.clear()
            self.votes, self.weight = self.votes[:0], self.weight[:0]
        new = sorted(words - self.row.keys())
        if not new:
            return
        n = len(self.weight)
        self.row.update(zip(new, range(n, n + len(new))))
        digests = b"".join(hashlib.md5(w.encode("utf-8", "surrogatepass")).digest() for w in new)
        bits = np.unpackbits(np.frombuffer(digests, np.uint8)).reshape(-1, BITS)
        self.votes = np.concatenate([self.votes, bits.astype(np.float32) * 2 - 1])
        self.weight = np.concatenate([self.weight, np.array([min(len(w), LONGEST) ** 2 for w in new], np.float32)])

    def fingerprints(self, texts: list[str]) -> np.ndarray:
        """Packed bits, BITS / 8 bytes for each text."""
        out = np.zeros((len(texts), BITS), np.uint8)
        counts = [Counter(t.lower().split()) for t in texts]
        self.learn(set().union(*counts))
        for i, c in enumerate(counts):
            if c:
                at = np.fromiter(map(self.row.__getitem__, c), np.int64, len(c))
                weight = self.weight[at] * (1 + np.log(np.fromiter(c.values(), np.float32, len(c))))
                # whole numbers, so that the sum does not depend on the order of the words
                out[i] = np.rint(weight * 16) @ self.votes[at] > 0
        return np.packbits(out, axis=1)


def fingerprint_column(text: Column) -> Column:
    """Hexadecimal fingerprint of a text column without nulls."""

    @F.pandas_udf("string")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        h = SimHasher()
        for texts in parts:
            yield pd.Series([x.tobytes().hex() for x in h.fingerprints(texts.tolist())], dtype=object)

    return of(text)


def _likeness(a: list[str], b: list[str]) -> np.ndarray:
    """Estimated cosine of the term vectors, 0 at least: cos(pi * distance / BITS)."""
    x = np.frombuffer(bytes.fromhex("".join(a)), np.uint8).reshape(-1, BITS // 8)
    y = np.frombuffer(bytes.fromhex("".join(b)), np.uint8).reshape(-1, BITS // 8)
    distance = np.bitwise_count(x ^ y).sum(axis=1)
    return np.clip(np.cos(np.pi * distance / BITS), 0, 1)


def likeness_column(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(_likeness(x.tolist(), y.tolist()))

    return of(a, b)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every text."""
    prepare(df.sparkSession)
    return df.select(F.col(id_col), fingerprint_column(text_or_empty(text_col)).alias("fingerprint"))


@dataclass(frozen=True)
class Search:
    """Fingerprints within `radius` bits, by tables of `extra` of radius + extra blocks each."""

    radius: int = 3
    extra: int = 2
    #: Fingerprints under a key that are compared at a time; more are compared chunk by chunk.
    chunk: int = 2048

    def __post_init__(self) -> None:
        if self.radius < 0 or self.extra < 1 or self.radius + self.extra > BITS:
            raise ValueError("radius of 0 or more, extra of 1 or more, and no more blocks than bits are needed")

    @property
    def masks(self) -> np.ndarray:
        """For each table, which bits its blocks have: packed rows."""
        n = self.radius + self.extra
        block = np.arange(BITS) * n // BITS
        return np.stack([np.packbits(np.isin(block, chosen)) for chosen in combinations(range(n), self.extra)])


def _table_keys(s: Search):
    """The keys of a fingerprint, one for each table: equal where the table's blocks are."""
    masks = s.masks

    @F.pandas_udf("array<bigint>")
    def of(prints: pd.Series) -> pd.Series:
        if not len(prints):
            return pd.Series([], dtype=object)
        x = np.frombuffer(bytes.fromhex("".join(prints)), np.uint8).reshape(-1, BITS // 8)
        keys = np.empty((len(x), len(masks)), np.int64)
        for t, m in enumerate(masks):
            half = np.ascontiguousarray(x & m).view(np.uint64)
            h = half[:, 0] * np.uint64(0x9E3779B97F4A7C15) ^ (half[:, 1] + np.uint64(t)) * np.uint64(0xC2B2AE3D27D4EB4F)
            keys[:, t] = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)
        return pd.Series(list(keys), dtype=object)

    return of


def _adjacent(s: Search, table: int, x: np.ndarray, own: np.ndarray, two: bool) -> np.ndarray:
    """Which rows of a task are a pair within the radius that this table tells, as a matrix."""
    out = np.zeros((len(x), len(x)), bool)
    for k in range(0, len(x), 256):
        may = np.bitwise_count(x[k : k + 256, None] ^ x).sum(axis=2) <= s.radius
        if two:
            may &= own[k : k + 256, None] != own
        i, j = np.nonzero(may)
        apart = (x[k + i] ^ x[j]).view(np.uint8).reshape(-1, BITS // 8)
        # a key's hash may bring others together, so the table's own blocks must agree; an earlier table tells others
        first = (i + k != j) & ~(apart & s.masks[table]).any(axis=1)
        for m in s.masks[:table]:
            first &= (apart & m).any(axis=1)
        out[k + i[first], j[first]] = True
    return out


def _met(s: Search, pairs: bool):
    """Of each task's rows: the pairs (a, b, distance), a < b, or (f, n, root): how many it meets, and its group's smallest.

    Rows: task, table, two (whether the task holds two chunks), print, own (its chunk), sorted by the first three.
    """

    def told(rows: list[tuple]) -> pa.RecordBatch | None:
        names = sorted({r[3]: r[4] for r in rows}.items())
        own = np.array([c for _, c in names])
        x = np.frombuffer(bytes.fromhex("".join(f for f, _ in names)), np.uint64).reshape(-1, BITS // 64)
        near = _adjacent(s, rows[0][1], x, own, rows[0][2])
        if pairs:
            i, j = np.nonzero(np.triu(near))
            distance = np.bitwise_count(x[i] ^ x[j]).sum(axis=1).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array([names[p][0] for p in i], pa.string()), pa.array([names[p][0] for p in j], pa.string()), pa.array(distance)], names=["a", "b", "distance"])
        n, root = near.sum(axis=1), np.arange(len(names))
        some = np.flatnonzero(n)
        while len(some):
            low = np.minimum(root[some], np.where(near[some], root, len(names)).min(axis=1))
            low = np.minimum(low, root[low])
            if (low == root[some]).all():
                break
            root[some] = low
        return pa.RecordBatch.from_arrays([pa.array([names[p][0] for p in some], pa.string()), pa.array(n[some].astype(np.int64)), pa.array([names[p][0] for p in root[some]], pa.string())], names=["f", "n", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(5))))
        for _, task in groupby(every, key=lambda r: r[:3]):
            rows = list(task)  # two chunks at most
            if len(rows) > 1:
                yield told(rows)

    return run


def _tasks(prints: DataFrame, s: Search, col: str) -> DataFrame:
    """Distinct fingerprints by the keys that two or more of them share, a key with many of them cut into chunks."""
    prepare(prints.sparkSession)
    distinct = prints.select(F.col(col).alias("f")).where("f is not null").distinct()
    keyed = saved(distinct.select("f", F.posexplode(_table_keys(s)("f")).alias("table", "key")), "blocks")
    sizes = saved(keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "shared")
    few = keyed.where(Bitmap(sizes, "key").maybe("key")).join(sizes, "key")
    chunks = F.ceil(F.col("size") / s.chunk).cast("int")
    rows = few.withColumn("own", F.pmod(F.xxhash64("f"), chunks).cast("int"))
    rows = rows.select("key", "table", "f", "own", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other"))
    rows = rows.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("task"), "table", (F.col("own") != F.col("other")).alias("two"), "f", "own")
    return rows.repartition("task").sortWithinPartitions("task", "table", "two")


def near(prints: DataFrame, radius: int = 3, extra: int = 2, col: str = "fingerprint", chunk: int = 2048) -> DataFrame:
    """(a, b, distance), a < b: all pairs of distinct fingerprints within the radius, each once.

    Fingerprints are hexadecimal; nulls are left out, and an empty table gives no pairs. A key with many fingerprints is
    cut into chunks, whose pairs are tasks of their own, so no task holds more than two chunks. There are as many rows
    as near pairs; near_classes() has a row for each fingerprint only.
    """
    s = Search(radius, extra, chunk)
    return _tasks(prints, s, col).mapInArrow(_met(s, True), "a string, b string, distance int")


def near_classes(prints: DataFrame, radius: int = 3, extra: int = 2, col: str = "fingerprint", chunk: int = 2048) -> DataFrame:
    """(fingerprint, n_near, near_class) of the distinct fingerprints that have another one within the radius.

    n_near: how many such others there are; near_class: the smallest fingerprint that steps within the radius reach.
    Pairs stay within their tasks: each tells how many its fingerprints meet and joins them to its groups' smallest.
    """
    s = Search(radius, extra, chunk)
    told = saved(_tasks(prints, s, col).mapInArrow(_met(s, False), "f string, n bigint, root string"), "near")
    # components() takes integers: any different ones, in a saved table so that they stay
    ranked = saved(told.groupBy("f").agg(F.sum("n").alias("n_near")).withColumn("number", F.monotonically_increasing_id()), "ranked")
    id_of = lambda c, name: ranked.select(F.col("f").alias(c), F.col("number").alias(name))
    links = told.select("f", "root").where("f <> root").distinct().join(id_of("f", "a"), "f").join(id_of("root", "b"), "root").select("a", "b")
    found = saved(ranked.join(components(links), F.col("number") == F.col("id")).select("f", "n_near", "component"), "found")
    names = found.groupBy("component").agg(F.min("f").alias("near_class"))
    return found.join(names, "component").select(F.col("f").alias(col), "n_near", "near_class")


#: Bytes of texts in one range of ids, about.
RANGE_BYTES = 32 << 20
_ROW = [("id", pa.int64()), ("part", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("next_fingerprint", pa.string()), ("first_text", pa.string()), ("last_text", pa.string())]
_ROW_DDL = "id bigint, part bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string, first_text string, last_text string"


def edited_text(text: str, after: str) -> str:
    """text, whose last floor(n / 2) code points are replaced by the first as many (or all) of the text after it."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _succession(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text) of one range in their order to _ROW; a row waits for the one after it.

    The first row has its text as first_text; the last one has its text as last_text, and nothing of an edited text yet.
    """
    h, part = SimHasher(), TaskContext.get().partitionId()
    waits: tuple | None = None
    for b in batches:
        ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
        if not texts:
            continue
        prints = [x.tobytes().hex() for x in h.fingerprints(texts)]
        first = texts[0] if waits is None else None
        before = [] if waits is None else [waits]
        line = [*before, *((i, t, f, None) for i, t, f in zip(ids, texts, prints))]
        if first is not None:
            line[0] = (*line[0][:3], first)
        waits = line.pop()
        after = [*line[1:], waits]
        edited = [edited_text(a[1], z[1]) for a, z in zip(line, after)]
        marks = [x.tobytes().hex() for x in h.fingerprints(edited)] if edited else []
        yield _rows([(i, part, len(t), _sha(e), f, m, z[2], head, None) for (i, t, f, head), e, m, z in zip(line, edited, marks, after)])
    if waits is not None:
        i, t, f, head = waits
        yield _rows([(i, part, len(t), None, f, None, None, head, t)])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(_ROW)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _ROW)], names=[n for n, _ in _ROW])


def with_edits(df: DataFrame, id_col: str, text_col: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, next_fingerprint) of every row, as a saved table.

    Rows are sorted by (id, text's hash, text) across ranges of about range_bytes of texts, so an id that very many rows repeat
    spreads over ranges by its texts' hashes; only equal rows share a range. Within a range each row meets the next one
    as it streams past. The last row of a range meets the first one of the next range by a join of one row for each range;
    after the last range comes the first.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), text_or_empty(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = ("id", F.xxhash64("text"), "text")
    placed = rows.repartitionByRange(max(1, -(-total // range_bytes)), "id", F.xxhash64("text")).sortWithinPartitions(*order)
    made = saved(placed.mapInArrow(_succession, _ROW_DDL), "succession")
    done = made.where("last_text is null")
    # one number for each range that has rows
    parts = [r["part"] for r in made.where("last_text is not null").select("part").orderBy("part").collect()]
    if not parts:
        return made.select("id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint")
    before = df.sparkSession.createDataFrame(list(zip(parts, [parts[-1], *parts[:-1]])), "part bigint, before bigint")
    firsts = made.where("first_text is not null").join(before, "part").select("before", F.col("first_text").alias("after"), F.col("fingerprint").alias("after_print"))
    last = made.where("last_text is not null").join(firsts, F.col("part") == F.col("before"))

    @F.pandas_udf("edited_sha256 string, edited_fingerprint string")
    def edited(texts: pd.Series, others: pd.Series) -> pd.DataFrame:
        h, both = SimHasher(), [edited_text(a, b) for a, b in zip(texts, others)]
        return pd.DataFrame({"edited_sha256": [_sha(x) for x in both], "edited_fingerprint": [x.tobytes().hex() for x in h.fingerprints(both)]})

    last = last.select("id", "n_chars", "fingerprint", edited("last_text", "after").alias("e"), F.col("after_print").alias("next_fingerprint"))
    columns = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint"]
    return done.select(*columns).unionByName(last.select("id", "n_chars", "e.edited_sha256", "fingerprint", "e.edited_fingerprint", "next_fingerprint"))


def edited_likeness(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3) -> DataFrame:
    """Every text against an edited copy of itself, against its successor, and against all other fingerprints.

    The edited text keeps all but the last floor(n / 2) code points and continues with the first as many of the
    next text. Returns id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and by the
    block tables n_near (distinct other fingerprints within the search's radius) and near_class (the smallest
    fingerprint that steps within the radius reach, its own without any).
    """
    prepare(df.sparkSession)
    rows = with_edits(df, id_col, text_col)
    out = saved(
        rows.select(
            F.col("id").alias(id_col),
            "n_chars",
            "edited_sha256",
            "fingerprint",
            "edited_fingerprint",
            likeness_column(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
            likeness_column(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        ),
        "fingerprints",
    )
    classes = saved(near_classes(out, radius), "classes")
    # only rows whose fingerprint may have neighbours are matched
    maybe = Bitmap(classes, "fingerprint").maybe("fingerprint")
    alone = lambda rows: rows.withColumn("n_near", F.coalesce("n_near", F.lit(0))).withColumn("near_class", F.coalesce("near_class", "fingerprint"))
    none = out.where(~maybe).withColumn("n_near", F.lit(None).cast("bigint")).withColumn("near_class", F.lit(None).cast("string"))
    some = out.where(maybe).join(classes, "fingerprint", "left").select(*none.columns)
    return alone(none.unionByName(some)).withColumn("n_near", F.col("n_near").cast("bigint"))
