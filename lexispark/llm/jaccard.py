"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct word shingles, each a 64-bit hash. Two documents link when their Jaccard
similarity is t = num / den or more; then their sets differ in at most (1 - t) / t times the smaller size.

1. Sketch. For a band of sizes that bound is D. The shingles fall by hash into K = D + 1 + extra blocks, and each
   block is the XOR of its shingles' hashes: a folded parity sketch, in which one differing shingle changes one
   block. Two linked sets therefore agree in at least extra + 1 blocks (pigeonhole). Blocks of few shingles (none,
   or at strict thresholds one) say little and are left out where a document has fewer than `extra` of them;
   agreeing blocks are light in both, so at least two of the agreeing ones are always sent. A document a little
   larger than a band is sketched for that band too, as the smaller side of a pair names the band.
2. Join. A task sorts the blocks' keys and sends them, compressed, to buckets of the key's hash; there documents
   that share a key meet, one bucket of bounded size after another. Many keys bring the same documents together, and
   each such group is kept once. Pairs are not made within a group: each document meets the group's smallest id. A second, one-bit parity sketch gives a
   Hamming distance that never exceeds the symmetric difference, which drops most false candidates before
   shingles are fetched and the similarity is verified exactly: by shortened hashes, which leave a few pairs near the
   threshold open, and those by whole ones. A key that very many documents of a task share is
   sent once by that task, for the smallest of its documents, and they stay where they are, as a group beside it.
   A document meets one leader first, and others only where it is not in their components then.
3. Rest. Links give components. A key whose documents lie in one component is settled. The others are tried again
   with other leaders; what remains unsettled is compared by sketches across components within the key, in tasks of
   one or two chunks of bounded size, and only pairs that may link are emitted and verified. No pair is left out;
   of a component's equal documents one stands for all there.

Equal documents of one task are sent once. Shingles of candidates come from a further pass over the texts, filtered
by a bitmap of the candidates' ids whose size is bounded; its false hits cost work and no rows.

Ids are integers. Rows that repeat an id with other texts are documents of their own, under keys that are no ids; a
component is still named by its smallest id, so two components have one name where that id has unlinked texts.

Defined results: null texts and texts without words have no shingles and link with nothing; fewer words than the
shingle's are one shingle; texts of any length are taken whole, as bands of sizes have no end; rows with a null id are
left out of links and get their size and a null component; of linked documents the smallest id names the component;
repeated rows give repeated results; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import count, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.bitmap import Bitmap
from lexispark.llm.common import forget, prepare, saved, sweep, text_or_empty, trim
from lexispark.llm.graph import components

SKETCH_BITS = 1024
#: Documents that a task remembers to send equal ones once.
REMEMBERED = 100_000


@dataclass(frozen=True)
class Params:
    words: int = 3
    num: int = 90
    den: int = 100
    #: Sizes of a band's largest set over its smallest.
    ratio: float = 1.5
    #: Documents of an unsettled key that are compared at a time; a larger key is compared by pairs of chunks.
    chunk: int = 4096
    #: Rounds with other leaders before that.
    leaders: int = 1
    #: Documents that a task sketches at a time; a key that more than `hot` of them share is sent once.
    flush: int = 4096
    hot: int = 64

    def __post_init__(self) -> None:
        if not 0 < self.num < self.den or self.words < 1:
            raise ValueError("0 < num < den and words of 1 or more are needed")

    @property
    def light(self) -> int:
        """Blocks of fewer shingles say little: a block has about num / (den - num) of them."""
        return 2 if self.num >= 8 * (self.den - self.num) else 1

    @property
    def spare(self) -> int:
        """Hundredths of a sketch's blocks that are added for light ones."""
        return 6 if self.light == 2 else 12

    def most_apart(self, smaller: int) -> int:
        """The largest symmetric difference of a linked pair whose smaller set has this size."""
        return smaller * (self.den - self.num) // self.num


def _mix(h: np.ndarray, seed: int) -> np.ndarray:
    h = h + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Sorted distinct shingle hashes of texts; words seen before are remembered, up to a bound."""

    def __init__(self, words: int, bound: int = 120_000):
        self.words, self.bound = words, bound
        self.row: dict[bytes, int] = {}
        self.hashes = np.zeros(0, np.uint64)

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.row) > self.bound:
            self.row.clear()
            self.hashes = self.hashes[:0]
        # lower() and split() of bytes know A-Z and the ASCII spaces only, as is meant here
        lists = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
        new = sorted(set().union(*lists) - self.row.keys())
        if new:
            n = len(self.row)
            self.row.update(zip(new, range(n, n + len(new))))
            digests = b"".join(hashlib.blake2b(w, digest_size=8).digest() for w in new)
            self.hashes = np.concatenate([self.hashes, np.frombuffer(digests, np.uint64)])
        return [self._one(x) for x in lists]

    def _one(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros(0, np.uint64)
        h = self.hashes[np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))]
        n = min(self.words, len(h))
        total = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            total = _mix(total ^ h[i : len(h) - n + 1 + i], i)
        return np.unique(total)


@dataclass(frozen=True)
class Band:
    number: int
    low: int
    high: int  # sizes low to high - 1
    apart: int
    extra: int
    reach: int  # the largest set that a set of this band can link with

    @property
    def blocks(self) -> int:
        return self.apart + 1 + self.extra


@lru_cache(maxsize=8)
def _known(p: Params) -> list[Band]:
    return []


def bands(p: Params, size: int) -> list[Band]:
    """The bands up to the one in which a set of this size lies, and perhaps more; there is no last one."""
    out = _known(p)
    while not out or out[-1].high <= size:
        a = out[-1].high if out else 1
        if out:
            b = max(a + 1, int(a * p.ratio))
        else:  # the first band: sizes at which linked sets are equal
            b = next(n for n in count(1) if p.most_apart(n))
        apart = p.most_apart(b - 1)
        extra = 0 if apart == 0 else 2 + -(-(apart + 1) * p.spare // 100)
        out.append(Band(len(out), a, b, apart, extra, (b - 1) * p.den // p.num))
    return out


def keys_of(s: np.ndarray, p: Params) -> np.ndarray:
    """Distinct keys of a shingle set, for every band that it belongs to or lies just above."""
    out, n = [], len(s)
    for b in bands(p, n):
        if b.low > n:
            break
        if n >= b.high and n > b.reach:
            continue
        h = _mix(s, 1000 + b.number)
        block = ((h >> np.uint64(32)) * np.uint64(b.blocks)) >> np.uint64(32)
        order = np.argsort(block.astype(np.int32), kind="stable")
        size = np.bincount(block.astype(np.int64), minlength=b.blocks)
        some = np.flatnonzero(size)
        value = np.zeros(b.blocks, np.uint64)
        value[some] = np.bitwise_xor.reduceat(_mix(s[order], 5), (np.cumsum(size) - size)[some])
        light = size < p.light
        keep = np.ones(b.blocks, bool) if b.extra == 0 or light.sum() >= b.extra else ~light
        out.append(_mix(value[keep] ^ _mix(np.arange(b.blocks, dtype=np.uint64)[keep] + np.uint64(b.number << 32), 6), 7))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def sketch_of(s: np.ndarray) -> bytes:
    """One-bit parities: the Hamming distance of two sketches never exceeds the sets' symmetric difference."""
    return np.packbits((np.bincount((_mix(s, 8) >> np.uint64(54)).astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)).tobytes()


def _planes(x: np.ndarray) -> bytes:
    """Numbers of 64 bits, compressed by bytes of equal place."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes())


def _unplanes(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).reshape(-1).view(kind)


_PRINTS = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("same", pa.int64()), ("sketch", pa.binary()), ("digest", pa.binary()), ("bucket", pa.int32()), ("keys", pa.binary()), ("ids", pa.binary()), ("key", pa.int64()), ("group", pa.list_(pa.int64()))])
_PRINTS_DDL = "id bigint, n bigint, same bigint, sketch binary, digest binary, bucket int, keys binary, ids binary, key bigint, group array<bigint>"


def _sent(keys: np.ndarray, ids: np.ndarray, bucket_bits: int, hot: int) -> Iterator[dict]:
    """Rows of one flush: for each bucket its keys and ids, and the groups of hot keys."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(begins, len(keys)))
    keep, first = np.ones(len(keys), bool), np.zeros(len(keys), bool)
    for b, n in zip(begins[sizes > hot].tolist(), sizes[sizes > hot].tolist()):
        keep[b : b + n], first[b] = False, True
        yield {"key": int(keys[b].view(np.int64)), "group": np.unique(ids[b : b + n]).tolist()}
    yield from _buckets(keys[keep], ids[keep], bucket_bits, None)
    yield from _buckets(keys[first], ids[first], bucket_bits, 1)


def _buckets(keys: np.ndarray, ids: np.ndarray, bucket_bits: int, hot: int | None) -> Iterator[dict]:
    """Rows of sorted keys, cut at the buckets' edges; hot: 1 where other documents of these keys stayed behind."""
    bucket = (keys >> np.uint64(64 - bucket_bits)).astype(np.int64) if bucket_bits else np.zeros(len(keys), np.int64)
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist() + [len(keys)] if len(keys) else [0]
    for a, b in zip(edges, edges[1:]):
        yield {"bucket": int(bucket[a]), "same": hot, "keys": _planes(np.diff(keys[a:b], prepend=np.uint64(0))), "ids": _planes(ids[a:b])}


def _prints(docs: DataFrame, p: Params, bucket_bits: int) -> DataFrame:
    """Rows of documents (id, n, sketch and digest, or same: the id of an equal document sent instead), of buckets and of hot keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, first = Shingler(p.words), {}
        keys: list[np.ndarray] = []
        ids: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if keys:
                rows = list(_sent(np.concatenate(keys), np.concatenate(ids), bucket_bits, p.hot))
                keys.clear()
                ids.clear()
                yield pa.RecordBatch.from_pylist(rows, _PRINTS)

        for b in batches:
            rows = []
            for i, s in zip(b.column(0).to_pylist(), shingler.sets(b.column(1).to_pylist())):
                row = {"id": i, "n": len(s)}
                if i is not None and len(s):
                    digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    if len(first) >= REMEMBERED:
                        first.clear()
                    if digest in first:
                        row["same"] = first[digest]
                    else:
                        first[digest] = i
                        row["sketch"], row["digest"] = sketch_of(s), digest
                        keys.append(keys_of(s, p))
                        ids.append(np.full(len(keys[-1]), i, np.int64))
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, _PRINTS)
            if len(keys) >= p.flush or sum(map(len, keys)) > 2_000_000:
                yield from flush()
        yield from flush()
        del shingler, first
        trim()

    return docs.mapInArrow(run, _PRINTS_DDL)


def _dealt(bucket_bits: int):
    """Rows of buckets, sorted by bucket, dealt further: as few rows as the keys that a task holds at a time give for finer buckets."""

    def flush(held: list[tuple]) -> pa.RecordBatch:
        rows = []
        for hot in (None, 1):
            some = [r for r in held if r[2] == hot]
            if some:
                keys, ids = (np.concatenate([r[i] for r in some]) for i in (0, 1))
                order = np.lexsort((ids, keys))
                rows += _buckets(keys[order], ids[order], bucket_bits, hot)
        held.clear()
        return pa.RecordBatch.from_pylist(rows, _PRINTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for keys, ids, same in zip(*(b.column(c).to_pylist() for c in ("keys", "ids", "same"))):
                held.append((np.cumsum(_unplanes(keys, np.uint64), dtype=np.uint64), _unplanes(ids, np.int64), same))
                size += len(held[-1][0])
                if size >= DEALT:
                    yield flush(held)
                    size = 0
        if held:
            yield flush(held)
        trim()

    return run


_MET = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("same", pa.int64()), ("sketch", pa.binary()), ("digest", pa.binary()), ("key", pa.int64()), ("group", pa.list_(pa.int64())), ("hot", pa.bool_())])
_MET_DDL = "id bigint, n bigint, same bigint, sketch binary, digest binary, key bigint, group array<bigint>, hot boolean"


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups (key, group, hot) of the keys that two or more documents share; rows come sorted by bucket.

    A group within another one of its bucket says nothing new and goes; a hot key's group stays, as its key matters.
    Rows without a bucket (documents, and the groups of hot keys that stayed behind, whose hot is null) pass.
    """

    def buckets() -> Iterator[tuple]:
        for b in batches:
            none = pc.is_null(b.column("bucket"))
            if pc.any(none).as_py():
                passed.append(b.filter(none))
            b = b.filter(pc.invert(none))
            yield from zip(*(b.column(c).to_pylist() for c in ("bucket", "keys", "ids", "same")))

    def through() -> Iterator[pa.RecordBatch]:
        while passed:
            b = passed.pop()
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in _MET.names[:-1]), pa.nulls(b.num_rows, pa.bool_())], schema=_MET)

    passed: list[pa.RecordBatch] = []
    for _, of_bucket in groupby(buckets(), key=lambda r: r[0]):  # one bucket is held at a time
        some = []
        for r in of_bucket:
            yield from through()
            some.append(r[1:])
        each = [np.cumsum(_unplanes(k, np.uint64), dtype=np.uint64) for k, _, _ in some]
        keys, ids = np.concatenate(each), np.concatenate([_unplanes(i, np.int64) for _, i, _ in some])
        warm = np.concatenate([np.full(len(k), h == 1) for k, (_, _, h) in zip(each, some)])
        order = np.lexsort((ids, keys))
        keys, ids, warm = keys[order], ids[order], warm[order]
        begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        hot = np.logical_or.reduceat(warm, begins)
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])])  # an id once for each key
        keys, ids = keys[new], ids[new]
        begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(begins, len(keys)))
        mark = np.add.reduceat(_mix(ids.view(np.uint64), 9), begins)
        shared = sizes > 1
        _, one = np.unique(mark[shared & ~hot], return_index=True)
        plain = np.flatnonzero(shared & ~hot)[one]
        rows = [(int(keys[begins[g]].view(np.int64)), ids[begins[g] : begins[g] + sizes[g]], True) for g in np.flatnonzero(shared & hot).tolist()]
        holders: dict[int, set[int]] = {}  # an id -> the groups kept so far that hold it
        for g in plain[np.argsort(-sizes[plain], kind="stable")].tolist():
            own = ids[begins[g] : begins[g] + sizes[g]].tolist()
            within = holders.get(own[0], set())
            for i in own[1:]:
                if not within:
                    break
                within = within & holders.get(i, set())
            if not within:
                for i in own:
                    holders.setdefault(i, set()).add(g)
                rows.append((int(keys[begins[g]].view(np.int64)), own, False))
        for k in range(0, len(rows), 4096):
            key, group, is_hot = zip(*rows[k : k + 4096])
            none = [pa.nulls(len(key), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*none, pa.array(key, pa.int64()), pa.array(group, pa.list_(pa.int64())), pa.array(is_hot, pa.bool_())], schema=_MET)
        del some, each, keys, ids, warm, rows, holders
    yield from through()
    trim()


def _compared(num: int, den: int, block: int = 64):
    """Pairs of one task, across components, whose sizes and sketches allow a link. Rows come sorted by task.

    A row's own chunk and whether the task holds two chunks say which pairs are the task's. Pairs leave by blocks of
    rows, so the memory does not depend on how many there are. Documents of the largest component meet the others only.
    """

    def pairs(group: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids, comps, n, own = (np.array([r[i] for r in group], np.int64) for i in (1, 2, 3, 5))
        values, counts = np.unique(comps, return_counts=True)
        large = comps == values[counts.argmax()]
        others = np.flatnonzero(~large)
        if not len(others):
            return
        bits = np.unpackbits(np.frombuffer(b"".join(r[4] for r in group), np.uint8).reshape(len(group), -1), axis=1).astype(np.float32)
        ones = bits.sum(axis=1)
        for k in range(0, len(others), block):
            x = others[k : k + block]
            apart = (ones[x, None] + ones - 2 * (bits[x] @ bits.T)).astype(np.int64)
            total = n[x, None] + n
            may = den * (total - apart) >= num * (total + apart)
            may &= den * np.minimum(n[x, None], n) >= num * np.maximum(n[x, None], n)
            may &= (comps[x, None] != comps) & (large | (ids[x, None] > ids))
            if group[0][6]:
                may &= own[x, None] != own
            a, b = np.nonzero(may)
            if len(a):
                one, two = ids[x][a], ids[b]
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(one, two)), pa.array(np.minimum(one, two))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(7))))
        for _, task in groupby(rows, key=lambda r: r[0]):
            group = list(task)  # two chunks at most
            if len(group) > 1:
                yield from pairs(group)
        trim()

    return run


def _close(a: pd.Series, b: pd.Series, na: pd.Series, nb: pd.Series, num: pd.Series, den: pd.Series) -> pd.Series:
    """Whether sizes and sketches allow a link."""
    if not len(a):
        return pd.Series([], dtype=bool)
    x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1) for s in (a, b))
    apart = np.bitwise_count(x ^ y).sum(axis=1).astype(np.int64)
    na, nb, num, den = (s.to_numpy() for s in (na, nb, num, den))
    # union = (na + nb + apart) / 2 and intersection = (na + nb - apart) / 2
    return pd.Series((den * (na + nb - apart) >= num * (na + nb + apart)) & (den * np.minimum(na, nb) >= num * np.maximum(na, nb)))


def _coded(s: np.ndarray) -> bytes:
    """A set's size and, compressed, the upper CODED bits of its sorted hashes."""
    steps = np.diff(s >> np.uint64(64 - CODED), prepend=np.uint64(0))
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, : CODED // 8].T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _decoded(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(CODED // 8, -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, : CODED // 8] = planes.T
    return np.cumsum(steps.view(np.uint64).reshape(-1))


def _judged(a: pd.Series, b: pd.Series, num: pd.Series, den: pd.Series) -> pd.Series:
    """Of coded sets: 1 linked, 0 not, 2 unsure.

    Shortened hashes may count some shingles as common that are not: `slack` at most, as more would collide less often
    than once in 10^14 pairs. They never miss a common one.
    """
    out = []
    for x, y, n, d in zip(a, b, num, den):
        x, y = sorted((_decoded(x), _decoded(y)), key=len)
        common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
        rate, slack, chance = len(x) * len(y) / (1 << CODED), 0, 1.0
        while chance > 1e-14:  # of more than `slack` collisions
            slack += 1
            chance *= rate / slack
        slack -= 1
        link = lambda c: d * c >= n * (len(x) + len(y) - c)
        out.append(0 if not link(common) else 1 if link(common - slack) else 2)
    return pd.Series(out, dtype="int32")


def _linked(a: pd.Series, b: pd.Series, num: pd.Series, den: pd.Series) -> pd.Series:
    """Of whole sets."""
    out = []
    for x, y, n, d in zip(a, b, num, den):
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        common = len(np.intersect1d(x, y, assume_unique=True))
        out.append(d * common >= n * (len(x) + len(y) - common))
    return pd.Series(out, dtype=bool)


#: Bits of a hash by which sets are compared first.
CODED = 40
#: Documents for each bucket of keys, and the bits of how many buckets one pass takes.
BUCKET_DOCS = 2048
PASS_BITS = 14
#: Bits by which a task deals its keys at a time: with more, a row would hold few keys and compress badly. DEALT: keys that
#: a task holds to deal them further.
LEVEL_BITS = 10
DEALT = 2_000_000


class _Join:
    def __init__(self, docs: DataFrame, p: Params, unique: bool = False):
        """docs: id, text; unique: no id has two rows."""
        self.docs, self.p, self.unique = docs, p, unique
        self.num, self.den = F.lit(p.num), F.lit(p.den)
        # a few hundred thousand keys to a bucket, at a hundred or so for each document
        bits = max(4, (docs.count() // BUCKET_DOCS).bit_length())
        #: documents (id, n, and same or sketch and digest), and groups (key, group, hot)
        self.prints = self.met(_prints(docs, p, min(bits, LEVEL_BITS)), bits)
        #: n, sketch and digest of each document that was sent
        self.info = self.prints.where("sketch is not null").select("id", "n", "sketch", "digest")
        if not unique:
            # several tasks may have sent the rows of a key, which have one text; a pair would come as often as both sides' rows multiply to
            self.info = saved(self.info.dropDuplicates(["id"]), "info")
        #: pairs that the coded sets left open
        self.unsure: list[DataFrame] = []

    def met(self, sent: DataFrame, bits: int) -> DataFrame:
        """What _met() makes of the buckets: one pass for every 2^PASS_BITS of them, so that a shuffle's partitions stay
        few however many there are; one pass takes the rows as they are made, several read their own folder of a saved
        table. Keys are dealt by LEVEL_BITS at a time, so that a row of a bucket has thousands of them at any number of buckets."""
        parts = 1 << min(bits, PASS_BITS)
        # rows without a bucket go anywhere
        to = F.coalesce(F.col("bucket"), F.pmod(F.xxhash64("id", "n", "key", "group"), F.lit(parts)).cast("int"))
        run = lambda rows: rows.repartition(parts, to).sortWithinPartitions("bucket").mapInArrow(_met, _MET_DDL)
        level = min(bits, LEVEL_BITS)
        if level < bits:
            sent = saved(sent, "sent")
        while level < bits:
            # rows of a coarse bucket meet in a few tasks, which deal their keys to finer buckets
            spread = F.pmod(F.xxhash64("keys"), F.lit(1 << max(0, min(bits, PASS_BITS) - level)))
            level = min(bits, level + LEVEL_BITS)
            finer = sent.where("bucket is not null").repartition(parts, F.col("bucket"), spread).sortWithinPartitions("bucket").mapInArrow(_dealt(level), _PRINTS_DDL)
            coarse, sent = sent, saved(sent.where("bucket is null").unionByName(finer), "sent")
            forget(coarse)
        if bits <= PASS_BITS:
            out = saved(run(sent), "prints")
        else:
            # a folder for each pass, so that a pass reads its own rows only
            sent = saved(sent.withColumn("pass", F.coalesce(F.shiftright("bucket", PASS_BITS), F.lit(-1))), "sent", "pass")
            made = sent.where("pass = -1").select(*_MET.names[:-1], F.lit(None).cast("boolean").alias("hot"))
            for number in range(1 << bits - PASS_BITS):
                made = made.unionByName(run(sent.where(F.col("pass") == number).drop("pass")))
            out = saved(made, "prints")
            forget(sent)
        sweep(self.docs.sparkSession)
        return out

    def groups(self) -> DataFrame:
        """(key, group, many): documents that share a key; many: a hot key, which has several groups."""
        some = self.prints.where("group is not null")
        once = some.where("not hot").groupBy("group").agg(F.min("key").alias("key")).select("key", "group")
        # a group of first documents of a hot key keeps that key, which the documents that stayed behind (hot is null) have too
        hot = some.where("hot or hot is null").select("key", "group", F.lit(True).alias("many"))
        return saved(once.withColumn("many", F.lit(False)).unionByName(hot), "groups")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The links among pairs (a, b); pairs that coded sets leave open wait in self.unsure."""
        ia, ib = (self.info.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in "ab")
        close = pairs.distinct().join(ia, "a").join(ib, "b").where(F.pandas_udf(_close, "boolean")("sa", "sb", "na", "nb", self.num, self.den)).select("a", "b")
        close = saved(close, "pairs")
        if close.isEmpty():
            return close
        judged = self.compared(close, _coded, F.pandas_udf(_judged, "int"), F.col("judged") > 0)
        forget(close)
        self.unsure.append(judged.where("judged = 2").select("a", "b"))
        return judged.where("judged = 1").select("a", "b")

    def compared(self, pairs: DataFrame, value, udf, test) -> DataFrame:
        """(a, b, judged) of the saved pairs, by value(set) of either side, where the test holds."""
        ids = saved(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "ids")
        sets = self.per_document(ids, "shingles binary", value, pa.binary())
        # rows of one key have one text
        sets = saved(sets if self.unique else sets.groupBy("id").agg(F.min("shingles").alias("shingles")), "shingles")
        sa, sb = (sets.select(F.col("id").alias(c), F.col("shingles").alias(f"x{c}")) for c in "ab")
        met = pairs.join(sa, "a").join(sb, "b").withColumn("judged", udf("xa", "xb", self.num, self.den))
        found = saved(met.where(test).select("a", "b", "judged"), "verified")
        forget(ids)
        forget(sets)
        sweep(self.docs.sparkSession)
        return found

    def run(self) -> DataFrame:
        """(id, component) of the documents that link with others."""
        return self.resolved(*self.searched())[1]

    def resolved(self, links: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(links, components) with those pairs that coded sets left open and that lie in different components."""
        unsure = None
        for u in self.unsure:
            unsure = u if unsure is None else unsure.unionByName(u)
        self.unsure.clear()
        if unsure is None:
            return links, found
        left = saved(self.apart(unsure.distinct(), found), "pairs")
        if left.isEmpty():
            return links, found
        more = self.compared(left, lambda s: s.tobytes(), F.pandas_udf(_linked, "boolean"), F.col("judged")).select("a", "b")
        if more.isEmpty():
            return links, found
        links = links.unionByName(more)
        return links, components(links)

    def apart(self, pairs: DataFrame, found: DataFrame) -> DataFrame:
        """The pairs whose documents lie in different components."""
        of = lambda c: found.select(F.col("id").alias(c), F.col("component").alias(f"c{c}"))
        return pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")

    def per_document(self, ids: DataFrame, ddl: str, value, kind: pa.DataType) -> DataFrame:
        """value(shingle set) of every row with one of the ids, and of a few others."""
        words, name = self.p.words, ddl.split()[0]

        some = Bitmap(ids, "id")
        has = some.has

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shingler = Shingler(words)
            for b in batches:
                b = b.filter(pa.array(has(b.column(2).to_numpy())))
                sets = shingler.sets(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([value(s) for s in sets], kind)], names=["id", name])
            del shingler
            trim()

        # the bitmap is asked where the texts are read, so that a task has one Python worker; its few false hits stay
        near = self.docs.where("id is not null").select("id", "text", some.position("id").alias("at"))
        return near.mapInArrow(run, f"id bigint, {ddl}")

    def searched(self) -> tuple[DataFrame, DataFrame]:
        """(links, components), as far as coded sets tell."""
        groups = self.groups()
        same = self.prints.where("same is not null and same <> id").select(F.col("id").alias("a"), F.col("same").alias("b"))
        # a group's documents meet its smallest id; those of a hot key's groups also the smallest of all of them, so
        # that few are left to be compared with one another
        many = groups.where("many")
        leaders = many.groupBy("key").agg(F.min(F.array_min("group")).alias("b"))
        pairs = groups.select(F.explode("group").alias("a"), F.array_min("group").alias("b"))
        pairs = pairs.unionByName(many.join(leaders, "key").select(F.explode("group").alias("a"), "b"))
        pairs = saved(pairs.where("a <> b").distinct(), "pairs")
        # each document meets one leader, and further ones only where that left them in different components
        tried = saved(pairs.groupBy("a").agg(F.min("b").alias("b")), "pairs")
        links = self.verified(tried).unionByName(same)
        found = components(links)
        met = saved(self.apart(pairs, found).join(tried, ["a", "b"], "left_anti"), "pairs")
        forget(pairs)
        tried = tried.unionByName(met)
        links, found = self.resolved(*self.more(links, met, found))
        members = groups.select("key", F.explode("group").alias("id"))
        for turn in range(self.p.leaders):
            left = self.unsettled(members, found)
            if left is None:
                return links, found
            leader = left.groupBy("key").agg(F.min(F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), "id", "component")).alias("l"))
            met = left.join(leader, "key").where("component <> l.component").select(F.greatest("id", "l.id").alias("a"), F.least("id", "l.id").alias("b"))
            met = saved(met.distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
            tried = tried.unionByName(met)
            members, before = left.select("key", "id"), found
            links, found = self.more(links, met, found)
            if found is before:
                return self.rest(left, links, tried, found)
        left = self.unsettled(members, found)
        return (links, found) if left is None else self.rest(left, links, tried, found)

    def more(self, links: DataFrame, pairs: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
        new = self.verified(pairs)
        if new.isEmpty():
            return links, found
        links = links.unionByName(new)
        return links, components(links)

    def unsettled(self, members: DataFrame, found: DataFrame) -> DataFrame | None:
        """(key, id, component) of the keys whose documents lie in two components or more; None without any.

        Of a component's equal documents in a key the smallest id stands for all, as they link with the same ones: what
        is compared does not grow with the square of the copies.
        """
        placed = members.distinct().join(found, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
        placed = saved(placed, "placed")
        keys = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
        left = placed.join(keys, "key").join(self.info.select("id", "digest"), "id").groupBy("key", "component", "digest").agg(F.min("id").alias("id"))
        left = saved(left.select("key", "id", "component"), "left")
        forget(placed)
        return None if left.isEmpty() else left

    def rest(self, left: DataFrame, links: DataFrame, tried: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Every pair across components within a key; a key of many documents is compared chunk by chunk."""
        sizes = left.groupBy("key").agg(F.count("*").alias("size"))
        chunks = F.ceil(F.col("size") / self.p.chunk).cast("int")
        rows = left.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("id"), chunks).cast("int"))
        rows = rows.select("key", "id", "component", "own", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other"))
        rows = rows.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("task"), "id", "component", "own", (F.col("own") != F.col("other")).alias("two"))
        whole = rows.join(self.info, "id").select("task", "id", "component", "n", "sketch", "own", "two")
        met = whole.repartition("task").sortWithinPartitions("task").mapInArrow(_compared(self.p.num, self.p.den), "a bigint, b bigint")
        met = saved(met.distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
        sweep(self.docs.sparkSession)
        return self.more(links, met, found)


def _keyed(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(df with __key, further, repeated): a key names one id and one text, null for a null id.

    The key of an id's first text, by digest, is the id. further (key, id) has the other texts' keys, which lie outside
    the ids; None where every id has one text. repeated: the ids of two rows or more; None without any.
    """
    ids, text = F.col(id_col).cast("bigint"), text_or_empty(text_col)
    here = df.withColumn("__key", ids)
    repeated = saved(here.where("__key is not null").groupBy("__key").count().where("count > 1").select(F.col("__key").alias("id")), "repeated")
    if repeated.isEmpty():
        return here, None, None
    many = here.where(F.coalesce(Bitmap(repeated, "id").maybe("__key"), F.lit(False)))
    texts = saved(many.where("__key is not null").select(F.col("__key").alias("id"), F.sha2(text, 256).alias("digest")).distinct(), "texts")
    first = texts.groupBy("id").agg(F.min("digest").alias("first"), F.count("*").alias("n")).where("n > 1")
    # any different numbers serve as keys, in a saved table so that they stay
    others = saved(texts.join(first, "id").where("digest <> first").select("id", "digest", F.monotonically_increasing_id().alias("number")), "texts")
    n = others.agg(F.max("number")).first()[0]
    if n is None:
        return here, None, repeated
    low, high = here.agg(F.min("__key"), F.max("__key")).first()
    begin = high + 1 if high + n + 1 < 1 << 63 else low - n - 1
    if begin < -(1 << 63):
        raise ValueError("the ids leave no room for the keys of repeated ids with other texts")
    further = others.select("id", "digest", (F.col("number") + F.lit(begin)).alias("key"))
    maybe = F.coalesce(Bitmap(further, "id").maybe("__key"), F.lit(False))
    moved = here.where(maybe).withColumn("__digest", F.sha2(text, 256)).join(further, (F.col("__key") == further["id"]) & (F.col("__digest") == further["digest"]), "left")
    moved = moved.select(*df.columns, F.coalesce(further["key"], F.col("__key")).alias("__key"))
    return here.where(~maybe).unionByName(saved(moved, "moved")), further.select("key", "id"), repeated


def _found(rows: DataFrame, further: DataFrame | None, p: Params, text_col: str, unique: bool) -> tuple[_Join, DataFrame]:
    """The join of the rows of _keyed(), and (key, component, name): the key and the id of the component's smallest id."""
    j = _Join(rows.select(F.col("__key").alias("id"), text_or_empty(text_col).alias("text")), p, unique)
    found = j.run()
    if further is None:
        return j, found.select(F.col("id").alias("key"), "component", F.col("component").alias("name"))
    members = found.withColumnRenamed("id", "key").join(further, "key", "left").select("key", "component", F.coalesce("id", "key").alias("id"))
    first = members.groupBy("component").agg(F.min(F.struct("id", "key")).alias("m"))
    return j, saved(members.join(first, "component").select("key", F.col("m.key").alias("component"), F.col("m.id").alias("name")), "found")


def join(df: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row; ids are integers."""
    prepare(df.sparkSession)
    rows, further, twice = _keyed(df.select(id_col, text_col), id_col, text_col)
    j, found = _found(rows, further, p, text_col, twice is None)
    sizes = j.prints.where("n is not null").select(F.col("id").alias("key"), F.col("n").alias("n_shingles"))
    sizes = sizes.withColumn("id", F.col("key")) if further is None else sizes.join(further, "key", "left").withColumn("id", F.coalesce("id", "key"))
    return sizes.join(found, "key", "left").select(F.col("id").alias(id_col), "n_shingles", F.coalesce("name", "id").alias("component_id"))


def representatives(df: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that stay when one document of each component does, with all their columns.

    A row with the smallest id of a component stays; rows that repeat an id and its text stay as one row, and rows that
    repeat an id with another text are documents of their own. Rows with a null id and rows without shingles link with
    nothing and stay. Other columns may have any names, also those that the join uses.
    """
    prepare(df.sparkSession)
    names = df.columns
    plain = df.toDF(*(f"c{i}" for i in range(len(names))))
    here, further, twice = _keyed(plain, f"c{names.index(id_col)}", f"c{names.index(text_col)}")
    _, found = _found(here, further, p, f"c{names.index(text_col)}", twice is None)
    # only removed keys are matched, and only documents that have one are shuffled
    gone = saved(found.where("component <> key").select(F.col("key").alias("__gone")).distinct(), "gone")
    maybe = Bitmap(gone, "__gone").maybe("__key")
    rest = here.where(~F.coalesce(maybe, F.lit(False)))
    sure = here.where(F.coalesce(maybe, F.lit(False))).join(gone, F.col("__key") == F.col("__gone"), "left_anti")
    kept = rest.unionByName(sure)
    if twice is not None:
        repeated = here.where("__key is not null").groupBy("__key").count().where("count > 1").select(F.col("__key").alias("__gone"))
        repeated = saved(repeated, "repeated")
        once = kept.join(repeated, F.col("__key") == F.col("__gone"), "left_semi").dropDuplicates(["__key"])
        kept = kept.join(repeated, F.col("__key") == F.col("__gone"), "left_anti").unionByName(once)
    return kept.drop("__key").toDF(*names)
