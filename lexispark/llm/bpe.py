"""Byte-level BPE by corpus-level merge replay.

The corpus's distinct pretokens meet in buckets of their hashes, and a bucket is replayed as one corpus: an inverted
index leads from the rank of a mergeable token pair to the positions where that pair stands; merges are applied in rank
order over the whole bucket at once, and after each merge only the two touched neighbours get new index entries.

1. Each task sends the distinct words of each block of its texts (BLOCK_CHARS) to the buckets, compressed.
2. Each bucket's words are replayed, once however many tasks sent them, and the ids are saved under the task and block.
3. Each task reads its own words' ids, block by block, and puts its texts together. Should its rows have been dealt
   otherwise than before, words that it does not find are replayed by the task itself, so the ids are the same.

A frequent word is one entry of a block's list, so no word is a hot key, and no text is shuffled.

Defined results: a null text is the empty text (no ids); null ids and repeated rows give rows of their own; texts of any
length are encoded whole; a vocabulary without a token for each byte is refused; an empty table gives an empty table;
columns other than the id and the text are ignored.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Callable, Iterator, Sequence
from heapq import heappop, heappush
from itertools import chain, groupby
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lexispark.llm.common import memo, prepare, shared_folder, text_or_empty, trim
from lexispark.llm.pretoken import ChunkEncoder, distinct, flattened

DEFAULT_VOCABULARY = "byte_bpe_50k.tiktoken"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class MergeReplay:
    """Ranks of a vocabulary, replayed over blocks of distinct byte strings."""

    SHIFT = 24

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary has no token for byte {missing[0]}: {len(missing)} of 256 are missing")
        if max(ranks.values()) >> self.SHIFT or min(ranks.values()) < 0:
            raise ValueError(f"ranks must lie from 0 to {(1 << self.SHIFT) - 1}")
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        #: Every pair of tokens that may merge, as left << SHIFT | right, with the rank of the result.
        self.pairs: dict[int, int] = {}
        get = ranks.get
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = get(token[:k]), get(token[k:])
                if left is not None and right is not None:
                    self.pairs[left << self.SHIFT | right] = rank
        #: The same, sorted.
        self.keys = np.array(sorted(self.pairs), np.int64)
        self.key_ranks = np.array([self.pairs[k] for k in self.keys.tolist()], np.int64)

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of every word. The many lists make no cycles, so the collector need not look at them meanwhile."""
        collects = gc.isenabled()
        gc.disable()
        try:
            return self._replayed(words)
        finally:
            if collects:
                gc.enable()

    def _index(self, symbols: list[int]) -> dict[int, list[int]]:
        """Rank of a pair -> the positions of its left symbol."""
        s = np.array(symbols, np.int64)
        key = np.where((s[:-1] >= 0) & (s[1:] >= 0), s[:-1] << self.SHIFT | s[1:], -1)
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        at = np.flatnonzero(self.keys[place] == key)
        rank = self.key_ranks[place[at]]
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        edges = np.flatnonzero(np.diff(rank, prepend=-1)).tolist() + [len(rank)]
        return {int(rank[a]): at[a:b].tolist() for a, b in zip(edges, edges[1:])}

    def _replayed(self, words: list[bytes]) -> list[list[int]]:
        """Words are replayed together as one corpus.

        symbols holds the tokens of all words one after another, -1 after each word and for swallowed places.
        """
        pairs, shift, known = self.pairs.get, self.SHIFT, self.ranks.get
        out: list[list[int] | None] = [None] * len(words)
        todo: list[tuple[int, int]] = []
        symbols: list[int] = [-1]
        single = self.single.__getitem__
        for w, word in enumerate(words):
            whole = known(word)
            if whole is None:
                todo.append((w, len(symbols)))
                symbols.extend(map(single, word))
                symbols.append(-1)
            else:
                out[w] = [whole]
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        index = self._index(symbols) if self.pairs else {}
        heap = sorted(index)
        while heap:
            r = heappop(heap)
            positions = index.pop(r)
            if len(positions) > 1:
                positions.sort()
            late: list[int] = []  # positions of words that now have a pair of lower rank, which goes first
            held = -1  # the end of such a word
            for i in positions:
                x = symbols[i]
                if x < 0:
                    continue
                j = after[i]
                y = symbols[j]
                if y < 0 or pairs(x << shift | y) != r:
                    continue
                if i < held:
                    late.append(i)
                    continue
                k = after[j]
                symbols[i], symbols[j], after[i], before[k] = r, -1, k, i
                z = symbols[k]
                if z >= 0 and (q := pairs(r << shift | z)) is not None:
                    if q in index:
                        index[q].append(i)
                    else:
                        index[q] = [i]
                        heappush(heap, q)
                    if q < r:
                        held = symbols_end(symbols, after, k)
                h = before[i]
                z = symbols[h]
                if z >= 0 and (q := pairs(z << shift | r)) is not None:
                    if q in index:
                        index[q].append(h)
                    else:
                        index[q] = [h]
                        heappush(heap, q)
                    if q < r:
                        held = symbols_end(symbols, after, k)
            if late:
                if r in index:
                    index[r] += late
                else:
                    index[r] = late
                    heappush(heap, r)
        for w, begin in todo:
            i, ids = begin, []
            while (x := symbols[i]) >= 0:
                ids.append(x)
                i = after[i]
            out[w] = ids
        return out  # type: ignore[return-value]


def symbols_end(symbols: list[int], after: list[int], i: int) -> int:
    """The end of the word in which position i lies."""
    while symbols[i] >= 0:
        i = after[i]
    return i


class Codec:
    """Texts to ids and back."""

    def __init__(self, path: str, pattern: str, max_words: int = 500_000):
        self.replay = MergeReplay(load_ranks(path))
        self.pattern = regex.compile(pattern)
        self.words: dict[str, Sequence[int]] = {}
        self.max_words = max_words
        self.chunks = ChunkEncoder(pattern, self._encode_chunks)
        self.missed = 0
        self.table: Callable[[list[str]], tuple[np.ndarray, np.ndarray] | None] = lambda chunks: None
        lengths = np.fromiter(map(len, self.replay.bytes_of), np.int64, len(self.replay.bytes_of))
        self.length, self.start = lengths, np.cumsum(lengths) - lengths
        self.flat = np.frombuffer(b"".join(self.replay.bytes_of), np.uint8)

    def know(self, table: Callable[[list[str]], tuple[np.ndarray, np.ndarray] | None]) -> None:
        """Encode no chunks but those that the table gives no ids for; forgets what was known."""
        self.table = table
        self.words = {}
        self.chunks.forget()

    def _encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.table(chunks)
        return self.fresh(chunks) if found is None else found

    def fresh(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks one after another, how many each has), by replaying the words that are not remembered."""
        pieces = [self.pattern.findall(c) for c in chunks]
        if len(self.words) > self.max_words:
            self.words = {}
        new = [p for p in dict.fromkeys(chain.from_iterable(pieces)) if p not in self.words]
        self.missed += len(new)
        self.words.update(zip(new, self.replay.encode_words([p.encode("utf-8", "surrogatepass") for p in new])))
        words = self.words
        return flattened([words[x[0]] if len(x) == 1 else [i for p in x for i in words[p]] for x in pieces])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self.chunks.encode(texts)

    def decode(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        lengths = self.length[ids]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1]) + np.repeat(self.start[ids] - ends + lengths, lengths)
        return self.flat[at].tobytes()


def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker process, kept between tasks."""
    return memo(("codec", path, pattern), lambda: Codec(path, pattern))


#: Characters of the texts whose distinct words are one block.
BLOCK_CHARS = 4_000_000
#: Characters of texts for each bucket of words that is replayed as one corpus.
BUCKET_CHARS = 24_000_000
#: Buckets among which a task deals a block's words: with more, a row would hold few words and compress badly.
MOST_BUCKETS = 256


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """(id, text) of a task's rows, cut into blocks by the texts' lengths alone, so that every pass cuts alike."""
    rows, size = [], 0
    for b in batches:
        for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            rows.append(row)
            size += len(row[1])
            if size >= BLOCK_CHARS:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def _words_of(texts: list[str]) -> list[str]:
    """What texts are cut into at spaces (see pretoken.py), as a ChunkEncoder asks for it, in the order of first occurrence."""
    tails, heads = distinct([t.split(" ") for t in texts])
    return [*map(" ".__add__, tails), *heads]


def _bucketed(words: list[str], buckets: int) -> dict[int, tuple[list[bytes], np.ndarray]]:
    """bucket -> (its words as bytes, in the order of the list; their places in it)."""
    whole = [w.encode("utf-8", "surrogatepass") for w in words]
    bucket = np.fromiter(map(crc32, whole), np.uint32, len(whole)) % np.uint32(buckets)
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order], prepend=-1)).tolist() + [len(order)]
    return {int(bucket[order[a]]): ([whole[i] for i in order[a:b].tolist()], order[a:b]) for a, b in zip(edges, edges[1:])}


def _pressed(parts: list[bytes]) -> tuple[bytes, bytes]:
    """Byte strings one after another, and their lengths, compressed."""
    press = zstandard.ZstdCompressor(level=1).compress
    return press(b"".join(parts)), press(np.fromiter(map(len, parts), np.uint32, len(parts)).tobytes())


def _split(data: bytes, lengths: bytes) -> list[bytes]:
    unpress = zstandard.ZstdDecompressor().decompress
    whole, ends = unpress(data), np.cumsum(np.frombuffer(unpress(lengths), np.uint32), dtype=np.int64).tolist()
    return [whole[a:b] for a, b in zip([0, *ends], ends)]


_SENT = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("bucket", pa.int32()), ("words", pa.binary()), ("sizes", pa.binary())])


def word_table(source: DataFrame, path: str, pattern: str, kind: str) -> tuple[str, int]:
    """(folder of the ids of the corpus's words, buckets of a block): Parquet under part=<task>, rows (block, bucket, n, check, ids, counts).

    source: (id, text). Each task sends the distinct words of each of its blocks to buckets of the words' hashes.
    A bucket's distinct words, from all tasks, are replayed as one corpus; the ids go back in the order in which the
    words came. n and check (a checksum) tell whether a list of words is the one that was sent. A corpus that needs more than
    MOST_BUCKETS (6 billion characters) is replayed by regions of its tasks, each with its own buckets, so that what a
    word costs does not grow with the corpus.
    """
    n_chars = source.agg(F.sum(F.length("text"))).first()[0] or 0
    regions = max(1, -(-n_chars // (BUCKET_CHARS * MOST_BUCKETS)))
    buckets = max(1, -(-n_chars // (BUCKET_CHARS * regions)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for number, rows in enumerate(_blocks(batches)):
            parts = _bucketed(_words_of([t for _, t in rows]), buckets)
            yield pa.RecordBatch.from_pylist([{"part": part, "block": number, "bucket": part % regions * buckets + i, "words": data, "sizes": sizes} for i, (x, _) in parts.items() for data, sizes in [_pressed(x)]], _SENT)
        trim()

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        press = zstandard.ZstdCompressor(level=1).compress
        rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(5))))
        for bucket, of_bucket in groupby(rows, key=lambda r: r[2]):
            asked = [(part, block, _split(data, sizes)) for part, block, _, data, sizes in of_bucket]
            words = list(set().union(*(x[2] for x in asked)))
            flat, counts = c.fresh([w.decode("utf-8", "surrogatepass") for w in words])
            starts = np.cumsum(counts) - counts
            at = dict(zip(words, range(len(words))))
            for part, block, mine in asked:
                i = np.fromiter(map(at.__getitem__, mine), np.int64, len(mine))
                n = counts[i]
                ends = np.cumsum(n)
                ids = flat[np.arange(ends[-1]) + np.repeat(starts[i] - ends + n, n)]
                columns = [(part, pa.int32()), (block, pa.int32()), (bucket % buckets, pa.int32()), (len(mine), pa.int64()), (crc32(b"".join(mine)), pa.int64()), (press(ids.astype(np.uint32).tobytes()), pa.binary()), (press(n.astype(np.uint32).tobytes()), pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in columns], names=["part", "block", "bucket", "n", "check", "ids", "counts"])
        trim()

    sent = source.mapInArrow(send, "part int, block int, bucket int, words binary, sizes binary")
    made = sent.repartition(min(regions * buckets, 1 << 14), "bucket").sortWithinPartitions("bucket").mapInArrow(replay, "part int, block int, bucket int, n bigint, check bigint, ids binary, counts binary")
    folder = shared_folder(source.sparkSession, kind)
    made.repartition("part").sortWithinPartitions("part", "block").write.partitionBy("part").parquet(folder)
    return folder, buckets


def _known(folder: str) -> Iterator[tuple[int, dict[int, tuple]]]:
    """(block, bucket -> (n, check, ids, counts)) of the running task's part of a word_table(), block by block."""
    fs, root = pafs.FileSystem.from_uri(folder)
    at = f"{root}/part={TaskContext.get().partitionId()}"
    if fs.get_file_info(at).type == pafs.FileType.NotFound:
        return
    files = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(at)) if f.path.endswith(".parquet"))
    rows = (r for f in files for b in pq.ParquetFile(f, filesystem=fs).iter_batches(64) for r in zip(*(b.column(c).to_pylist() for c in ("block", "bucket", "n", "check", "ids", "counts"))))
    for block, some in groupby(rows, key=lambda r: r[0]):
        yield block, {r[1]: r[2:] for r in some}


def _lookup(table: dict[int, tuple], buckets: int) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray] | None]:
    """The ids of a block's words by the table; None for any other list of words."""
    unpress = zstandard.ZstdDecompressor().decompress

    def of(words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        flats, lengths, places = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for bucket, (mine, at) in _bucketed(words, buckets).items():
            n, check, ids, counts = table.get(bucket, (None, None, None, None))
            if n != len(mine) or check != crc32(b"".join(mine)):
                return None
            flats.append(np.frombuffer(unpress(ids), np.uint32))
            lengths.append(np.frombuffer(unpress(counts), np.uint32).astype(np.int64))
            places.append(at)
        flat, counts = np.concatenate(flats), np.concatenate(lengths)
        # from the buckets' order to that of the words
        order = np.empty(len(counts), np.int64)
        order[np.concatenate(places)] = np.arange(len(counts))
        starts, n = (np.cumsum(counts) - counts)[order], counts[order]
        ends = np.cumsum(n)
        return flat[np.arange(int(n.sum())) + np.repeat(starts - ends + n, n)], n

    return of


def _encoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str, folder: str, buckets: int) -> Iterator[tuple[list, list[np.ndarray], Codec]]:
    """(ids of documents, token ids of their texts, codec) of a task's rows.

    Words come from the word table; should the rows have been dealt otherwise than before, they are replayed here.
    """
    c = codec(path, pattern)
    known = _known(folder)
    table = next(known, None)
    for number, rows in enumerate(_blocks(batches)):
        while table is not None and table[0] < number:
            table = next(known, None)
        c.know(_lookup(table[1] if table is not None and table[0] == number else {}, buckets))
        ids = c.encode([t for _, t in rows])
        for k in range(0, len(rows), 256):
            yield [i for i, _ in rows[k : k + 256]], ids[k : k + 256], c
    c.know(lambda words: None)
    trim()


def _source(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str, pa.DataType]:
    source = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return source, source.schema["id"].dataType.simpleString(), to_arrow_type(source.schema["id"].dataType)


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>): the token ids of every whole text."""
    prepare(df.sparkSession)
    source, kind, arrow = _source(df, id_col, text_col)
    folder, buckets = word_table(source, path, pattern, "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids, _ in _encoded(batches, path, pattern, folder, buckets):
            yield pa.RecordBatch.from_arrays([pa.array(keys, arrow), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))], names=["id", "ids"])

    return source.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, content binary): the bytes of every id list; a null list is empty."""
    prepare(df.sparkSession)
    source = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>")).alias("ids"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            content = [c.decode(np.asarray(x, np.int64)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(content, pa.binary())], names=["id", "content"])

    return source.mapInArrow(run, f"id {kind}, content binary").withColumnRenamed("id", id_col)


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encoding and decoding in one pass, for texts whose ids need not leave the task."""
    prepare(df.sparkSession)
    source, kind, arrow = _source(df, id_col, text_col)
    folder, buckets = word_table(source, path, pattern, "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids, c in _encoded(batches, path, pattern, folder, buckets):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, arrow),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(c.decode(x)).hexdigest() for x in ids], pa.string()),
                ],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return source.mapInArrow(run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
