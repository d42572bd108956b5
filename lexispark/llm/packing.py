"""Packing tokenised documents into sequences by vector bin packing.

Every piece is a vector (tokens, one segment, loss-bearing tokens), every sequence a bin with a limit on each.
Pieces of a full sequence's length fill a sequence alone. All shorter ones meet in a pool; the dot-product
heuristic fills one bin at a time with the fitting piece whose vector has the largest dot product with what
the bin has left, both in shares of the limits. Where nothing fits any more, a waiting piece may be cut to close
the gap (allow_cut). Each task packs its own rows with a bounded pool, so there is no shuffle, and a hot key
has no effect; a sequence's id is the task's number and a running number, and a lost task is packed again
alike, as its rows come in the same order.

Defined results: a null text is empty and gives one piece, the closing id alone; null ids and repeated rows are packed
each on its own; of pieces alike in all three measures the one that came last goes first; a text of any length is cut
into sequences of its own and one shorter piece; an empty table gives an empty table; columns other than those named
are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import memo, prepare, text_or_empty, trim
from lexispark.llm.pretoken import ChunkEncoder, flattened

DEFAULT_VOCABULARY = "byte_bpe_50k.json"
#: Chunks, and characters and ids, that a worker remembers; the encoder is fast enough for more to be no gain.
REMEMBERED = (120_000, 6_000_000)


@dataclass(frozen=True)
class Limits:
    """What a sequence may hold, and the shortest piece that a cut may make."""

    tokens: int = 1024
    segments: int = 64
    loss_tokens: int = 1024
    allow_cut: bool = True
    shortest_cut: int = 8


@dataclass(frozen=True)
class Piece:
    """Tokens [start, start + length) of a document; the last `loss` of them bear loss."""

    doc: int
    start: int
    length: int
    loss: int

    def cut(self, n: int) -> tuple[Piece, Piece]:
        """The first n tokens and the rest."""
        rest = min(self.loss, self.length - n)
        return Piece(self.doc, self.start, n, self.loss - rest), Piece(self.doc, self.start + n, self.length - n, rest)


def split_document(doc: int, n: int, loss: int, limits: Limits) -> list[Piece]:
    """Pieces of one document, none over a limit."""
    rest, out = Piece(doc, 0, n, loss), []
    while rest.length > limits.tokens or rest.loss > limits.loss_tokens:
        plain = rest.length - rest.loss
        head, rest = rest.cut(min(limits.tokens, plain + limits.loss_tokens, rest.length - 1))
        out.append(head)
    return [*out, rest]


class Packer:
    """Packs pieces into sequences; pieces wait until the pool holds enough for a good choice."""

    def __init__(self, limits: Limits, pool: int = 4096):
        self.limits, self.size = limits, pool
        self.pool: dict[tuple[int, int], list[Piece]] = defaultdict(list)
        self.waiting = 0

    def add(self, piece: Piece) -> None:
        self.pool[(piece.length, piece.loss)].append(piece)
        self.waiting += 1

    def _types(self) -> np.ndarray:
        return np.array(sorted(k for k, v in self.pool.items() if v), np.int64).reshape(-1, 2)

    def _take(self, kind: tuple[int, int]) -> Piece:
        self.waiting -= 1
        return self.pool[kind].pop()

    def drain(self, keep: int = 0) -> Iterator[list[Piece]]:
        """Sequences, until only `keep` pieces wait (0: until none does)."""
        c = self.limits
        types = self._types()
        left = np.array([len(self.pool[tuple(t)]) for t in types.tolist()], np.int64)
        share = np.stack([types[:, 0] / c.tokens, np.full(len(types), 1 / c.segments), types[:, 1] / c.loss_tokens], axis=1)
        while self.waiting > keep:
            room, bin_ = [c.tokens, c.segments, c.loss_tokens], []
            while room[0] > 0 and room[1] > 0 and self.waiting:
                weight = np.array([room[0] / c.tokens, room[1] / c.segments, room[2] / c.loss_tokens])
                gain = np.where((left > 0) & (types[:, 0] <= room[0]) & (types[:, 1] <= room[2]), share @ weight, -1.0)
                best = int(gain.argmax()) if len(gain) else -1
                if best < 0 or gain[best] < 0:
                    break
                left[best] -= 1
                piece = self._take(tuple(types[best].tolist()))
                bin_.append(piece)
                room = [room[0] - piece.length, room[1] - 1, room[2] - piece.loss]
            if c.allow_cut and bin_ and room[0] >= c.shortest_cut and room[1] > 0 and self.waiting:
                alive = np.flatnonzero(left > 0)
                for i in alive[::-1]:  # the longest first
                    length, loss = types[i].tolist()
                    n = min(room[0], length - loss + room[2])
                    if n >= c.shortest_cut and n < length:
                        left[i] -= 1
                        head, rest = self._take((length, loss)).cut(n)
                        bin_.append(head)
                        self.add(rest)
                        at = np.flatnonzero((types[:, 0] == rest.length) & (types[:, 1] == rest.loss))
                        if len(at):
                            left[at[0]] += 1
                        else:
                            types = np.vstack([types, [[rest.length, rest.loss]]])
                            left = np.append(left, 1)
                            share = np.vstack([share, [[rest.length / c.tokens, 1 / c.segments, rest.loss / c.loss_tokens]]])
                            order = np.lexsort((types[:, 1], types[:, 0]))
                            types, left, share = types[order], left[order], share[order]
                        break
            yield bin_

    def sequences(self, documents: Iterable[tuple[int, int, int]]) -> Iterator[list[Piece]]:
        """documents: (number, tokens, loss-bearing tokens)."""
        c = self.limits
        for doc, n, loss in documents:
            for piece in split_document(doc, n, loss, c):
                if piece.length == c.tokens:
                    yield [piece]
                else:
                    self.add(piece)
            if self.waiting >= self.size:
                yield from self.drain(self.size // 8)
        yield from self.drain()


def ranks_of(path: str) -> tuple[dict[bytes, int] | None, str, int]:
    """(ranks, a special token's string, its id) of a tokenizer file of byte-level merges; no ranks where the file says more than ranks can.

    Encoding by rank gives the same ids where every merge's token has an id in the order of the merges.
    """
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    model, special = whole["model"], [t for t in whole.get("added_tokens", []) if t.get("special")]
    steps = [x.get("type") for x in (whole.get("pre_tokenizer") or {}).get("pretokenizers", [whole.get("pre_tokenizer") or {}])]
    plain = model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")) and not whole.get("normalizer")
    if not plain or steps != ["ByteLevel"] or (whole["pre_tokenizer"].get("add_prefix_space")) or not special:
        return None, "", 0
    # byte-level alphabets write bytes that are no visible character as code points from 256 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    names = {t["content"] for t in special}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in names}
    order = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    return (ranks if order == sorted(order) and len(ranks) == len(order) + 256 else None), special[0]["content"], special[0]["id"]


def encoder(path: str, pattern: str) -> ChunkEncoder:
    """One encoder for each worker process, kept between tasks."""
    return memo(("encoder", path, pattern), lambda: _encoder(path, pattern))


def _encoder(path: str, pattern: str) -> ChunkEncoder:
    ranks, mark, end = ranks_of(path)
    if ranks is None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core already
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        return ChunkEncoder(pattern, lambda chunks: flattened([x.ids for x in t.encode_batch_fast(chunks, add_special_tokens=False)] if chunks else []), *REMEMBERED)
    import tiktoken

    e = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={mark: end})

    def encode(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if any(mark in c for c in chunks):
            return flattened([e.encode_ordinary(c) for c in chunks])
        # one call for many chunks: the special token's string keeps them apart, and its id tells where they end
        joined = (mark.join([*chunks[i : i + 256], ""]) for i in range(0, len(chunks), 256))
        flat = np.concatenate([np.zeros(0, np.uint32), *(np.array(e.encode(x, allowed_special="all"), np.uint32) for x in joined)])
        ends = np.flatnonzero(flat == end)
        return flat[flat != end], np.diff(ends, prepend=-1) - 1

    return ChunkEncoder(pattern, encode, *REMEMBERED)


COLUMNS = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, loss_tokens bigint"


def pack(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", loss_col: str | None = None, limits: Limits = Limits(), end_id: int = 0, response_col: str | None = None) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens.

    loss_col: how many of a document's last tokens bear loss, the closing id among them (all where absent or null).
    response_col, for instruction data: the text that follows a document's own, encoded by itself; its tokens and the
    closing id bear loss, and loss_col is not used. A null response is empty.
    """
    prepare(df.sparkSession)
    loss = F.col(loss_col).cast("bigint") if loss_col else F.lit(None).cast("bigint")
    source = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"), loss.alias("loss"), *([text_or_empty(response_col).alias("response")] if response_col else []))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, pattern)
        base = TaskContext.get().partitionId() << 40
        kept: dict[int, tuple[object, np.ndarray, int]] = {}  # documents with pieces that wait: id, ids, tokens still to place
        id_type: list[pa.DataType] = [pa.int64()]

        def documents() -> Iterator[tuple[int, int, int]]:
            number = 0
            for b in batches:
                id_type[0] = b.schema.field(0).type
                answers = encode.encode(b.column(3).to_pylist()) if response_col else [None] * b.num_rows
                for key, ids, n_loss, answer in zip(b.column(0).to_pylist(), encode.encode(b.column(1).to_pylist()), b.column(2).to_pylist(), answers):
                    if answer is not None:
                        ids, n_loss = np.concatenate([ids, answer]), len(answer) + 1
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    kept[number] = (key, ids, len(ids))
                    yield number, len(ids), len(ids) if n_loss is None else max(0, min(n_loss, len(ids)))
                    number += 1

        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * 8
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], id_type[0]), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["id", *(x.split()[0] for x in COLUMNS.split(", "))])

        for s, pieces in enumerate(Packer(limits).sequences(documents())):
            offset = 0
            for p in pieces:
                key, ids, left = kept[p.doc]
                rows.append((key, p.start, p.length, zlib.crc32(ids[p.start : p.start + p.length].tobytes()), len(ids), base + s, offset, p.loss))
                offset += p.length
                if left == p.length:
                    del kept[p.doc]
                else:
                    kept[p.doc] = (key, ids, left - p.length)
            if len(rows) >= 4096:
                yield batch()
        yield batch()
        encode.forget()
        trim()

    return source.mapInArrow(run, f"id {kind}, {COLUMNS}").withColumnRenamed("id", id_col)
