"""Media columns: content-addressed payloads in tar shards, with rows that carry digest, shard, offset and length.

store() turns a payload into a grey 8-bit PNG picture, 64 samples to a row, which goes into a tar shard under the
payload's SHA-256 digest. A payload is stored once, however many rows have it: digests that only one task has are stored
there, the others from one row each, so only the texts of copies are shuffled. The rows (id, digest, shard, offset, length)
are a table in the shared folder. A shard's name belongs to the attempt that wrote it, so a lost attempt leaves a file that
no row names. headers() reads the first bytes of each picture by its range and fills the metadata columns without touching
the samples. read() fetches the ranges, undoes the encoding and computes features.

Shards are reached through pyarrow's file systems by URI, so the shared folder may be local or in a store.

Defined results: a null text is the empty text, whose payload is one block of zeros; equal texts have equal digests
and values, and one stored payload; rows that repeat an id and null ids are rows of their own; texts of any
length are stored whole; a damaged picture ends the job by its checksum; an empty table gives an empty table; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import contextlib
import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.bitmap import Bitmap
from lexispark.llm.common import prepare, saved, shared_folder, text_or_empty

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Signature, and the IHDR chunk with its length, name and checksum.
HEADER_BYTES = 8 + 12 + 13
#: A shard is closed beyond this many bytes and the task opens another.
SHARD_BYTES = 256 << 20


def payload_of(data: bytes) -> bytes:
    """data and zeros, up to a positive multiple of WIDTH."""
    return data + bytes(max(WIDTH, -(-len(data) // WIDTH) * WIDTH) - len(data))


def _chunk(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def to_png(payload: bytes, level: int = 6) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each line begins with filter 0
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def png_header(data: bytes) -> dict[str, int]:
    """Width, height and bit depth, from the first HEADER_BYTES."""
    if data[:8] != SIGNATURE or data[12:16] != b"IHDR":
        raise ValueError("not a PNG picture")
    width, height, depth = struct.unpack(">IIB", data[16:25])
    return {"width": width, "height": height, "bit_depth": depth}


def from_png(data: bytes) -> bytes:
    head = png_header(data)
    at, body = 8, []
    while at < len(data):
        (n,), name = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + n]
        if struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] != zlib.crc32(name + part):
            raise ValueError("a PNG chunk is damaged")
        if name == b"IDAT":
            body.append(part)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(head["height"], head["width"] + 1)
    if lines[:, 0].any():
        raise ValueError("only PNG filter 0 is written here")
    return lines[:, 1:].tobytes()


class ShardWriter:
    """One tar shard after another in a folder; add() returns where the member's bytes lie."""

    def __init__(self, folder: str, shard_bytes: int):
        self.fs, self.root = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.root, recursive=True)
        self.shard_bytes, self.stream, self.name, self.at = shard_bytes, None, "", 0

    def add(self, name: str, data: bytes) -> tuple[str, int, int]:
        if self.stream is None or self.at > self.shard_bytes:
            self.close()
            self.name, self.at = f"{uuid.uuid4().hex}.tar", 0
            self.stream = self.fs.open_output_stream(f"{self.root}/{self.name}")
        info = tarfile.TarInfo(name)
        info.size = len(data)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        self.stream.write(head + data + bytes(-len(data) % 512))
        offset = self.at + len(head)
        self.at = offset + len(data) + -len(data) % 512
        return self.name, offset, len(data)

    def close(self) -> None:
        if self.stream is not None:
            self.stream.write(bytes(1024))
            self.stream.close()
            self.stream = None


#: Bytes of ranges that one task reads.
READ_BYTES = 32 << 20
#: Digests, or read results, that a task remembers; beyond that it forgets all, which costs storage or reads only.
REMEMBERED = 200_000
_PLACE = [("n_bytes", pa.int64()), ("digest", pa.string()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
_PLACE_DDL = "n_bytes bigint, digest string, shard string, offset bigint, length bigint"


def _batch(kept: list, columns: list[tuple[str, pa.DataType]], names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    made = list(zip(*rows)) or [()] * len(columns)
    return pa.RecordBatch.from_arrays(kept + [pa.array(v, t) for v, (_, t) in zip(made, columns)], names=names + [c for c, _ in columns])


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, folder: str | None = None) -> tuple[DataFrame, str]:
    """(rows, folder of the shards). rows: id, n_bytes, digest, shard, offset, length.

    Digests that several tasks have are found first; such payloads are stored apart, one row of each digest, and their
    rows get its place by a join on the digest. All others are stored where they are read.
    """
    spark = df.sparkSession
    prepare(spark)
    folder = folder or shared_folder(spark, "media")
    text = text_or_empty(text_col)
    padded = F.rpad(F.encode(text, "UTF-8"), (F.greatest(F.ceil(F.octet_length(text) / WIDTH), F.lit(1)) * WIDTH).cast("int"), F.lit(b"\x00"))
    source = df.select(F.col(id_col).alias("id"), text.alias("text"), F.sha2(padded, 256).alias("digest"))
    kind = source.schema["id"].dataType.simpleString()
    tasks = source.select("digest", F.spark_partition_id().alias("task")).groupBy("digest").agg(F.min("task").alias("a"), F.max("task").alias("b"))
    several = Bitmap(saved(tasks.where("a <> b").select("digest"), "media-several"), "digest")
    has = several.has

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, places = ShardWriter(folder, shard_bytes), {}
        try:
            for b in batches:
                rows = []
                for text, digest, elsewhere in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), has(b.column(3).to_numpy()).tolist()):
                    data = text.encode("utf-8", "surrogatepass")
                    if elsewhere:
                        rows.append((len(data), digest, None, None, None))
                        continue
                    if digest not in places:
                        if len(places) >= REMEMBERED:
                            places.clear()
                        places[digest] = shards.add(f"{digest[:2]}/{digest}.png", to_png(payload_of(data)))
                    rows.append((len(data), digest, *places[digest]))
                yield _batch([b.column(0)], _PLACE, ["id"], rows)
        finally:
            shards.close()

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = ShardWriter(folder, shard_bytes)
        try:
            for b in batches:
                rows = [shards.add(f"{d[:2]}/{d}.png", to_png(payload_of(t.encode("utf-8", "surrogatepass")))) for d, t in zip(*(b.column(i).to_pylist() for i in range(2)))]
                yield _batch([b.column(0)], _PLACE[2:], ["digest"], rows)
        finally:
            shards.close()

    at = several.position("digest").alias("at")
    rows = saved(source.select("id", "text", "digest", at).mapInArrow(own, f"id {kind}, {_PLACE_DDL}"), "media-own")
    once = source.where(several.maybe("digest")).groupBy("digest").agg(F.min("text").alias("text"))
    places = saved(once.mapInArrow(common, "digest string, shard string, offset bigint, length bigint"), "media-common")
    other = rows.where("shard is null").select("id", "n_bytes", "digest").join(places, "digest").select(*rows.columns).sortWithinPartitions("shard", "offset")
    return saved(rows.where("shard is not null").unionByName(other), "media-rows"), folder


def _ranges(rows: DataFrame, folder: str, take: int | None, compute, columns: list[tuple[str, pa.DataType]], ddl: str) -> DataFrame:
    """rows with compute(bytes of the range); take: only so many of its first bytes."""
    names = rows.columns
    place = [names.index(c) for c in ("shard", "offset", "length")]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        name, known = None, {}
        with contextlib.ExitStack() as opened:
            for b in batches:
                out = []
                for shard, offset, length in zip(*(b.column(i).to_pylist() for i in place)):
                    if (shard, offset) not in known:
                        if shard != name:
                            opened.close()  # one shard is open at a time
                            name, file = shard, opened.enter_context(fs.open_input_file(f"{root}/{shard}"))
                        if len(known) >= REMEMBERED // 10:
                            known.clear()
                        known[shard, offset] = compute(file.read_at(length if take is None else min(take, length), offset))
                    out.append(known[shard, offset])
                yield _batch([b.column(i) for i in range(len(names))], columns, names, out)

    return rows.mapInArrow(run, f"{kinds}, {ddl}")


def headers(rows: DataFrame, folder: str) -> DataFrame:
    """rows of store() with width, height and bit_depth, from header-only range reads."""

    def compute(data: bytes) -> tuple:
        h = png_header(data)
        return h["width"], h["height"], h["bit_depth"]

    prepare(rows.sparkSession)
    return _ranges(rows, folder, HEADER_BYTES, compute, [("width", pa.int32()), ("height", pa.int32()), ("bit_depth", pa.int32())], "width int, height int, bit_depth int")


def feature(payload: bytes) -> str:
    """Mean and entropy of the samples, and the share of zeros."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    p = counts[counts > 0] / len(payload)
    return f"mean={(counts * np.arange(256)).sum() / len(payload):.4f};entropy={float(-(p * np.log2(p)).sum()) + 0.0:.4f};zeros={counts[0] / len(payload):.4f}"


def read(rows: DataFrame, folder: str) -> DataFrame:
    """rows of store() with what the stored bytes say: sizes, digests, the last samples' checksum and a feature."""

    def compute(data: bytes) -> tuple:
        payload = from_png(data)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(data), hashlib.sha256(data).hexdigest(), feature(payload)

    columns = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    prepare(rows.sparkSession)
    return _ranges(rows, folder, None, compute, columns, "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


def media_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Every row with its stored payload's place and what headers() and read() found there."""
    rows, folder = store(df, id_col, text_col, shard_bytes)
    # the rows are short and the ranges long: as many tasks as the ranges' bytes need, each with neighbours of a shard
    total = rows.agg(F.sum("length")).first()[0] or 0
    spread = rows.repartitionByRange(max(1, -(-total // READ_BYTES)), "shard", "offset", "id").sortWithinPartitions("shard", "offset")
    return read(headers(spread, folder), folder).withColumnRenamed("id", id_col)
