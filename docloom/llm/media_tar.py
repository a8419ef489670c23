"""Media columns: content-addressed payloads in tar shards; rows carry digest, offset and length.

A payload is stored as an 8-bit greyscale PNG (lossless), once for each digest, as a member of an uncompressed tar shard named
by its digest. Metadata columns come from a range read of the PNG's header alone; features come from the stored bytes.
Shards are written through pyarrow's file systems, so any shared folder with a URI works; a shard is named by its partition and
attempt, and only the shards of committed attempts are named by rows, so a lost or repeated task leaves whole results.
"""

from __future__ import annotations

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

from docloom.llm.common import bounded, fresh, text_bytes, written

WIDTH = 576
#: A tar shard is closed beyond this many bytes.
SHARD_BYTES = 256 << 20
#: Bytes of a shard that one task reads.
READ_BYTES = 4 << 20
#: The bitmap of repeated digests has 2**BITS bits (8 MB).
BITS = 26
#: Digests that one task remembers to send each payload once; a task with more forgets the oldest half and sends some twice.
SEEN = 1 << 20
_MAGIC = b"\x89PNG\r\n\x1a\n"


def padded(raw: bytes, width: int = WIDTH) -> bytes:
    """``raw`` with bytes 255 up to a positive multiple of ``width``."""
    return raw + b"\xff" * (-len(raw) % width or (0 if raw else width))


def encode_png(payload: bytes, width: int = WIDTH, level: int = 9) -> bytes:
    """The payload's bytes as the samples of a greyscale PNG, row after row, each with filter 0."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = b"".join(b"\0" + payload[i : i + width] for i in range(0, len(payload), width))
    return _MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(payload) // width, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, level)) + chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from a PNG's first 33 bytes."""
    if head[:8] != _MAGIC or head[12:16] != b"IHDR" or struct.unpack(">I", head[29:33])[0] != zlib.crc32(head[12:29]):
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", head[16:25])


def decode_png(data: bytes) -> bytes:
    """The samples of a PNG that ``encode_png`` wrote; checks every chunk."""
    width, height, _ = png_header(data)
    at, packed = 8, []
    while at < len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged PNG chunk")
        if kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    rows = zlib.decompress(b"".join(packed))
    if len(rows) != height * (width + 1):
        raise ValueError("PNG of another size")
    return b"".join(rows[i + 1 : i + 1 + width] for i in range(0, len(rows), width + 1))


def _filesystem(uri: str):
    return pafs.FileSystem.from_uri(uri)


class _Shards:
    """Tar shards of one task: ``add`` returns a member's shard, offset and length."""

    def __init__(self, at: str, shard_bytes: int):
        (self.fs, self.root), self.most = _filesystem(at), shard_bytes
        self.out, self.name, self.offset = None, "", 0

    def add(self, name: str, data: bytes) -> tuple[str, int, int]:
        if self.out is None or self.offset > self.most:
            self.close()
            self.fs.create_dir(self.root, recursive=True)
            self.name, self.offset = f"{uuid.uuid4().hex}.tar", 0
            self.out = self.fs.open_output_stream(f"{self.root}/{self.name}")
        info = tarfile.TarInfo(name)
        info.size = len(data)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        self.out.write(head + data + b"\0" * (-len(data) % 512))
        place = (self.name, self.offset + len(head), len(data))
        self.offset += len(head) + len(data) + -len(data) % 512
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * 1024)
            self.out.close()
            self.out = None


def _repeated_bits(rows: DataFrame) -> np.ndarray:
    """A bitmap of 2**BITS bits with the bit of each digest that occurs more than once set (others by chance)."""
    bit = F.shiftright(F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long"), 32 - BITS)
    twice = rows.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select(bit.alias("bit"))
    words = twice.groupBy(F.shiftright("bit", 5).alias("word")).agg(F.bit_or(F.pow(F.lit(2.0), F.pmod("bit", F.lit(32))).cast("long")).alias("bits")).toArrow()
    bits = np.zeros(1 << (BITS - 5), np.uint32)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    return bits


def store(rows: DataFrame, key: str, payload: str, at: str, width: int = WIDTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Store the binary column ``payload`` under the folder ``at``; a row for each input row: key, n_bytes, digest, shard, offset, length.

    Digests are counted first. A payload whose digest is certainly unique (by a bitmap of fixed size) is written by the task
    that reads it; the others go to the task of their digest, once from each reading task, so that a hot payload costs one
    copy for each task. With ever more repeated digests the bitmap sends ever more payloads that way; the result stays the same.
    Null payloads are stored as empty ones; equal payloads share a member; an empty table writes no shard.
    """
    spark = rows.sparkSession
    rows = rows.withColumn(payload, F.coalesce(F.col(payload), F.lit(bytearray())))
    index = written(rows.select(F.col(key).alias("key"), F.octet_length(payload).cast("long").alias("n_bytes"), F.unhex(F.sha2(payload, 256)).alias("digest")), "media-rows")
    bits = spark.sparkContext.broadcast(_repeated_bits(index))
    names = ["digest", "shard", "offset", "length", "media"]
    schema = pa.schema([("digest", pa.binary()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("media", pa.binary())])

    def batch(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], f.type) for i, f in enumerate(schema)], names=names)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, seen, table = _Shards(at, shard_bytes), {}, bits.value
        try:
            for b in batches:
                found, held = [], 0
                for raw in b.column(0):
                    raw = raw.as_py() or b""
                    digest = hashlib.sha256(raw).digest()
                    bit = int.from_bytes(digest[:4], "big") >> (32 - BITS)
                    if not table[bit >> 5] >> (bit & 31) & 1:
                        found.append((digest, *shards.add(f"{digest.hex()}.png", encode_png(padded(raw, width), width)), None))
                    elif digest not in seen:
                        found.append((digest, None, None, None, media := encode_png(padded(raw, width), width)))
                        held += len(media)
                        seen[digest] = None
                        if len(seen) > SEEN:
                            for old in list(seen)[: SEEN // 2]:
                                del seen[old]
                    if held > 16 << 20:
                        yield batch(found)
                        found, held = [], 0
                yield batch(found)
        finally:
            shards.close()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, done = _Shards(at, shard_bytes), set()
        try:
            for b in batches:
                found = []
                for digest, media in zip(b.column("digest").to_pylist(), b.column("media")):
                    if digest not in done:
                        done.add(digest)
                        found.append((digest, *shards.add(f"{digest.hex()}.png", media.as_py()), None))
                yield batch(found)
        finally:
            shards.close()

    types = "digest binary, shard string, offset long, length long, media binary"
    once = written(rows.select(payload).mapInArrow(encode, types), "media-once")
    met = once.filter("media is not null").select("digest", "media").repartition("digest").mapInArrow(write, types)
    places = written(once.filter("media is null").unionByName(met).drop("media"), "media-places")
    return index.join(places, "digest").select("key", "n_bytes", "digest", "shard", "offset", "length")


def header_columns(index: DataFrame, at: str) -> DataFrame:
    """``index`` (shard, offset, length ...) with width, height and depth from range reads of 33 bytes each."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(at)
        for b in batches:
            found, held, f = [], None, None
            for shard, offset in zip(b.column("shard").to_pylist(), b.column("offset").to_pylist()):
                if shard != held:
                    f, held = fs.open_input_file(f"{root}/{shard}"), shard
                f.seek(offset)
                found.append(png_header(f.read(33)))
            cols = [pa.array([x[i] for x in found], pa.int32()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, "width", "height", "depth"])

    return index.mapInArrow(read, f"{', '.join(f'`{x.name}` {x.dataType.simpleString()}' for x in index.schema)}, width int, height int, depth int")


def read_features(index: DataFrame, at: str) -> DataFrame:
    """Columns of ``index`` and, from the stored bytes: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    ``index`` needs shard, offset and length, one row for each digest.
    """
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(at)
        held, f = None, None
        for b in batches:
            found = []
            for shard, offset, length in zip(*(b.column(c).to_pylist() for c in ("shard", "offset", "length"))):
                if shard != held:
                    f, held = fs.open_input_file(f"{root}/{shard}"), shard
                f.seek(offset)
                media = f.read(length)
                payload = decode_png(media)
                found.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
            cols = [pa.array([x[i] for x in found], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, *names])

    kept = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in index.schema)
    return index.mapInArrow(read, f"{kept}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def feature(payload: bytes) -> str:
    """Mean sample of each of 8 equal parts of the payload, as two hexadecimal digits each."""
    n = len(payload)
    parts = [payload[n * i // 8 : n * (i + 1) // 8] for i in range(8)]
    return "".join(f"{sum(p) // max(1, len(p)):02x}" for p in parts)


def media_columns(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """A row for each row of ``docs`` with its payload's media columns, all from reading the store back.

    Null texts count as empty and get one row of bytes 255. Repeated rows and equal texts share one stored member and all
    values. Rows with a null key keep it. Extra columns are ignored.
    """
    at = fresh(docs.sparkSession, "media")
    rows = written(store(bounded(docs).select(F.col(key).alias("key"), text_bytes(text).alias("payload")), "key", "payload", at, width), "media-index")
    # the index alone holds one row for each digest
    unique = rows.select("digest", "shard", "offset", "length").dropDuplicates(["digest"])
    unique = unique.repartition("shard", F.floor(F.col("offset") / READ_BYTES)).sortWithinPartitions("shard", "offset")
    feats = read_features(header_columns(unique, at), at)
    return rows.select("key", "n_bytes", "digest").join(feats, "digest").withColumnRenamed("key", key)
