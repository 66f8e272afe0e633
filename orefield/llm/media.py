"""Media columns: content-addressed payloads in tar shards.

A payload is stored losslessly as an 8-bit grey image, 64 samples a line (PNG: deflated, checksummed). Tasks append images to
tar shards in the shared folder; a member's name is the digest of its image. Each payload is stored once: texts whose digest several rows share
meet, one a task and digest, before they are stored (a bitmap of fixed size tells them from the others, which are stored where they
lie). Rows carry only shard, offset, length and digest. They are written out before anything reads the shards, so a
retried task leaves a shard that no row names, never a row without its bytes. Metadata columns come from range reads of
the first 33 bytes of a member; samples are read by a second range read where they are asked for, each member once, in the order of the shards,
by as many tasks as its bytes ask for.

Defined cases: null and empty text give one line of 64 zero bytes; equal texts give equal values; very long texts are split into
several image chunks; an empty table gives no rows; other columns are not read.
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
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import maybe_in, new_path, open_store, stage, table, unstage, utf8

LINE = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Bytes before the image data: signature and the header chunk.
HEADER = 33
CHUNK = 1 << 28
SHARD_BYTES = 64 << 20
#: Stored bytes that a task reads back, at most about.
READ_BYTES = 64 << 20


def padded(body: bytes) -> bytes:
    return body + bytes(-len(body) % LINE or (0 if body else LINE))


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(payload: bytes) -> bytes:
    """A grey PNG whose samples are the payload's bytes."""
    lines = np.zeros((len(payload) // LINE, LINE + 1), np.uint8)  # each line begins with filter 0
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, LINE)
    packed = zlib.compress(lines.tobytes(), 4)
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", LINE, lines.shape[0], 8, 0, 0, 0, 0))
    return SIGNATURE + head + b"".join(chunk(b"IDAT", packed[k : k + CHUNK]) for k in range(0, len(packed), CHUNK)) + chunk(b"IEND", b"")


def header(start: bytes) -> tuple[int, int, int]:
    """Width, height and bits a sample, from a member's first bytes."""
    if start[:8] != SIGNATURE or start[12:16] != b"IHDR":
        raise ValueError("not an image of this store")
    return struct.unpack(">IIB", start[16:25])


def decode(image: bytes) -> bytes:
    width, height, _ = header(image)
    at, packed = 8, []
    while at < len(image):
        (size,) = struct.unpack_from(">I", image, at)
        kind, data = image[at + 4 : at + 8], image[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", image, at + 8 + size)[0] != zlib.crc32(kind + data):
            raise ValueError("an image chunk is damaged")
        if kind == b"IDAT":
            packed.append(data)
        at += 12 + size
    return np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples, and the share that differs from the next one."""
    x = np.frombuffer(payload, np.uint8)
    p = np.bincount(x, minlength=256)
    p = p[p > 0] / x.size
    return f"mean={x.mean():.6f};std={x.std():.6f};entropy={-(p * np.log2(p)).sum():.6f};change={(x[1:] != x[:-1]).mean():.6f}"


class Shards:
    """Appends members to tar files of bounded size."""

    def __init__(self, folder: str, most: int) -> None:
        self.fs, self.folder = open_store(folder)
        self.most, self.out, self.at = most, None, 0

    def put(self, image: bytes) -> tuple[str, int, int, str]:
        """Shard, offset and length of the image, and its digest."""
        digest = hashlib.sha256(image).hexdigest()
        if self.out is not None and self.at > self.most:
            self.close()
        if self.out is None:
            self.name, self.at = f"media-{uuid.uuid4().hex}.tar", 0
            self.out = self.fs.open_output_stream(f"{self.folder}/{self.name}")
        info = tarfile.TarInfo(f"{digest}.png")
        info.size = len(image)
        head = info.tobuf(tarfile.GNU_FORMAT)
        at = self.at + len(head)
        body = head + image + bytes(-len(image) % tarfile.BLOCKSIZE)
        self.out.write(body)
        self.at += len(body)
        return self.name, at, len(image), digest

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(2 * tarfile.BLOCKSIZE))
            self.out.close()
            self.out = None


def stored(docs: DataFrame, folder: str | None = None, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, str]:
    """Writes the texts of docs; returns the staged rows (doc_id, n_bytes, shard, at, length, digest) and the folder of the shards."""
    folder = folder or new_path(docs.sparkSession, "media")
    fs, path = open_store(folder)
    fs.create_dir(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = Shards(folder, shard_bytes)
        for batch in batches:
            got = [shards.put(encode(padded((text.as_py() or "").encode()))) for text in batch.column(1)]
            columns = list(zip(*got, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True))], names=["key", "shard", "at", "length", "digest"])
        shards.close()

    body = utf8(F.col("text"))
    key = F.unhex(F.sha2(body, 256)).alias("key")
    keys = stage(docs.select("doc_id", F.length(body).cast("long").alias("n_bytes"), key), "media-keys")
    shared = stage(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.xxhash64("key").alias("k")), "media-shared")
    rows = maybe_in(docs.select("text", key).withColumn("k", F.xxhash64("key")), shared, "k")
    once = rows.where("_maybe").groupBy("key").agg(F.first("text").alias("text"))
    places = stage(rows.where("not _maybe").select("key", "text").unionByName(once).mapInArrow(run, "key binary, shard string, at long, length long, digest string"), "media-places")
    out = stage(keys.join(places, "key").select("doc_id", "n_bytes", "shard", "at", "length", "digest"), "media-rows")
    unstage(keys, shared, places)
    return out, folder


def read_back(rows: DataFrame, folder: str, samples: bool = True) -> DataFrame:
    """rows with width, height, bits by range reads of headers; with samples also what their bytes give."""
    names = ["width", "height", "bits"] + ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] * samples
    kinds = ["int", "long", "int"] + ["long", "string", "long", "long", "string", "string"] * samples
    types = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_store(folder)
        name, file = None, None
        for batch in batches:
            out = []
            for shard, at, length, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != name:
                    name, file = shard, fs.open_input_file(f"{path}/{shard}")
                found = header(file.read_at(HEADER, at))
                if samples:
                    image = file.read_at(length, at)
                    if (sha := hashlib.sha256(image).hexdigest()) != digest:
                        raise ValueError(f"{shard} at {at} is not {digest}")
                    payload = decode(image)
                    found += (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-LINE:]), len(image), sha, feature(payload))
                out.append(found)
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, types[k]) for c, k in zip(columns, kinds, strict=True))], names=["shard", "at", *names])

    members = stage(rows.select("shard", "at", "length", "digest").distinct(), "media-members")
    whole = members.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-whole // READ_BYTES))
    dealt = members.repartitionByRange(int(tasks), "shard", "at").sortWithinPartitions("shard", "at")
    read = dealt.mapInArrow(run, ", ".join(["shard string, at long", *map(" ".join, zip(names, kinds))]))
    return rows.join(read, ["shard", "at"]).select(*rows.columns, *names)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, folder = stored(table(spark, sf_dir, "documents"))
    return read_back(rows, folder).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "bits")
