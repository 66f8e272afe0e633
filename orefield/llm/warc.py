"""WARC archives and the merge of their capture index.

Pages become WARC records, gzipped one by one, in archive files of bounded size in the shared folder. Of records with equal
payloads of at least `least` bytes the one with the largest page_id is the response and the others are revisits that refer to it
and carry no payload. The archives are then read back record by record; digests and lengths of responses come from the bytes read, those
of revisits from their record.

The index of captures is merged externally. Each archive file gives one run, sorted by (URL key, timestamp, page_id) when it is read.
Runs are range-partitioned by that key (ties by run), and each range merges its slices of all runs with a loser tree: log2(k) comparisons
a capture, in one pass over slices that stay in their runs' order. Tasks follow the bytes of the archives and the number of
captures, so neither grows: a range holds about RANGE_ROWS captures, without payloads, which is what a task keeps in memory.

Defined cases: null html is an empty payload; a null url has an empty key; rows with equal page_ids and equal large payloads are all
responses if that page_id is the largest; a null page_id counts as less than any, so such a row revisits the largest page_id of its payload, and where
a payload has only null page_ids all are responses; an empty table gives no rows and no archive; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, open_store, stage, table, utf8

FILE_BYTES = 64 << 20
#: Archive bytes that a task reads back, and captures that a task merges, at most about.
READ_BYTES, RANGE_ROWS = 256 << 20, 1 << 17
LEAST = 1000
EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)
FIRST, LAST = (int((datetime(*day, tzinfo=timezone.utc) - EPOCH).total_seconds()) for day in ((1, 1, 2), (9999, 12, 30)))


def url_key(url: str | None) -> str:
    """The URL in the order that indexes sort by: host labels from the last to the first, then path and query."""
    try:
        parts = urlsplit((url or "").strip())
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return (url or "").lower()
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/").lower() + (f"?{'&'.join(sorted(parts.query.lower().split('&')))}" if parts.query else "") if host else (url or "").lower()


def timestamp(page_id: int | None) -> str:
    """Pages carry no time of capture: one second a page_id, from a fixed day, up to the ends of the calendar; there page_id alone orders."""
    return (EPOCH + timedelta(seconds=min(LAST, max(FIRST, page_id or 0)))).isoformat()[:19] + "Z"


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {timestamp(page_id)}",
        *([f"WARC-Target-URI: {url.replace(chr(13), '%0D').replace(chr(10), '%0A')}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if refers_to is not None else []),
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes, int]:
    """A record's fields, its payload and the payload's length as the HTTP header has it."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    return fields, payload, stated


def number(urn: str) -> int | None:
    digits = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def with_kinds(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """pages with sha1 and refers_to. Only digests that several rows share meet in the join; a digest that many pages share is
    counted before the exchange, and the join's page side may be split wherever one is hot."""
    body = utf8(F.col("html"))
    digests = stage(pages.select("page_id", F.sha1(body).alias("sha1"), F.length(body).alias("n")).where(F.col("n") >= least).groupBy("sha1", "n").agg(F.max("page_id").alias("first"), F.count("*").alias("c")).where("c > 1").select("sha1", "first"), "warc-shared")
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.sha1(body).alias("sha1"))
    return rows.join(digests, "sha1", "left").select("page_id", "url", "html", "sha1", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"))


def write_archives(rows: DataFrame, folder: str | None = None, file_bytes: int = FILE_BYTES) -> tuple[DataFrame, str]:
    """Writes rows (page_id, url, html, sha1, refers_to); returns the staged list of files (file, records, bytes) and their folder.

    A file counts once its task is done; a task that is run again leaves files that the list does not name.
    """
    folder = folder or new_path(rows.sparkSession, "warc")
    fs, path = open_store(folder)
    fs.create_dir(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        done, out, name, n, size = [], None, "", 0, 0
        for batch in batches:
            for page_id, url, html, sha1, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name, n, size = f"pages-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                member = gzip.compress(record(page_id, url, html.encode(), sha1, refers_to), 4, mtime=0)
                out.write(member)
                n, size = n + 1, size + len(member)
                if size >= file_bytes:
                    out.close()
                    done.append((name, n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, n, size))
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["file", "records", "bytes"])

    return stage(rows.mapInArrow(run, "file string, records long, bytes long"), "warc-files"), folder


def members(file) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each gzip member, read in blocks."""
    held, at = b"", 0
    while True:
        unpack, parts, used = zlib.decompressobj(31), [], 0
        while not unpack.eof:
            if not held:
                held = file.read(1 << 20)
                if not held:
                    if used:
                        raise EOFError("an archive ends inside a record")
                    return
            parts.append(unpack.decompress(held))
            used += len(held) - len(unpack.unused_data)
            held = unpack.unused_data
        yield at, used, b"".join(parts)
        at += used


CAPTURE = [("run", pa.string()), ("seq", pa.int64()), ("url_key", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()), ("at", pa.int64()), ("length", pa.int64())]
CAPTURE_DDL = ", ".join(f"{n} {'string' if t == pa.string() else 'long'}" for n, t in CAPTURE)
SORT_KEY = ("url_key", "captured", "page_id")


def order_of(row: tuple) -> tuple:
    """The key of a capture; rows are in CAPTURE's order."""
    return row[2], row[3], row[4] is not None, row[4] or 0


def read_runs(files: DataFrame, folder: str, run_rows: int = 1 << 16) -> DataFrame:
    """Reads archives back; each yields runs of at most run_rows captures, each sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)

        def batch_of(rows: list[tuple], name: str, part: int) -> pa.RecordBatch:
            rows.sort(key=order_of)
            rows = [(f"{name}#{part}", k, *r[2:]) for k, r in enumerate(rows)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), CAPTURE, strict=True)], names=[n for n, _ in CAPTURE])

        for batch in batches:
            for name, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, part, n = [], 0, 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as file:
                    for at, length, raw in members(file):
                        fields, payload, stated = parse(raw)
                        digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        revisit = fields["WARC-Type"] == "revisit"
                        if not revisit and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != stated):
                            raise ValueError(f"{name} at {at}: the payload is not what its record says")
                        url = fields.get("WARC-Target-URI")
                        rows.append((None, None, url_key(url), fields["WARC-Date"], number(fields["WARC-Record-ID"]), stated, digest, fields["WARC-Type"], number(fields["WARC-Refers-To"]) if revisit else None, name, at, length))
                        n += 1
                        if len(rows) >= run_rows:
                            yield batch_of(rows, name, part)
                            rows, part = [], part + 1
                if n != expected:
                    raise ValueError(f"{name} has {n} records, not {expected}")
                if rows:
                    yield batch_of(rows, name, part)

    some = files.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()
    tasks = min(max(1, some.n), max(4 * files.sparkSession.sparkContext.defaultParallelism, -(-some.b // READ_BYTES)))
    return files.select("file", "records").repartition(tasks).mapInArrow(run, CAPTURE_DDL)


class LoserTree:
    """Merges sorted iterators: inner node i keeps the loser of its match, so a new head meets only the losers above it."""

    def __init__(self, sources: list[Iterator], key) -> None:
        self.sources, self.key = sources, key
        self.size = 1
        while self.size < max(1, len(sources)):
            self.size *= 2
        self.heads: list = [None] * self.size
        self.keys: list = [None] * self.size  # None: used up, loses to all
        for k in range(len(sources)):
            self.advance(k)
        self.losers = [0] * self.size
        self.winner = self.build(1)

    def advance(self, k: int) -> None:
        head = next(self.sources[k], None)
        self.heads[k], self.keys[k] = head, None if head is None else self.key(head)

    def beats(self, a: int, b: int) -> bool:
        """Ties go to the earlier run."""
        x, y = self.keys[a], self.keys[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        left, right = self.build(2 * node), self.build(2 * node + 1)
        won, lost = (left, right) if self.beats(left, right) or self.keys[right] is None else (right, left)
        self.losers[node] = lost
        return won

    def __iter__(self) -> Iterator:
        while self.keys[self.winner] is not None:
            k = self.winner
            yield self.heads[k]
            self.advance(k)
            node = (self.size + k) // 2
            while node >= 1:
                if self.beats(self.losers[node], k):
                    k, self.losers[node] = self.losers[node], k
                node //= 2
            self.winner = k


def merged(runs: DataFrame) -> DataFrame:
    """The captures of all staged runs in the order of (url_key, captured, page_id), over all partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[str, list[pa.RecordBatch]] = {}
        names = [n for n, _ in CAPTURE]
        for batch in batches:  # sorted by (run, seq): each run's slice comes whole and in order
            ids = batch.column(0).dictionary_encode()
            codes, start = ids.indices.to_pylist(), 0
            for k in range(1, len(codes) + 1):
                if k == len(codes) or codes[k] != codes[start]:
                    slices.setdefault(ids.dictionary[codes[start]].as_py(), []).append(batch.slice(start, k - start))
                    start = k

        def walk(parts: list[pa.RecordBatch]) -> Iterator[tuple]:
            for part in parts:
                for at in range(0, part.num_rows, 1024):
                    yield from zip(*(c.to_pylist() for c in part.slice(at, 1024).columns), strict=True)

        out: list[tuple] = []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), CAPTURE, strict=True)], names=names)

        for row in LoserTree([walk(parts) for parts in slices.values()], order_of):
            out.append(row)
            if len(out) == 8192:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    tasks = max(runs.sparkSession.sparkContext.defaultParallelism, -(-runs.count() // RANGE_ROWS))
    return runs.repartitionByRange(tasks, *SORT_KEY, "run", "seq").sortWithinPartitions("run", "seq").mapInArrow(run, CAPTURE_DDL)


def archive(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Writes pages as WARC, reads the archives back, and returns their captures in index order."""
    files, folder = write_archives(with_kinds(pages, least))
    return merged(stage(read_runs(files, folder), "warc-runs"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "captured")
