"""Substring dedup: remove the words of every passage that stands anywhere else, judged by windows of `width` words.

Pass 1 sketches. A window is estimated by its anchor, the least hash among its runs of `gram` words: equal windows have equal anchors,
so a window stands at most as often as its anchor. A task gathers the distinct anchors that it picks, with a flag for those that it picks twice, and deals them out by
slices of the hash. A slice merges what all tasks send into its DEPTH rows of count-min cells, and sends back to each task those of its anchors whose cells count two or more in every row.
So a slice holds its own part of the sketch, a task the anchors of its own text, and both stay as large as they are when the corpus grows.
Pass 2 counts exactly. Windows whose anchor may repeat are grouped by 96 bits of hash. A task first settles what it holds
twice, and sends one entry of a window to the window's bucket; after OFTEN shards of a task that have sent it, which is enough to know, the others only note its places. So a window, however common, has no more than
OFTEN entries a task (TASK_WINDOWS bounds the memory for that: windows beyond it are sent by every shard, and lost never). Buckets send back the places of repeated windows. Documents without candidates are done in pass 2; only the
others meet their places again, by row id, and are cut. Both passes must see the documents dealt alike, as files are; a sum over the words of each
task's part is compared, and a difference is an error.

Defined cases: null text has no words; texts of under `width` words lose nothing; repeated rows lose whatever is in a whole window; windows
that overlap their own copy in one document count as repeated; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, new_path, open_store, stage, table

WIDTH, GRAM = 35, 18
SHARD_WORDS = 1 << 19
#: Sketch cells a byte of text and row (about 32 an anchor; only those that are counted take memory), text bytes a slice, and anchors that a task gathers before it deals them out.
DEPTH, CELLS_PER_BYTE, SLICE_BYTES, GATHERED = 2, 0.56, 32 << 20, 1 << 21
#: Windows that a task remembers, and how often it sends one.
TASK_WINDOWS, OFTEN = 1 << 21, 4
BUCKET_BYTES = 2 << 20
PLACES_PER_TASK = 1 << 19
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)

_hashes: dict[bytes, int] = {}


def word_hash(word: bytes) -> int:
    found = _hashes.get(word)
    if found is None:
        if len(_hashes) > 200_000:
            _hashes.clear()
        found = _hashes[word] = xxhash.xxh3_64_intdigest(word)
    return found


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def rolling(h: np.ndarray, length: int, base: int) -> np.ndarray:
    """Hashes of the runs of `length` words that begin at each place, modulo 2**64, from running sums of h * base**i."""
    n = h.size
    if n < length:
        return np.zeros(0, np.uint64)
    power, back = powers(base, n), powers(pow(base, -1, 1 << 64), n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(h * power)])
    out = (sums[length:] - sums[:-length]) * back[: n - length + 1]
    return out ^ (out >> np.uint64(31))


def sliding(x: np.ndarray, size: int, best) -> np.ndarray:
    """best (minimum or maximum) over x[i : i + size], for every i where that is whole, by doubling."""
    span = 1
    while span * 2 <= size:
        x = best(x[:-span], x[span:])
        span *= 2
    return best(x[: x.size - (size - span)], x[size - span :]) if size > span else x


class Shard:
    """Words of some documents, one after another, and their windows."""

    def __init__(self, docs: list[list[bytes]], width: int, gram: int) -> None:
        self.sizes = np.array([len(d) for d in docs], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.h = np.fromiter((word_hash(w) for d in docs for w in d), np.uint64, int(self.starts[-1]))
        self.width, self.gram, n = width, gram, self.h.size
        left = np.repeat(self.starts[1:], self.sizes) - np.arange(n)  # words to the document's end
        self.whole = left[: max(0, n - width + 1)] >= width
        if n >= width:
            grams = rolling(self.h, gram, BASES[0])
            grams[left[: grams.size] < gram] = FULL
            self.grams, self.anchors = grams, sliding(grams, width - gram + 1, np.minimum)
        else:
            self.grams = self.anchors = np.zeros(0, np.uint64)

    def picked(self) -> np.ndarray:
        """Hashes of the runs that are the anchor of some window, once for each place."""
        if not self.whole.any():
            return np.zeros(0, np.uint64)
        reach = self.width - self.gram
        padded = np.concatenate([np.zeros(reach, np.uint64), np.where(self.whole, self.anchors, np.uint64(0)), np.zeros(reach, np.uint64)])
        return self.grams[sliding(padded, reach + 1, np.maximum) == self.grams]

    def windows(self, at: np.ndarray) -> np.ndarray:
        """Hashes of the windows at these places, as pairs of 64 bits."""
        return np.column_stack([rolling(self.h, self.width, b)[at] for b in BASES]) if at.size else np.zeros((0, 2), np.uint64)


def cells(anchors: np.ndarray, row: int, width: int) -> np.ndarray:
    """The anchors' cells in a row of `width` cells."""
    return ((anchors ^ (anchors >> np.uint64(29))) * MIX[row] >> np.uint64(32)) * np.uint64(width) >> np.uint64(32)


def shards_of(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    for batch in batches:
        held, size, first = [], 0, 0
        for row in range(batch.num_rows):
            held.append((batch.column(column)[row].as_py() or "").encode().split())
            size += len(held[-1])
            if size >= SHARD_WORDS or row + 1 == batch.num_rows:
                yield batch.slice(first, len(held)), held
                held, size, first = [], 0, row + 1


ODD = np.uint64(1)


def gathered(parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Distinct anchors (even numbers) of (anchors, whether picked twice) lists, each plus 1 where it is picked twice."""
    anchors, inverse, n = np.unique(np.concatenate([a for a, _ in parts]), return_inverse=True, return_counts=True)
    return anchors | ((n > 1) | (np.bincount(inverse, np.concatenate([t for _, t in parts]), anchors.size) > 0)).astype(np.uint64)


def estimated(codes: np.ndarray, cells_a_row: int) -> np.ndarray:
    """Which of these anchors, one entry a task, count two or more in all rows of the sketch that they make."""
    out = np.ones(codes.size, bool)
    for row in range(DEPTH):
        _, cell = np.unique(cells(codes & ~ODD, row, cells_a_row), return_inverse=True)
        out &= (np.bincount(cell, 1.0 + (codes & ODD)) >= 2)[cell]
    return out


def sketched(docs: DataFrame, cells_a_row: int, slices: int, width: int, gram: int) -> str:
    """Writes, by the partition p of docs, the anchors that may repeat, and the sum of the partition's words; returns the folder."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, held, size, total = TaskContext.get().partitionId(), [], 0, np.uint64(0)

        def rows(part: list[int], packed: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([p] * len(part), pa.int64()), pa.array(packed, pa.binary())], names=["part", "p", "codes"])

        def put() -> pa.RecordBatch:
            codes = gathered(held)
            part, _, packed = packed_by((codes >> ODD) % np.uint64(slices), codes, np.ndarray.tobytes)
            return rows(part.astype(np.int64).tolist(), packed)

        for _, texts in shards_of(batches, 0):
            shard = Shard(texts, width, gram)
            total += shard.h.sum(dtype=np.uint64)
            picked, n = np.unique(shard.picked() & ~ODD, return_counts=True)
            if picked.size:
                held.append((picked, n > 1))
                size += picked.size
            if size >= GATHERED:
                yield put()
                held, size = [], 0
        if held:
            yield put()
        yield rows([-1 - p % 1024], [total.tobytes()])  # no slice: passed on

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, owners, packs = None, [], []

        def done() -> pa.RecordBatch:
            if now < 0:
                return pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), pa.array([True] * len(owners)), pa.array(packs, pa.binary())], names=["p", "is_sum", "body"])
            codes = [np.frombuffer(x, np.uint64) for x in packs]
            edges = np.cumsum([0] + [c.size for c in codes])
            every = np.concatenate(codes)
            keep = estimated(every, cells_a_row)
            back = [(p, (every[x:y][keep[x:y]] & ~ODD).tobytes()) for p, x, y in zip(owners, edges, edges[1:], strict=False) if keep[x:y].any()]
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in back], pa.int64()), pa.array([False] * len(back), pa.bool_()), pa.array([x for _, x in back], pa.binary())], names=["p", "is_sum", "body"])

        for batch in batches:
            for part, p, codes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now:
                    if now is not None:
                        yield done()
                    now, owners, packs = part, [], []
                owners.append(p)
                packs.append(codes)
        if now is not None:
            yield done()

    path = new_path(docs.sparkSession, "anchors")
    dealt = docs.select("text").mapInArrow(lean(count), "part long, p long, codes binary").repartition("part").sortWithinPartitions("part")
    dealt.mapInArrow(lean(answer), "p long, is_sum boolean, body binary").repartition("p").write.partitionBy("p").parquet(path)
    return path


def answers(path: str, p: int) -> tuple[np.ndarray, np.uint64]:
    """The sorted anchors that may repeat of partition p, and the sum of its words."""
    import pyarrow.parquet as pq
    from pyarrow import fs as files

    store, root = open_store(path)
    found, total = [], np.uint64(0)
    for info in store.get_file_info(files.FileSelector(f"{root}/p={p}", allow_not_found=True)):
        if info.is_file and info.base_name.endswith(".parquet") and info.base_name[0] not in "._":
            with store.open_input_file(info.path) as file:
                got = pq.read_table(file, columns=["is_sum", "body"])
            for is_sum, body in zip(got["is_sum"].to_pylist(), got["body"].to_pylist(), strict=True):
                if is_sum:
                    total += np.frombuffer(body, np.uint64)[0]
                else:
                    found.append(np.frombuffer(body, np.uint64))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64), total


def among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of x stand in a sorted array."""
    if not known.size:
        return np.zeros(x.size, bool)
    return known[np.minimum(np.searchsorted(known, x), known.size - 1)] == x


class Windows:
    """The windows that a task has met, up to `most`, and how often it has sent each."""

    def __init__(self, most: int) -> None:
        self.most, self.a, self.b, self.sent = most, np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint8)

    def met(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of each window here, or -1."""
        if not self.a.size:
            return np.full(a.size, -1)
        at = np.minimum(np.searchsorted(self.a, a), self.a.size - 1)
        return np.where((self.a[at] == a) & (self.b[at] == b), at, -1)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if self.a.size < self.most:
            order = np.argsort(np.concatenate([self.a, a]), kind="stable")
            self.a, self.b, self.sent = (np.concatenate(x)[order] for x in ((self.a, a), (self.b, b), (self.sent, np.ones(a.size, np.uint8))))


NONE = -1
#: A window in a bucket: 96 bits of its hash, and its place (row id and word).
ENTRY = np.dtype([("a", "<u8"), ("b", "<u4"), ("rid", "<i8"), ("at", "<u4")])
PLACE = np.dtype([("rid", "<i8"), ("at", "<u4")])


def in_columns(rows: np.ndarray) -> bytes:
    """Structured rows, one field after another: row ids and places in order then compress well."""
    return b"".join(rows[f].tobytes() for f in rows.dtype.names)


def from_columns(packs: list[bytes], kind: np.dtype) -> np.ndarray:
    sizes = [len(p) // kind.itemsize for p in packs]
    out, at = np.empty(sum(sizes), kind), 0
    for pack, n in zip(packs, sizes, strict=True):
        done = 0
        for f in kind.names:
            out[f][at : at + n] = np.frombuffer(pack, kind[f], n, done)
            done += n * kind[f].itemsize
        at += n
    return out


def packed_by(key: np.ndarray, rows: np.ndarray, pack=in_columns) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The distinct keys, how many rows each has, and those rows packed."""
    order = np.argsort(key, kind="stable")
    rows, key = rows[order], key[order]
    edges = np.append(np.flatnonzero(np.diff(key, prepend=key[0] - 1)), key.size) if key.size else np.zeros(1, np.int64)
    return key[edges[:-1]], np.diff(edges), [pack(rows[x:y]) for x, y in zip(edges, edges[1:], strict=False)]


def looked_up(docs: DataFrame, sketch: str, buckets: int, width: int, gram: int) -> DataFrame:
    """Staged rows of two kinds: documents (bucket null; sha256 where done, else text and the places known repeated), and
    bucket entries (n windows: hashes and place, row id and word packed; NONE for windows known repeated)."""
    kind = docs.schema["doc_id"].dataType
    names = ["rid", "doc_id", "n_words", "kept_sha256", "text", "known", "bucket", "n", "entries"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, total, windows = TaskContext.get().partitionId(), np.uint64(0), Windows(TASK_WINDOWS)
        (seen, expected), rid = answers(sketch, p), p << 32
        for batch, held in shards_of(batches, 1):
            shard = Shard(held, width, gram)
            total += shard.h.sum(dtype=np.uint64)
            at = np.flatnonzero(shard.whole)
            at = at[among(shard.anchors[at] & ~ODD, seen)]
            hashes = shard.windows(at)
            e = np.empty(at.size, ENTRY)
            e["a"], e["b"], e["at"] = hashes[:, 0], hashes[:, 1] >> np.uint64(32), at
            e = e[np.lexsort((e["b"], e["a"]))]
            first = np.ones(at.size, bool)
            first[1:] = (e["a"][1:] != e["a"][:-1]) | (e["b"][1:] != e["b"][:-1])
            alone = first & np.append(first[1:], True)[: at.size]
            place = windows.met(e["a"][first], e["b"][first])
            often = np.zeros(place.size, bool)
            often[place >= 0] = windows.sent[place[place >= 0]] >= OFTEN
            windows.sent[place[(place >= 0) & ~often]] += 1
            before = often[np.cumsum(first) - 1]
            doc = np.searchsorted(shard.starts, e["at"], "right") - 1
            known = [b""] * len(held)
            twice = np.sort(e["at"][~alone | before])
            owner = np.searchsorted(shard.starts, twice, "right") - 1
            for d in np.unique(owner):
                known[d] = (twice[owner == d] - shard.starts[d]).astype(np.uint32).tobytes()
            open_docs = np.zeros(len(held), bool)
            open_docs[doc] = True
            e["rid"], e["at"] = np.where(alone & ~before, rid + doc, NONE), e["at"] - shard.starts[doc]
            new = first.copy()
            new[first] = place < 0
            windows.add(e["a"][new], e["b"][new])
            e = e[first & ~before]
            e = e[np.lexsort((e["at"], e["rid"]))]
            bucket, sizes, packed = packed_by((e["a"] % np.uint64(buckets)).astype(np.int64), e)
            none, m = [None] * len(held), len(packed)
            body = batch.column(1)
            columns = [
                pa.array([rid + k for k in range(len(held))] + [None] * m, pa.int64()), pa.concat_arrays([batch.column(0), pa.nulls(m, batch.column(0).type)]),
                pa.array(shard.sizes.tolist() + [None] * m, pa.int64()), pa.array([None if o else hashlib.sha256(b" ".join(w)).hexdigest() for o, w in zip(open_docs, held, strict=True)] + [None] * m, pa.string()),
                pa.array([x.as_py() if o else None for o, x in zip(open_docs, body, strict=True)] + [None] * m, pa.string()), pa.array(known + [None] * m, pa.binary()),
                pa.array(none + bucket.tolist(), pa.int64()), pa.array(none + sizes.tolist(), pa.int64()), pa.array(none + packed, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            rid += len(held)
        if total != expected:
            raise RuntimeError("the documents came dealt in another way than in the first pass: write them out first")

    return stage(docs.select("doc_id", "text").mapInArrow(lean(run), f"rid long, doc_id {kind.simpleString()}, n_words long, kept_sha256 string, text string, known binary, bucket long, n long, entries binary"), "windows")


def repeated(rows: DataFrame) -> DataFrame:
    """rid, places (packed) of the windows that stand elsewhere too, one row a document; rows: bucket and entries.

    Buckets deal their places out by row id in packs, so what moves follows the places, not documents times buckets.
    """
    tasks = int(max(1, -(-(rows.agg(F.sum("n")).first()[0] or 0) // PLACES_PER_TASK)))

    def joined(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> np.ndarray:
        return from_columns([x for batch in batches for x in batch.column(0).to_pylist()], kind)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = joined(batches, ENTRY)
        e = e[np.lexsort((e["b"], e["a"]))]
        new = np.ones(e.size, bool)
        new[1:] = (e["a"][1:] != e["a"][:-1]) | (e["b"][1:] != e["b"][:-1])
        group = np.cumsum(new) - 1
        more = (np.bincount(group) > 1) | (np.bincount(group, e["rid"] == NONE) > 0)
        e = e[more[group] & (e["rid"] != NONE)]
        places = np.empty(e.size, PLACE)
        places["rid"], places["at"] = e["rid"], e["at"]
        places = places[np.lexsort((places["at"], places["rid"]))]
        part, _, packed = packed_by((places["rid"].astype(np.uint64) * MIX[0] >> np.uint64(32)).astype(np.int64) % tasks, places)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(packed, pa.binary())], names=["part", "places"])

    def regroup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rids, _, packed = packed_by((p := joined(batches, PLACE))["rid"], np.ascontiguousarray(p["at"]), np.ndarray.tobytes)
        for at in range(0, len(packed), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(rids[at : at + 4096], pa.int64()), pa.array(packed[at : at + 4096], pa.binary())], names=["rid", "places"])

    met = rows.repartition(tasks, "bucket").select("entries").mapInArrow(lean(meet), "part long, places binary")
    return met.repartition(tasks, "part").select("places").mapInArrow(lean(regroup), "rid long, places binary")


def removed(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, sketch_cells: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 and kept_text (null where all is kept)."""
    if not 0 < gram <= width:
        raise ValueError("gram is at least 1 and at most width")
    docs = docs.select("doc_id", "text")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    slices = 1 if sketch_cells else max(1, -(-size // SLICE_BYTES))
    cells_a_row = sketch_cells or max(1 << 16, int(size * CELLS_PER_BYTE / slices))
    buckets = 1 << max(6, (size // BUCKET_BYTES).bit_length())
    rows = looked_up(docs, sketched(docs, cells_a_row, slices, width, gram), buckets, width, gram)
    places = repeated(rows.where("bucket is not null").select("bucket", "n", "entries"))
    todo = rows.where("bucket is null and text is not null").select("rid", "doc_id", "n_words", "text", "known").join(places, "rid", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sha, kept_text = [], [], []
            for text, known, more in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                words = text.encode().split()
                at = np.frombuffer(known + (more or b""), np.uint32).astype(np.int64)
                marks = np.zeros(len(words) + 1, np.int64)
                np.add.at(marks, at, 1)
                np.add.at(marks, at + width, -1)
                gone = np.cumsum(marks[:-1]) > 0
                kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
                n.append(int(gone.sum()))
                sha.append(hashlib.sha256(kept).hexdigest())
                kept_text.append(kept.decode() if n[-1] else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(kept_text, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    cuts = todo.select("doc_id", "n_words", "text", "known", "places").mapInArrow(lean(cut), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept_text string")
    done = rows.where("bucket is null and text is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", F.lit(None).cast("string").alias("kept_text"))
    return done.unionByName(cuts)


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
