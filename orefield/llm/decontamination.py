"""Benchmark decontamination: every training shard gets an FM-index, in which the benchmark's phrases are searched backwards.

A phrase is a window of `width` consecutive words of a benchmark item, or all of a shorter item. A shard is a run of documents
with SHARD_WORDS words or one document. It is indexed once for all blocks of a group of the benchmark, which is all of it up to VOCABULARY words. The index covers what can hold a phrase: words that the group does not have
become one separator, and between separators only runs at least as long as the shortest phrase stay. That loses no place. All
phrases of a block are searched together, a symbol a step, by wavelet-matrix ranks; places come from sampled suffix positions; spans
of one document are merged by a running sum of starts and ends.

The benchmark is cut into blocks of bounded size on the executors. Tasks read them from the shared folder, hold BLOCKS_HELD of them and one group's words at most, and search each in the
same index; the driver sees their names. Documents are read where they lie, without an exchange, in one pass.

Defined cases: null text has no words; items without words match nothing; items of one id are one item, a null id being the empty one;
repeated rows get equal results; an empty table gives no rows; other columns are passed on where documents are returned.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import lean, new_path, open_store, stage, table
from .fmindex import FMIndex

WIDTH = 10
SHARD_WORDS = 1 << 19
BLOCK_BYTES, BLOCKS_HELD = 2 << 20, 4
VOCABULARY = 1 << 20
#: Bytes of a word stay, A-Z become lower case, all others become spaces.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


class Phrases:
    """One block of the benchmark: its words, and its distinct phrases by length, as rows of the words' numbers, with the items of each."""

    def __init__(self, items: list[tuple[str, list[bytes]]], width: int) -> None:
        ids: dict[bytes, int] = {}
        seen: dict[tuple[int, ...], set[str]] = {}
        for item, words in items:
            row = [ids.setdefault(w, len(ids)) for w in words]
            for k in range(max(1, len(row) - width + 1)) if row else ():
                seen.setdefault(tuple(row[k : k + width]), set()).add(item)
        self.words = list(ids)
        self.names = sorted({x for held in seen.values() for x in held})
        at = {x: k for k, x in enumerate(self.names)}
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in sorted({len(p) for p in seen}):
            own = [p for p in seen if len(p) == size]
            ends = np.cumsum([len(seen[p]) for p in own])
            self.by_length[size] = np.array(own, np.int32), np.concatenate([[0], ends]), np.array([at[x] for p in own for x in sorted(seen[p])], np.int32)


class Shard:
    """The index of a run of documents, in which the phrases of all blocks of a group are searched. ids: the group's words, numbered from 1."""

    def __init__(self, docs: list[list[bytes]], ids: dict[bytes, int], shortest: int) -> None:
        self.ids = ids
        self.sizes = np.array([len(d) for d in docs], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes + 1)])  # a 0 after each document
        self.marks = np.zeros(int(self.starts[-1]) + 1, np.int64)
        self.items: list[set[str]] = [set() for _ in docs]
        s = np.zeros(int(self.starts[-1]), np.int64)
        for d, at in zip(docs, self.starts[:-1], strict=True):
            s[at : at + len(d)] = np.fromiter((ids.get(w, 0) for w in d), np.int64, len(d))
        inside = np.concatenate([[0], (s > 0).astype(np.int8), [0]])
        begin, end = np.flatnonzero(np.diff(inside) == 1), np.flatnonzero(np.diff(inside) == -1)
        long = end - begin >= shortest
        begin, end = begin[long], end[long]
        self.index = None
        if begin.size:
            # the runs, each with the 0 that ends it: another word, or a document's end
            sizes = end - begin + 1
            self.origin = np.repeat(begin - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            self.index = FMIndex(s[self.origin], len(ids))

    def search(self, block: Phrases) -> None:
        """Marks the places of the block's phrases and notes their items."""
        if self.index is None:
            return
        number = np.fromiter((self.ids[w] for w in block.words), np.int64, len(block.words))
        for size, (patterns, edges, owners) in block.by_length.items():
            lo, hi = self.index.search(number[patterns])
            count = hi - lo
            if not count.any():
                continue
            phrase = np.repeat(np.arange(count.size), count)
            rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
            at = self.origin[self.index.locate(rows)]
            np.add.at(self.marks, at, 1)
            np.add.at(self.marks, at + size, -1)
            doc = np.searchsorted(self.starts, at, "right") - 1
            for d, p in np.unique(np.column_stack([doc, phrase]), axis=0).tolist():
                self.items[d].update(block.names[x] for x in owners[edges[p] : edges[p + 1]])

    def hits(self) -> list[np.ndarray]:
        """For each document which words are hit."""
        hit = np.cumsum(self.marks[:-1]) > 0
        return [hit[at : at + n] for at, n in zip(self.starts[:-1], self.sizes, strict=True)]


def phrase_blocks(benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> tuple[str, list[list[str]], int]:
    """Writes the benchmark's blocks, and the words of each, on the executors; returns their folder, their names in groups of up to VOCABULARY words, and the length of
    the shortest phrase."""
    folder = new_path(benchmark.sparkSession, "phrases")
    fs, path = open_store(folder)
    fs.create_dir(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        held, size = [], 0

        def put() -> Iterator[pa.RecordBatch]:
            block = Phrases(held, width)
            if block.by_length:
                name = uuid.uuid4().hex
                for end, body in (("", block), ("-words", block.words)):
                    with store.open_output_stream(f"{root}/{name}{end}") as out:
                        out.write(pickle.dumps(body))
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([min(block.by_length)], pa.int64()), pa.array([len(block.words)], pa.int64())], names=["name", "shortest", "words"])

        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append((item, words_of(text)))
                size += len(text or "")
                if size >= block_bytes:
                    yield from put()
                    held, size = [], 0
        if held:
            yield from put()

    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    blocks = stage(rows.mapInArrow(lean(run), "name string, shortest long, words long"), "phrase-blocks").orderBy("name").collect()  # one short row a block
    groups, words = [], 0
    for r in blocks:
        if not groups or words + r.words > VOCABULARY:
            groups.append([])
            words = 0
        groups[-1].append(r.name)
        words += r.words
    return folder, groups, min((r.shortest for r in blocks), default=0)


NEW = [("n_words", pa.int64(), "long"), ("n_hit", pa.int64(), "long"), ("n_items", pa.int64(), "long"), ("items_sha256", pa.string(), "string"), ("contaminated", pa.bool_(), "boolean"), ("hit_spans", pa.list_(pa.int64()), "array<long>")]


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256, contaminated and hit_spans (first and past-the-last word of each span, in
    turn); columns so named are replaced."""
    if width < 1:
        raise ValueError("width is at least 1")
    folder, groups, shortest = phrase_blocks(benchmark, width)
    kept = [c for c in docs.columns if c not in {n for n, _, _ in NEW}]
    at = kept.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded: dict[str, Phrases] = {}
        vocabulary: dict[int, dict[bytes, int]] = {}

        def read(name: str) -> Any:
            fs, path = open_store(folder)
            with fs.open_input_stream(f"{path}/{name}") as file:
                return pickle.loads(file.read())

        def block(name: str) -> Phrases:
            if name not in loaded:
                if len(loaded) == BLOCKS_HELD:
                    loaded.pop(next(iter(loaded)))
                loaded[name] = read(name)
            return loaded[name]

        def ids(group: int) -> dict[bytes, int]:
            if group not in vocabulary:
                vocabulary.clear()
                words = dict.fromkeys(w for name in groups[group] for w in read(f"{name}-words"))
                vocabulary[group] = dict(zip(words, range(1, len(words) + 1), strict=True))
            return vocabulary[group]

        def finish(batch: pa.RecordBatch, texts: list[list[bytes]]) -> pa.RecordBatch:
            hit, items = [np.zeros(len(t), bool) for t in texts], [set() for _ in texts]
            for group, names in enumerate(groups):
                shard = Shard(texts, ids(group), shortest)
                for name in names:
                    shard.search(block(name))
                hit = [a | b for a, b in zip(hit, shard.hits(), strict=True)]
                items = [a | b for a, b in zip(items, shard.items, strict=True)]
            n = [int(h.sum()) for h in hit]
            edges = [np.flatnonzero(np.diff(np.concatenate([[0], h.astype(np.int8), [0]]))).tolist() if c else [] for h, c in zip(hit, n, strict=True)]
            said = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
            columns = [[len(t) for t in texts], n, [len(x) for x in items], said, [c > 0 for c in n], edges]
            return pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, (_, t, _) in zip(columns, NEW, strict=True))], names=[*kept, *(n for n, _, _ in NEW)])

        for batch in batches:
            held, size, first = [], 0, 0
            for row in range(batch.num_rows + 1):
                if row == batch.num_rows or size >= SHARD_WORDS:
                    if held:
                        yield finish(batch.slice(first, len(held)), held)
                    held, size, first = [], 0, row
                if row < batch.num_rows:
                    held.append(words_of(batch.column(at)[row].as_py()))
                    size += len(held[-1])

    new = StructType.fromDDL(", ".join(f"{name} {kind}" for name, _, kind in NEW))
    return docs.select(*kept).mapInArrow(lean(run), StructType([*docs.select(*kept).schema.fields, *new.fields]))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
