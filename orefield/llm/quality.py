"""Quality classifier: a factorisation machine over hashed words, structure statistics and text metadata.

A document's features are its distinct words, hashed into buckets and weighted alike so that their squares sum to one, and statistics of
its structure and size, each in one of BINS bins by the training rows' quantiles. The machine adds a bias, a weight for each
feature, and for each pair of features the product of their vectors; with s = sum of v*x and q = sum of (v*x)^2 over the
features, the pairs sum to (s*s - q)/2, so scoring is linear in the number of features. Rows are scored where they lie,
in one pass without an exchange.

It is fitted on the driver with a sample of labelled rows, `most` of them if there are more (a documented bound; chosen by hashes, so give or take a few hundredths), never on
rows held out: those whose crc32(doc_id as text) leaves 1 when divided by 3. Labels are bounded first (by doc_id), then the distinct (doc_id, text) that they join with, so an id that many
documents share teaches no more than its part. Labels, lang, source and doc_id are not features.

Defined cases: null text is empty text, which has a score as any, and so have very long texts, read whole; documents of one doc_id are scored each by its text; rows of labels without doc_id or quality teach nothing; with
labels of one class only, or none, every score is the share of label 1 with one added to either class; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, stage, table, unstage

BUCKETS, FACTORS, BINS = 1 << 16, 8, 16
MOST_LABELLED = 8000
SYMBOLS = b"#$%&*@^~<>{}[]\\_=+"
N_STATS = 16
#: Features scored together; bounds the memory of a batch.
CHUNK = 150_000
BATCH_ROWS = 500

_bucket: dict[str, int] = {}


def bucket_of(word: str) -> int:
    found = _bucket.get(word)
    if found is None:
        if len(_bucket) > 100_000:
            _bucket.clear()
        found = _bucket[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS
    return found


def features(text: str) -> tuple[np.ndarray, list[float]]:
    """The buckets of the text's distinct words, and its statistics."""
    words = text.split()
    held = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    body = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    seen = np.bincount(body, minlength=256)
    n, m, b = max(1, len(words)), max(1, len(lines)), max(1, body.size)
    stats = [
        np.log1p(len(words)), len(text) / n, len(held) / n, seen[65:91].sum() / b, seen[48:58].sum() / b, seen[33] / n, seen[124] / n,
        seen[np.frombuffer(SYMBOLS, np.uint8)].sum() / n, (seen[44] + seen[46] + seen[58] + seen[59]) / n, np.log1p(len(lines)), 1 - len(set(lines)) / m, len(words) / m,
        seen[128:].sum() / b, max(held.values(), default=0) / n, seen[97:123].sum() / b, (seen[34] + seen[39] + seen[40] + seen[41] + seen[63]) / n,
    ]
    return np.fromiter({bucket_of(w) for w in held}, np.int64), stats


@dataclass
class Machine:
    edges: np.ndarray  # N_STATS x (BINS - 1)
    bias: float
    w: np.ndarray
    v: np.ndarray

    @staticmethod
    def columns(words: list[np.ndarray], stats: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature ids and values of all rows, one after another, and where each row begins."""
        bins = np.stack([BUCKETS + k * BINS + np.searchsorted(edges[k], stats[:, k], "right") for k in range(N_STATS)], axis=1)
        sizes = np.array([x.size + N_STATS for x in words])
        ids = np.concatenate([part for x, y in zip(words, bins, strict=True) for part in (y, x)])
        values = np.concatenate([part for x in words for part in (np.ones(N_STATS), np.full(x.size, 1 / np.sqrt(max(1, x.size))))])
        return ids, values, np.concatenate([[0], np.cumsum(sizes)[:-1]])

    def raw(self, ids: np.ndarray, values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        vx = self.v[ids] * values[:, None]
        s = np.add.reduceat(vx, starts)
        q = np.add.reduceat(vx * vx, starts)
        return self.bias + np.add.reduceat(self.w[ids] * values, starts) + 0.5 * (s * s - q).sum(axis=1), vx, s

    def scores(self, words: list[np.ndarray], stats: np.ndarray) -> np.ndarray:
        out, k = np.empty(len(words)), 0
        while k < len(words):
            last, size = k, 0
            while last < len(words) and (size == 0 or size + words[last].size <= CHUNK):
                size += words[last].size + N_STATS
                last += 1
            z = self.raw(*self.columns(words[k:last], stats[k:last], self.edges))[0]
            out[k:last] = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            k = last
        return out


def fit(words: list[np.ndarray], stats: np.ndarray, labels: np.ndarray, rounds: int = 12, rate: float = 0.08, decay: float = 2e-4, seed: int = 5) -> Machine:
    """Logistic loss, both classes weighing the same; per-feature step sizes (AdaGrad) on batches in a fixed random order."""
    rng = np.random.default_rng(seed)
    n = labels.size
    ones = int(labels.sum())
    size = BUCKETS + N_STATS * BINS
    edges = np.stack([np.quantile(stats[:, k], np.arange(1, BINS) / BINS) for k in range(N_STATS)]) if n else np.zeros((N_STATS, BINS - 1))
    if not 0 < ones < n:
        return Machine(edges, float(np.log((ones + 1) / (n - ones + 1))), np.zeros(size), np.zeros((size, FACTORS)))
    m = Machine(edges, 0.0, np.zeros(size), rng.normal(0, 0.02, (size, FACTORS)))
    weight = np.where(labels == 1, n / (2 * ones), n / (2 * (n - ones)))
    gw, gv, gb = np.full(size, 1e-6), np.full((size, FACTORS), 1e-6), 1e-6
    for _ in range(rounds):
        order = rng.permutation(n)
        for at in range(0, n, 64):
            rows = order[at : at + 64]
            ids, values, starts = Machine.columns([words[r] for r in rows], stats[rows], edges)
            z, vx, s = m.raw(ids, values, starts)
            d = weight[rows] * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[rows]) / rows.size
            owner = np.repeat(np.arange(rows.size), np.diff(np.append(starts, ids.size)))
            used, inverse = np.unique(ids, return_inverse=True)
            dx = d[owner] * values
            step_w = np.bincount(inverse, dx, used.size) + decay * m.w[used]
            each = dx[:, None] * (s[owner] - vx)
            step_v = np.stack([np.bincount(inverse, each[:, f], used.size) for f in range(FACTORS)], axis=1) + decay * m.v[used]
            gw[used] += step_w**2
            gv[used] += step_v**2
            gb += d.sum() ** 2
            m.w[used] -= rate * step_w / np.sqrt(gw[used])
            m.v[used] -= rate / 4 * step_v / np.sqrt(gv[used])
            m.bias -= rate * d.sum() / np.sqrt(gb)
    return m


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def learned(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST_LABELLED) -> Machine:
    """Fits a machine on at most `most` labelled rows that are not held out."""
    rows = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.max("y").alias("y"))
    share = most / max(most, rows.count())
    rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) < int(share * (1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [features(t or "") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([w.tolist() for w, _ in got], pa.list_(pa.int32())), pa.array([[float(x) for x in s] for _, s in got], pa.list_(pa.float64())), batch.column(1).cast(pa.int32())], names=["words", "stats", "y"])

    # `rows` follows `most`, whatever the size of labels, so its broadcast is bounded
    known = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).join(F.broadcast(rows), "doc_id")
    known_ = stage(known.dropDuplicates(["doc_id", "h"]), "quality-known")
    share = most / max(most, known_.count())
    known = known_.where(F.pmod(F.xxhash64("doc_id", "h", F.lit(8)), F.lit(1 << 30)) < int(share * (1 << 30)))
    got = known.sortWithinPartitions("doc_id", "h").select("text", "y").mapInArrow(lean(run), "words array<int>, stats array<double>, y int").toArrow()
    unstage(known_)
    words = [np.sort(np.array(x, np.int64)) for x in got["words"].to_pylist()]
    stats = np.array(got["stats"].to_pylist(), np.float64).reshape(len(words), N_STATS)
    y = np.array(got["y"].to_pylist(), np.float64)
    order = np.lexsort((y, *stats.T)) if len(words) else np.arange(0)  # the same machine whatever the order of arrival
    return fit([words[k] for k in order], stats[order], y[order])


def scored(docs: DataFrame, machine: Machine, name: str = "score") -> DataFrame:
    """docs with the column `name`, in 0..1; a column so named is replaced."""
    kept = [c for c in docs.columns if c != name]
    small = Machine(machine.edges, machine.bias, machine.w.astype(np.float32), machine.v.astype(np.float32))
    shared = docs.sparkSession.sparkContext.broadcast(small)  # its size is fixed by BUCKETS and FACTORS
    at = kept.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for k in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(k, BATCH_ROWS)
                got = [features(t or "") for t in batch.column(at).to_pylist()]
                s = m.scores([np.sort(w) for w, _ in got], np.array([x for _, x in got], np.float64))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], names=[*kept, name])

    schema = docs.select(*kept).schema.add(name, "double")
    return docs.select(*kept).mapInArrow(lean(run), schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, learned(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))
