"""Sparse algebra on rows (row_id, col_id, v), and least squares."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass
from threading import Lock

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def multiply(a: DataFrame, x: DataFrame) -> DataFrame:
    """row_id, y = A x; x(col_id, x)."""
    return a.join(x, "col_id").groupBy("row_id").agg(F.sum(F.col("v") * F.col("x")).alias("y"))


def multiply_transposed(a: DataFrame, u: DataFrame) -> DataFrame:
    """col_id, y = A' u; u(row_id, u)."""
    return a.join(u, "row_id").groupBy("col_id").agg(F.sum(F.col("v") * F.col("u")).alias("y"))


def multiply_part(a: DataFrame, x: DataFrame, first: int, last: int, shift: int = 0) -> DataFrame:
    """Rows first..last only, with columns shifted to those of x."""
    part = a.where(F.col("row_id").between(first, last)).withColumn("col_id", F.col("col_id") - shift)
    return multiply(part, x)


def accumulate(y: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """y + more by key, where either may lack a key."""
    return y.unionByName(more).groupBy(key).agg(F.sum("y").alias("y"))


def column_norms(a: DataFrame) -> DataFrame:
    return a.groupBy("col_id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))


def normalised_columns(a: DataFrame) -> DataFrame:
    """A with columns of norm 1, in single precision."""
    return a.join(column_norms(a).where("norm > 0"), "col_id").select("row_id", "col_id", (F.col("v") / F.col("norm")).cast("float").alias("v"))


def normalised(x: DataFrame, value: str) -> DataFrame:
    """x over its length; null values for length 0."""
    length = x.agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("length"))
    return x.crossJoin(F.broadcast(length)).withColumn(value, F.col(value) / F.when(F.col("length") != 0, F.col("length"))).drop("length")


def faults(a: DataFrame, rows: int, columns: int) -> DataFrame:
    """Entries outside the matrix, zero, or given twice."""
    out = ~F.col("row_id").between(0, rows - 1) | ~F.col("col_id").between(0, columns - 1) | F.col("v").isNull() | (F.col("v") == 0)
    twice = a.groupBy("row_id", "col_id").agg(F.count("*").alias("n")).where("n > 1").select("row_id", "col_id", F.lit("given twice").alias("fault"))
    return a.where(out).select("row_id", "col_id", F.lit("outside or empty").alias("fault")).unionByName(twice)


def stacked(blocks: list[tuple[DataFrame, int]]) -> DataFrame:
    """Blocks (rows, number of rows) beneath each other."""
    out, at = None, 0
    for rows, n in blocks:
        moved = rows.withColumn("row_id", F.col("row_id") + at)
        out, at = moved if out is None else out.unionByName(moved), at + n
    return out


@dataclass(frozen=True)
class Operator:
    """A linear map by its products; x has `columns` numbers, A x has `rows`. both, if it is there: `round` in one pass."""

    rows: int
    columns: int
    apply: Callable[[np.ndarray], np.ndarray]
    transposed: Callable[[np.ndarray], np.ndarray]
    both: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None

    def round(self, x: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """y = A x and A' (c y + d)."""
        if self.both:
            return self.both(x, c, d)
        y = self.apply(x)
        return y, self.transposed(c * y + d)


def dense_operator(a: np.ndarray) -> Operator:
    return Operator(a.shape[0], a.shape[1], lambda x: a @ x, lambda u: a.T @ u)


def local_operator(a: DataFrame, rows: int, columns: int, most: int = 1 << 26) -> Operator:
    """Holds a matrix of at most `most` entries on the driver."""
    if a.count() > most:
        raise ValueError("the matrix is too large for the driver: use distributed_operator")
    got = a.select("row_id", "col_id", "v").toPandas()
    r, c, v = got.row_id.to_numpy(), got.col_id.to_numpy(), got.v.to_numpy(np.float64)
    return Operator(rows, columns, lambda x: np.bincount(r, v * x[c], rows), lambda u: np.bincount(c, v * u[r], columns))


PACKED = "r long, first long, mask binary, kept binary, nnz long"


def pack(r: int, first: int, stays: np.ndarray, x: np.ndarray) -> tuple[int, int, bytes, bytes, int]:
    """A line's values where they stay, in single precision, and a bit for each column from `first` on. Compressed are the bits and the values' highest bytes (sign and exponent);
    the others are as good as random."""
    import pyarrow as pa

    kept, mask = x[stays].astype("<f4").view("<u4"), np.packbits(stays, bitorder="little").tobytes()
    low, middle, top = kept.astype("<u2").tobytes(), (kept >> 16).astype(np.uint8).tobytes(), pa.compress((kept >> 24).astype(np.uint8).tobytes(), codec="zstd", asbytes=True)
    return r, first, struct.pack("<q", len(mask)) + pa.compress(mask, codec="zstd", asbytes=True), low + middle + top, kept.size


#: Columns of a line that are taken at once: what is made of them stays in a core's cache.
COLUMNS_AT_ONCE = 1 << 16


def unpacked(batch) -> Iterator[tuple[int, list[tuple[slice, np.ndarray, np.ndarray]]]]:
    """Of an Arrow batch of packed lines: r, and by runs of columns which these are, where in the run values are, and these. Numbers of columns are looked up several times faster
    than a mask is."""
    import pyarrow as pa

    columns = [batch.column(c) for c in ("r", "first", "mask", "kept", "nnz")]
    for r, first, mask, kept, nnz in zip(*columns, strict=True):
        (size,), nnz, first, kept = struct.unpack_from("<q", mask.as_buffer()), nnz.as_py(), first.as_py(), kept.as_buffer()
        bits = np.frombuffer(pa.decompress(mask.as_buffer()[8:], size, codec="zstd"), np.uint8)
        low, middle = np.frombuffer(kept, "<u2", nnz), np.frombuffer(kept, np.uint8, nnz, 2 * nnz)
        top, at, runs = np.frombuffer(pa.decompress(kept[3 * nnz :], nnz, codec="zstd"), np.uint8) if nnz else middle, 0, []
        for lo in range(0, 8 * size, COLUMNS_AT_ONCE):
            cols = np.flatnonzero(np.unpackbits(bits[lo // 8 : (lo + COLUMNS_AT_ONCE) // 8], bitorder="little").view(bool))
            if cols.size:
                own = slice(at, at := at + cols.size)
                values = top[own].astype("<u4")
                values <<= 8
                values |= middle[own]
                values <<= 16
                values |= low[own]
                runs.append((slice(first + lo, first + lo + COLUMNS_AT_ONCE), cols, values.view("<f4")))
        yield r.as_py(), runs


def product(runs: list[tuple[slice, np.ndarray, np.ndarray]], x: np.ndarray) -> float:
    """A line times x."""
    return float(sum(k.astype(np.float64) @ x[run].take(cols, mode="clip") for run, cols, k in runs))


def add_line(total: np.ndarray, runs: list[tuple[slice, np.ndarray, np.ndarray]], u: float) -> None:
    """total + u times a line, in place; a line has a column once."""
    for run, cols, k in runs:
        here, more = total[run], k.astype(np.float64)
        more *= u
        more += here.take(cols, mode="clip")
        here[cols] = more


#: Packed lines go to a task's Python in batches of about so many bytes: Arrow holds a batch several times while it grows.
BATCH_BYTES = 1 << 23
_batches, _batches_lock = {"users": 0, "before": None}, Lock()


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """While it lasts, jobs send Arrow batches of at most BATCH_BYTES; several threads may be in it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    with _batches_lock:
        if not _batches["users"]:
            _batches["before"] = spark.conf.get(name, None)
            spark.conf.set(name, str(BATCH_BYTES))
        _batches["users"] += 1
    try:
        yield
    finally:
        with _batches_lock:
            _batches["users"] -= 1
            if not _batches["users"]:
                spark.conf.unset(name) if _batches["before"] is None else spark.conf.set(name, _batches["before"])


def packed(lines: DataFrame, line: str = "obs_id") -> DataFrame:
    """Lines (line, cols, kept; a column once) as bytes: half the room of columns by number where many stay, and copied whole on their way to a task."""
    import pandas as pd

    def run(batches):
        for b in batches:
            rows = []
            for r, c, k in b.itertuples(index=False):
                c, k = np.asarray(c, np.int64), np.asarray(k, np.float32)
                first = int(c.min()) if c.size else 0
                x, stays = np.zeros(int(c.max()) + 1 - first if c.size else 0, np.float32), np.zeros(int(c.max()) + 1 - first if c.size else 0, bool)
                x[c - first], stays[c - first] = k, True
                rows.append(pack(int(r), first, stays, x))
            yield pd.DataFrame(rows, columns=["r", "first", "mask", "kept", "nnz"])

    return lines.select(line, "cols", "kept").mapInPandas(run, PACKED)


def distributed_operator(lines: DataFrame, rows: int, columns: int, line: str = "obs_id", whole: bool = False) -> Operator:
    """Kernel lines (line, cols, kept), or packed ones, stay cached on the executors, packed; only vectors travel. Products of the transpose are summed in a
    task, of which there is one a core: it takes several cached partitions, those of its executor if it can. Where the tasks' vectors are many or long, they are
    merged by blocks of columns before they come to the driver. whole: no line comes in pieces, so a round is one pass."""
    held = lines if "mask" in lines.columns else packed(lines, line)
    held = held.persist()  # lost blocks are made again
    spark, context = lines.sparkSession, lines.sparkSession.sparkContext
    tasks, block = max(1, min(held.rdd.getNumPartitions(), context.defaultParallelism)), 1 << 16
    read = held.coalesce(tasks)

    def apply(x: np.ndarray) -> np.ndarray:
        import pyarrow as pa

        shared = context.broadcast(x)

        def run(batches):
            for b in batches:
                got = [(r, product(runs, shared.value)) for r, runs in unpacked(b)]
                yield pa.RecordBatch.from_pydict({"r": pa.array([r for r, _ in got], pa.int64()), "y": pa.array([y for _, y in got], pa.float64())})

        with small_batches(spark):
            got = read.mapInArrow(run, "r long, y double").toPandas()
        shared.destroy()
        return np.bincount(got.r.to_numpy(), got.y.to_numpy(), rows)  # a line may come in pieces

    def merged(batches):
        import pyarrow as pa

        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, y in zip(b.column("block"), b.column("y"), strict=True):
                if k.as_py() < 0:
                    yield pa.RecordBatch.from_pydict({"block": pa.array([-1], pa.int64()), "y": pa.array([y.as_py()], pa.binary())})
                else:
                    total[k.as_py()] = total.get(k.as_py(), 0) + np.frombuffer(y.as_buffer())
        for k, y in total.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int64()), "y": pa.array([y.tobytes()], pa.binary())})

    def back(x: np.ndarray | None, c: np.ndarray | None, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A x, and A' (c A x + d); without x, A' d. Blocks of the second are numbered from 0, and the first has number -1."""
        shared = context.broadcast((x, c, d))

        def run(batches):
            import pyarrow as pa

            x, c, d = shared.value
            total, seen = np.zeros(columns), []
            for b in batches:
                for r, runs in unpacked(b):
                    u = d[r]
                    if x is not None:
                        y = product(runs, x)
                        seen.append((float(r), y))
                        u = c[r] * y + u
                    add_line(total, runs, u)
            blocks = [(at // block, some.tobytes()) for at in range(0, columns, block) if (some := total[at : at + block]).any()]
            for k, y in [(-1, np.array(seen).tobytes()), *blocks]:
                yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int64()), "y": pa.array([y], pa.binary())})

        got = read.mapInArrow(run, "block long, y binary")
        if tasks * columns > 1 << 23:
            got = got.repartition(context.defaultParallelism, "block").mapInArrow(merged, "block long, y binary")
        y, out = np.zeros(rows), np.zeros(columns)
        with small_batches(spark):
            for k, some in _blocks(got):
                if k < 0:
                    pairs = some.reshape(-1, 2)
                    y[pairs[:, 0].astype(np.int64)] = pairs[:, 1]
                else:
                    out[k * block : (k + 1) * block] += some
        shared.destroy()
        return y, out

    return Operator(rows, columns, apply, lambda u: back(None, None, u)[1], back if whole else None)


def _blocks(rows: DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    for b in rows.toArrow().to_batches():
        for k, y in zip(b.column("block"), b.column("y"), strict=True):
            yield k.as_py(), np.frombuffer(y.as_buffer())


def triangular(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """A tall matrix of few columns and its right side (the last column), turned by orthogonal maps into one row a column: least squares have the same
    solution and LSQR the same rounds. Each task turns its rows to a triangle, batch after batch; only triangles come to the driver, so no vector has the data's length."""
    import pandas as pd

    names = rows.columns

    def run(batches):
        held = np.zeros((0, len(names)))
        for b in batches:
            held = np.linalg.qr(np.concatenate([held, b.to_numpy(np.float64)]), mode="r")
        yield pd.DataFrame(held, columns=names)

    got = rows.mapInPandas(run, ", ".join(f"`{n}` double" for n in names)).collect()
    whole = np.linalg.qr(np.array([tuple(x) for x in got]).reshape(-1, len(names)), mode="r")
    return whole[:, :-1], whole[:, -1]


def lines_operator(lines: DataFrame, rows: int, columns: int, line: str = "obs_id", most: int = 1 << 22) -> Operator:
    """Kernel lines as an operator: on the driver if their entries are at most `most` (then two jobs a round would cost more than the
    products), else on the executors."""
    held = (lines if "mask" in lines.columns else packed(lines, line)).persist()  # made once, counted and then read
    entries, pieces, whole = held.agg(F.coalesce(F.sum("nnz"), F.lit(0)), F.count("*"), F.countDistinct("r")).first()
    if entries > most:
        return distributed_operator(held, rows, columns, line, pieces == whole)
    got = [x for b in held.toArrow().to_batches() for x in unpacked(b)]
    held.unpersist()
    r = np.repeat(np.array([x for x, _ in got], np.int64), [sum(k.size for *_, k in runs) for _, runs in got])
    c = np.concatenate([np.zeros(0, np.int64), *(run.start + cols for _, runs in got for run, cols, _ in runs)])
    v = np.concatenate([np.zeros(0), *(k for _, runs in got for *_, k in runs)])
    return Operator(rows, columns, lambda x: np.bincount(r, v * x[c], rows), lambda u: np.bincount(c, v * u[r], columns))


def stack_operators(parts: list[Operator]) -> Operator:
    """Operators beneath each other. Those whose rounds are passes on the executors have them at the same time."""
    edges = np.cumsum([0] + [p.rows for p in parts])
    split = lambda u: [u[a:b] for a, b in zip(edges, edges[1:], strict=False)]

    def both(x: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        with ThreadPoolExecutor(max(1, sum(p.both is not None for p in parts))) as pool:
            asked = [pool.submit(p.round, x, *own) if p.both else own for p, *own in zip(parts, split(c), split(d), strict=True)]
            got = [p.round(x, *own) if p.both is None else own for p, own in zip(parts, asked, strict=True)]
            got = [g if isinstance(g, tuple) else g.result() for g in got]
        return np.concatenate([y for y, _ in got]), sum(z for _, z in got)

    return Operator(int(edges[-1]), parts[0].columns, lambda x: np.concatenate([p.apply(x) for p in parts]), lambda u: sum(p.transposed(v) for p, v in zip(parts, split(u), strict=True)), both if any(p.both for p in parts) else None)


@dataclass(frozen=True)
class Solution:
    x: np.ndarray
    iterations: int
    r: float
    reason: str


def soft(x: np.ndarray, gamma: float) -> np.ndarray:
    return np.sign(x) * np.maximum(np.abs(x) - gamma, 0)


def lsqr(a: Operator, b: np.ndarray, most: int = 100, least_r: float = 1e-13, gamma: float = 0.0, target_rms: float = 0.0, data_rows: int | None = None) -> Solution:
    """Least squares by Golub-Kahan bidiagonalisation with plane rotations.

    Ends after `most` rounds, when the estimated residual over |b| is at most least_r, when the root mean square over the first
    data_rows reaches target_rms (if positive), or when a length vanishes. gamma shrinks the solution after each round; the directions
    and the residual estimate go on as if it did not. A target needs A x, which is kept up from products that the rounds make anyway, unless gamma bends x.
    """
    x = np.zeros(a.columns)
    beta = float(np.linalg.norm(b))
    if beta == 0:
        return Solution(x, 0, 0.0, "nothing to fit")
    u = b / beta
    v = a.transposed(u)
    alpha = float(np.linalg.norm(v))
    if alpha == 0:
        return Solution(x, 0, 1.0, "the data are orthogonal to all columns")
    v = v / alpha
    w, start, bar_rho, bar_phi, r = v.copy(), beta, alpha, beta, 1.0
    data_rows = a.rows if data_rows is None else data_rows
    done, reason = 0, "rounds"
    ax, aw, back = np.zeros(a.rows if target_rms > 0 else 0), np.zeros(a.rows), 0.0
    while done < most and r > least_r:
        if target_rms > 0 and np.sqrt(np.mean(((a.apply(x) if gamma else ax)[:data_rows] - b[:data_rows]) ** 2)) <= target_rms:
            reason = "target"
            break
        if a.both:
            av, atu = a.both(v, np.broadcast_to(1.0, a.rows), -alpha * u)
        else:
            av, atu = a.apply(v), None
        aw *= -back
        aw += av
        u *= -alpha
        u += av
        beta = float(np.linalg.norm(u))
        if beta:
            u /= beta
        v = (a.transposed(u) if atu is None else atu / (beta or 1.0)) - beta * v
        alpha = float(np.linalg.norm(v))
        if alpha:
            v = v / alpha
        rho = float(np.hypot(bar_rho, beta))
        if rho == 0:
            reason = "rho"
            break
        cos, sin = bar_rho / rho, beta / rho
        x = x + (cos * bar_phi / rho) * w
        if target_rms > 0 and not gamma:  # only a target asks for A x
            ax += (cos * bar_phi / rho) * aw
        back = sin * alpha / rho
        w = v - back * w
        bar_rho, bar_phi = -cos * alpha, sin * bar_phi
        if gamma:
            x = soft(x, gamma)
        r = bar_phi / start
        done += 1
        if abs(bar_rho) < 1e-30:
            reason = "exact"
            break
    else:
        reason = "residual" if r <= least_r else "rounds"
    return Solution(x, done, r, reason)
