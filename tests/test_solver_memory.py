"""What a solver round over lines on the executors sends and holds."""

import pickle

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orefield import schema as S
from orefield.operators import kernels, linalg


def batch(rows):
    return pa.RecordBatch.from_pydict({n: pa.array(v, t) for n, v, t in zip(("r", "first", "mask", "kept", "nnz"), zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64()), strict=True)})


@pytest.mark.parametrize("n", [0, 1, 13, 70001, 200000])
def test_a_packed_line_is_the_line(n):
    rng = np.random.default_rng(5)
    x = rng.normal(size=n) * np.exp(-np.arange(n) / 9e3)
    stays = rng.random(n) < 0.5
    ((r, runs),) = linalg.unpacked(batch([linalg.pack(3, 40, stays, x)]))
    want = np.where(stays, x, 0).astype(np.float32).astype(np.float64)
    y, total = rng.normal(size=n + 40), np.zeros(n + 40)
    linalg.add_line(total, runs, 1.0)
    assert r == 3 and np.array_equal(total[40:], want) and not total[:40].any()
    assert np.isclose(linalg.product(runs, y), want @ y[40:])


def test_a_packed_line_takes_less_than_its_floats_and_bits():
    n = 100000
    x = np.random.default_rng(5).normal(size=n) * np.exp(-np.arange(n) / 9e3)
    _, _, mask, kept, nnz = linalg.pack(0, 0, np.abs(x) > np.median(np.abs(x)), x)
    assert len(mask) + len(kept) < 0.95 * (n / 8 + 4 * nnz)


def test_tasks_take_several_partitions_and_vectors_pass_no_exchange(spark, monkeypatch):
    """200 partitions by 70000 columns were 200 vectors, which were merged by an exchange on disk."""
    lines = spark.range(200).select(F.col("id").alias("obs_id"), F.expr("array(int(id), int(69999))").alias("cols"), F.expr("array(float(1), float(2))").alias("kept")).repartition(200)
    op, seen = linalg.distributed_operator(lines, 200, 70000), []
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)

    def watched(rows, of=linalg._blocks):
        seen.append((rows._jdf.queryExecution().optimizedPlan().toString(), rows.rdd.getNumPartitions(), spark.conf.get(name)))
        return of(rows)

    monkeypatch.setattr(linalg, "_blocks", watched)
    got = op.transposed(np.ones(200))
    assert got[69999] == 400 and got[:200].sum() == 200
    plan, tasks, size = seen[0]
    assert "RepartitionByExpression" not in plan and tasks <= spark.sparkContext.defaultParallelism
    assert int(size.rstrip("b")) == linalg.BATCH_BYTES and spark.conf.get(name) == before


@pytest.mark.parametrize("kind", ["gravity", "magnetic"])
def test_grids_travel_in_few_bytes(spark, kind):
    held = S.with_boxes(spark.range(20000).select(F.col("id").alias("cell_id"))).orderBy("cell_id").toPandas()
    box = {c: held[c].to_numpy(np.float64) for c in kernels.BOX}
    grid = kernels.Grid(box, kind, (0.3, 0.5, 0.81))
    sent = pickle.dumps(grid)
    assert len(sent) < 10 * len(held)  # were 32 for the corners' numbers alone
    for point in ((530.7, 20.3, -7.1), (530.7, 20.3, 77.4)):
        assert np.array_equal(pickle.loads(sent).line(point)[0][0], grid.line(point)[0][0])


def test_a_magnetic_grid_holds_its_corners_only(spark):
    """No second copy of the boxes beside the lattice, which has them; a point inside a cell has its void."""
    held = S.with_boxes(spark.range(300).select(F.col("id").alias("cell_id"))).orderBy("cell_id").toPandas()
    box, point = {c: held[c].to_numpy(np.float64) for c in kernels.BOX}, (530.7, 20.3, 77.4)
    grid = kernels.Grid(box, "magnetic", (0.3, 0.5, 0.81))
    assert not any(isinstance(v, dict | np.ndarray) for v in vars(grid).values())
    want = kernels.line_of("magnetic", (0.3, 0.5, 0.81), 50000.0)(*point, box)[0][0]
    assert np.allclose(grid.line(point)[0][0], want, rtol=1e-9, atol=1e-9 * np.abs(want).max())
