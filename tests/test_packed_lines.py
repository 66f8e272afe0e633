"""Lines of places, packed in their tasks, and long axes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orefield import schema as S
from orefield.operators import compress, kernels, linalg, wavelet
from orefield.operators.wavelet import Wavelet
from orefield.plans import inversion

FIELD = (0.3, 0.5, 0.81)


@pytest.mark.parametrize(("kind", "parts", "data_parts"), [("gravity", 1, 1), ("gradient", 1, 6), ("magnetic", 1, 1), ("magnetic", 3, 3)])
def test_packed_lines_are_the_compressed_ones(spark, kind, parts, data_parts):
    """Six observations at three places, one inside a cell; the operators' products are equal."""
    cells = S.with_boxes(spark.range(300).select(F.col("id").alias("cell_id")))
    at = [(0.7, 0.3, -1.1), (530.7, 20.3, 77.4), (370.7, 920.3, -9.1)]
    obs = spark.createDataFrame([(o, *at[o % 3]) for o in range(6)], "obs_id long, x double, y double, z double")
    w = np.linspace(1, 2, 300)
    for kept, rate in ((Wavelet.NONE, 1.0), (Wavelet.HAAR, 0.4)):
        lines = compress.compressed_lines(kernels.kernel_rows(obs, cells, kind, FIELD, 50000.0, parts, data_parts), w, (10, 10, 3), kept, rate)
        want = linalg.lines_operator(lines, 6 * data_parts, 300 * parts)
        settings = inversion.Settings((10, 10, 3), (S.DX, S.DY, S.DZ), wavelet=kept)
        p = inversion.problem_of(spark, "grav", obs, cells, np.zeros(6 * data_parts), w, settings, rate, FIELD, 50000.0, parts, data_parts, kind)
        raw = inversion.kernel_operator(lines, 6 * data_parts, (10, 10, 3), kept, parts)
        assert (p.kernel.rows, p.kernel.columns) == (want.rows, want.columns)
        x, u = np.random.default_rng(3).normal(size=300 * parts), np.random.default_rng(4).normal(size=6 * data_parts)
        assert np.allclose(p.kernel.apply(x), raw.apply(x), rtol=1e-5, atol=1e-6 * np.abs(raw.apply(x)).max())
        assert np.allclose(p.kernel.transposed(u), raw.transposed(u), rtol=1e-5, atol=1e-6 * np.abs(raw.transposed(u)).max())


def test_a_place_has_one_line(spark):
    cells = S.with_boxes(spark.range(300).select(F.col("id").alias("cell_id")))
    obs = spark.createDataFrame([(o, 0.7, 0.3, -1.1 - o % 2) for o in range(8)], "obs_id long, x double, y double, z double")
    spots, place = inversion.numbered_places(obs)
    assert place.tolist() == [1, 0] * 4 and spots.count() == 2
    assert compress.packed_lines(spots, cells, np.ones(300), (10, 10, 3), Wavelet.NONE, 1.0, "gravity").count() == 2


@pytest.mark.parametrize("kind", [Wavelet.HAAR, Wavelet.D4])
@pytest.mark.parametrize("n", [65, 96, 200])
def test_long_axes_are_lifted(monkeypatch, kind, n):
    x = np.random.default_rng(5).normal(size=(2, 6 * n))
    got = wavelet.transform(x, (3, 2, n), kind)
    back = wavelet.transform(got, (3, 2, n), kind, inverse=True)
    monkeypatch.setattr(wavelet, "MATRIX_MOST", n)
    assert np.allclose(got, wavelet.transform(x, (3, 2, n), kind)) and np.allclose(back, x)
    monkeypatch.setattr(wavelet, "MATRIX_MOST", 0)
    monkeypatch.setattr(wavelet, "matrix", None)  # a matrix of an axis of 12000 cells would have 1.2 GB
    assert np.allclose(wavelet.transform(x, (3, 2, n), kind), got)


def test_merged_products_are_those_of_one_task(spark):
    rng = np.random.default_rng(6)
    a = rng.normal(size=(9, 70000)).astype(np.float32) * (rng.random((9, 70000)) < 0.2)
    lines = spark.createDataFrame([(k, np.flatnonzero(r).tolist(), r[r != 0].tolist()) for k, r in enumerate(a)], "obs_id long, cols array<int>, kept array<float>").repartition(200)
    op = linalg.distributed_operator(lines, 9, 70000)
    u, x = rng.normal(size=9), rng.normal(size=70000)
    assert np.allclose(op.transposed(u), a.T.astype(float) @ u) and np.allclose(op.apply(x), a.astype(float) @ x)


def test_a_round_is_one_pass(spark):
    """Products of a stack, one of whose operators is on the executors, by `round` and by themselves; LSQR asks for no other."""
    cells = S.with_boxes(spark.range(300).select(F.col("id").alias("cell_id")))
    obs = spark.createDataFrame([(o, 70.7 * (o % 5), 0.3, -1.1 - o % 2) for o in range(20)], "obs_id long, x double, y double, z double")
    spots, place = inversion.numbered_places(obs)
    lines = compress.packed_lines(spots, cells, np.ones(300), (10, 10, 3), Wavelet.HAAR, 0.5, "gravity")
    dense = linalg.lines_operator(lines, 10, 300)
    far = linalg.lines_operator(lines, 10, 300, most=0)
    assert far.both and not dense.both
    rng = np.random.default_rng(7)
    w, x, c, d = rng.random(20) * 1e6, rng.normal(size=600), rng.random(320), rng.normal(size=320)
    there, here = (linalg.stack_operators([inversion.placed(inversion.scaled_rows(inversion.shared_rows(a, place), w), 300, 600), inversion.placed(inversion.diagonal(np.full(300, 0.1)), 0, 600)]) for a in (far, dense))
    for got, want in zip(there.round(x, c, d), here.round(x, c, d), strict=True):
        assert np.allclose(got, want, rtol=1e-9, atol=1e-9 * np.abs(want).max())
    b = rng.normal(size=320)
    assert np.allclose(linalg.lsqr(there, b, 5).x, linalg.lsqr(here, b, 5).x, rtol=1e-6, atol=1e-9)
    pieces = linalg.packed(spark.createDataFrame([(0, [0, 2], [1.0, 2.0]), (0, [5], [3.0])], "obs_id long, cols array<int>, kept array<float>"))
    assert linalg.lines_operator(pieces, 1, 6, most=0).both is None
