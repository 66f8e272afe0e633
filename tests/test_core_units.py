"""Known results and properties of the numerical operators."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from orefield.functions import prism
from orefield.functions.prism import ARRAYS
from orefield.operators import compress, constraints, linalg, weights
from orefield.operators.stencil import Scheme
from orefield.operators.wavelet import Wavelet, matrix, transform
from orefield.plans.config import Config
from orefield.plans.inversion import Settings, cross_gradient, differences, projected
from orefield.sources import files, text

BOX = {"x1": np.array([0.0]), "x2": np.array([100.0]), "y1": np.array([0.0]), "y2": np.array([100.0]), "z1": np.array([0.0]), "z2": np.array([50.0])}


def test_prism_far_away_is_a_point():
    x, y, z = 5000.7, 4200.3, -8000.0
    s = prism.sides(x, y, z, BOX.__getitem__)
    r = np.array([50 - x, 50 - y, 25 - z])
    size = np.linalg.norm(r)
    point = 500000 * r / size**3
    got = [f(ARRAYS, *s)[0] for f in (prism.attraction_x, prism.attraction_y, prism.attraction_z)]
    assert np.allclose(got, point, rtol=2e-3)


def test_tensors_have_no_trace_and_agree():
    for x, y, z in ((250.3, 80.1, -10.0), (-30.5, 420.0, 90.0)):
        s = prism.sides(x, y, z, BOX.__getitem__)
        g = prism.gradients(ARRAYS, s[0], s[1], tuple(-v for v in s[2]))
        t = prism.magnetic_tensor(ARRAYS, *prism.sides(x, y, z, BOX.__getitem__, turned=True))
        assert abs(g["xx"] + g["yy"] + g["zz"])[0] % (2 * np.pi) == pytest.approx(0, abs=1e-9)
        assert abs(t["xx"] + t["yy"] + t["zz"])[0] < 1e-12
        for n in ("xy", "yz", "zx"):
            assert g[n][0] == pytest.approx(t[n][0], abs=1e-9)


@pytest.mark.parametrize("kind", [Wavelet.HAAR, Wavelet.D4])
@pytest.mark.parametrize("n", [1, 2, 3, 10, 11, 12, 32, 128])
def test_wavelets_are_orthonormal(kind, n):
    m = matrix(n, kind)
    assert np.abs(m @ m.T - np.eye(n)).max() < 1e-13


def test_haar_of_the_identity():
    assert (np.abs(transform(np.eye(1000), (10, 10, 10), Wavelet.HAAR)) > 1e-14).sum() == 46656


@pytest.mark.parametrize("kind", [Wavelet.HAAR, Wavelet.D4])
def test_wavelets_keep_length_and_products(kind):
    x = np.arange(1, 10 * 11 * 12 + 1, dtype=float)
    t = transform(x, (10, 11, 12), kind)
    assert np.linalg.norm(t) == pytest.approx(np.linalg.norm(x))
    assert np.allclose(transform(t, (10, 11, 12), kind, inverse=True), x)
    a = np.array([[(2 * i - j) / (i + j) for j in range(1, 61)] for i in range(1, 6)])
    v = np.linspace(0, 1, 60)
    assert np.allclose(a @ v, transform(a, (3, 4, 5), kind) @ transform(v, (3, 4, 5), kind))


def solve(a, b, **more):
    return linalg.lsqr(linalg.dense_operator(np.array(a, float)), np.array(b, float), **more).x


def test_lsqr_known_systems():
    assert np.allclose(solve([[1, 1, 0], [2, 1, -1]], [1, 0]), [0, 1, 1])
    assert np.allclose(solve([[0.25] * 4], [1.0]), [1, 1, 1, 1])
    n = 200
    assert np.allclose(solve([[j] * n for j in range(1, n + 1)], [j * n for j in range(1, n + 1)]), np.ones(n))
    x = np.linspace(0, 1, 1000)
    assert np.allclose(solve(np.column_stack([np.ones(1000), x, x * x]), 1 - 3 * x), [1, -3, 0], atol=1e-8)


def test_lsqr_against_direct():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(40, 12)), rng.normal(size=40)
    assert np.allclose(solve(a, b, most=200), np.linalg.lstsq(a, b, rcond=None)[0])


def test_lsqr_ends():
    a = linalg.dense_operator(np.eye(3))
    assert linalg.lsqr(a, np.zeros(3)).reason == "nothing to fit"
    assert linalg.lsqr(a, np.array([1.0, 2, 3]), most=50, target_rms=10.0).reason == "target"
    assert np.allclose(linalg.lsqr(a, np.array([1.0, 2, 3]), gamma=0.5).x, [0.5, 1.5, 2.5])


def adjoint(op, seed=0):
    rng = np.random.default_rng(seed)
    x, u = rng.normal(size=op.columns), rng.normal(size=op.rows)
    return op.apply(x) @ u, x @ op.transposed(u)


def test_operators_are_adjoint():
    settings = Settings((4, 5, 3), (2.0, 3.0, 5.0))
    rng = np.random.default_rng(2)
    for op in (differences(settings, rng.random(60)), cross_gradient(rng.random(60), rng.random(60), settings)[1]):
        assert np.allclose(*adjoint(op))


def test_cross_gradient_derivative():
    settings = Settings((4, 4, 4), (1.0, 2.0, 3.0))
    rng = np.random.default_rng(3)
    a, b, da, db = (rng.random(64) for _ in range(4))
    tau, op = cross_gradient(a, b, settings)
    e = 1e-6
    assert np.allclose((cross_gradient(a + e * da, b + e * db, settings)[0] - tau) / e, op.apply(np.concatenate([da, db])), atol=1e-5)


def boxes(spark, nx, ny, nz):
    rows = spark.range(nx * ny * nz).select(F.col("id").alias("cell_id"), (F.col("id") % nx).alias("i"), (F.floor(F.col("id") / nx) % ny).alias("j"), F.floor(F.col("id") / (nx * ny)).alias("k"))
    return rows.select("*", *((F.col(n) + s - 1).cast("double").alias(f"{a}{s}") for a, n in zip("xyz", "ijk") for s in (1, 2)))


@pytest.mark.parametrize("central", [False, True])
def test_cross_gradient_entries(spark, central):
    cells = boxes(spark, 20, 20, 144).withColumns({"m1": (F.col("i") + 1).cast("double"), "m2": (F.col("i") + 2).cast("double")})
    got = constraints.cross_gradient_entries(constraints.cross_gradient(cells, (20, 20, 144), central), 1.0)
    assert got.count() == 457904


def test_identity_damping(spark):
    rows = boxes(spark, 10, 72, 4).select("cell_id", F.col("cell_id").cast("double").alias("value"), F.lit(0.0).alias("reference"), F.lit(1.0).alias("column_weight"))
    got = constraints.damping(rows, 1.0)
    assert got.where("row_id = col_id and v = 1 and b = -row_id").count() == 2880


def test_projection_takes_the_first_of_equal_ends():
    bounds = np.tile(np.array([[0.0, 1.0], [3.0, 4.0]])[:, None, :], (1, 4, 1))
    assert projected(np.array([0.5, 2.0, 9.0, -3.0]), bounds).tolist() == [0.5, 1.0, 4.0, 0.0]


def test_column_norms(spark):
    a = spark.createDataFrame([(r, c, float(r * 10 + c + 1)) for r in range(30) for c in range(5)], "row_id long, col_id long, v double")
    got = {x.col_id: x.norm for x in linalg.column_norms(linalg.normalised_columns(a).withColumn("v", F.col("v").cast("double"))).collect()}
    assert len(got) == 5 and all(abs(v - 1) < 1e-6 for v in got.values())


def test_operator_on_executors(spark):
    lines = spark.createDataFrame([(0, [0, 2], [1.0, 2.0]), (1, [1], [3.0]), (2, [], [])], "obs_id long, cols array<int>, kept array<float>")
    for op in (linalg.distributed_operator(lines, 3, 3), linalg.lines_operator(lines, 3, 3)):
        assert op.apply(np.array([1.0, 2, 3])).tolist() == [7.0, 6.0, 0.0]
        assert op.transposed(np.array([1.0, 2, 3])).tolist() == [1.0, 6.0, 2.0]


def test_config():
    c = Config.parse(["# note = 1", "modelGrid.size = 2 3 4", "inversion.modelDamping.grav.weight = 1.d-9", "no key here", "forward.data.grav.dataGridFile = None", "inversion.admm.grav.bounds = -1. 1.d0 3 4"])
    assert c["modelGrid.size"] == [2, 3, 4] and c["inversion.modelDamping.grav.weight"] == 1e-9 and c["forward.data.grav.dataGridFile"] == ""
    assert c["inversion.admm.grav.bounds"] == [-1, 1, 3, 4] and c.active() == ["grav"]
    with pytest.warns(UserWarning):
        Config.parse(["nothing.known = 1"])


def test_text_sources_refuse_what_is_wrong(spark, tmp_path):
    (tmp_path / "short").write_text("3\n1 2\n")
    with pytest.raises(ValueError):
        text.table(spark, str(tmp_path / "short"), ["a", "b"])
    (tmp_path / "grid").write_text("1\n1 0 0 1 0 1 1 1 1\n")
    with pytest.raises(ValueError):
        text.model_grid(spark, str(tmp_path / "grid"))
    (tmp_path / "bounds").write_text("1 1\n5 3 1\n")
    with pytest.raises(ValueError):
        text.bounds(spark, str(tmp_path / "bounds"))


def test_pictures_are_bytes_as_the_format_has_them(spark):
    """Two cells beside each other, written out by hand."""
    cells = spark.createDataFrame([(1, 1, 0, 0, 2.0, 4.0, 0.0, 2.0, 1.0, 3.0, 7.0, -1.0, 5.0), (0, 0, 0, 0, 0.0, 2.0, 0.0, 2.0, 1.0, 3.0, 6.0, 1.0, 4.0)], "cell_id long, i long, j long, k long, x1 double, x2 double, y1 double, y2 double, z1 double, z2 double, a double, b double, c double")
    be = lambda *x: struct.pack(f">{len(x)}f", *x)
    head = lambda kind: b"# vtk DataFile Version 3.0\nt\nBINARY\nDATASET " + kind + b"\n"
    grid = files.structured_grid(cells, ["a"], "rho", title="t")
    assert grid == head(b"STRUCTURED_GRID") + b"DIMENSIONS        2        1        1\n\n\nPOINTS        2 FLOAT\n" + be(1, 1, -2, 3, 1, -2) + b"\n\nPOINT_DATA        2\nSCALARS rho FLOAT\nLOOKUP_TABLE default\n" + be(6, 7)
    vectors = files.structured_grid(cells, ["a", "b", "c"], "m", title="t")
    assert vectors.endswith(b"VECTORS m FLOAT\n" + be(6, 1, -4, 7, -1, -5))
    corners = [v for x in (0, 2) for z in (-1, -3) for y in (0, 2) for xx in (x, x + 2) for v in (xx, y, z)]
    ints = lambda *x: struct.pack(f">{len(x)}i", *x)
    assert files.voxels(cells, ["a"], "rho", title="t") == head(b"UNSTRUCTURED_GRID") + b"POINTS 16 FLOAT\n" + be(*corners) + b"\n\nCELLS 2 18\n" + ints(8, *range(8), 8, *range(8, 16)) + b"\n\nCELL_TYPES 2\n" + ints(11, 11) + b"\n\nCELL_DATA        2\nSCALARS rho FLOAT\nLOOKUP_TABLE default\n" + be(6, 7)
    obs = spark.createDataFrame([(0, 1.0, 2.0, 3.0, 9.0)], "obs_id long, x double, y double, z double, v double")
    assert files.points(obs, ["v"], "d", title="t") == head(b"UNSTRUCTURED_GRID") + b"\nPOINTS        1 FLOAT\n" + be(1, 2, -3) + b"\n\nCELLS 1 2\n" + ints(1, 0) + b"\n\nCELL_TYPES 1\n" + ints(1) + b"\n\nPOINT_DATA        1\nSCALARS d FLOAT\nLOOKUP_TABLE default\n" + be(9)


def test_codes_of_derivatives():
    assert [Scheme.of_code(k) for k in (0, 1, 2, 3, 6, 7)] == [Scheme.BACKWARD, Scheme.FORWARD, Scheme.CENTRAL, Scheme.FORWARD3, Scheme.FORWARD3, Scheme.FORWARD4]
    with pytest.raises(ValueError):
        Config.parse(["inversion.crossGradient.derivativeType = 3"])


def test_penalty_weights():
    assert constraints.admm_weight(1.0, 1e-5, 1e-4, 2.0, 10.0) == 2.0  # the data are fitted
    assert constraints.admm_weight(1.0, 1e-3, 1e-4, 2.0, 10.0) == 1.0  # they are not
    assert constraints.admm_weight(16.0, 1e-5, 1e-4, 2.0, 10.0) == 16.0  # over the most
    assert constraints.admm_weight(3.0, 1e-5, 1e-4, 1.0, 10.0) == 3.0


def test_a_target_ends_the_rounds_as_if_the_residual_were_made_anew():
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(60, 20)), rng.normal(size=60)
    whole = [linalg.lsqr(linalg.dense_operator(a), b, most=k).x for k in range(1, 15)]
    rms = [float(np.sqrt(np.mean((a @ x - b) ** 2))) for x in whole]
    for target in (rms[2] * 1.0001, rms[5] * 1.0001):
        got = linalg.lsqr(linalg.dense_operator(a), b, most=50, target_rms=target)
        assert got.reason == "target" and got.iterations == next(k + 1 for k, x in enumerate(rms) if x <= target)
    counted = []
    op = linalg.Operator(60, 20, lambda x: counted.append(1) or a @ x, lambda u: a.T @ u)
    linalg.lsqr(op, b, most=8, target_rms=1e-9)
    assert len(counted) == 8


def test_even_parts_and_ranks(spark):
    rows = spark.range(0, 1003).select(((F.col("id") * 7919) % 1003).alias("x")).repartition(7)
    got = compress.even_parts(rows, "x", 10).orderBy("x").toPandas()
    want = np.repeat(np.arange(10), [101] * 3 + [100] * 7)
    assert got.part.tolist() == want.tolist()
    assert compress.numbered(rows, "x").where("rank <> x").count() == 0
    assert compress.even_parts(rows.where("x < 3"), "x", 10).toPandas().part.nunique() == 3


def test_weights_in_blocks_of_observations(spark):
    cells = boxes(spark, 4, 4, 3)
    obs = spark.range(23).select(F.col("id").alias("obs_id"), (F.col("id") * 0.37).alias("x"), (F.col("id") % 5 * 0.9).alias("y"), F.lit(-0.5).alias("z"))
    for f in (lambda most: weights.distance(cells, obs, 2.0, 1.0, most), lambda most: weights.nearest(cells, obs, 2.0, most)):
        a, b = (f(most).orderBy("cell_id").toPandas() for most in (1000, 6))
        assert np.allclose(a, b)


def test_columns_of_parts(spark):
    got = compress.parts_of(spark.range(-2, 40).withColumnRenamed("id", "cell_id"), [3, 3, 10, 25]).collect()
    assert [r.part for r in got] == [-1, -1, *(sum(b <= c for b in (3, 3, 10, 25)) for c in range(40))]
    lines = spark.createDataFrame([(0, [0, 2, 3, 30], [1.0, 2.0, 3.0, 4.0]), (1, [9], [5.0])], "obs_id long, cols array<int>, kept array<float>")
    cut = {(r.part, r.obs_id): (r.cols, r.kept) for r in compress.repartitioned_kernel(lines, [3, 10]).collect()}
    assert cut == {(0, 0): ([0, 2], [1.0, 2.0]), (1, 0): ([0], [3.0]), (2, 0): ([20], [4.0]), (1, 1): ([6], [5.0])}
