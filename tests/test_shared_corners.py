"""Sums over corners that cells share, places that observations share, text in several files, tall matrices as triangles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orefield import schema as S
from orefield.functions import prism
from orefield.operators import compress, kernels, linalg
from orefield.sources import text


def grid(spark, n):
    return S.with_boxes(spark.range(n).select(F.col("id").alias("cell_id"))).withColumn("m", 1.0 + F.col("cell_id") % 7)


def places(spark):
    return spark.createDataFrame([(0, 0.7, 0.3, -1.1), (1, 530.7, 20.3, -7.1), (2, 0.7, 0.3, -1.1), (3, 530.7, 20.3, 77.4), (4, 100.04, 20.3, 10.4)], "obs_id long, x double, y double, z double")


@pytest.mark.parametrize("most", [1 << 20, 130])
def test_sums_are_those_of_the_pairs(spark, most):
    obs, cells = places(spark), grid(spark, 300)
    got = kernels.tensor_sums(obs, cells, "m", most).orderBy("obs_id").toPandas()
    names = ["txx", "tyy", "tzz", "txy", "tyz", "tzx"]
    want = kernels.bore_tensors(obs, cells).join(cells, "cell_id").groupBy("obs_id").agg(*(F.sum(F.col("m") * F.col(n)).alias(n) for n in names)).orderBy("obs_id").toPandas()
    assert got.obs_id.tolist() == [0, 1, 2, 3, 4] and np.allclose(got[names], want[names], rtol=1e-9, atol=1e-9)
    g = kernels.sums(obs, cells, ("m",), "attraction", ("x", "y", "z"), most).orderBy("obs_id").toPandas()
    v = kernels.gravity_vector(obs, cells).groupBy("obs_id").agg(*(F.sum(F.col("m") * F.col(n) / prism.G).alias(n) for n in ("gx", "gy", "gz"))).orderBy("obs_id").toPandas()
    assert np.allclose(g[["x_m", "y_m", "z_m"]], v[["gx", "gy", "gz"]], rtol=1e-9, atol=1e-6)


def test_each_corner_and_place_is_evaluated_once(spark, monkeypatch):
    boxes = grid(spark, 2000).orderBy("cell_id").toPandas()
    lattice = kernels.Lattice({c: boxes[c].to_numpy() for c in kernels.BOX})
    assert lattice.x.size == 11 * 11 * 21
    far = kernels.Lattice({c: boxes[c].to_numpy()[[0, 1999]] for c in kernels.BOX})
    assert far.x.size == 16 and np.array_equal(far.z[far.at[7]], [50.0, 1000.0])
    assert kernels.sums(places(spark), grid(spark, 100), ("m",), "attraction", ("z",)).count() == 5


def test_lines_keep_the_order_of_files_of_any_size(spark, tmp_path):
    """Spark reads the longest file first."""
    (tmp_path / "part-00000.txt").write_text("6\n1.5\n")
    (tmp_path / "part-00001.txt").write_text("2.5\n" + "3.5" + "0" * 400 + "\n4.5\n")
    (tmp_path / "part-00002.txt").write_text("5.5" + "0" * 90 + "\n6.5\n")
    old = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", 1 << 27)
    try:
        got = {r.row: r.v for r in text.table(spark, str(tmp_path), ["v"]).collect()}
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", old)
    assert got == {k: k + 1.5 for k in range(6)}


def test_a_tall_matrix_as_a_triangle(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=(500, 3))
    rows = spark.createDataFrame([tuple(map(float, x)) for x in a], "one double, x double, y double").repartition(7)
    t, b = linalg.triangular(rows)
    assert t.shape == (3, 2)
    want = np.linalg.lstsq(a[:, :2], a[:, 2], rcond=None)[0]
    assert np.allclose(linalg.lsqr(linalg.dense_operator(t), b, 20, 1e-15).x, want)
    assert np.allclose(t.T @ t, a[:, :2].T @ a[:, :2])


def test_lines_are_cut_where_they_are_made(spark):
    """The same as lines cut apart; observations at one place share a line."""
    obs, cells = places(spark), grid(spark, 300)
    spots, of = compress.places_of(obs)
    assert {r.obs_id: r.place for r in of.collect()} == {0: 0, 1: 1, 2: 0, 3: 3, 4: 4}
    want = {r.obs_id: r for r in compress.compressed(kernels.kernel_rows(obs, cells).select("obs_id", "vals"), 300, 0.15).collect()}
    got = compress.cut_gravity(spots, cells, 0.15).collect()
    assert {(r.obs_id, r.times) for r in got} == {(0, 2), (1, 1), (3, 1), (4, 1)}
    for r in got:
        assert r.cols == want[r.obs_id].cols and r.kept == want[r.obs_id].kept and r.nnz == len(r.cols) and abs(r.error - want[r.obs_id].error) < 1e-12
    parts = compress.cut_gravity(spots, cells, 0.15, 1.0, [100, 200]).collect()
    for o in (0, 1, 3, 4):
        assert [c + 100 * r.part for r in sorted(parts, key=lambda r: r.part) if r.obs_id == o for c in r.cols] == want[o].cols
    counts = {r.cell_id: r.nnz for r in compress.column_counts(compress.cut_gravity(spots, cells, 0.15)).collect()}
    assert sum(counts.values()) == sum(r.nnz for r in want.values())


def test_gradient_rows_are_joined_once(spark, data):
    from orefield.plans.queries import gradient_block

    assert "Join" not in gradient_block(spark, data)._jdf.queryExecution().optimizedPlan().toString()
