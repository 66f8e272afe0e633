"""Runs from parameter files, over files that the test writes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orefield.operators import compress, constraints, kernels
from orefield.operators.linalg import lines_operator
from orefield.operators.wavelet import Wavelet
from orefield.plans.inversion import Settings, clustering, cross_gradient, differences, mixture, places
from orefield.plans.queries import FIELD
from orefield.plans.run import run
from orefield.sources import files, text


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("run")
    nx, ny, nz = 6, 5, 3
    cells = spark.range(nx * ny * nz).select(F.col("id").alias("cell_id"), (F.col("id") % nx).alias("i"), (F.floor(F.col("id") / nx) % ny).alias("j"), F.floor(F.col("id") / (nx * ny)).alias("k"))
    box = [(F.col(n) + s) * d for n, d in (("i", 100.0), ("j", 100.0), ("k", 50.0)) for s in (0, 1)]
    text.write(cells, f"{folder}/grid", "cell_id", [*box, *(F.col(n) + 1 for n in "ijk")])
    block = F.when(F.col("i").between(2, 3) & F.col("j").between(1, 3) & (F.col("k") == 1), 250.0).otherwise(0.0)
    text.write(cells, f"{folder}/truth_grav", "cell_id", [block])
    text.write(cells, f"{folder}/truth_magn", "cell_id", [block / 10000])
    obs = spark.range(64).select("id", (F.col("id") % 8 * 80 + 20.5).alias("x"), (F.floor(F.col("id") / 8) * 65 + 10.5).alias("y"), F.lit(-1.0).alias("z"))
    text.write(obs, f"{folder}/obs", "id", [F.col("x"), F.col("y"), F.col("z"), F.lit(0)])
    text.write(spark.createDataFrame([(0, 2.0, 0.0, 40.0, 0.0, 0.01, 0.1), (1, 1.0, 250.0, 40.0, 0.025, 0.01, 0.1)], "n int, w double, a double, b double, c double, d double, e double"), f"{folder}/mixture", "n", [F.col(c) for c in "wabcde"])
    return folder


def parameters(folder, out, more):
    base = {
        "global.outputFolderPath": f"{folder}/{out}", "modelGrid.size": "6 5 3", "modelGrid.grav.file": f"{folder}/grid", "modelGrid.magn.file": f"{folder}/grid", "forward.depthWeighting.type": 1, "forward.depthWeighting.grav.Z0": 1.0, "forward.depthWeighting.magn.Z0": 1.0,
        **{f"forward.data.{p}.{k}": v for p in ("grav", "magn") for k, v in (("nData", 64), ("dataGridFile", f"{folder}/obs"), ("useSyntheticModelForDataValues", 1), ("syntheticModelFile", f"{folder}/truth_{p}"))},
        "inversion.nMajorIterations": 3, "inversion.nMinorIterations": 60, "inversion.modelDamping.grav.weight": "1.d-11", "inversion.joint.grav.problemWeight": "1.d0",
    }
    path = folder / f"{out}.txt"
    path.write_text("# a run\n" + "".join(f"{k} = {v}\n" for k, v in (base | more).items()))
    return str(path)


def test_gravity_run(spark, inputs):
    problems, log = run(spark, parameters(inputs, "grav", {"forward.matrixCompression.type": 1, "forward.matrixCompression.rate": 1.0, "inversion.admm.enableADMM": 1, "inversion.admm.nLithologies": 2, "inversion.admm.grav.bounds": "-1 1 240 260"}))
    assert [p.name for p in problems] == ["grav"] and len(log) == 3
    assert log[-1]["data_grav"] < 0.05
    calc = text.observations(spark, f"{inputs}/grav/data/grav_calculated", 1)
    costs = spark.read.csv(f"{inputs}/grav/costs", header=True, inferSchema=True).orderBy("iteration").collect()
    assert calc.count() == 64 and [r.iteration for r in costs] == [0, 1, 2, 3] and len(costs[0]) == 20
    assert [r.data_cost_grav for r in costs[1:]] == pytest.approx([x["data_grav"] for x in log])
    assert costs[0].data_cost_grav == pytest.approx(1) and costs[0].ADMM_weight_grav > 0 and costs[-1].model_cost_grav > 0
    assert (inputs / "grav/grav.txt").read_text() == (inputs / "grav.txt").read_text()
    misfit = text.observations(spark, f"{inputs}/grav/data/grav_misfit", 1).orderBy("obs_id").toPandas().v.str[0].to_numpy()
    assert np.allclose(misfit, problems[0].measured - problems[0].calculated)
    counts = files.read_counts(spark, f"{inputs}/grav/SENSIT", "grav")
    assert counts.agg(F.sum("nnz")).first()[0] == files.read_kernel(spark, f"{inputs}/grav/SENSIT", "grav", {"dims": [6, 5, 3], "data": 64, "wavelet": 1, "rate": 1.0, "parts": [1, 1]})[0].agg(F.sum("nnz")).first()[0]
    assert (inputs / "grav/pictures/grav_half_z.vtk").read_bytes().startswith(b"# vtk DataFile Version 3.0\n")
    again, _ = run(spark, parameters(inputs, "again", {"forward.matrixCompression.type": 1, "forward.matrixCompression.rate": 1.0, "sensit.readFromFiles": 1, "sensit.folderPath": f"{inputs}/grav/SENSIT", "inversion.nMajorIterations": 0}))
    assert np.allclose(again[0].measured, problems[0].measured)
    with pytest.raises(ValueError):
        run(spark, parameters(inputs, "other", {"sensit.readFromFiles": 1, "sensit.folderPath": f"{inputs}/grav/SENSIT"}))


def test_joint_run(spark, inputs):
    more = {"inversion.joint.magn.problemWeight": 1e-7, "inversion.modelDamping.magn.weight": 1e-8, "inversion.joint.grav.columnWeightMultiplier": 1.0, "inversion.crossGradient.weight": 1e-9, "inversion.dampingGradient.grav.weight": 1e-13,
        "inversion.clustering.grav.weight": 1e-10, "inversion.clustering.magn.weight": 1e-10, "inversion.clustering.mixtureFile": f"{inputs}/mixture", "inversion.nMajorIterations": 2}
    problems, log = run(spark, parameters(inputs, "joint", more))
    assert [p.name for p in problems] == ["grav", "magn"] and len(log) == 2
    assert log[-1]["data_grav"] < 1 and log[-1]["data_magn"] < 1
    assert {"cross_gradient", "clustering_grav", "clustering_magn", "gradient_grav"} <= set(log[0])


def test_vector_run(spark, inputs):
    """A magnetisation of three parts from three data parts, bounds on its third."""
    cells = text.model_grid(spark, f"{inputs}/grid")
    block = F.when(F.col("i").between(2, 3) & F.col("j").between(1, 3) & (F.col("k") == 0), 2.0).otherwise(0.0)
    text.write(cells, f"{inputs}/truth_vector", "cell_id", [block, -block, block * 2])
    more = {"inversion.joint.grav.problemWeight": 0, "inversion.joint.magn.problemWeight": 1, "modelGrid.magn.nModelComponents": 3, "forward.data.magn.nDataComponents": 3, "forward.data.magn.syntheticModelFile": f"{inputs}/truth_vector", "forward.depthWeighting.magn.power": 2.0,
        "inversion.modelDamping.magn.weight": 1e-9, "inversion.dampingGradient.magn.weight": 1e-9, "inversion.admm.enableADMM": 1, "inversion.admm.magn.bounds": "0 5", "inversion.admm.magn.weight": 1e-3, "forward.matrixCompression.type": 1, "forward.matrixCompression.rate": 0.9, "inversion.joint.magn.columnWeightMultiplier": 1.0}
    (p,), log = run(spark, parameters(inputs, "vector", more))
    assert p.value.size == 3 * 90 and p.measured.size == 3 * 64 and p.u.size == 90 and log[-1]["data_magn"] < 0.05 < log[0]["data_before_magn"]
    rows = text.table(spark, f"{inputs}/vector/model/magn_final", ["x", "y", "z"]).orderBy("row").toPandas()
    assert np.allclose(rows[["x", "y", "z"]].to_numpy().T.ravel(), p.value)
    assert b"VECTORS k FLOAT" in (inputs / "vector/pictures/magn_full.vtk").read_bytes()
    direct = parameters(inputs, "direct", more | {"forward.matrixCompression.type": 0, "inversion.nMajorIterations": 0})
    (q,), _ = run(spark, direct)
    tensors = kernels.magnetic_tensors(kernels.pairs(text.observations(spark, f"{inputs}/obs"), cells))
    m = cells.select("cell_id", block.alias("m"))
    lines = kernels.magnetic_lines(tensors, (0.0, 0.0, 1.0), 50000.0, 3, 3).join(m, "cell_id")
    sums = lines.groupBy("obs_id").agg(*(F.sum(F.col("m") * (F.col(f"s1{d}") - F.col(f"s2{d}") + 2 * F.col(f"s3{d}"))).alias(f"d{d}") for d in (1, 2, 3))).orderBy("obs_id").toPandas()
    assert np.allclose(q.measured, sums[["d1", "d2", "d3"]].to_numpy().ravel(), rtol=1e-5, atol=1e-3)


def test_gradient_tensor_run(spark, inputs):
    more = {"forward.data.grav.type": 2, "forward.data.grav.nDataComponents": 6, "inversion.nMajorIterations": 1}
    (p,), _ = run(spark, parameters(inputs, "tensor", more))
    got = kernels.gravity_gradients(text.observations(spark, f"{inputs}/obs"), text.model_grid(spark, f"{inputs}/grid")).join(text.table(spark, f"{inputs}/truth_grav", ["m"]).withColumnRenamed("row", "cell_id"), "cell_id")
    want = got.groupBy("obs_id").agg(*(F.sum(F.col(f"g{c}") * F.col("m")).alias(c) for c in ("xx", "yy", "zz", "xy", "yz", "zx"))).orderBy("obs_id").drop("obs_id").toPandas().to_numpy()
    assert p.measured.size == 6 * 64 and np.allclose(p.measured.reshape(64, 6), want, rtol=1e-5, atol=1e-12)
    assert (inputs / "tensor/pictures/grav_calculated_data.vtk").read_bytes().count(b"FIELD data 6") == 1


def test_prior_models_and_intermediate_models(spark, inputs):
    cells = text.model_grid(spark, f"{inputs}/grid")
    for name, v in (("prior", 10.0), ("prior_2", 40.0)):
        text.write(cells, f"{inputs}/{name}", "cell_id", [F.lit(v)])
    more = {"inversion.priorModel.type": 2, "inversion.priorModel.nModels": 2, "inversion.priorModel.grav.file": f"{inputs}/prior", "inversion.modelDamping.grav.weight": 1e-3, "inversion.nMajorIterations": 2, "inversion.writeModelEveryNiter": 2}
    (p,), _ = run(spark, parameters(inputs, "priors", more))
    assert np.allclose(p.prior, 40)
    final = [text.table(spark, f"{inputs}/{folder}/model/grav_final", ["v"]).agg(F.avg("v")).first()[0] for folder in ("priors", "priors_2")]
    assert final[0] < final[1]
    assert text.table(spark, f"{inputs}/priors/model/grav_inter_2", ["v"]).count() == 90 and not (inputs / "priors/model/grav_inter_1").exists()
    (inputs / "priors/stop").write_text("")
    _, log = run(spark, parameters(inputs, "priors", more))
    assert log == []


def test_cluster_weights_by_cell(spark, inputs):
    cells = text.model_grid(spark, f"{inputs}/grid")
    text.write(cells, f"{inputs}/cell_weights", "cell_id", [F.when(F.col("k") == 1, 0.2).otherwise(0.9), F.when(F.col("k") == 1, 0.8).otherwise(0.1)], "90 2")
    more = {"inversion.clustering.grav.weight": 1e-10, "inversion.clustering.magn.weight": 0.0, "inversion.clustering.mixtureFile": f"{inputs}/mixture", "inversion.clustering.constraintsType": 2, "inversion.clustering.cellWeightsFile": f"{inputs}/cell_weights", "inversion.nMajorIterations": 1}
    (p,), log = run(spark, parameters(inputs, "cells", more))
    assert log[0]["clustering_grav"] > 0 and "clustering_magn" not in log[0]
    got = text.table(spark, f"{inputs}/cells/model/clustering_data", ["f", "fx", "fy", "a", "b"]).orderBy("row").toPandas()
    w = np.where(np.arange(90) // 30 == 1, 0.8, 0.1)
    bell = np.exp(-((p.value - 250) ** 2) / (2 * 40**2)) / np.sqrt(2 * np.pi * 40**2)
    assert np.allclose(got.b, w * np.maximum(bell, 0), rtol=1e-6) and np.allclose(got.f, got.a + got.b)


def test_blocks_of_an_uneven_grid(spark):
    """The loop's operators against the relational blocks, on cells of different sizes."""
    nx, ny, nz = 4, 5, 3
    edges = {a: np.cumsum([0.0, *(1.0 + k * 0.7 for k in range(n))]) for a, n in zip("xyz", (nx, ny, nz))}
    rng = np.random.default_rng(4)
    rows = [(i + nx * (j + ny * k), i, j, k, *(float(edges[a][m + s]) for a, m in zip("xyz", (i, j, k)) for s in (0, 1)), *map(float, rng.random(7))) for k in range(nz) for j in range(ny) for i in range(nx)]
    cells = spark.createDataFrame(rows, "cell_id long, i long, j long, k long, x1 double, x2 double, y1 double, y2 double, z1 double, z2 double, m1 double, m2 double, column_weight double, w double, f_x double, f_y double, f_z double").cache()
    got = cells.orderBy("cell_id").toPandas()
    spacing = tuple((got[f"{a}2"] - got[f"{a}1"]).to_numpy() for a in "xyz")
    n, m1, m2 = nx * ny * nz, got.m1.to_numpy(), got.m2.to_numpy()
    for central, field in ((False, 0), (True, 0), (False, 1), (True, 2)):
        settings = Settings((nx, ny, nz), spacing, central=central, field_of=field, field=got[["f_x", "f_y", "f_z"]].to_numpy().T)
        tau, op = cross_gradient(m1, m2, settings)
        held = constraints.cross_gradient(cells, (nx, ny, nz), central, field=field)
        want = held.orderBy("cell_id").toPandas()
        assert np.allclose(tau, want[["tau_x", "tau_y", "tau_z"]].to_numpy().T.ravel())
        dense = np.zeros((3 * n, 2 * n))
        for r in constraints.cross_gradient_entries(held, 1.0).collect():
            dense["xyz".index(r.axis) * n + r.cell_id, (r.problem - 1) * n + r.col_id] = r.v
        assert np.allclose(np.array([op.apply(e) for e in np.eye(2 * n)]).T, dense) and np.allclose(np.array([op.transposed(e) for e in np.eye(3 * n)]), dense)
    op = differences(Settings((nx, ny, nz), spacing), got.column_weight.to_numpy())
    dense = np.zeros((3 * n, n))
    for at, a in enumerate("xyz"):
        for r in constraints.entries(constraints.damping_gradient(cells.withColumn("w", F.lit(1.0)), "m1", a, 1.0, (nx, ny, nz))).collect():
            dense[at * n + r.row_id, r.col_id] = r.v
    assert np.allclose(np.array([op.apply(e) for e in np.eye(n)]).T, dense)


def test_entries_of_the_loops_cross_gradient():
    """Columns that no row sees together are probed together."""
    dims = (20, 20, 144)
    i, j, k = places(dims)
    for central in (False, True):
        op = cross_gradient(i + 1.0, i + 2.0, Settings(dims, (1.0, 1.0, 1.0), central=central))[1]
        found = 0
        for colour in range(27):
            one = ((i % 3 + 3 * (j % 3) + 9 * (k % 3)) == colour).astype(float)
            found += sum(np.count_nonzero(op.apply(np.concatenate(x))) for x in ((one, 0 * one), (0 * one, one)))
        assert found == 457904


def test_a_point_inside_a_cell(spark, inputs):
    """Bulk lines against the relational form with voids; a small clearance shrinks the void."""
    cells = text.model_grid(spark, f"{inputs}/grid")
    obs = spark.createDataFrame([(0, 230.0, 170.5, 60.2), (1, 100.05, 333.0, 149.0), (2, 10.0, 20.0, -5.0)], "obs_id long, x double, y double, z double")
    got = kernels.kernel_rows(obs, cells, "magnetic", FIELD, 50000.0, 3, 3).collect()
    want = {(r.obs_id, r.cell_id): r for r in kernels.magnetic_lines(kernels.bore_tensors(obs, cells), FIELD, 50000.0, 3, 3).collect()}
    assert len(got) == 27
    for r in got:
        o, d = divmod(r.obs_id, 3)
        assert np.allclose(r.vals, [want[o, c][f"s{r.part + 1}{d + 1}"] for c in range(90)], rtol=1e-9)


def test_kernels_of_grids_in_blocks(spark, inputs):
    cells, obs = text.model_grid(spark, f"{inputs}/grid"), text.observations(spark, f"{inputs}/obs")
    w = np.linspace(1, 2, 90)
    for kind, rate in ((Wavelet.NONE, 1.0), (Wavelet.HAAR, 0.4)):
        out = []
        for most in (1 << 20, 37):
            lines = kernels.kernel_rows(obs, cells, most=most)
            if most == 37:
                assert lines.count() == 64 * 3
                lines = lines.repartition("obs_id", "part").sortWithinPartitions("obs_id", "part", "first")
            out.append(lines_operator(compress.compressed_lines(lines, w, (6, 5, 3), kind, rate), 64, 90).apply(np.arange(90.0)))
        assert np.allclose(*out)
    cells = cells.withColumn("m", F.col("i") * 1.0)
    a, b = (kernels.forward(obs, cells, "m", most=most).orderBy("obs_id").toPandas().d for most in (1 << 20, 20))
    assert np.allclose(a, b)


def test_points_on_edges_are_errors(spark):
    cell = spark.createDataFrame([(0, 0.0, 1.0, 0.0, 1.0, 0.0, 1.0)], "cell_id long, x1 double, x2 double, y1 double, y2 double, z1 double, z2 double")
    on_edge = spark.createDataFrame([(0, 1.0, -5.0, 1.0)], "obs_id long, x double, y double, z double")
    on_face = spark.createDataFrame([(0, 1.0, 0.5, -3.0)], "obs_id long, x double, y double, z double")
    for make in (lambda: kernels.gravity_z(on_edge, cell).collect(), lambda: kernels.magnetic_tensors(kernels.pairs(on_face, cell)).collect(), lambda: kernels.kernel_rows(on_edge, cell).collect(), lambda: kernels.kernel_rows(on_face, cell, "magnetic", FIELD).collect()):
        with pytest.raises(Exception, match="lies on an edge"):
            make()


def test_mixture_derivatives():
    from orefield.operators.constraints import Cluster
    from orefield.plans.inversion import Settings

    clusters = (Cluster(0.6, 1.0, 0.5, 2.0, 0.7, 0.3), Cluster(0.4, 3.0, 0.6, 1.0, 0.4, 0.2))
    x, y, e = np.linspace(0, 4, 9), np.linspace(3, 0, 9), 1e-6
    f, fx, fy = mixture(clusters, x, y)
    assert np.allclose((mixture(clusters, x + e, y)[0] - f) / e, fx, atol=1e-5) and np.allclose((mixture(clusters, x, y + e)[0] - f) / e, fy, atol=1e-5)
    s = Settings((9, 1, 1), (1, 1, 1), clusters=clusters, cluster_weights=(1.0, 2.0))
    (v1, b1), (v2, b2) = clustering(x, y, s)
    assert np.allclose(v1, -fx / f) and np.allclose(v2, -2 * fy / f) and np.allclose(b2, 2 * b1)
