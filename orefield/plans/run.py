"""A run from a parameter file: grids and data are read, kernels built or read, models inverted, results written."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import direction_cosines, size
from ..operators import compress, kernels, weights
from ..operators.constraints import Cluster, normalised_clusters
from ..operators.stencil import Scheme
from ..operators.wavelet import Wavelet
from ..sources import files, folders, text
from .config import Config
from .inversion import Problem, Settings, begin, bells, both_values, cross_gradient, invert, kernel_operator, mixture, model_cost, predicted, unscaled

#: The cost file's columns, and where the log of a round has them.
COSTS = {"iteration": "", "data_cost_grav": "data_before_grav", "data_cost_mag": "data_before_magn", "model_cost_grav": "model_grav", "model_cost_mag": "model_magn", "ADMM_cost_grav": "admm_cost_grav", "ADMM_cost_mag": "admm_cost_magn",
    "ADMM_weight_grav": "admm_weight_grav", "ADMM_weight_mag": "admm_weight_magn", **{f"damp_gradient_cost_{a}_{p}": f"gradient_{a}_{q}" for p, q in (("grav", "grav"), ("mag", "magn")) for a in "xyz"},
    **{f"cross_grad_cost_{a}": f"cross_{a}" for a in "xyz"}, "clustering_cost_grav": "clustering_grav", "clustering_cost_mag": "clustering_magn"}


def column(rows: DataFrame, key: str, value: str) -> np.ndarray:
    """A column in the order of its key, as long as the model or the data."""
    return rows.select(key, value).orderBy(key).toPandas()[value].to_numpy(np.float64)


def column_weights(spark: SparkSession, c: Config, p: str, cells: DataFrame, obs: DataFrame) -> DataFrame:
    kind, power = c["forward.depthWeighting.type"], c.of("forward.depthWeighting.@.power", p)
    if kind == 1:
        w = weights.depth(cells, power, c.of("forward.depthWeighting.@.Z0", p))
        if w.where("weight is null").limit(1).count():
            raise ValueError("a cell has no positive depth")
    elif kind == 2:
        w = weights.distance(cells, obs, power, c.of("forward.depthWeighting.@.beta", p))
    elif kind == 3:
        w = weights.nearest(cells, obs, power)
    else:
        raise ValueError(f"depth weighting {kind} is not known")
    out = weights.column_weight(w, cells, c.of("inversion.joint.@.columnWeightMultiplier", p))
    if c["forward.depthWeighting.applyLocalWeight"]:
        local = text.table(spark, c.of("forward.depthWeighting.@.file", p), ["w"]).withColumnRenamed("row", "cell_id")
        out = weights.with_local(out, local)
    return out


def several(spark: SparkSession, path: str, parts: int, units: float = 1.0) -> np.ndarray:
    """Values of `parts` columns, part after part."""
    names = [f"v{k}" for k in range(parts)]
    rows = text.table(spark, path, names, units).orderBy("row").toPandas()
    return np.concatenate([rows[n].to_numpy(np.float64) for n in names])


def model_of(spark: SparkSession, c: Config, p: str, which: str, n: int, parts: int, units: float, number: int = 1) -> np.ndarray:
    """A model of one value, or from a file; the files of prior models after the first end in their number."""
    if c[f"inversion.{which}.type"] == 1:
        return np.full(n * parts, c[f"inversion.{which}.{p}.value"] * units)
    path = c[f"inversion.{which}.{p}.file"]
    return several(spark, path if number == 1 else f"{path}_{number}", parts, units)


def parts_of(c: Config, p: str) -> tuple[int, int]:
    """Values a cell and values an observation."""
    return c["modelGrid.magn.nModelComponents"] if p == "magn" else 1, c.of("forward.data.@.nDataComponents", p)


def problem_from(spark: SparkSession, c: Config, p: str) -> tuple[Problem, DataFrame, DataFrame]:
    """The problem, its cells and its observations."""
    dims, down = tuple(c["modelGrid.size"]), c["global.zAxisDirection"] == 1
    cells = text.model_grid(spark, c.of("modelGrid.@.file", p), down, dims).cache()
    units, model_units = c.of("global.@.dataUnitsMultiplier", p), c.of("global.@.modelUnitsMultiplier", p)
    synthetic = bool(c.of("forward.data.@.useSyntheticModelForDataValues", p))
    values = c.of("forward.data.@.dataValuesFile", p) or c.of("forward.data.@.dataGridFile", p)
    parts, data_parts = parts_of(c, p)
    obs = text.observations(spark, values, 0 if synthetic else data_parts, units, down).cache()
    n_data, n = obs.count(), int(np.prod(dims))
    if n_data != c.of("forward.data.@.nData", p) or cells.count() != n:
        raise ValueError("the files' sizes are not those of the parameters")
    kind, rate = Wavelet(c["forward.matrixCompression.type"]), c["forward.matrixCompression.rate"]
    about = {"dims": list(dims), "data": n_data, "wavelet": kind.value, "rate": rate, "parts": [parts, data_parts]}
    folder = c["sensit.folderPath"] if c["sensit.readFromFiles"] == 1 else f"{c['global.outputFolderPath'].rstrip('/')}/SENSIT"
    if c["sensit.readFromFiles"] != 1:
        w = column_weights(spark, c, p, cells, obs)
        field = direction_cosines(c["forward.magneticField.inclination"], c["forward.magneticField.declination"], c["forward.magneticField.XaxisDeclination"])
        form = "magnetic" if p == "magn" else "gradient" if c["forward.data.grav.type"] == 2 else "gravity"
        lines = kernels.kernel_rows(obs, cells, form, field, c["forward.magneticField.intensity_nT"], parts, data_parts)
        lines = compress.compressed_lines(lines, column(w, "cell_id", "column_weight"), dims, kind, rate)
        files.write_kernel(lines, w, folder, p, about)
    lines, w = files.read_kernel(spark, folder, p, about)
    rows = n_data * data_parts
    kernel = kernel_operator(lines, rows, dims, kind, parts)
    prior, start = (model_of(spark, c, p, which, n, parts, model_units) for which in ("priorModel", "startingModel"))
    out = Problem(p, kernel, np.zeros(rows), np.ones(rows), np.tile(column(w, "cell_id", "column_weight"), parts), start, prior, c.of("inversion.joint.@.problemWeight", p), c.of("inversion.modelDamping.@.weight", p), c.of("inversion.dampingGradient.@.weight", p), c.of("inversion.admm.@.weight", p), parts=parts)
    if synthetic:
        out.measured = predicted(out, several(spark, c.of("forward.data.@.syntheticModelFile", p), parts, model_units))
    else:
        out.measured = np.array(obs.select("obs_id", "v").orderBy("obs_id").toPandas().v.tolist(), np.float64).ravel()
    if c.of("forward.data.@.useError", p):
        errors = several(spark, c.of("forward.data.@.errorFile", p), data_parts).reshape(data_parts, n_data).T.ravel()
        out.data_weight = 1 / (units * errors)
    if c["inversion.modelDamping.applyLocalWeight"]:
        out.local_damping = column(text.table(spark, c.of("inversion.modelDamping.@.file", p), ["w"]), "row", "w")
    if c["inversion.dampingGradient.weightType"] == 2:
        three = text.table(spark, c.of("inversion.dampingGradient.@.weightsFile", p), ["x", "y", "z"])
        out.local_gradient = np.concatenate([column(three, "row", a) for a in "xyz"])
    if c["inversion.admm.enableADMM"]:
        given = text.global_bounds(cells, c.of("inversion.admm.@.bounds", p), model_units) if c["inversion.admm.boundType"] == 1 else text.bounds(spark, c.of("inversion.admm.@.boundsFile", p), model_units)
        held = given.select("cell_id", "bounds", "w").orderBy("cell_id").toPandas()
        out.bounds = np.array([[(b["lo"], b["hi"]) for b in row] for row in held.bounds], np.float64).transpose(1, 0, 2)
        out.bound_weight = held.w.to_numpy(np.float64)
    return out, cells, obs


def clusters_from(spark: SparkSession, c: Config) -> list[Cluster]:
    rows = text.table(spark, c["inversion.clustering.mixtureFile"], ["w", "mu1", "s1", "mu2", "s2", "s12"]).orderBy("row").collect()
    return normalised_clusters([Cluster(r.w, r.mu1, r.s1, r.mu2, r.s2, r.s12) for r in rows])


def settings_from(spark: SparkSession, c: Config, cells: DataFrame) -> Settings:
    """Each cell has its own size."""
    n, of = int(np.prod(c["modelGrid.size"])), c["inversion.crossGradient.vectorFieldType"]
    spacing = tuple(column(cells.select("cell_id", size(a).alias("h")), "cell_id", "h") for a in "xyz")
    weights_ = (c["inversion.clustering.grav.weight"], c["inversion.clustering.magn.weight"])
    clusters = tuple(clusters_from(spark, c)) if max(weights_) > 0 else ()
    own = c["inversion.clustering.cellWeightsFile"] if clusters and c["inversion.clustering.constraintsType"] != 1 else ""
    return Settings(
        tuple(c["modelGrid.size"]), spacing, c["inversion.nMajorIterations"], c["inversion.nMinorIterations"], c["inversion.minResidual"], c["inversion.modelDamping.normPower"],
        c["inversion.softThresholdL1"], c["inversion.targetMisfit"], Wavelet(c["forward.matrixCompression.type"]), c["inversion.crossGradient.weight"], c["inversion.admm.dataCostThreshold"], c["inversion.admm.weightMultiplier"], c["inversion.admm.maxWeight"],
        (bool(c["inversion.crossGradient.grav.keepModelConstant"]), bool(c["inversion.crossGradient.magn.keepModelConstant"])), clusters, weights_, c["inversion.clustering.optimizationType"] == 2,
        several(spark, own, len(clusters)).reshape(len(clusters), n) if own else None, Scheme.of_code(c["inversion.crossGradient.derivativeType"]) is Scheme.CENTRAL, of,
        several(spark, c["inversion.crossGradient.vectorFieldFile"], 3).reshape(3, n) if of else None)


def with_values(rows: DataFrame, key: str, values: np.ndarray, parts: int, units: float, by_part: bool) -> tuple[DataFrame, list[str]]:
    """rows with columns v1, v2, ...: values part after part, or all parts of a row beside each other."""
    table = values.reshape(parts, -1).T if by_part else values.reshape(-1, parts)
    names = [f"v{k + 1}" for k in range(parts)]
    made = rows.sparkSession.createDataFrame([(k, *map(float, v)) for k, v in enumerate(table / units)], ", ".join([f"{key} long", *(f"{n} double" for n in names)]))
    return rows.join(made, key), names


def write_data(c: Config, p: Problem, obs: DataFrame, folder: str, which: str, values: np.ndarray) -> None:
    rows, names = with_values(obs.drop("v"), "obs_id", values, parts_of(c, p.name)[1], c.of("global.@.dataUnitsMultiplier", p.name), False)
    text.write(rows, f"{folder}/data/{p.name}_{which}", "obs_id", [F.col(x) for x in ("x", "y", "z", *names)])
    folders.write_bytes(rows.sparkSession, f"{folder}/pictures/{p.name}_{which}_data.vtk", files.points(rows, names, "data"))


def write_model(c: Config, name: str, cells: DataFrame, folder: str, which: str, values: np.ndarray, parts: int, units: float, label: str, pictures: bool = True) -> None:
    rows, names = with_values(cells, "cell_id", values, parts, units, True)
    text.write(rows, f"{folder}/model/{name}_{which}", "cell_id", [F.col(x) for x in names])
    if pictures:
        for part, held in files.slices(rows, tuple(c["modelGrid.size"])).items():
            body = files.structured_grid(held, names, label)
            folders.write_bytes(cells.sparkSession, f"{folder}/pictures/{name}_{part}.vtk" if which == "final" else f"{folder}/pictures/{name}_{which}_{part}.vtk", body)


def write_costs(spark: SparkSession, folder: str, problems: list[Problem], log: list[dict[str, float]], power: float) -> None:
    """A row for each round, of the model that it starts from, and one of the model that the last ends with, which has no constraints' costs."""
    rows = [(x["round"] - 1, *(float(x.get(k, 0.0)) for k in list(COSTS.values())[1:])) for x in log]
    last = {f"data_before_{p.name}": p.costs[-1] if p.costs else 0.0 for p in problems} | {f"model_{p.name}": model_cost(p, power) for p in problems}
    rows.append((float(len(log)), *(float(last.get(k, 0.0)) for k in list(COSTS.values())[1:])))
    spark.createDataFrame(rows, ", ".join(f"{k} double" for k in COSTS)).coalesce(1).write.mode("overwrite").csv(f"{folder}/costs", header=True)


def write_joint(spark: SparkSession, c: Config, problems: list[Problem], cells: DataFrame, folder: str, settings: Settings) -> None:
    """What both models give together: the cross-gradient's size, and each cell's probability, its derivatives and its clusters' parts."""
    if settings.cross_weight and len(problems) == 2:
        tau = cross_gradient(problems[0].value, problems[1].value, settings)[0]
        write_model(c, "cross_grad", cells, folder, "final", np.linalg.norm(tau.reshape(3, -1), axis=0), 1, 1.0, "cross_grad")
    if settings.clusters:
        x, y = both_values(problems)
        active = tuple(w != 0 for w in settings.cluster_weights)
        own = bells(settings.clusters, x, y, active) * (np.array([[k.weight] for k in settings.clusters]) if settings.cluster_cells is None else settings.cluster_cells)
        f, fx, fy = mixture(settings.clusters, x, y, active, settings.cluster_cells)
        if settings.cluster_log:
            fx, fy = (np.where(f != 0, -s / np.where(f != 0, f, 1), 0) for s in (fx, fy))
        write_model(c, "clustering", cells, folder, "final", f, 1, 1.0, "probability")
        write_model(c, "clustering", cells, folder, "data", np.concatenate([f, fx, fy, *own]), 3 + len(own), 1.0, "data", pictures=False)


def run(spark: SparkSession, path: str) -> tuple[list[Problem], list[dict[str, float]]]:
    """Reads the parameters at path and does what they ask, for each prior model; with no major rounds only the forward results are written.

    Results of prior models after the first go to folders that end in their number. A file named stop in the first folder ends the rounds. Returns
    the problems and the costs as the last prior model leaves them.
    """
    c = files.read_config(spark, path)
    built = [problem_from(spark, c, p) for p in c.active()]
    problems = [b[0] for b in built]
    if not problems:
        raise ValueError("no problem has a weight")
    base = c["global.outputFolderPath"].rstrip("/")
    folders.copy(spark, path, base)
    settings, start, log = settings_from(spark, c, built[0][1]), [p.value.copy() for p in problems], []
    n, every = int(np.prod(settings.dims)), c["inversion.writeModelEveryNiter"]
    units = {p.name: c.of("global.@.modelUnitsMultiplier", p.name) for p in problems}
    labels = {p.name: c.of("output.paraview.@.modelLabel", p.name) for p in problems}
    for number in range(1, c["inversion.priorModel.nModels"] + 1):
        folder = base if number == 1 else f"{base}_{number}"
        if number > 1:
            begin(problems, start, [model_of(spark, c, p.name, "priorModel", n, p.parts, units[p.name], number) for p in problems])
        for p, cells, obs in built:
            write_data(c, p, obs, folder, "observed", p.measured)
            write_data(c, p, obs, folder, "prior", predicted(p, p.prior))
            write_data(c, p, obs, folder, "starting", predicted(p))
            write_model(c, p.name, cells, folder, "prior", p.prior, p.parts, units[p.name], labels[p.name], c["inversion.priorModel.type"] > 1)

        def after(k: int, folder: str = folder) -> None:
            if every and k % every == 0:
                for p, cells, _ in built:
                    write_model(c, p.name, cells, folder, f"inter_{k}", p.value, p.parts, units[p.name], labels[p.name], pictures=False)

        log = invert(problems, settings, lambda: folders.exists(spark, f"{base}/stop"), after)
        for p, cells, obs in built:
            p.calculated = predicted(p) if p.calculated is None else p.calculated
            write_data(c, p, obs, folder, "calculated", p.calculated)
            write_data(c, p, obs, folder, "misfit", p.measured - p.calculated)
            write_model(c, p.name, cells, folder, "final", p.value, p.parts, units[p.name], labels[p.name])
        if log:
            write_costs(spark, folder, problems, log, settings.power)
        write_joint(spark, c, problems, built[0][1], folder, settings)
    return problems, log


__all__ = ["column", "problem_from", "run", "unscaled"]
