"""Inversion of one or two kinds of data for the properties of cells.

Each major round solves, by least squares, the kernel rows over the constraint rows for a change of the model in weighted form, and
adds it. Kernels are compressed lines on the executors and the driver holds vectors of the length of the model and of the data; only
kernels under a set number of entries come to the driver whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..operators import compress
from ..operators.constraints import Cluster, admm_weight
from ..operators.linalg import Operator, lines_operator, lsqr, stack_operators
from ..operators.wavelet import Wavelet, transform


#: The problems, in the order of the clusters' properties.
NAMES = ("grav", "magn")


@dataclass
class Problem:
    """One kind of data. Models hold `parts` values a cell, part after part, each in the order of cell_id; so do column weights.
    bounds (intervals, cells, 2) or none: for the last part."""

    name: str
    kernel: Operator
    measured: np.ndarray
    data_weight: np.ndarray
    column_weight: np.ndarray
    value: np.ndarray
    prior: np.ndarray
    weight: float = 1.0
    alpha: float = 0.0
    beta: float = 0.0
    rho: float = 0.0
    bounds: np.ndarray | None = None
    z: np.ndarray | None = None
    u: np.ndarray | None = None
    local_damping: np.ndarray | None = None
    local_gradient: np.ndarray | None = None
    bound_weight: np.ndarray | None = None
    parts: int = 1
    costs: list[float] = field(default_factory=list)
    calculated: np.ndarray | None = None


@dataclass(frozen=True)
class Settings:
    """spacing: the cells' sizes along x, y, z, each a number or an array in the order of cell_id. cluster_cells: weights (clusters, cells) in place
    of the clusters' own. field: the gradient (3, cells) that stands for that of model field_of (1 or 2)."""

    dims: tuple[int, int, int]
    spacing: tuple[Any, Any, Any]
    major: int = 10
    minor: int = 100
    least_r: float = 1e-13
    power: float = 2.0
    gamma: float = 0.0
    target_rms: float = 0.0
    wavelet: Wavelet = Wavelet.NONE
    cross_weight: float = 0.0
    rho_threshold: float = 1e-4
    rho_multiplier: float = 1.0
    rho_most: float = 1e10
    keep: tuple[bool, bool] = (False, False)
    clusters: tuple[Cluster, ...] = ()
    cluster_weights: tuple[float, float] = (0.0, 0.0)
    cluster_log: bool = True
    cluster_cells: np.ndarray | None = None
    central: bool = False
    field_of: int = 0
    field: np.ndarray | None = None

    def sizes(self) -> list[np.ndarray]:
        n = math.prod(self.dims)
        return [np.broadcast_to(np.asarray(h, np.float64), n) for h in self.spacing]


def by_part(f: Callable[[np.ndarray], np.ndarray], n: int) -> Callable[[np.ndarray], np.ndarray]:
    """f on each run of n numbers."""
    return lambda x: f(x.reshape(-1, n)).reshape(-1)


def kernel_operator(lines: DataFrame, data: int, dims: tuple[int, int, int], kind: Wavelet, parts: int = 1) -> Operator:
    """Compressed lines as an operator on models of `parts` values a cell."""
    n = math.prod(dims)
    raw = lines_operator(lines, data, n * parts)
    forth = by_part(lambda x: transform(x, dims, kind), n)
    back = by_part(lambda x: transform(x, dims, kind, inverse=True), n)

    def both(x: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y, z = raw.round(forth(x), c, d)
        return y, back(z)

    return Operator(data, n * parts, lambda x: raw.apply(forth(x)), lambda u: back(raw.transposed(u)), raw.both and both)


def numbered_places(obs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """The distinct places (obs_id from 0, x, y, z), and the number of each observation's place, in the order of obs_id."""
    held = obs.select("obs_id", "x", "y", "z").toArrow().to_pandas().sort_values("obs_id")
    spots, place = np.unique(held[["x", "y", "z"]].to_numpy(np.float64), axis=0, return_inverse=True)
    rows = pd.DataFrame({"obs_id": np.arange(len(spots)), "x": spots[:, 0], "y": spots[:, 1], "z": spots[:, 2]})
    return obs.sparkSession.createDataFrame(rows, "obs_id long, x double, y double, z double"), place.reshape(-1)


def shared_rows(a: Operator, place: np.ndarray, data_parts: int = 1) -> Operator:
    """The operator of observations by that of places: observations at one place have the same lines."""
    at = (place[:, None] * data_parts + np.arange(data_parts)).ravel()
    gathered = lambda u: np.bincount(at, u, a.rows)

    def both(x: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y, z = a.round(x, gathered(c), gathered(d))
        return y[at], z

    return Operator(at.size, a.columns, lambda x: a.apply(x)[at], lambda u: a.transposed(gathered(u)), a.both and both)


def problem_of(spark: SparkSession, name: str, obs: DataFrame, cells: DataFrame, measured: np.ndarray, column_weight: np.ndarray, settings: Settings, rate: float = 1.0, field_: tuple[float, float, float] | None = None, intensity: float = 50000.0, parts: int = 1, data_parts: int = 1, kind: str | None = None, **more) -> Problem:
    """Builds, compresses and caches the kernel, a place once. measured is in the order of obs_id, which counts from 0, and of data parts in each; column_weight is one part's."""
    kind = kind or ("magnetic" if field_ else "gravity")
    spots, place = numbered_places(obs)
    lines = compress.packed_lines(spots, cells, column_weight, settings.dims, settings.wavelet, rate, kind, field_, intensity, parts, data_parts)
    kernel = shared_rows(kernel_operator(lines, (int(place.max(initial=-1)) + 1) * data_parts, settings.dims, settings.wavelet, parts), place, data_parts)
    zero = np.zeros(column_weight.size * parts)
    return Problem(name, kernel, measured, np.ones(measured.size), np.tile(column_weight, parts), more.pop("value", zero.copy()), more.pop("prior", zero.copy()), parts=parts, **more)


def unscaled(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.divide(x, w, out=np.zeros_like(x), where=w != 0)


def predicted(p: Problem, value: np.ndarray | None = None) -> np.ndarray:
    """Data of a model: the kernel holds column weights, so the model is taken over them."""
    return p.kernel.apply(unscaled(p.value if value is None else value, p.column_weight))


def diagonal(d: np.ndarray) -> Operator:
    return Operator(d.size, d.size, lambda x: d * x, lambda u: d * u)


def stencil(dims: tuple[int, int, int], own: list[np.ndarray], ahead: list[np.ndarray], behind: list[np.ndarray]) -> Operator:
    """For each axis, own * x + ahead * (the next cell's x) + behind * (the last cell's x); weights that reach out of the grid must be 0."""
    n, strides = math.prod(dims), (1, dims[0], dims[0] * dims[1])

    def apply(x: np.ndarray) -> np.ndarray:
        out = [w * x for w in own]
        for o, s, f, b in zip(out, strides, ahead, behind, strict=True):
            o[: n - s] += f[: n - s] * x[s:]
            o[s:] += b[s:] * x[: n - s]
        return np.concatenate(out)

    def transposed(u: np.ndarray) -> np.ndarray:
        out = np.zeros(n)
        for y, w, s, f, b in zip(np.split(u, 3), own, strides, ahead, behind, strict=True):
            out += w * y
            out[s:] += (f * y)[: n - s]
            out[: n - s] += (b * y)[s:]
        return out

    return Operator(3 * n, n, apply, transposed)


def places(dims: tuple[int, int, int]) -> tuple[np.ndarray, ...]:
    """i, j, k of each cell."""
    at = np.arange(math.prod(dims))
    return at % dims[0], at // dims[0] % dims[1], at // (dims[0] * dims[1])


def scaled_columns(a: Operator, w: np.ndarray) -> Operator:
    return Operator(a.rows, a.columns, lambda x: a.apply(w * x), lambda u: w * a.transposed(u))


def differences(settings: Settings, w: np.ndarray) -> Operator:
    """Forward differences along the three axes of w * x, each over the cell's own size; nothing for the last cell of an axis."""
    slope = [np.where(at < n - 1, 1 / h, 0.0) for at, n, h in zip(places(settings.dims), settings.dims, settings.sizes(), strict=True)]
    return scaled_columns(stencil(settings.dims, [-g for g in slope], slope, [np.zeros_like(g) for g in slope]), w)


def placed(a: Operator, at: int, columns: int) -> Operator:
    """A on columns at, at + 1, ... of a longer vector."""

    def transposed(u: np.ndarray) -> np.ndarray:
        out = np.zeros(columns)
        out[at : at + a.columns] = a.transposed(u)
        return out

    def both(x: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = np.zeros(columns)
        y, out[at : at + a.columns] = a.round(x[at : at + a.columns], c, d)
        return y, out

    return Operator(a.rows, columns, lambda x: a.apply(x[at : at + a.columns]), transposed, a.both and both)


def scaled_rows(a: Operator, d: np.ndarray) -> Operator:
    def both(x: np.ndarray, c: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y, z = a.round(x, c * d * d, e * d)
        return d * y, z

    return Operator(a.rows, a.columns, lambda x: d * a.apply(x), lambda u: a.transposed(d * u), a.both and both)


def cross_differences(settings: Settings) -> Operator:
    """Differences of the cross-gradient: none in cells on a first and a last face, backward on a last face, else forward, or central away from the faces."""
    at = places(settings.dims)
    left = np.any([a == 0 for a in at], axis=0)
    right = np.any([a == n - 1 for a, n in zip(at, settings.dims, strict=True)], axis=0)
    back, central = right & ~left, settings.central & ~left & ~right
    forward = ~right & ~central
    ahead = [(forward + 0.5 * central) / h for h in settings.sizes()]
    behind = [-(back + 0.5 * central) / h for h in settings.sizes()]
    return stencil(settings.dims, [-(f + b) for f, b in zip(ahead, behind, strict=True)], ahead, behind)


def cross_gradient(a: np.ndarray, b: np.ndarray, settings: Settings) -> tuple[np.ndarray, Operator]:
    """tau of two models and its derivative by both (before column weights), as the relational form has them. A gradient that is given
    stands for its model's; the derivative by that model is still that of its differences."""
    n = a.size
    d = cross_differences(settings)
    ga, gb = d.apply(a), d.apply(b)
    if settings.field_of:
        faces = [[x == 0, x == m - 1] for x, m in zip(places(settings.dims), settings.dims, strict=True)]
        none = np.any([f[0] for f in faces], axis=0) & np.any([f[1] for f in faces], axis=0)
        given = np.where(none, 0.0, settings.field).ravel()
        ga, gb = (given, gb) if settings.field_of == 1 else (ga, given)
    split = lambda g: np.split(g, 3)

    def cross(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        (px, py, pz), (qx, qy, qz) = split(p), split(q)
        return np.concatenate([py * qz - pz * qy, pz * qx - px * qz, px * qy - py * qx])

    def apply(x: np.ndarray) -> np.ndarray:
        return cross(d.apply(x[:n]), gb) + cross(ga, d.apply(x[n:]))

    def transposed(t: np.ndarray) -> np.ndarray:
        # (p x q) . t = p . (q x t) = q . (t x p)
        return np.concatenate([d.transposed(cross(gb, t)), d.transposed(cross(t, ga))])

    return cross(ga, gb), Operator(3 * n, 2 * n, apply, transposed)


def bells(clusters: tuple[Cluster, ...], x: np.ndarray, y: np.ndarray, active: tuple[bool, bool] = (True, True)) -> np.ndarray:
    """Each cluster's density (clusters, places), as the relational form has it."""
    out = []
    for c in clusters:
        a, b, e = c.sigma1**2, c.sigma2**2, c.sigma12**2
        dx, dy = x - c.mu1, y - c.mu2
        if all(active):
            det = a * b - e * e
            arg, norm = -(b * dx * dx - 2 * e * dx * dy + a * dy * dy) / (2 * det), 2 * math.pi * math.sqrt(det)
        else:
            s, gap = (a, dx) if active[0] else (b, dy)
            arg, norm = -gap * gap / (2 * s), math.sqrt(2 * math.pi * s)
        out.append(np.where(arg < -100, math.exp(-100), np.exp(np.maximum(arg, -100)) / norm))
    return np.array(out)


def mixture(clusters: tuple[Cluster, ...], x: np.ndarray, y: np.ndarray, active: tuple[bool, bool] = (True, True), cells: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Density and derivatives; cells: the clusters' weights (clusters, places) in place of the common ones."""
    g = bells(clusters, x, y, active) * (np.array([[c.weight] for c in clusters]) if cells is None else cells)
    fx, fy = np.zeros_like(x), np.zeros_like(x)
    for c, own in zip(clusters, g, strict=True):
        a, b, e = c.sigma1**2, c.sigma2**2, c.sigma12**2
        det, dx, dy = a * b - e * e, x - c.mu1, y - c.mu2
        fx, fy = fx - own * (b * dx - e * dy) / det, fy - own * (a * dy - e * dx) / det
    return g.sum(axis=0), fx, fy


def mixture_top(settings: Settings, active: tuple[bool, bool]) -> np.ndarray:
    """The largest density at a cluster's centre, by the weights of each cell."""
    centres = np.array([[c.mu1, c.mu2] for c in settings.clusters])
    cells = np.array([[c.weight] for c in settings.clusters]) if settings.cluster_cells is None else settings.cluster_cells
    g = bells(settings.clusters, centres[:, 0], centres[:, 1], active)  # (clusters, centres)
    return np.maximum(0.0, np.einsum("ci,cn->in", g, cells).max(axis=0))


def clustering(x: np.ndarray, y: np.ndarray, settings: Settings) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each problem the diagonal (before column weights) and the right-hand side."""
    active = tuple(w != 0 for w in settings.cluster_weights)
    f, fx, fy = mixture(settings.clusters, x, y, active, settings.cluster_cells)
    top = mixture_top(settings, active)
    if settings.cluster_log:
        safe = np.where(f > 0, f, 1)
        gap, slopes = np.where(f > 0, np.log(np.maximum(top, 1e-300)) - np.log(safe), 0), [np.where(f != 0, -s / safe, 0) for s in (fx, fy)]
    else:
        gap, slopes = f - top, [fx, fy]
    return [(w * s, -w * gap) for w, s in zip(settings.cluster_weights, slopes, strict=True)]


def projected(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    lo, hi = bounds[..., 0], bounds[..., 1]
    ends = np.stack([lo, hi], axis=1).reshape(-1, x.size)
    near = ends[np.abs(ends - x).argmin(axis=0), np.arange(x.size)]
    return np.where(((lo <= x) & (x <= hi)).any(axis=0), x, near)


def data_cost(p: Problem) -> float:
    whole = float(np.linalg.norm(p.measured))
    return float(np.linalg.norm(p.calculated - p.measured)) / whole if whole else math.nan


def model_cost(p: Problem, power: float) -> float:
    """Of the first part."""
    n = p.value.size // p.parts
    return float((np.abs(unscaled(p.value - p.prior, p.column_weight)[:n]) ** power).sum())


def both_values(problems: list[Problem]) -> tuple[np.ndarray, np.ndarray]:
    """The properties that clusters are in: a problem that is not solved stands as 0."""
    held = {p.name: p.value for p in problems}
    zero = np.zeros_like(problems[0].value)
    return (problems[0].value, problems[1].value) if len(problems) == 2 else tuple(held.get(n, zero) for n in NAMES)  # type: ignore[return-value]


def step(problems: list[Problem], settings: Settings) -> dict[str, float]:
    """One major round, in place; the round's costs: of the model that it starts from and of its constraints, and data_* of the model that it ends with."""
    n = math.prod(settings.dims)
    starts = np.cumsum([0] + [p.value.size for p in problems])
    columns = int(starts[-1])
    parts: list[Operator] = []
    rhs: list[np.ndarray] = []
    costs: dict[str, float] = {}

    def add(a: Operator, b: np.ndarray, name: str) -> None:
        parts.append(a)
        rhs.append(b)
        costs[name] = costs.get(name, 0.0) + float(b @ b)

    for at, p in zip(starts, problems, strict=False):
        if p.calculated is None:
            p.calculated = predicted(p)
        costs |= {f"data_before_{p.name}": data_cost(p), f"model_{p.name}": model_cost(p, settings.power)}
        w = p.weight * p.data_weight
        add(placed(scaled_rows(p.kernel, w), at, columns), w * (p.measured - p.calculated), f"residual_{p.name}")
    data_rows = sum(b.size for b in rhs)
    for at, p in zip(starts, problems, strict=False):
        for k in range(p.parts):
            own, here = slice(k * n, (k + 1) * n), int(at) + k * n
            if p.alpha:
                diff = unscaled((p.value - p.prior)[own], p.column_weight[own])
                d = np.full(n, p.alpha * p.weight)
                if settings.power != 2:
                    d = d * np.where(diff != 0, np.abs(np.where(diff != 0, diff, 1)) ** (settings.power / 2 - 1), 1)
                if p.local_damping is not None:
                    d = d * p.local_damping
                add(placed(diagonal(d), here, columns), -d * diff, f"damping_{p.name}")
            if p.beta:
                grad = differences(settings, np.ones(n)).apply(p.value[own])
                rows = np.full(3 * n, p.weight * p.beta) if p.local_gradient is None else p.weight * p.beta * p.local_gradient
                add(placed(scaled_rows(differences(settings, p.column_weight[own]), rows), here, columns), -rows * grad, f"gradient_{p.name}")
                for a, g in zip("xyz", np.split(grad, 3), strict=True):
                    costs[f"gradient_{a}_{p.name}"] = costs.get(f"gradient_{a}_{p.name}", 0.0) + float(g @ g)
    for at, p in zip(starts, problems, strict=False):
        if p.bounds is not None:
            own = slice((p.parts - 1) * n, p.parts * n)  # the only part, or z
            value = p.value[own]
            p.u = np.zeros(n) if p.u is None else p.u
            p.z = projected(value + p.u, p.bounds)
            p.u = p.u + value - p.z
            diff = unscaled(value - (p.z - p.u), p.column_weight[own])
            d = np.full(n, p.rho * p.weight) if p.bound_weight is None else p.rho * p.weight * p.bound_weight
            add(placed(diagonal(d), int(at) + own.start, columns), -d * diff, f"admm_{p.name}")
            whole = float(np.linalg.norm(p.z))
            costs |= {f"admm_cost_{p.name}": float(np.linalg.norm(value - p.z)) / whole if whole else 0.0, f"admm_weight_{p.name}": p.rho}
    if settings.cross_weight and len(problems) == 2:
        tau, derivative = cross_gradient(problems[0].value, problems[1].value, settings)
        w = np.concatenate([p.column_weight * (not k) for p, k in zip(problems, settings.keep, strict=True)])
        scaled = Operator(derivative.rows, columns, lambda x: settings.cross_weight * derivative.apply(w * x), lambda u: settings.cross_weight * w * derivative.transposed(u))
        add(scaled, -settings.cross_weight * tau, "cross_gradient")
        costs |= {f"cross_{a}": float(t @ t) for a, t in zip("xyz", np.split(tau, 3), strict=True)}
    if settings.clusters:
        blocks = clustering(*both_values(problems), settings)
        for k, (at, p) in enumerate(zip(starts, problems, strict=False)):
            own = k if len(problems) == 2 else NAMES.index(p.name)
            v, b = blocks[own]
            if settings.cluster_weights[own]:
                add(placed(diagonal(v * p.column_weight), at, columns), b, f"clustering_{p.name}")
    got = lsqr(stack_operators(parts), np.concatenate(rhs), settings.minor, settings.least_r, settings.gamma, settings.target_rms, data_rows)
    for at, p in zip(starts, problems, strict=False):
        p.value = p.value + got.x[at : at + p.value.size] * p.column_weight
        p.calculated = predicted(p)
        p.costs.append(data_cost(p))
        costs[f"data_{p.name}"] = p.costs[-1]
        if p.bounds is not None:
            p.rho = admm_weight(p.rho, p.costs[-1], settings.rho_threshold, settings.rho_multiplier, settings.rho_most)
    return costs


def invert(problems: list[Problem], settings: Settings, stopped: Callable[[], bool] | None = None, after: Callable[[int], None] | None = None) -> list[dict[str, float]]:
    """All major rounds; ends early when `stopped` says so. One row of costs a round; after(round) runs when a round is done."""
    log = []
    for k in range(settings.major):
        if stopped and stopped():
            break
        log.append({"round": float(k + 1)} | step(problems, settings))
        if after:
            after(k + 1)
    return log


def begin(problems: list[Problem], start: list[np.ndarray], prior: list[np.ndarray], keep_multipliers: bool = False) -> None:
    """Sets the problems to a starting and a prior model; interval multipliers begin anew unless kept."""
    for p, v, q in zip(problems, start, prior, strict=True):
        p.value, p.prior, p.costs, p.calculated = v.copy(), q, [], None
        if not keep_multipliers:
            p.u = None


def invert_each(problems: list[Problem], priors: list[list[np.ndarray]], settings: Settings, keep_multipliers: bool = False) -> list[tuple[list[np.ndarray], list[dict[str, float]]]]:
    """The same data with several prior models, each from the problems' starting model; penalty weights go on as they have become."""
    start, out = [p.value.copy() for p in problems], []
    for prior in priors:
        begin(problems, start, prior, keep_multipliers)
        log = invert(problems, settings)
        out.append(([p.value.copy() for p in problems], log))
    return out
