"""Constraint blocks: each yields matrix rows (row_id, col_id, v) and a right-hand side (row_id, b)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import norm_multiplier, size, unscaled
from .stencil import AXES, Scheme, gradient, shifted


def damping(rows: DataFrame, alpha: float, problem_weight: float = 1.0, power: float = 2.0, local: str | None = None) -> DataFrame:
    """rows(cell_id, value, reference, column_weight) to row_id, col_id, v, b; diagonal."""
    diff = unscaled(F.col("value") - F.col("reference"), F.col("column_weight"))
    v = F.lit(alpha * problem_weight)
    if power != 2.0:
        v = v * norm_multiplier(diff, power)
    if local:
        v = v * F.col(local)
    return rows.select(F.col("cell_id").alias("row_id"), F.col("cell_id").alias("col_id"), v.alias("v"), (-v * diff).alias("b"))


def damping_gradient(cells: DataFrame, value: str, axis: str, beta: float, lengths: tuple[int, int, int], problem_weight: float = 1.0) -> DataFrame:
    """cells (boxes, value, column_weight, local weight w) to row_id, axis, own, next, v_own, v_next, b, g; a row for each cell with a
    neighbour ahead (the last cell of an axis has an empty row)."""
    n = dict(zip("xyz", lengths, strict=True))[axis]
    stride = {"x": 1, "y": lengths[0], "z": lengths[0] * lengths[1]}[axis]
    scale, g = problem_weight * beta, gradient(value, axis, Scheme.FORWARD, n)
    ahead = shifted(F.col("column_weight"), axis, 1)
    full = cells.withColumns({"g": g, "ahead": ahead}).where(F.col(AXES[axis][0]) < n - 1)
    return full.select(F.col("cell_id").alias("row_id"), F.lit(axis).alias("axis"), F.col("cell_id").alias("own"), (F.col("cell_id") + stride).alias("next"),
        (-scale / size(axis) * F.col("column_weight") * F.col("w")).alias("v_own"), (scale / size(axis) * F.col("ahead") * F.col("w")).alias("v_next"), (-scale * F.col("g") * F.col("w")).alias("b"), "g")


def entries(block: DataFrame) -> DataFrame:
    """A two-entry block as matrix rows, zeros left out."""
    two = F.array(F.struct(F.col("own").alias("c"), F.col("v_own").alias("v")), F.struct(F.col("next").alias("c"), F.col("v_next").alias("v")))
    return block.select("row_id", F.explode(two).alias("e")).select("row_id", F.col("e.c").alias("col_id"), F.col("e.v").alias("v")).where("v <> 0")


# disjoint intervals


def projection(x: Column, bounds: Column) -> Column:
    """x if it lies in an interval of bounds (array of lo, hi), else the nearest end; the first of equals."""
    ends = F.flatten(F.transform(bounds, lambda b: F.array(b["lo"], b["hi"])))
    start = F.struct(F.lit(float("inf")).alias("d"), F.lit(None).cast("double").alias("e"))
    near = F.aggregate(ends, start, lambda best, e: F.when(F.abs(e - x) < best["d"], F.struct(F.abs(e - x).alias("d"), e.alias("e"))).otherwise(best))
    return F.when(F.exists(bounds, lambda b: (b["lo"] <= x) & (x <= b["hi"])), x).otherwise(near["e"])


def admm_step(rows: DataFrame, bounds: str = "bounds") -> DataFrame:
    """rows(…, x, u, bounds) with z = P(x + u), the new u = u + x - z, and x0 = z - u to damp towards."""
    z = projection(F.col("x") + F.col("u"), F.col(bounds))
    out = rows.withColumn("z", z).withColumn("u", F.col("u") + F.col("x") - F.col("z"))
    return out.withColumn("x0", F.col("z") - F.col("u"))


def admm_weight(rho: float, cost: float, threshold: float, multiplier: float, most: float) -> float:
    """The next penalty weight."""
    return rho * multiplier if cost < threshold and rho < most and multiplier != 1 else rho


# cross-gradient


def cross_gradient(cells: DataFrame, lengths: tuple[int, int, int], central: bool = False, keep: tuple[bool, bool] = (False, False), field: int = 0) -> DataFrame:
    """cells (boxes, m1, m2) to cell_id, tau_x..tau_z, and d: entries (row axis, col_id, problem, v) of the derivatives.

    Cells on a first and a last face have none; on a last face differences go backward; central differences go forward on a
    first face. Each difference has a small stencil, and tau = grad m1 x grad m2 is linear in either, so an entry is the other
    gradient's part times the stencil's weight. field 1 or 2: the columns f_x, f_y, f_z stand for that model's gradient; its entries stay
    those of the model's own differences, unless it is kept.
    """
    names = list(zip("xyz", "ijk", lengths, strict=True))
    left = F.lit(False)
    right = F.lit(False)
    for _, index, n in names:
        left, right = left | (F.col(index) == 0), right | (F.col(index) == n - 1)
    kind = F.when(left & right, "none").when(right, "backward").when(left, "forward").otherwise("central" if central else "forward")
    schemes = [Scheme.FORWARD, Scheme.BACKWARD] + [Scheme.CENTRAL] * central
    rows, slopes = cells.withColumn("kind", kind), {}
    for m in ("m1", "m2"):
        for a, _, n in names:
            g = F.lit(0.0)
            for s in schemes:
                g = F.when(F.col("kind") == s.value, gradient(m, a, s, n)).otherwise(g)
            slopes[f"{m}_{a}"] = F.when(F.col("kind") != "none", F.col(f"f_{a}")).otherwise(0.0) if m == f"m{field}" else g
    rows = rows.withColumns(slopes)  # at once, so that each axis is one window for both models and all schemes
    tau = {a: F.col(f"m1_{p}") * F.col(f"m2_{q}") - F.col(f"m1_{q}") * F.col(f"m2_{p}") for a, (p, q) in zip("xyz", ("yz", "zx", "xy"), strict=True)}
    stride = {"x": 1, "y": lengths[0], "z": lengths[0] * lengths[1]}
    found = []
    for a, (p, q) in zip("xyz", ("yz", "zx", "xy"), strict=True):
        # tau_a = m1_p * m2_q - m1_q * m2_p: the derivative by an m1 on the p stencil is weight * m2_q, and so on
        for problem, along, factor in ((1, p, F.col(f"m2_{q}")), (1, q, -F.col(f"m2_{p}")), (2, q, F.col(f"m1_{p}")), (2, p, -F.col(f"m1_{q}"))):
            if keep[problem - 1]:
                continue
            h = size(along)
            ahead = F.when(F.col("kind") == "forward", 1 / h).when(F.col("kind") == "central", 0.5 / h).otherwise(0.0)
            behind = F.when(F.col("kind") == "backward", -1 / h).when(F.col("kind") == "central", -0.5 / h).otherwise(0.0)
            for shift, weight in ((1, ahead), (-1, behind), (0, -(ahead + behind))):
                found.append(F.struct(F.lit(a).alias("axis"), (F.col("cell_id") + shift * stride[along]).alias("col_id"), F.lit(problem).alias("problem"), (factor * weight).alias("v")))
    out = rows.withColumns({f"tau_{a}": t for a, t in tau.items()})
    length = lambda m: F.sqrt(sum(F.col(f"{m}_{a}") * F.col(f"{m}_{a}") for a in "xyz"))
    entries_ = F.array(*found) if found else F.array().cast("array<struct<axis:string,col_id:bigint,problem:int,v:double>>")
    return out.select("cell_id", "kind", "tau_x", "tau_y", "tau_z", length("m1").alias("size1"), length("m2").alias("size2"), entries_.alias("d"))


def normalised_cross_gradient(tau: DataFrame) -> DataFrame:
    """tau over both gradients' sizes, between -1 and 1 a part; 0 where a gradient vanishes."""
    both = F.col("size1") * F.col("size2")
    return tau.select("cell_id", *(F.when(both != 0, F.col(f"tau_{a}") / both).otherwise(0.0).alias(f"tau_{a}") for a in "xyz"))


def cross_gradient_entries(tau: DataFrame, weight: float) -> DataFrame:
    """cell_id, axis, problem, col_id, v: entries of one column summed, times a weight; columns' own weights are not in it."""
    flat = tau.where("kind <> 'none'").select("cell_id", F.explode("d").alias("e")).select("cell_id", "e.*")
    return flat.groupBy("cell_id", "axis", "problem", "col_id").agg((F.sum("v") * weight).alias("v")).where("v <> 0")


# mixtures


@dataclass(frozen=True)
class Cluster:
    weight: float
    mu1: float
    sigma1: float
    mu2: float
    sigma2: float
    sigma12: float


def normalised_clusters(clusters: list[Cluster]) -> list[Cluster]:
    whole = sum(c.weight for c in clusters)
    return [Cluster(c.weight / whole, c.mu1, c.sigma1, c.mu2, c.sigma2, c.sigma12) for c in clusters]


def bell(c: Cluster, x: Column, y: Column, active: tuple[bool, bool] = (True, True)) -> Column:
    """A cluster's density; an exponent under -100 gives exp(-100). With one active property the other is left out."""
    a, b, d = c.sigma1**2, c.sigma2**2, c.sigma12**2
    if all(active):
        det = a * b - d * d
        dx, dy = x - c.mu1, y - c.mu2
        arg, norm = -(b * dx * dx - 2 * d * dx * dy + a * dy * dy) / (2 * det), 2 * math.pi * math.sqrt(det)
    else:
        s, dx = (a, x - c.mu1) if active[0] else (b, y - c.mu2)
        arg, norm = -dx * dx / (2 * s), math.sqrt(2 * math.pi * s)
    return F.when(arg < -100.0, math.exp(-100.0)).otherwise(F.exp(arg) / norm)


def mixture(clusters: list[Cluster], x: Column, y: Column, active: tuple[bool, bool] = (True, True), weights: list[Column] | None = None) -> tuple[Column, Column, Column]:
    """The density and its derivatives by both properties (always by the two-property form). weights: the clusters' own in each cell, in place of the common ones."""
    parts = [(c, w * bell(c, x, y, active)) for c, w in zip(clusters, weights or [F.lit(c.weight) for c in clusters], strict=True)]
    f, fx, fy = F.lit(0.0), F.lit(0.0), F.lit(0.0)
    for c, g in parts:
        a, b, d = c.sigma1**2, c.sigma2**2, c.sigma12**2
        det = a * b - d * d
        f = f + g
        fx = fx - g * (b * (x - c.mu1) - d * (y - c.mu2)) / det
        fy = fy - g * (a * (y - c.mu2) - d * (x - c.mu1)) / det
    return f, fx, fy


def mixture_top(clusters: list[Cluster], active: tuple[bool, bool] = (True, True), weights: list[Column] | None = None) -> Column:
    """The largest density at a cluster's centre."""
    return F.greatest(F.lit(0.0), *(mixture(clusters, F.lit(c.mu1), F.lit(c.mu2), active, weights)[0] for c in clusters), F.lit(0.0))


def clustering(rows: DataFrame, clusters: list[Cluster], weights: tuple[float, float], logarithmic: bool = True, cell_weights: list[Column] | None = None) -> DataFrame:
    """rows(cell_id, m1, m2) with density, v1, v2 (entries before column weights) and b1, b2. A property of weight 0 is left out of the density."""
    active = tuple(w != 0 for w in weights)
    f, fx, fy = mixture(clusters, F.col("m1"), F.col("m2"), active, cell_weights)
    out = rows.withColumns({"density": f, "fx": fx, "fy": fy, "top": mixture_top(clusters, active, cell_weights)})
    if logarithmic:
        gap = F.when(F.col("density") > 0, F.log("top") - F.log("density")).otherwise(0.0)
        slope = lambda n: F.when(F.col("density") != 0, -F.col(n) / F.col("density")).otherwise(0.0)
    else:
        gap, slope = F.col("density") - F.col("top"), F.col
    return out.withColumns({"v1": slope("fx") * weights[0], "v2": slope("fy") * weights[1], "b1": -gap * weights[0], "b2": -gap * weights[1]})


def block_cost(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sum of squares of right-hand sides."""
    return rows.groupBy(*(by or [])).agg(F.sum(F.col("b") * F.col("b")).alias("cost"))
