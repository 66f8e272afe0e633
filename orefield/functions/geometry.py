"""Expressions over grid cells and points."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = (("x", "i"), ("y", "j"), ("z", "k"))


def size(axis: str) -> Column:
    return F.abs(F.col(f"{axis}2") - F.col(f"{axis}1"))


def centre(axis: str) -> Column:
    return 0.5 * (F.col(f"{axis}1") + F.col(f"{axis}2"))


def volume() -> Column:
    return F.abs(size("x") * size("y") * size("z"))


def index(i: Column, j: Column, k: Column, nx: int, ny: int, nz: int) -> Column:
    """Position of a cell counted from 0 with i fastest; -1 outside the grid."""
    inside = i.between(0, nx - 1) & j.between(0, ny - 1) & k.between(0, nz - 1)
    return F.when(inside, i + j * nx + k * (nx * ny)).otherwise(F.lit(-1))


def inside(x: Column, y: Column, z: Column) -> Column:
    """The point lies strictly inside the cell."""
    return (F.col("x1") < x) & (x < F.col("x2")) & (F.col("y1") < y) & (y < F.col("y2")) & (F.col("z1") < z) & (z < F.col("z2"))


def direction_cosines(inclination: float, declination: float, azimuth: float = 0.0) -> tuple[float, float, float]:
    """x east, y north, z down; declination east of north, azimuth of the x axis."""
    dip, turn = math.radians(inclination), math.radians(math.fmod(450.0 - declination, 360.0)) - math.radians(azimuth)
    return math.cos(dip) * math.cos(turn), math.cos(dip) * math.sin(turn), math.sin(dip)


def direction_cosines_of(inclination: Column, declination: Column, azimuth: Column) -> Column:
    dip, turn = F.radians(inclination), F.radians((F.lit(450.0) - declination) % 360.0) - F.radians(azimuth)
    return F.struct((F.cos(dip) * F.cos(turn)).alias("x"), (F.cos(dip) * F.sin(turn)).alias("y"), F.sin(dip).alias("z"))


def scaled(value: Column, weight: Column) -> Column:
    return value * weight


def unscaled(value: Column, weight: Column) -> Column:
    """value / weight, and 0 where the weight masks the cell."""
    return F.when(weight != 0, value / weight).otherwise(0.0)


def soft_threshold(x: Column, gamma: float) -> Column:
    return F.signum(x) * F.greatest(F.abs(x) - gamma, F.lit(0.0))


def norm_multiplier(diff: Column, power: float) -> Column:
    """Turns a squared norm into a norm of another power: |d|**(p/2 - 1), 1 at 0."""
    return F.when(diff != 0, F.pow(F.abs(diff), power / 2 - 1)).otherwise(1.0)


# vectors: structs with x, y, z


def vector(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def add(a: Column, b: Column) -> Column:
    return vector(*(a[c] + b[c] for c in "xyz"))


def subtract(a: Column, b: Column) -> Column:
    return vector(*(a[c] - b[c] for c in "xyz"))


def times(s: Column, a: Column) -> Column:
    return vector(*(s * a[c] for c in "xyz"))


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross(a: Column, b: Column) -> Column:
    return vector(*(a[p] * b[q] - a[q] * b[p] for p, q in ("yz", "zx", "xy")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


# text and numbers


def number_after(text: Column, symbol: str) -> Column:
    """The whole number that follows the symbol's first place."""
    return F.regexp_extract(text, f"{symbol}([0-9]+)", 1).cast("long")


def column_count(line: Column) -> Column:
    return F.size(F.split(F.trim(line), r"\s+"))


def gaussian_noise(sigma: float, mu: float, seed: int) -> Column:
    return F.randn(seed) * sigma + mu


def uniform_noise(scale: float, seed: int) -> Column:
    return (F.rand(seed) - 0.5) * scale
