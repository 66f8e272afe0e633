"""Closed forms for a rectangular prism, as sums over its eight corners.

Each form is written once over an arithmetic (Spark columns, or NumPy arrays for bulk work): a corner is the vector from the
point to it, or back, with the sign of its side on each axis. Columns stay inside generated code; arrays evaluate all cells of a batch
at once. A point on an edge or face where a form has no value is an error, in either arithmetic: no cell's part is left out silently.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The gravitational constant, its nearest single-precision number, and the permeability of vacuum.
G = 6.674e-11
G_SINGLE = float(np.float32(6.674e-11))
MU0 = 4 * math.pi * 1e-7
TESLA_TO_NANO = 1e9


@dataclass(frozen=True)
class Arithmetic:
    atan2: Callable
    log: Callable
    sqrt: Callable
    where: Callable
    nonzero: Callable


ON_EDGE = "a point lies on an edge or face of a cell: move the point or the grid"


def _checked(good: Any) -> None:
    if not np.all(good):
        raise ValueError(ON_EDGE)


def _array_log(x: np.ndarray) -> np.ndarray:
    _checked(x > 0)
    return np.log(x)


def _array_nonzero(x: np.ndarray) -> np.ndarray:
    _checked(x != 0)
    return x


def _column(good: Column, value: Column) -> Column:
    return F.when(good, value).otherwise(F.raise_error(F.lit(ON_EDGE)).cast("double"))


COLUMNS = Arithmetic(F.atan2, lambda x: _column(x > 0, F.log(x)), F.sqrt, lambda test, a, b: F.when(test, a).otherwise(b), lambda x: _column(x != 0, x))
ARRAYS = Arithmetic(np.arctan2, _array_log, np.sqrt, np.where, _array_nonzero)


def full_turn(m: Arithmetic, angle: Any) -> Any:
    """The angle in 0..2 pi."""
    return m.where(angle < 0, angle + 2 * math.pi, angle)


def corners(m: Arithmetic, xs: tuple, ys: tuple, zs: tuple):
    """(sign, x, y, z, distance) of the eight corners, given both sides of each axis."""
    for a, x in enumerate(xs):
        for b, y in enumerate(ys):
            for c, z in enumerate(zs):
                yield (-1) ** (a + b + c + 1), x, y, z, m.sqrt(x * x + y * y + z * z)


def total(terms) -> Any:
    out = None
    for sign, value in terms:
        out = (value if sign > 0 else -value) if out is None else (out + value if sign > 0 else out - value)
    return out


def attraction_terms(m: Arithmetic) -> dict[str, Callable]:
    """A corner's part of the attraction by unit density over G; sides are point minus edge."""
    return {
        "x": lambda x, y, z, r: x * full_turn(m, m.atan2(y * z, x * r)) - y * m.log(r + z) - z * m.log(r + y),
        "y": lambda x, y, z, r: y * full_turn(m, m.atan2(x * z, y * r)) - z * m.log(r + x) - x * m.log(r + z),
        "z": lambda x, y, z, r: z * full_turn(m, m.atan2(x * y, z * r)) - x * m.log(r + y) - y * m.log(r + x),
    }


def attraction_z(m: Arithmetic, xs: tuple, ys: tuple, zs: tuple) -> Any:
    """Vertical attraction by unit density over G; sides are point minus edge."""
    f = attraction_terms(m)["z"]
    return total((s, f(x, y, z, r)) for s, x, y, z, r in corners(m, xs, ys, zs))


def attraction_x(m: Arithmetic, xs: tuple, ys: tuple, zs: tuple) -> Any:
    f = attraction_terms(m)["x"]
    return total((s, f(x, y, z, r)) for s, x, y, z, r in corners(m, xs, ys, zs))


def attraction_y(m: Arithmetic, xs: tuple, ys: tuple, zs: tuple) -> Any:
    f = attraction_terms(m)["y"]
    return total((s, f(x, y, z, r)) for s, x, y, z, r in corners(m, xs, ys, zs))


def gradient_terms(m: Arithmetic) -> dict[str, Callable]:
    """A corner's part of the gravity gradient, in the order xx, yy, zz, xy, yz, zx; z has its sign turned."""
    return {
        "xx": lambda x, y, z, r: full_turn(m, m.atan2(x * y, x * x + r * z + z * z)),
        "yy": lambda x, y, z, r: full_turn(m, m.atan2(x * y, r * r + r * z - x * x)),
        "zz": lambda x, y, z, r: full_turn(m, -m.atan2(x * y, r * z)),
        "xy": lambda x, y, z, r: m.log(r + z),
        "yz": lambda x, y, z, r: m.log((r - x) / (r + x)) * 0.5,
        "zx": lambda x, y, z, r: m.log((r - y) / (r + y)) * 0.5,
    }


def gradients(m: Arithmetic, xs: tuple, ys: tuple, zs: tuple) -> dict[str, Any]:
    """The gravity gradient's six components by unit density over G, in the order xx, yy, zz, xy, yz, zx; zs have their sign turned."""
    return {n: total((s, f(x, y, z, r)) for s, x, y, z, r in corners(m, xs, ys, zs)) for n, f in gradient_terms(m).items()}


def tensor_terms(m: Arithmetic) -> dict[str, Callable]:
    """A corner's part of the magnetic tensor but zz; sides are edge minus point, x and y not 0."""
    return {
        "xx": lambda x, y, z, r: -m.atan2(y * z, x * r),
        "yy": lambda x, y, z, r: -m.atan2(x * z, y * r),
        "xy": lambda x, y, z, r: m.log(z + r),
        "yz": lambda x, y, z, r: m.log(x + r),
        "zx": lambda x, y, z, r: m.log(y + r),
    }


def magnetic_tensor(m: Arithmetic, xs: tuple, ys: tuple, zs: tuple) -> dict[str, Any]:
    """The symmetric magnetic tensor, trace 0; sides are edge minus point. A point in the plane of an x or y face is an error."""
    xs, ys = tuple(map(m.nonzero, xs)), tuple(map(m.nonzero, ys))
    out = {n: total((s, f(x, y, z, r)) for s, x, y, z, r in corners(m, xs, ys, zs)) for n, f in tensor_terms(m).items()}
    return out | {"zz": -(out["xx"] + out["yy"])}


def projected(tensor: dict[str, Any], field: tuple[float, float, float]) -> tuple[Any, Any, Any]:
    """The tensor times the field's direction."""
    rows = (("xx", "xy", "zx"), ("xy", "yy", "yz"), ("zx", "yz", "zz"))
    return tuple(sum(tensor[n] * f for n, f in zip(row, field, strict=True)) for row in rows)  # type: ignore[return-value]


def sides(px: Any, py: Any, pz: Any, box: Callable[[str], Any], turned: bool = False) -> tuple[tuple, tuple, tuple]:
    """Point minus edge for each axis (edge minus point if turned)."""
    pairs = ((px, "x"), (py, "y"), (pz, "z"))
    return tuple(tuple((box(f"{a}{s}") - p) if turned else (p - box(f"{a}{s}")) for s in (1, 2)) for p, a in pairs)  # type: ignore[return-value]


def column_sides(turned: bool = False, flip_z: bool = False) -> tuple[tuple[Column, Column], ...]:
    """Sides for rows that hold a point (x, y, z) and a box."""
    xs, ys, zs = sides(F.col("x"), F.col("y"), F.col("z"), F.col, turned)
    return xs, ys, tuple(-z for z in zs) if flip_z else zs
