"""Finite differences on the grid, as windows along one axis at a time; a value outside the grid counts as 0."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import size

AXES = {"x": ("i", ("j", "k")), "y": ("j", ("i", "k")), "z": ("k", ("i", "j"))}


class Scheme(Enum):
    BACKWARD = "backward"
    FORWARD = "forward"
    CENTRAL = "central"
    FORWARD3 = "forward3"
    FORWARD4 = "forward4"

    @staticmethod
    def of_code(code: int) -> Scheme:
        """The scheme of a derivative code: 0 backward, 2 central, 3 and 6 three-point, 7 four-point, others forward."""
        return {0: Scheme.BACKWARD, 2: Scheme.CENTRAL, 3: Scheme.FORWARD3, 6: Scheme.FORWARD3, 7: Scheme.FORWARD4}.get(code, Scheme.FORWARD)


def along(axis: str) -> Window:
    own, others = AXES[axis]
    return Window.partitionBy(*others).orderBy(own)


def shifted(value: Column, axis: str, by: int) -> Column:
    w = along(axis)
    return value if by == 0 else F.lead(value, by, 0.0).over(w) if by > 0 else F.lag(value, -by, 0.0).over(w)


def gradient(value: str, axis: str, scheme: Scheme, length: int, by: Column | None = None) -> Column:
    """The derivative of a column along an axis of `length` cells; forms with more points fall back to forward in the last two cells."""
    u = lambda n: shifted(F.col(value), axis, n)
    h, at = size(axis), F.col(AXES[axis][0])
    forward = (u(1) - u(0)) / h
    if scheme is Scheme.BACKWARD:
        return (u(0) - u(-1)) / h
    if scheme is Scheme.CENTRAL:
        return (u(1) - u(-1)) / (2 * h)
    if scheme is Scheme.FORWARD3:
        return F.when(at >= length - 2, forward).otherwise((-u(2) + 4 * u(1) - 3 * u(0)) / (2 * h))
    if scheme is Scheme.FORWARD4:
        return F.when(at >= length - 2, forward).otherwise((-u(2) + 27 * u(1) - 27 * u(0) + u(-1)) / (24 * h))
    return forward


def gradients(rows: DataFrame, value: str, scheme: Scheme, lengths: tuple[int, int, int]) -> DataFrame:
    """rows (cells with a value) with g_x, g_y, g_z."""
    return rows.withColumns({f"g_{a}": gradient(value, a, scheme, n) for a, n in zip("xyz", lengths, strict=True)})
