"""Costs and extents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def relative_cost(calc: Column, meas: Column) -> Column:
    """|calc - meas| / |meas|; null for no data of size."""
    whole = F.sum(F.pow(meas, 2))
    return F.sqrt(F.sum(F.pow(calc - meas, 2))) / F.sqrt(F.when(whole != 0, whole))


def weighted_rmse(calc: Column, meas: Column, weight: Column) -> Column:
    return F.sqrt(F.avg(F.pow(weight * (calc - meas), 2)))


def vector_cost(a: Column, b: Column) -> Column:
    """sqrt(sum (a - b)^2 / sum a^2); 0 for a of size 0. The vector that counts as the true one comes first."""
    whole = F.sum(F.pow(a, 2))
    return F.when(whole != 0, F.sqrt(F.sum(F.pow(a - b, 2)) / whole)).otherwise(0.0)


def model_cost(value: Column, prior: Column, column_weight: Column, power: float) -> Column:
    """Sum of |(value - prior) / column weight| ** power; masked cells add nothing."""
    return F.sum(F.when(column_weight != 0, F.pow(F.abs((value - prior) / column_weight), power)).otherwise(0.0))


def extents(cells: DataFrame) -> DataFrame:
    return cells.agg(*(f(e).alias(f"{n}_{a}") for a in "xyz" for n, f, e in (("min", F.min, F.least(f"{a}1", f"{a}2")), ("max", F.max, F.greatest(f"{a}1", f"{a}2")))))


def residual(weight: Column, meas: Column, calc: Column) -> Column:
    return weight * (meas - calc)
