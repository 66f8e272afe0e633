"""Orthonormal Haar and Daubechies-4 transforms of gridded values, by lifting along each axis.

Two forms: lifting on arrays, for bulk kernels, and sparse one-dimensional matrices joined to relations, three joins and sums a
transform. The inverse is the transpose.
"""

from __future__ import annotations

import math
from enum import Enum

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Wavelet(Enum):
    NONE = 0
    HAAR = 1
    D4 = 2


def scales(n: int) -> int:
    return int(math.log(n) / math.log(2)) if n > 0 else 0


def lift(x: np.ndarray, kind: Wavelet) -> np.ndarray:
    """Transforms the first axis. On each scale the pairs are (low, high); a low without a partner stays as it is."""
    x = np.array(x, np.float64)
    root3 = math.sqrt(3)
    for scale in range(1, scales(x.shape[0]) + 1):
        step = 2**scale
        high = x[step // 2 :: step]
        low = x[::step][: high.shape[0]]
        if kind is Wavelet.HAAR:
            high -= low
            low += high / 2
            low *= math.sqrt(2)
            high /= math.sqrt(2)
        else:
            low += root3 * high
            high -= root3 / 4 * low + (root3 - 2) / 4 * np.roll(low, 1, axis=0)
            low -= np.roll(high, -1, axis=0)
            low *= (root3 - 1) / math.sqrt(2)
            high *= (root3 + 1) / math.sqrt(2)
    return x


def lift_back(x: np.ndarray, kind: Wavelet) -> np.ndarray:
    """The inverse of `lift`: its steps from the last to the first."""
    x = np.array(x, np.float64)
    root3 = math.sqrt(3)
    for scale in range(scales(x.shape[0]), 0, -1):
        step = 2**scale
        high = x[step // 2 :: step]
        low = x[::step][: high.shape[0]]
        if kind is Wavelet.HAAR:
            high *= math.sqrt(2)
            low /= math.sqrt(2)
            low -= high / 2
            high += low
        else:
            high /= (root3 + 1) / math.sqrt(2)
            low /= (root3 - 1) / math.sqrt(2)
            low += np.roll(high, -1, axis=0)
            high += root3 / 4 * low + (root3 - 2) / 4 * np.roll(low, 1, axis=0)
            low -= root3 * high
    return x


#: Axes up to this length are transformed by their matrix, longer ones by lifting: a matrix has the square of an axis' length.
MATRIX_MOST = 64


def matrix(n: int, kind: Wavelet) -> np.ndarray:
    return np.eye(n) if kind is Wavelet.NONE else lift(np.eye(n), kind)


def transform(values: np.ndarray, dims: tuple[int, int, int], kind: Wavelet, inverse: bool = False) -> np.ndarray:
    """values: (..., nx*ny*nz) with x fastest."""
    if kind is Wavelet.NONE:
        return values
    nx, ny, nz = dims
    x = values.reshape(*values.shape[:-1], nz, ny, nx)
    for axis, n in ((-1, nx), (-2, ny), (-3, nz)):
        if n > MATRIX_MOST:
            x = np.moveaxis((lift_back if inverse else lift)(np.moveaxis(x, axis, 0), kind), 0, axis)
            continue
        m = matrix(n, kind)
        x = np.moveaxis(np.moveaxis(x, axis, -1) @ (m if inverse else m.T), -1, axis)
    return np.ascontiguousarray(x).reshape(values.shape)


def matrix_table(spark: SparkSession, n: int, kind: Wavelet) -> DataFrame:
    """dst, src, coef: the transform's non-zero entries, about n log n rows."""
    m = matrix(n, kind)
    return spark.createDataFrame([(int(d), int(s), float(m[d, s])) for d, s in zip(*np.nonzero(np.abs(m) > 1e-14), strict=True)], "dst long, src long, coef double")


def transform_rows(rows: DataFrame, value: str, dims: tuple[int, int, int], kind: Wavelet, inverse: bool = False) -> DataFrame:
    """rows(i, j, k, value) transformed; zeros may be absent before, and tiny values stay after."""
    out = rows.select("i", "j", "k", F.col(value).alias("v"))
    for axis, n in zip("ijk", dims, strict=True):
        m = matrix_table(rows.sparkSession, n, kind)
        m = m.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "coef") if inverse else m
        others = [c for c in "ijk" if c != axis]
        out = out.join(m, out[axis] == m["src"]).groupBy(*others, F.col("dst").alias(axis)).agg(F.sum(F.col("coef") * F.col("v")).alias("v"))
    return out.select("i", "j", "k", F.col("v").alias(value))
