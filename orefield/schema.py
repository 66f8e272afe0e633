"""The tables of the engine and the fixtures that derive them from the driver's tables.

cell(cell_id, i, j, k, x1, x2, y1, y2, z1, z2): boxes of a structured grid, i fastest, ids and indices from 0, z down.
obs(obs_id, x, y, z): places of observation. model(cell_id, density, suscept, prior): cell properties. Sparse matrices are
rows (row_id, col_id, v); rows without entries are absent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NX, NY = 10, 10
DX, DY, DZ = 100.0, 100.0, 50.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_boxes(ids: DataFrame) -> DataFrame:
    """ids(cell_id, ...) with grid indices and box edges."""
    i, j, k = F.col("cell_id") % NX, F.floor(F.col("cell_id") / NX) % NY, F.floor(F.col("cell_id") / (NX * NY))
    edges = {f"{a}{s}": (F.col(n) + (s - 1)) * d for a, n, d in (("x", "i", DX), ("y", "j", DY), ("z", "k", DZ)) for s in (1, 2)}
    return ids.withColumns({"i": i.cast("long"), "j": j.cast("long"), "k": k.cast("long")}).withColumns(edges)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_boxes(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("cell_id")))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(key.cast("long").alias("obs_id"), ((key * 37) % 1000 + 0.7).alias("x"), ((key * 53) % 1000 + 0.3).alias("y"), (-1.1 - F.col("s_nationkey")).alias("z"))


def bore_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places inside cells; every seventh lies so near a face that its void shrinks."""
    key, parts = F.col("s_suppkey"), table(spark, sf_dir, "part")
    depth = DZ * (parts.count() // (NX * NY))
    x = F.when(key % 7 == 0, ((key * 37) % 10) * 100 + 0.05).otherwise((key * 37) % 1000 + 0.7)
    return table(spark, sf_dir, "supplier").select(key.cast("long").alias("obs_id"), x.alias("x"), ((key * 53) % 1000 + 0.3).alias("y"), ((key * 29) % F.lit(int(depth)) + 0.4).alias("z"))


def model(spark: SparkSession, sf_dir: str) -> DataFrame:
    density = F.col("p_size") * 10.0
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("cell_id"), density.alias("density"), (F.col("p_retailprice").cast("double") / 1000000.0).alias("suscept"), (density * 0.9).alias("prior"))


def local_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("cell_id"), F.when(size == 50, 0.0).otherwise(1.0 + size % 5).alias("w"))


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse matrix: orders by parts, discounts in single precision."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("long").alias("row_id"), F.col("l_partkey").cast("long").alias("col_id")).agg(F.sum(F.col("l_discount").cast("float").cast("double")).alias("v")).where("v <> 0")
