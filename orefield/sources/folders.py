"""Small files and folders through Spark's file systems, so that they lie where the data lie."""

from __future__ import annotations

from typing import Any

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str) -> tuple[Any, Any]:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    store, where = _at(spark, path)
    return bool(store.exists(where))


def write_bytes(spark: SparkSession, path: str, body: bytes) -> None:
    """Writes one file, whose folder is made where it is missing."""
    store, where = _at(spark, path)
    out = store.create(where, True)
    try:
        out.write(bytearray(body))
    finally:
        out.close()


def copy(spark: SparkSession, path: str, folder: str) -> str:
    """Copies a file into a folder, under its own name."""
    _, where = _at(spark, path)
    to = f"{folder.rstrip('/')}/{where.getName()}"
    (store, _), (other, there) = _at(spark, path), _at(spark, to)
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(store, where, other, there, False, spark._jsc.hadoopConfiguration())
    return to
