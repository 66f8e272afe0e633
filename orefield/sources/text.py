"""Text tables: a first line with a count, then numbers parted by white space; further columns on a line are ignored.

Reading is distributed. Rows are numbered in the order of the files' names and of each file's splits, from the count of lines in each split, so no task sees all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered(raw: DataFrame, name: str = "row") -> DataFrame:
    """Lines of text files with their place, by the files' names and the splits of each file: Spark deals splits to partitions by size, so a partition's number says nothing."""
    at = raw.select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b")).withColumn("_m", F.monotonically_increasing_id())
    per = at.groupBy("_f", "_b").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = per.select("_f", "_b", "_first", before.alias("_start"))  # one row a split
    return at.join(F.broadcast(starts), ["_f", "_b"]).select("value", (F.col("_start") + F.col("_m") - F.col("_first")).alias(name))


def lines(spark: SparkSession, path: str) -> tuple[list[str], DataFrame]:
    """The words of the first line, and the further lines as row (from 0) and words."""
    whole = numbered(spark.read.text(path))
    first = whole.where("row = 0").first()
    if first is None:
        raise ValueError(f"{path} is empty")
    words = F.split(F.trim("value"), r"\s+").alias("words")
    rows = whole.where("row > 0").select((F.col("row") - 1).alias("row"), "value").where(F.trim("value") != "")
    return first.value.split(), rows.select("row", words)


def real(word: Column) -> Column:
    return F.regexp_replace(word, "[dD]", "e").cast("double")


def table(spark: SparkSession, path: str, names: list[str], units: float = 1.0) -> DataFrame:
    """row and the named columns; the count of the first line must be met."""
    head, rows = lines(spark, path)
    got = rows.count()
    if int(head[0]) != got:
        raise ValueError(f"{path} states {head[0]} rows and has {got}")
    return rows.select("row", *((real(F.get("words", k)) * units).alias(n) for k, n in enumerate(names)))


def observations(spark: SparkSession, path: str, parts: int = 0, units: float = 1.0, z_down: bool = True) -> DataFrame:
    """obs_id, x, y, z and v (parts values; none for a grid only)."""
    _, rows = lines(spark, path)
    word = lambda k: real(F.get("words", k))
    return rows.select(F.col("row").alias("obs_id"), word(0).alias("x"), word(1).alias("y"), (word(2) if z_down else -word(2)).alias("z"), F.array(*((word(3 + k) * units) for k in range(parts))).cast("array<double>").alias("v"))


def model_grid(spark: SparkSession, path: str, z_down: bool = True, dims: tuple[int, int, int] | None = None) -> DataFrame:
    """Cells from 9 columns, or 10 or 12 with one or three values before the indices; checks edges and the order of indices."""
    _, rows = lines(spark, path)
    width = rows.select(F.size("words").alias("n")).first().n
    if width not in (9, 10, 12):
        raise ValueError(f"a grid has 9, 10 or 12 columns, not {width}")
    word = lambda k: real(F.get("words", k))
    z1, z2 = (word(4), word(5)) if z_down else (-word(5), -word(4))
    index = {n: (F.get("words", width - 3 + k).cast("long") - 1).alias(n) for k, n in enumerate("ijk")}
    cells = rows.select(F.col("row").alias("cell_id"), *index.values(), word(0).alias("x1"), word(1).alias("x2"), word(2).alias("y1"), word(3).alias("y2"), z1.alias("z1"), z2.alias("z2"))
    bad = cells.where("x1 >= x2 or y1 >= y2 or z1 >= z2")
    if dims:
        bad = bad.unionByName(cells.where(F.col("cell_id") != F.col("i") + F.col("j") * dims[0] + F.col("k") * dims[0] * dims[1]))
    if bad.limit(1).count():
        raise ValueError(f"{path} has cells with wrong edges or out of order")
    return cells


def bounds(spark: SparkSession, path: str, units: float = 1.0) -> DataFrame:
    """cell_id, bounds (array of lo, hi) and w, from lines lo1 hi1 ... w after a head of cells and intervals."""
    head, rows = lines(spark, path)
    n = int(head[1])
    word = lambda k: real(F.get("words", k))
    out = rows.select(F.col("row").alias("cell_id"), F.array(*(F.struct((word(2 * k) * units).alias("lo"), (word(2 * k + 1) * units).alias("hi")) for k in range(n))).alias("bounds"), word(2 * n).alias("w"))
    if out.where(F.exists("bounds", lambda b: b["lo"] > b["hi"])).limit(1).count():
        raise ValueError(f"{path} has an interval that ends before it begins")
    return out


def global_bounds(cells: DataFrame, numbers: list[float], units: float = 1.0) -> DataFrame:
    """The same bounds for all cells: odd places begin an interval, even ones end it; weight 1."""
    pairs = F.array(*(F.struct(F.lit(lo * units).alias("lo"), F.lit(hi * units).alias("hi")) for lo, hi in zip(numbers[::2], numbers[1::2], strict=True)))
    return cells.select("cell_id", pairs.alias("bounds"), F.lit(1.0).alias("w"))


def data_weights(errors: DataFrame, units: float = 1.0) -> DataFrame:
    """row and weight = 1 / (units * error)."""
    return errors.select("row", (1 / (units * F.col("error"))).alias("weight"))


def write(rows: DataFrame, path: str, order: str, columns: list[Column], head: str | None = None) -> None:
    """Writes lines in the order of a column beneath a head (the count if none). Spark sorts by range and writes its parts in order;
    the head is the first part's first line."""
    n = rows.count()
    text = rows.select(F.col(order).cast("double").alias("_o"), F.concat_ws(" ", *(c.cast("string") for c in columns)).alias("value"))
    first = rows.sparkSession.createDataFrame([(float("-inf"), head if head is not None else str(n))], "_o double, value string")
    first.unionByName(text).repartitionByRange("_o").sortWithinPartitions("_o").select("value").write.mode("overwrite").text(path)


def split_grid(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A grid of 10 or 12 columns as its cells, and its values (row, v)."""
    _, rows = lines(spark, path)
    width = rows.select(F.size("words").alias("n")).first().n
    if width not in (10, 12):
        raise ValueError(f"a grid with values has 10 or 12 columns, not {width}")
    values = rows.select("row", F.transform(F.slice("words", 7, width - 9), real).alias("v"))
    return model_grid(spark, path), values
