"""What the operators of this subpackage share: the shared folder, staged tables, word classes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What parts words, for words that white space parts.
SPACES = r"[\x20\x09-\x0D]+"


def split_words(text: Column, gap: str = SPACES) -> Column:
    """The runs of a text between gaps. By splitting, since finding all matches copies the text for each of them, which is quadratic in long texts."""
    return F.array_remove(F.split(text, gap), "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the session has none (tests on one machine) a folder of this process is set, once.
    """
    held = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if held:
        return held.rstrip("/")
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="orefield-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


#: Paths made inside `freed`, innermost last.
_made: list[list[str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _made:
        _made[-1].append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def freed(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes at its end what operators have written inside to the shared folder, but for the paths that are in the list it gives.

    For work whose result is written before the end: tables that are still to be read must not be read from these files.
    """
    keep: list[str] = []
    _made.append([])
    try:
        yield keep
    finally:
        for path in _made.pop():
            if path not in keep:
                delete(spark, path)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: the lineage ends there, and lost executors cost nothing."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Deletes staged tables that no later plan reads."""
    for df in tables:
        delete(df.sparkSession, df._staged_at)


def lean(run):
    """A batch function that, when its task ends, gives the memory that it no longer uses back to the system: workers live on, and
    what one stage leaves in their allocators would stand beside what the next one needs."""

    def held(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes

            import pyarrow

            pyarrow.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
                trim(0)

    return held


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(text: Column) -> Column:
    """The text's bytes; null gives none."""
    return F.coalesce(F.encode(text, "UTF-8"), F.lit(b"").cast("binary"))


def null_last(name: Column) -> Column:
    """A key that sorts names by code point and null last, and that equi-joins null to null."""
    return F.coalesce(F.concat(F.lit("s"), name.cast("string")), F.lit("z"))


def open_store(uri: str):
    """The pyarrow file system of a folder and the folder's path there; works on executors for local, S3, GCS and HDFS folders."""
    from pyarrow import fs

    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def maybe_in(rows: DataFrame, keys: DataFrame, name: str, bits: int = 27) -> DataFrame:
    """rows with the column `_maybe`: true wherever the long `name` stands in keys, and for few other rows.

    The broadcast is a bitmap of 2**bits bits (16 MB) at most, whatever the number of keys; a fuller bitmap is only less choosy.
    """
    at = F.pmod(F.xxhash64(name), F.lit(1 << bits)) + 1  # Spark numbers bits from 1
    held = keys.groupBy(F.bitmap_bucket_number(at).alias("_k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_bits"))
    spot = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(spot / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, F.pmod(spot, F.lit(8)).cast("int")).bitwiseAND(F.lit(1))
    both = rows.join(F.broadcast(held), F.bitmap_bucket_number(at) == F.col("_k"), "left")
    return both.withColumn("_maybe", F.coalesce(bit == 1, F.lit(False))).drop("_k", "_bits")


def spot_of(key: Column, bits: int) -> Column:
    """The place of a key in a bitmap of 2**bits bits; Spark numbers bits from 1."""
    return F.pmod(F.xxhash64(key), F.lit(1 << bits)) + 1


def bitmap_file(spots: DataFrame, bits: int, name: str) -> str:
    """Writes the bitmap of the column `spot` (1 to 2**bits), 2**bits / 8 bytes whatever the number of rows; returns its path. Slices are made on the executors and
    pass the driver one at a time."""
    made = spots.groupBy(F.bitmap_bucket_number("spot").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits"))
    held = stage(made, name)
    path = new_path(spots.sparkSession, f"{name}-file")
    fs, file = open_store(path)
    with fs.open_output_stream(file) as out:
        at = 1
        for row in held.orderBy("k").toLocalIterator():
            out.write(bytes(4096) * (row.k - at) + bytes(row.bits))
            at = row.k + 1
        out.write(bytes(4096) * ((1 << bits) // 32768 + 1 - at))
    unstage(held)
    return path


def read_bitmap(path: str):
    """A bitmap file's bytes, on an executor."""
    import numpy as np

    fs, file = open_store(path)
    with fs.open_input_stream(file) as source:
        return np.frombuffer(source.read(), np.uint8)


def marked(bitmap, spots):
    """Whether each spot (from 1) is in the bitmap."""
    at = spots - 1
    return (bitmap[at >> 3] >> (at & 7).astype("u1") & 1).astype(bool)
