"""Forward modelling of observations as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import kernels


def forward_stream(spark: SparkSession, folder: str, schema: str, to_obs, cells: DataFrame, value: str, out: str, checkpoint: str, kind: str = "gravity", field=None, intensity: float = 50000.0):
    """A query that models each new file of observations once and appends obs_id and d to the Parquet folder `out`.

    The kernel needs no state between rows, so there is no watermark; a batch is an ordinary forward job, and a batch that is run
    again replaces its own folder.
    """
    rows = spark.readStream.schema(schema).parquet(folder)

    def model(batch: DataFrame, number: int) -> None:
        kernels.forward(to_obs(batch), cells, value, kind, field, intensity).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return rows.writeStream.foreachBatch(model).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
