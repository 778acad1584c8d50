"""Tables that arrive in pieces: windowed counts with a watermark, written as a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.shared import shared_folder


def windowed_counts(stream: DataFrame, at: str, by: list[str], value: str, window: str, late: str) -> DataFrame:
    """Rows, sum and largest value of each window and group. Where windows are closed (append_closed), rows whose window ended more than
    `late` before the newest row are left out; where the whole result is kept (drain), every row counts."""
    counted = stream.withWatermark(at, late).groupBy(F.window(at, window).alias("_w"), *by)
    counted = counted.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(value).alias("total"), F.max(value).alias("largest"))
    return counted.select(F.col("_w.start").alias("window_start"), *by, "n_rows", "total", "largest")


def append_closed(spark: SparkSession, counted: DataFrame, folder: str) -> DataFrame:
    """Run a stream over what is there now and append the windows that are closed to a table in `folder`, each once; read that table. Open
    windows stay in the state and are appended by a later call with the same folder. Only open windows are held."""
    query = counted.writeStream.outputMode("append").format("parquet").trigger(availableNow=True).option("checkpointLocation", f"{folder}/log").start(f"{folder}/out")
    query.awaitTermination()
    return spark.read.schema(counted.schema).parquet(f"{folder}/out")


def drain(spark: SparkSession, counted: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is there now, to the end, and read what it wrote. Windows still open are written too, as each batch rewrites
    the whole result in a folder of its own; the last one holds."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    query = (
        counted.writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{folder}/log")
        .foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/out-{n}")).start()
    )
    query.awaitTermination()
    last = query.lastProgress["batchId"] if query.lastProgress else 0
    return spark.read.schema(counted.schema).parquet(f"{folder}/out-{last}")
