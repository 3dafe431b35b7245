"""Incremental work: what has arrived since the last run is processed once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def process_new(
    spark: SparkSession, source: str, schema: T.StructType | str, sink: str, checkpoint: str, step: Callable[[DataFrame], DataFrame] = lambda df: df, form: str = "parquet",
) -> None:
    """Appends step(rows) of files that the checkpoint hasn't seen, then ends."""
    rows = spark.readStream.schema(schema).format(form).load(source)
    query = step(rows).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
    query.trigger(availableNow=True).outputMode("append").start().awaitTermination()


def unseen(rows: DataFrame, by: Sequence[str], time: str, late: str = "1 hour") -> DataFrame:
    """Rows of a stream whose key wasn't seen within the watermark."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(list(by))


def windowed_means(rows: DataFrame, time: str, value: str, by: Sequence[str], window: str, late: str = "1 hour") -> DataFrame:
    """Counts and means by event-time window; a window is out when the watermark passes it."""
    grouped = rows.withWatermark(time, late).groupBy(F.window(time, window).alias("window"), *by)
    made = grouped.agg(F.count("*").alias("rows"), F.avg(value).alias("mean"))
    return made.select(*by, F.col("window.start").alias("start"), "rows", "mean")
