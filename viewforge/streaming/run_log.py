"""Rates of runs by the hour, over a table or over files that keep coming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def hourly(rows: DataFrame, run: str, time: str, rate: str, late: str | None = None) -> DataFrame:
    """Rows and mean rate of each run and hour; in a stream, rows later than `late` are left out."""
    rows = rows.withWatermark(time, late) if late else rows
    by_hour = rows.groupBy(run, F.window(time, "1 hour").alias("w")).agg(F.count("*").alias("logs"), F.avg(rate).alias("mean_rate"))
    return by_hour.select(run, F.col("w.start").alias("hour"), "logs", "mean_rate")


def follow(spark: SparkSession, path: str, schema: str, sink: str, checkpoint: str, late: str = "2 hours") -> StreamingQuery:
    """Appends the closed hours of Parquet files arriving in path (event_type, ts, value) to Parquet in sink."""
    rows = spark.readStream.schema(schema).parquet(path)
    closed = hourly(rows, "event_type", "ts", "value", late)
    return closed.writeStream.format("parquet").outputMode("append").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
