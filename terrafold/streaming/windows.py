"""Windowed metrics over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.plans import work_dir


def windowed(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(begin, event_type, n, total) of tumbling windows; in append mode a stream gives a window when the newest event is `late` past its end, drops
    its state, and drops events that come later still."""
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").cast("timestamp_ntz").alias("begin"), "event_type", "n", "total")
    )


def closed_windows(spark: SparkSession, path: str, folder: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """All windows of the Parquet files at path (a pattern), read as a stream into `folder`; a later run takes new files on from the same state.

    Windows that are still open at the end of the input are closed by the plain aggregation of the events that the stream still holds:
    those newer than the last window it gave.
    """
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).parquet(path)
    windowed(stream, width, late).writeStream.outputMode("append").format("parquet").option("path", f"{folder}/windows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    given = spark.read.schema("begin timestamp_ntz, event_type string, n long, total double").parquet(f"{folder}/windows")
    after = given.agg((F.max("begin") + F.expr(f"INTERVAL '{width}'")).alias("after")).first()["after"]
    left = spark.read.schema(schema).parquet(path)
    open_ = windowed(left if after is None else left.filter(F.col("ts") >= F.lit(after)), width, late)
    return given.unionByName(open_)


def windowed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All windows of the events table, read as a stream, the open ones closed."""
    found = closed_windows(spark, f"{sf_dir}/events.parquet*", work_dir(spark, "windows"))  # a pattern, as a stream's plain path must be a folder
    return found.withColumn("total", F.round("total", 4))


QUERIES = {"windowed_metrics": windowed_metrics}
ORACLES = {"windowed_metrics": "SELECT date_trunc('day', ts) AS begin, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"}
