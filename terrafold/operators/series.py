"""Running statistics of metric series (key, order, value, weight)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def running(rows: DataFrame, key: str, order: list[str], value: str, weight: str, last: int) -> DataFrame:
    """Adds mean (weighted), total and median over the last rows of each key."""
    frame = W.partitionBy(key).orderBy(*order).rowsBetween(1 - last, 0)
    return rows.withColumns({
        "mean": F.sum(F.col(value) * F.col(weight)).over(frame) / F.sum(weight).over(frame),
        "total": F.sum(value).over(frame),
        "median": F.percentile(value, F.lit(0.5)).over(frame),
    })


def summary(rows: DataFrame, key: str, order: list[str], value: str, weight: str) -> DataFrame:
    """(key, latest, mean, n): combined before the shuffle, so long series are no burden."""
    return rows.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias("latest"), (F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("mean"), F.count(F.lit(1)).alias("n"))
