"""Reference-shaped inputs, derived from the given tables; each with the same rows as SQL.

points: scene, point_idx, x, y, z, sp (superpoint), ins, sem, noisy (mixed votes).
cloud: a large set of points without an id: scene, x, y, z, label.
masks: scene, gt, pred per point.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    axes = [F.col("embedding")[i].cast("double").alias(a) for i, a in enumerate("xyz")]
    idx = F.col("vec_id")
    return e.select(
        F.col("label").alias("scene"), idx.alias("point_idx"), *axes,
        (idx % 8).alias("sp"), (idx % 4).alias("ins"), (idx % 4 % 3).alias("sem"), (idx * 7 % 11 % 5).alias("noisy"),
    )


POINTS = """points AS (SELECT label AS scene, vec_id AS point_idx, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z,
  vec_id % 8 AS sp, vec_id % 4 AS ins, vec_id % 4 % 3 AS sem, vec_id * 7 % 11 % 5 AS noisy FROM embeddings)"""


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_suppkey") % 4).alias("scene"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * 100).alias("z"),
        (F.col("l_partkey") % 5).alias("label"),
    )


CLOUD = "cloud AS (SELECT l_suppkey % 4 AS scene, l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * 100 AS z, l_partkey % 5 AS label FROM lineitem)"


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 4).alias("scene"), (F.col("l_orderkey") % 6).alias("gt"), (F.col("l_partkey") % 10).alias("roll"))
    pred = F.when(F.col("roll") < 5 + (F.col("scene") + F.col("gt")) % 6, F.col("gt")).otherwise((F.col("gt") + 1) % 6)
    return li.select("scene", "gt", pred.alias("pred"))


MASKS = """masks AS (SELECT scene, gt, CASE WHEN roll < 5 + (scene + gt) % 6 THEN gt ELSE (gt + 1) % 6 END AS pred
  FROM (SELECT l_suppkey % 4 AS scene, l_orderkey % 6 AS gt, l_partkey % 10 AS roll FROM lineitem))"""
