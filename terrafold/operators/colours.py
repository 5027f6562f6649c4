"""Colours of points by what is known of them: embeddings, geometric features, regions, right and wrong predictions; red, green and blue from 0 to 255."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import by_entry, inner_product

NAMES = ("red", "green", "blue")


def shade(value: Column) -> Column:
    """A value from 0 to 1 as a whole number up to 255; beyond these it is cut off, and null stays null."""
    return F.when(value.isNotNull(), F.floor(255 * F.greatest(F.least(value, F.lit(1.0)), F.lit(0.0))).cast("int"))


def principal_axes(rows: DataFrame, column: str, k: int = 3) -> tuple[list[float], list[list[float]]]:
    """The mean and the k leading eigenvectors of the covariance of an array column; an axis' largest entry is above 0.

    The covariance is one aggregation over all rows; only it and the axes, a square of the width, reach the driver.
    """
    rows = rows.filter(F.col(column).isNotNull()).select(F.col(column).cast("array<double>").alias("v"))
    width = len(rows.first()["v"])
    mean = rows.agg(by_entry("v", width, F.avg).alias("mean")).first()["mean"]
    axes = PCA(k=k, inputCol="v", outputCol="p").fit(rows.select(array_to_vector("v").alias("v"))).pc.toArray().T
    return mean, [(a * np.sign(a[np.abs(a).argmax()])).tolist() for a in axes]


def embedding_colours(rows: DataFrame, column: str) -> DataFrame:
    """rows with colours from their array's projections on its three principal axes, -1 to 1 from dark to light; of at most three entries these themselves are taken.

    A row without an array, and all rows where there are no two, is grey.
    """
    value = F.col(column).cast("array<double>")
    known = rows.filter(F.col(column).isNotNull())
    first = known.select(F.size(column).alias("n")).limit(2).collect()
    if len(first) < 2:
        return rows.withColumns({c: F.lit(127) for c in NAMES})
    if first[0]["n"] <= len(NAMES):
        parts = [F.coalesce(F.get(value, F.lit(i)), F.lit(0.0)) for i in range(len(NAMES))]
    else:
        mean, axes = principal_axes(rows, column)
        parts = [inner_product(F.zip_with(value, F.array(*map(F.lit, mean)), lambda x, m: x - m), F.array(*map(F.lit, a))) for a in axes]
    return rows.withColumns({c: F.coalesce(shade((p + 1) / 2), F.lit(127)) for c, p in zip(NAMES, parts, strict=True)})


def feature_colours(rows: DataFrame, features: tuple[str, str, str] = ("linearity", "planarity", "verticality")) -> DataFrame:
    """rows with their features from 0 to 1 as colours."""
    return rows.withColumns({c: shade(F.col(f).cast("double")) for c, f in zip(NAMES, features, strict=True)})


def region_colours(rows: DataFrame, keys: list[str], seed: int = 0) -> DataFrame:
    """rows with a colour per region, from the hash of its keys: the same on every run."""
    h = F.xxhash64(F.lit(seed), *keys)
    return rows.withColumns({c: F.pmod(F.shiftright(h, 8 * i), F.lit(256)).cast("int") for i, c in enumerate(NAMES)})


def error_colours(rows: DataFrame, truth: str, predicted: str, unknown: int = 0) -> DataFrame:
    """rows (red, green, blue from 0 to 255) turned to a green hue where the prediction is right or the truth unknown, else to red; a little more saturated and lighter than they were."""
    high, low = F.greatest(*NAMES) / 255.0, F.least(*NAMES) / 255.0
    strong = F.least(F.when(high > 0, (high - low) / high).otherwise(0.0) + 0.3, F.lit(1.0))
    light = F.least(high + 0.1, F.lit(1.0))
    dark, right = light * (1 - strong), (F.col(truth) == F.col(predicted)) | (F.col(truth) == unknown)
    return rows.withColumns({"red": shade(F.when(right, dark).otherwise(light)), "green": shade(F.when(right, light).otherwise(dark)), "blue": shade(dark)})
