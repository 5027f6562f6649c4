"""Voxel grids: cells, means, label histograms and majorities, and the map from points to cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.plans import attach
from .order import running

CELL = ["vx", "vy", "vz"]


def with_cells(points: DataFrame, size: float) -> DataFrame:
    """Adds vx, vy, vz: floor((v - least v of the scene) / size)."""
    least = points.groupBy("scene").agg(*[F.min(a).alias(f"__{a}") for a in "xyz"])
    cells = [F.floor((F.col(a) - F.col(f"__{a}")) / size).alias(f"v{a}") for a in "xyz"]
    return attach(points, least, ["scene"]).select(*points.columns, *cells)


def downsampled(points: DataFrame, size: float, label: str) -> DataFrame:
    """A row per voxel: its number of points, their mean place, and the majority of their labels.

    Counts per label come first, so that a voxel of any number of points is combined before the shuffle.
    """
    by_label = with_cells(points, size).groupBy("scene", *CELL, F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(a).alias(f"s{a}") for a in "xyz"])
    voxels = by_label.groupBy("scene", *CELL).agg(F.sum("n").alias("points"), *[F.sum(f"s{a}").alias(f"s{a}") for a in "xyz"], majority(F.col("label"), F.col("n")).alias("label"))
    return voxels.select("scene", *CELL, "points", *[(F.col(f"s{a}") / F.col("points")).alias(f"mean_{a}") for a in "xyz"], "label")


def majority(label: Column, n: Column) -> Column:
    """The label of most points; 0 (no label) only if there is no other, and the lowest label of a tie."""
    voted = F.max(F.when(label != 0, F.struct(n.alias("n"), (-label).alias("label"))))
    return F.coalesce(-voted["label"], F.lit(0))


def label_histogram(points: DataFrame, size: float, label: str) -> DataFrame:
    """(scene, cell, label, n): how many points of each label a voxel has."""
    return with_cells(points, size).groupBy("scene", *CELL, F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def pruned(points: DataFrame, size: float, colours: list[str], histograms: list[str]) -> DataFrame:
    """A row per voxel: points, mean place, the means of the colours without their fraction, and a histogram (value, n) of each of `histograms`.

    Sums come first, then counts per value, so a voxel of any number of points is combined before the shuffle.
    """
    cells = with_cells(points, size)
    found = cells.groupBy("scene", *CELL).agg(F.count(F.lit(1)).alias("points"), *[F.avg(a).alias(f"mean_{a}") for a in "xyz"], *[F.floor(F.avg(c)).alias(c) for c in colours])
    for h in histograms:
        counts = cells.groupBy("scene", *CELL, F.col(h).alias("value")).agg(F.count(F.lit(1)).alias("n"))
        found = found.join(counts.groupBy("scene", *CELL).agg(F.sort_array(F.collect_list(F.struct("value", "n"))).alias(h)), ["scene", *CELL])
    return found


def point_to_voxel(points: DataFrame, size: float) -> DataFrame:
    """(scene, point_idx, voxel_id): voxels are numbered from 0 in the order of their first points."""
    cells = with_cells(points, size)
    first = cells.groupBy("scene", *CELL).agg(F.min("point_idx").alias("first"))
    ids = running(first, ["scene"], ["first"], []).withColumn("voxel_id", F.col("place") - 1).drop("first", "place")
    return cells.join(ids, ["scene", *CELL]).select("scene", "point_idx", "voxel_id")


def _with_step(points: DataFrame, steps: int) -> DataFrame:
    """Adds the least `step` of a box around the middle of its scene, of step / steps of the half extents in x and y, that has the point."""
    extent = points.groupBy("scene").agg(*[f(a).alias(f"__{n}_{a}") for a in "xy" for n, f in (("lo", F.min), ("hi", F.max))])

    def needed(a: str) -> Column:
        half = (F.col(f"__hi_{a}") - F.col(f"__lo_{a}")) / 2
        return F.when(half > 0, F.abs(F.col(a) - (F.col(f"__lo_{a}") + F.col(f"__hi_{a}")) / 2) / half * steps).otherwise(0.0)

    return attach(points, extent, ["scene"]).withColumn("step", F.ceil(F.greatest(needed("x"), needed("y")))).select(*points.columns, "step")


def _largest(stepped: DataFrame, max_points: int, steps: int) -> DataFrame:
    bins = stepped.groupBy("scene", "step").agg(F.count(F.lit(1)).alias("n"))
    steps_of = bins.select("scene").distinct().withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(steps - 1).cast("long"))))
    held = steps_of.join(bins, ["scene", "step"], "left").withColumn("points", F.sum(F.coalesce("n", F.lit(0))).over(W.partitionBy("scene").orderBy("step")))
    return held.filter(F.col("points") <= max_points).groupBy("scene").agg(F.max(F.struct("step", "points")).alias("best")).select("scene", "best.step", "best.points")


def largest_block(points: DataFrame, max_points: int, steps: int = 20) -> DataFrame:
    """(scene, step, points): the largest of `steps` scales of a box around the middle of the scene that holds at most max_points.

    The box has half widths of step / steps of the scene's half extents in x and y, borders included.  A point's least
    step is known by itself, so one pass makes a histogram of `steps` bins per scene, and no search is needed.
    """
    return _largest(_with_step(points.select("scene", "x", "y"), steps), max_points, steps)


def block_rows(points: DataFrame, max_points: int, steps: int = 20) -> DataFrame:
    """The rows of each scene's largest block, moved so that their least corner is at 0."""
    stepped = _with_step(points, steps)
    held = attach(stepped, _largest(stepped, max_points, steps).select("scene", F.col("step").alias("__best")), ["scene"]).filter("step <= __best").select(points.columns)
    least = held.groupBy("scene").agg(*[F.min(a).alias(f"__{a}") for a in "xyz"])
    return attach(held, least, ["scene"]).select(*[(F.col(c) - F.col(f"__{c}")).alias(c) if c in "xyz" else F.col(c) for c in points.columns])


def hash_subsample(points: DataFrame, keys: list[str], parts: int = 4, seed: str = "s") -> DataFrame:
    """Exactly floor(N / parts) rows of each scene, those of the smallest hashes of their keys.

    The cut is looked up in a histogram of the hashes' first digits; only the bin that it falls into is sorted.
    """
    digest = F.md5(F.concat_ws(":", F.lit(seed), *[F.col(k).cast("string") for k in keys]))
    rows = points.withColumn("digest", digest).withColumn("bin", F.substring("digest", 1, 3))
    bins = rows.groupBy("scene", "bin").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy("scene"))
    upto = F.sum("n").over(W.partitionBy("scene").orderBy("bin"))
    wanted = bins.select("scene", "bin", "n", (upto - F.col("n")).alias("before"), F.floor(total / parts).alias("take"))
    marked = attach(rows, wanted.filter("before < take"), ["scene", "bin"])
    inside = marked.filter("before + n <= take")
    place = F.row_number().over(W.partitionBy("scene", "bin").orderBy("digest", *keys))
    edge = marked.filter("before + n > take").withColumn("place", place).filter("before + place <= take")
    return inside.select(points.columns).unionByName(edge.select(points.columns))
