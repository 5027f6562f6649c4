"""From superpoints with predictions to the instances of scenes: growth, fragments and primaries, absorption, and whole ceilings, floors and walls.

superpoints: (scene, id, class, x, y, z, size, occupancy), the centre being that of the instance it is predicted to belong to and occupancy the logarithm of that
instance's voxels; points: (scene, point_idx, sp, x, y, z); edges: (scene, src, dst) between superpoints, taken both ways.
Points are only counted, by joins and aggregations; what goes in turn, growth and absorption, is over superpoints and groups, per scene and class.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.plans import cut
from .cluster import absorbed_in_turn, seeded
from .planes import wall_points, walls

CEILING, FLOOR, WALL = 0, 1, 2
GROW, FULL, VOXEL = 0.8, 0.3, 0.02
STUFF_POINTS, WALL_POINTS, WALL_DISTANCE, WALLS = 100, 10_000, 0.1, 10


def _groups(members: DataFrame, superpoints: DataFrame, counts: DataFrame) -> DataFrame:
    """(scene, class, id, x, y, z, points, voxels, size, parts) of groups (scene, id of a superpoint, cluster): the centre by points, mean expected voxels and size."""
    rows = members.join(superpoints, ["scene", "id"]).join(counts, ["scene", "id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    centre = [(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c) for c in "xyz"]
    found = rows.filter("n > 0").groupBy("scene", "class", "cluster").agg(*centre, F.sum("n").alias("points"), F.avg(F.exp("occupancy")).alias("voxels"), F.avg("size").alias("size"), F.count(F.lit(1)).alias("parts"))
    return found.withColumnRenamed("cluster", "id")


def grown_groups(edges: DataFrame, superpoints: DataFrame, points: DataFrame, grow: float = GROW, full: float = FULL, voxel: float = VOXEL, stuff: tuple[int, ...] = (CEILING, FLOOR, WALL)) -> tuple[DataFrame, DataFrame]:
    """The groups that grow from seeds (scene, class, id, fragment, x, y, z, points, voxels, filled, size, parts) and their superpoints (scene, id, cluster).

    A group that fills less than `full` of its expected voxels is a fragment.  filled: its distinct voxels, coordinates being cut off towards 0, so that those around 0 are twice
    as wide.  Superpoints of the stuff classes don't grow; one without points is in no group.
    """
    things = cut(superpoints.filter(~F.col("class").isin(*stuff)), "things")
    members = cut(seeded(edges, things, grow), "grown")
    counts = cut(points.groupBy("scene", F.col("sp").alias("id")).agg(F.count(F.lit(1)).alias("n")), "superpoint-points")
    cell = [(F.col(c) / voxel).cast("long").alias(f"v{c}") for c in "xyz"]
    held = points.select("scene", F.col("sp").alias("id"), *cell).distinct().join(members, ["scene", "id"])
    filled = held.select("scene", F.col("cluster").alias("id"), "vx", "vy", "vz").distinct().groupBy("scene", "id").agg(F.count(F.lit(1)).alias("filled"))
    groups = _groups(members, things, counts).join(filled, ["scene", "id"])
    return cut(groups.withColumn("fragment", F.col("filled") < full * F.col("voxels")), "groups"), members


def scene_instances(
    edges: DataFrame, superpoints: DataFrame, points: DataFrame, grow: float = GROW, full: float = FULL, voxel: float = VOXEL,
    stuff_points: int = STUFF_POINTS, wall_points_: int = WALL_POINTS, wall_distance: float = WALL_DISTANCE, most_walls: int = WALLS,
) -> tuple[DataFrame, DataFrame]:
    """All instances of the scenes, (scene, instance, class, conf, points), and their points, (scene, point_idx, instance).

    Primaries with what they absorb, of confidence points / expected voxels up to 1; ceiling and floor, each one instance of more than `stuff_points` points; and planes of
    the wall points while a scene has `wall_points_` of them left; these three of confidence 1.  Fragments that nothing absorbs are no instance.
    Instances are numbered by scene: primaries in the order of their seeds, ceiling, floor, walls.
    """
    groups, members = grown_groups(edges, superpoints, points, grow, full, voxel)
    into = absorbed_in_turn(groups)
    joined = groups.select("scene", "id", "fragment").join(into, ["scene", "id"], "left")
    kept = joined.select("scene", F.col("id").alias("cluster"), F.when(F.col("fragment"), F.col("into")).otherwise(F.col("id")).alias("primary")).filter("primary is not null")
    owned = cut(members.join(kept, ["scene", "cluster"]).select("scene", "id", F.col("primary").alias("cluster")), "primaries")
    counts = points.groupBy("scene", F.col("sp").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    things = _groups(owned, superpoints, counts).select("scene", F.lit(0).alias("kind"), F.col("id").alias("key"), "class", F.least(F.col("points") / F.col("voxels"), F.lit(1.0)).alias("conf"), "points")
    labelled = cut(points.join(superpoints.select("scene", F.col("id").alias("sp"), "class").filter(F.col("class").isin(CEILING, FLOOR, WALL)), ["scene", "sp"]).select("scene", "point_idx", "class", *"xyz"), "stuff")
    one = lambda kind, key, of: F.struct(F.lit(kind).alias("kind"), key.cast("long").alias("key"), of.alias("class"))
    stuff_of = labelled.filter(F.col("class") != WALL).groupBy("scene", "class").agg(F.count(F.lit(1)).alias("points")).filter(F.col("points") > stuff_points)
    standing = cut(labelled.filter(F.col("class") == WALL).select("scene", "point_idx", *"xyz"), "wall-points")
    planes = cut(walls(standing, wall_distance, most_walls, wall_points_), "walls")
    on_walls = cut(wall_points(standing, planes, wall_distance).select("scene", "point_idx", one(2, F.col("wall"), F.lit(WALL)).alias("which")), "on-walls")
    whole = stuff_of.select("scene", one(1, F.col("class"), F.col("class")).alias("which"), "points").unionByName(on_walls.groupBy("scene", "which").agg(F.count(F.lit(1)).alias("points")))
    every = things.unionByName(whole.select("scene", "which.kind", "which.key", "which.class", F.lit(1.0).alias("conf"), "points"))
    order = W.partitionBy("scene").orderBy("kind", "key")
    numbered = cut(every.withColumn("instance", (F.row_number().over(order) - 1).cast("long")), "instances")
    names = numbered.select("scene", "kind", "key", "instance")
    of_things = points.select("scene", "point_idx", F.col("sp").alias("id")).join(owned, ["scene", "id"]).select("scene", "point_idx", F.lit(0).alias("kind"), F.col("cluster").cast("long").alias("key"))
    of_stuff = labelled.filter(F.col("class") != WALL).select("scene", "point_idx", F.lit(1).alias("kind"), F.col("class").cast("long").alias("key"))
    placed = [of_things, of_stuff, on_walls.select("scene", "point_idx", "which.kind", "which.key")]
    found = reduce(DataFrame.unionByName, placed).join(names, ["scene", "kind", "key"]).select("scene", "point_idx", "instance")
    return numbered.select("scene", "instance", "class", "conf", "points"), found


def against(instances: DataFrame, members: DataFrame, truth: DataFrame, class_of: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What `metrics.precision_table` takes, of instances and the true instance of each point: (scene, point_idx, gt), class_of being an expression on gt.

    gts (scene, gt, class, gt_size), preds (scene, pred, class, pred_size, conf) and overlaps of a class (scene, gt, pred, class, common, gt_size, pred_size, iou).
    """
    gts = truth.groupBy("scene", "gt").agg(F.count(F.lit(1)).alias("gt_size")).withColumn("class", class_of)
    preds = instances.select("scene", F.col("instance").alias("pred"), "class", F.col("points").alias("pred_size"), "conf")
    common = truth.join(members, ["scene", "point_idx"]).groupBy("scene", "gt", F.col("instance").alias("pred")).agg(F.count(F.lit(1)).alias("common"))
    found = common.join(gts, ["scene", "gt"]).join(preds.select("scene", "pred", F.col("class").alias("__class"), "pred_size"), ["scene", "pred"]).filter(F.col("class") == F.col("__class"))
    return gts, preds, found.drop("__class").withColumn("iou", F.col("common") / (F.col("gt_size") + F.col("pred_size") - F.col("common")))
