"""Planes by consensus of seeded samples, all scenes at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.plans import attach, cut


def _hash(seed: int) -> Column:
    return F.xxhash64("x", "y", "z", F.lit(seed))


def hypotheses(points: DataFrame, n: int, seed: int) -> DataFrame:
    """(scene, planes): up to n planes a x + b y + c z + d = 0 of unit normals through three points each, those of the smallest hashes; copies of a point count once."""
    keyed = points.select("scene", *"xyz").distinct().withColumn("h", _hash(seed)).withColumn("part", F.spark_partition_id())
    near = keyed.withColumn("k", F.row_number().over(W.partitionBy("scene", "part").orderBy("h", *"xyz"))).filter(F.col("k") <= 3 * n)
    chosen = near.withColumn("k", F.row_number().over(W.partitionBy("scene").orderBy("h", *"xyz")) - 1).filter(F.col("k") < 3 * n)
    threes = chosen.groupBy("scene", F.expr("k div 3").alias("number")).agg(F.sort_array(F.collect_list(F.struct("k", *"xyz"))).alias("p")).filter(F.size("p") == 3)
    p = [{c: F.col("p")[i][c] for c in "xyz"} for i in range(3)]
    u, v = ({c: p[i][c] - p[0][c] for c in "xyz"} for i in (1, 2))
    a, b, c = u["y"] * v["z"] - u["z"] * v["y"], u["z"] * v["x"] - u["x"] * v["z"], u["x"] * v["y"] - u["y"] * v["x"]
    raw = threes.select("scene", "number", a.alias("a"), b.alias("b"), c.alias("c"), *[p[0][x].alias(x) for x in "xyz"]).withColumn("norm", F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b") + F.col("c") * F.col("c"))).filter("norm > 1e-12")
    unit = raw.select("scene", "number", *[(F.col(x) / F.col("norm")).alias(x) for x in "abc"], *"xyz")
    d = -(F.col("a") * F.col("x") + F.col("b") * F.col("y") + F.col("c") * F.col("z"))
    return unit.withColumn("d", d).groupBy("scene").agg(F.sort_array(F.collect_list(F.struct("number", "a", "b", "c", "d"))).alias("planes"))


def _near(plane: Column, threshold: float) -> Column:
    return F.abs(plane["a"] * F.col("x") + plane["b"] * F.col("y") + plane["c"] * F.col("z") + plane["d"]) < threshold


#: Points of a scene that are held against its planes at once.
CHUNK = 4096


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(scene, x, y, z): rows of one scene side by side, as arrays of at most CHUNK entries."""
    for batch in batches:
        scene = batch.column("scene").dictionary_encode()
        at = scene.indices.fill_null(len(scene.dictionary)).to_numpy(zero_copy_only=False)
        order = np.argsort(at, kind="stable")
        edge = np.flatnonzero(np.diff(at[order], prepend=-1))
        starts = [k for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(at)], strict=True) for k in range(a, b, CHUNK)]
        ends = pa.array([*starts, len(at)], pa.int32())
        arrays = [pa.ListArray.from_arrays(ends, batch.column(c).take(pa.array(order))) for c in "xyz"]
        yield pa.RecordBatch.from_arrays([batch.column("scene").take(pa.array(order[starts])), *arrays], names=["scene", *"xyz"])


def near_counts(points: DataFrame, hypothesised: DataFrame, threshold: float) -> DataFrame:
    """(scene, at, points): how many points (scene, x, y, z) are nearer to each of their scene's planes (scene, planes) than the threshold; planes without any are left out."""
    kind = points.schema["scene"].dataType.simpleString()

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                x, y, z = (batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in "xyz")
                planes = batch.column("planes")[row].values
                a, b, c, d = (planes.field(n).to_numpy(zero_copy_only=False)[:, None] for n in "abcd")
                found = (np.abs(a * x + b * y + c * z + d) < threshold).sum(axis=1)
                at = np.flatnonzero(found)
                yield pa.RecordBatch.from_arrays([batch.column("scene").take(pa.array(np.full(len(at), row))), pa.array(at, pa.int32()), pa.array(found[at], pa.int64())], names=["scene", "at", "points"])

    packed = points.select("scene", *[F.col(c).cast("double").alias(c) for c in "xyz"]).mapInArrow(_packed, f"scene {kind}, " + ", ".join(f"{c} array<double>" for c in "xyz"))
    found = packed.join(hypothesised, "scene").mapInArrow(count, f"scene {kind}, at int, points long")
    return found.groupBy("scene", "at").agg(F.sum("points").alias("points"))


def walls(points: DataFrame, threshold: float, most: int, least_points: int, n: int = 200) -> DataFrame:
    """(scene, wall, a, b, c, d, points): up to `most` planes per scene, each with the points that it takes from the rest.

    A round counts the points near each of the scene's n hypotheses, an array of points at a time, and the counts are summed
    before the shuffle.  The best one's points leave.  A scene goes on while it has at least least_points points.
    """
    rest, found = cut(points.select("scene", *"xyz")), None
    for wall in range(most):
        enough = cut(rest.groupBy("scene").agg(F.count(F.lit(1)).alias("left")).filter(F.col("left") >= least_points))
        if enough.isEmpty():
            break
        rest = rest.join(enough.select("scene"), "scene", "left_semi")
        hypothesised = cut(hypotheses(rest, n, wall), "planes")
        counted = near_counts(rest, hypothesised, threshold)
        best = counted.groupBy("scene").agg(F.max(F.struct("points", (-F.col("at")).alias("at"))).alias("best"))
        chosen = best.join(hypothesised, "scene").withColumn("plane", F.get("planes", -F.col("best.at")))
        chosen = cut(chosen.select("scene", F.lit(wall).alias("wall"), *[F.col(f"plane.{c}").alias(c) for c in "abcd"], F.col("best.points").alias("points")))
        found = chosen if found is None else found.unionByName(chosen)
        plane = {c: F.col(f"__{c}") for c in "abcd"}
        near = attach(rest, chosen.select("scene", *[F.col(c).alias(f"__{c}") for c in "abcd"]), ["scene"])
        rest = cut(near.filter(~_near(plane, threshold)).select("scene", *"xyz"))
    if found is None:
        return points.limit(0).select("scene", F.lit(0).alias("wall"), *[F.lit(0.0).alias(c) for c in "abcd"], F.lit(0).cast("long").alias("points"))
    return found


def wall_points(points: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """(points' columns, wall): the points of each of `walls`' planes: a point is taken by the first plane of its scene that it is nearer to than the threshold."""
    planes = found.groupBy("scene").agg(F.sort_array(F.collect_list(F.struct("wall", "a", "b", "c", "d"))).alias("__planes"))
    first = F.get(F.filter("__planes", lambda plane: _near(plane, threshold)), F.lit(0))
    return attach(points, planes, ["scene"]).withColumn("wall", first["wall"]).filter("wall is not null").select(*points.columns, "wall")
