"""Points before training: centring, integer cells, affine maps, crops, dense ids, label compaction, features of predictions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.plans import attach, cut
from .order import running


def centred(points: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` and x, y, z less their scene's mean."""
    means = points.groupBy("scene").agg(*[F.avg(a).alias(f"__{a}") for a in "xyz"])
    return attach(points, means, ["scene"]).select(*keep, *[(F.col(a) - F.col(f"__{a}")).alias(a) for a in "xyz"])


def byte_to_unit(value: Column) -> Column:
    """0 to 255 scaled to -1 to 1."""
    return value / 127.5 - 1


def integer_cells(points: DataFrame, scale: float, keep: list[str]) -> DataFrame:
    """The columns `keep` and ix, iy, iz: scaled coordinates less their scene's least, without their fraction."""
    least = points.groupBy("scene").agg(*[F.min(F.col(a) * scale).alias(f"__{a}") for a in "xyz"])
    return attach(points, least, ["scene"]).select(*keep, *[(F.col(a) * scale - F.col(f"__{a}")).cast("long").alias(f"i{a}") for a in "xyz"])


def affine(points: DataFrame, matrix: list[list[Column]]) -> DataFrame:
    """x, y, z as a row vector times the matrix, whose entries may differ by row of points."""
    moved = {b: sum((F.col(a) * matrix[i][j] for i, a in enumerate("xyz")), F.lit(0.0)) for j, b in enumerate("xyz")}
    return points.withColumns(moved)


def rotation(angle: Column, flip: Column) -> list[list[Column]]:
    """A turn about z after x times `flip`, for row vectors."""
    zero = F.lit(0.0)
    return [[flip * F.cos(angle), flip * F.sin(angle), zero], [-F.sin(angle), F.cos(angle), zero], [zero, zero, F.lit(1.0)]]


def unit(seed: str, *keys: str | Column) -> Column:
    """In (0, 1), the same for the same seed and keys."""
    text = F.concat_ws(":", F.lit(seed), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def random_box(points: DataFrame, full: float, shrink: float, max_points: int, steps: int, seed: str = "crop") -> DataFrame:
    """The rows of each scene in a box that holds at most max_points, with x, y, z moved to it, and the number of the step.

    Step 0 is the scene itself, its least corner at 0.  Step k is a box of full - shrink (k - 1) in x and y and `full` in z, at a random place of
    the scene.  The first step with few enough points counts: all steps are counted in one pass, a column for each.
    """
    extent = points.groupBy("scene").agg(*[f(a).alias(f"__{n}{a}") for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max))])
    rows = attach(points, extent, ["scene"])

    def moved(a: str, k: int) -> Column:
        side = full - (shrink * (k - 1) if a in "xy" else 0.0)
        slack = F.least(side - (F.col(f"__hi{a}") - F.col(f"__lo{a}")) + 0.001, F.lit(0.0))
        return F.col(a) - F.col(f"__lo{a}") + slack * unit(f"{seed}{k}{a}", "scene")

    def inside(k: int) -> Column:
        found = F.lit(True)
        for a in "xyz":
            found = found & (moved(a, k) >= 0) & (moved(a, k) < full - (shrink * (k - 1) if a in "xy" else 0.0))
        return found

    counts = rows.groupBy("scene").agg(F.count(F.lit(1)).alias("n0"), *[F.count_if(inside(k)).alias(f"n{k}") for k in range(1, steps)])
    first = F.coalesce(*[F.when(F.col(f"n{k}") <= max_points, k) for k in range(steps)], F.lit(steps))
    chosen = attach(rows, counts.select("scene", first.alias("step")), ["scene"])
    held, places = F.col("step") == 0, {a: F.when(F.col("step") == 0, F.col(a) - F.col(f"__lo{a}")) for a in "xyz"}
    for k in range(1, steps):
        held = held | ((F.col("step") == k) & inside(k))
        places = {a: c.when(F.col("step") == k, moved(a, k)) for a, c in places.items()}
    return chosen.filter(held).select(*[c for c in points.columns if c not in "xyz"], *[places[a].alias(a) for a in "xyz"], "step")


def dense_ids(rows: DataFrame, group: list[str], by: list[str]) -> DataFrame:
    """(group, by, index): the distinct `by` of each group numbered from 0 in their order."""
    return running(rows.select(*group, *by).distinct(), group, by, []).select(*group, *by, (F.col("place") - 1).alias("index"))


def compacted(labels: DataFrame, group: list[str], label: str) -> DataFrame:
    """(group, label, compact): the largest label goes into the lowest hole below the number of labels, and so on; the others stay.

    Labels are counted per group; what is ranked are labels, not points.
    """
    distinct = cut(labels.filter(F.col(label) >= 0).select(*group, F.col(label).alias("label")).distinct())
    sizes = distinct.groupBy(*group).agg(F.count(F.lit(1)).alias("m"))
    holes = sizes.select(*group, F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("label")).join(distinct, [*group, "label"], "left_anti")
    high = distinct.join(sizes, group).filter("label >= m").drop("m")
    holes = running(holes, group, ["label"], []).select(*group, F.col("label").alias("compact"), "place")
    high = running(high, group, [F.desc("label")], []).select(*group, "label", "place")
    moved = high.join(holes, [*group, "place"]).select(*group, "label", "compact")
    return distinct.join(moved, [*group, "label"], "left").select(*group, F.col("label").alias(label), F.coalesce("compact", "label").alias("compact"))


def with_value(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with the value worked out once however often `of` uses it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def softmax(scores: Column) -> Column:
    e = with_value(F.array_max(scores), lambda top: F.transform(scores, lambda x: F.exp(x - top)))
    return with_value(e, lambda e: with_value(F.aggregate(e, F.lit(0.0), lambda a, b: a + b), lambda total: F.transform(e, lambda x: x / total)))


def first_largest(values: Column) -> Column:
    """The place of the first of the largest values, from 0."""
    return F.array_position(values, F.array_max(values)) - 1


def one_hot(value: Column, low: int, high: int, on: float = 1.0) -> Column:
    """`on` at the rounded value (halves to even) within low to high, 0 elsewhere; places count from 0, so low should be 0."""
    at = F.greatest(F.least(F.rint(value), F.lit(float(high))), F.lit(float(low))).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(high - low)), lambda i: F.when(i == at, F.lit(float(on))).otherwise(0.0))


def decoded(code: Column) -> tuple[Column, Column]:
    """Class and number of the instance of class * 1000 + number; null for 0, no annotation."""
    return F.when(code != 0, F.floor(code / 1000)), F.when(code != 0, code % 1000)


def distortion(points: DataFrame, width: float, size: float, seed: str = "elastic") -> DataFrame:
    """x, y, z moved by a smooth random field: normal noise at the corners of cells of `width`, blurred twice over 3 x 3 x 3 corners, and interpolated.

    Blurred noise at a corner is a sum over the 5 x 5 x 5 corners around it with fixed weights, so corners need no grid: each that a
    point touches is computed once from hashes, and points join their eight corners.
    """
    at = points.withColumn("__row", F.monotonically_increasing_id())
    at = cut(at.withColumns({f"__i{a}": F.floor(F.col(a) / width) for a in "xyz"}), "distortion")
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i in (0, 1) for j in (0, 1) for k in (0, 1)])
    near = at.select("__row", "scene", *"xyz", *[f"__i{a}" for a in "xyz"], F.inline(steps))
    corner = {f"c{a}": F.col(f"__i{a}") + F.col(b) for a, b in zip("xyz", "ijk", strict=True)}
    weight = F.lit(1.0)
    for a, b in zip("xyz", "ijk", strict=True):
        part = F.col(a) / width - F.col(f"__i{a}")
        weight = weight * F.when(F.col(b) == 1, part).otherwise(1 - part)
    near = near.select("__row", "scene", *[c.alias(n) for n, c in corner.items()], weight.alias("w"))
    blur = [1 / 9, 2 / 9, 3 / 9, 2 / 9, 1 / 9]
    around = F.array(*[F.struct(F.lit(i - 2).alias("di"), F.lit(j - 2).alias("dj"), F.lit(k - 2).alias("dk"), F.lit(blur[i] * blur[j] * blur[k]).alias("b")) for i in range(5) for j in range(5) for k in range(5)])
    corners = near.select("scene", "cx", "cy", "cz").distinct().select("scene", "cx", "cy", "cz", F.inline(around))
    key = [F.col("cx") + F.col("di"), F.col("cy") + F.col("dj"), F.col("cz") + F.col("dk")]

    def normal(axis: str) -> Column:
        return F.sqrt(-2 * F.ln(unit(f"{seed}{axis}u", "scene", *key))) * F.cos(unit(f"{seed}{axis}v", "scene", *key) * 6.283185307179586)

    field = corners.groupBy("scene", "cx", "cy", "cz").agg(*[F.sum(F.col("b") * normal(a)).alias(f"n{a}") for a in "xyz"])
    moves = near.join(field, ["scene", "cx", "cy", "cz"]).groupBy("__row").agg(*[F.sum(F.col("w") * F.col(f"n{a}")).alias(f"m{a}") for a in "xyz"])
    return at.join(moves, "__row").select(*[(F.col(c) + size * F.col(f"m{c}")).alias(c) if c in "xyz" else F.col(c) for c in points.columns])
