"""Aggregates over labels, instances and superpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.plans import attach, cut
from .neighbors import blocks, near_pairs

IGNORED = -100


def mode_label(points: DataFrame, by: str, label: str) -> DataFrame:
    """(scene, by, label): the label of most points of each group, the lowest of a tie; counted per label first."""
    counts = points.groupBy("scene", by, F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("scene", by).agg((-F.max(F.struct("n", (-F.col("label")).alias("label")))["label"]).alias("label"))


def soft_histogram(points: DataFrame, by: str, label: str) -> DataFrame:
    """(scene, by, label, share): the shares of a group's points per label; ignored ones share the bin IGNORED."""
    counts = points.groupBy("scene", by, F.when(F.col(label) < 0, IGNORED).otherwise(F.col(label)).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("scene", by, "label", (F.col("n") / F.sum("n").over(W.partitionBy("scene", by))).alias("share"))


def soft_label(shares: DataFrame, by: str) -> DataFrame:
    """(scene, by, label): the bin of the largest share, the lowest of a tie; IGNORED is the last bin."""
    last = F.when(F.col("label") == IGNORED, F.lit(None)).otherwise(-F.col("label"))  # null is the least in a struct
    best = shares.groupBy("scene", by).agg(F.max(F.struct("share", last.alias("label"))).alias("best"))
    return best.select("scene", by, F.coalesce(-F.col("best.label"), F.lit(IGNORED)).alias("label"))


def mask_operations(one: DataFrame, two: DataFrame) -> DataFrame:
    """(scene, either, both, first_only): points of two masks (scene, point_idx), counted over their union, intersection and difference."""
    marked = one.select("scene", "point_idx", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(two.select("scene", "point_idx", F.lit(0).alias("a"), F.lit(1).alias("b")))
    per = marked.groupBy("scene", "point_idx").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return per.groupBy("scene").agg(F.count(F.lit(1)).alias("either"), F.count_if(F.col("a") + F.col("b") == 2).alias("both"), F.count_if(F.col("b") == 0).alias("first_only"))


def first_label(points: DataFrame, by: str, label: str) -> DataFrame:
    """(scene, by, label): the label of the group's first point; an unlabelled one counts as class 0."""
    first = points.groupBy("scene", by).agg(F.min_by(label, "point_idx").alias("label"))
    return first.withColumn("label", F.greatest("label", F.lit(0)))


def instance_codes(points: DataFrame, instance: str, class_of: DataFrame) -> DataFrame:
    """points with code: class * 1000 + instance + 1, 0 without an instance; class_of is (scene, instance, label)."""
    code = F.when(F.col(instance) == IGNORED, 0).otherwise(F.coalesce(F.col("label") * 1000 + F.col(instance) + 1, F.lit(0)))
    return points.join(class_of, ["scene", instance], "left").withColumn("code", code.cast("long"))


def propagation_report(points: DataFrame, truth: Column, given: Column, instance: Column, instance_given: Column) -> DataFrame:
    """One row of shares and accuracies of given labels: of all classes, of floor and wall (0 and 1), of the others, and of instances of the others."""
    has, stuff = given != IGNORED, given.isin(0, 1)
    thing = (instance_given != IGNORED) & ~stuff
    c = points.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(truth != IGNORED).alias("t"), F.count_if(has).alias("s"), F.count_if(has & (given == truth)).alias("sr"), F.count_if(stuff).alias("f"),
        F.count_if(stuff & (given == truth)).alias("fr"), F.count_if(thing).alias("i"), F.count_if(thing & (instance_given == instance)).alias("ir"),
    )
    n, t, s, sr, f, fr, i, ir = (F.col(x) for x in ("n", "t", "s", "sr", "f", "fr", "i", "ir"))
    shares = {"labelled_of_all": (s, n), "stuff_of_all": (f, n), "other_of_all": (s - f, n), "labelled_of_true": (s, t), "stuff_of_true": (f, t), "other_of_true": (s - f, t), "accuracy": (sr, s),
              "stuff_accuracy": (fr, f), "other_accuracy": (sr - fr, s - f), "instance_of_all": (i, n), "instance_of_true": (i, t), "instance_accuracy": (ir, i)}
    return c.select(*[F.try_divide(a, b).alias(name) for name, (a, b) in shares.items()])


def dice(rows: DataFrame, probabilities: str, label: str, epsilon: float = 1e-5) -> DataFrame:
    """(class, loss): per class, 1 less twice the overlap of its probabilities with its rows, over the sum of both squared."""
    each = rows.select(F.col(label).alias("__label"), F.posexplode(probabilities).alias("class", "p"))
    hit = (F.col("__label") == F.col("class")).cast("double")
    sums = each.groupBy("class").agg(F.sum(F.col("p") * hit).alias("both"), F.sum(F.col("p") * F.col("p")).alias("pp"), F.sum(hit).alias("tt"))
    return sums.select("class", (1 - (2 * F.col("both") + epsilon) / (F.col("pp") + F.col("tt") + 1e-4 + epsilon)).alias("loss"))


def offset_terms(rows: DataFrame) -> DataFrame:
    """(norm_loss, direction_loss) of rows (ox, oy, oz true, px, py, pz predicted, valid), over the valid ones."""
    far = sum((F.abs(F.col(f"p{a}") - F.col(f"o{a}")) for a in "xyz"), F.lit(0.0))
    length = {v: F.sqrt(sum((F.col(f"{v}{a}") * F.col(f"{v}{a}") for a in "xyz"), F.lit(0.0))) + 1e-8 for v in "op"}
    turn = -sum((F.col(f"o{a}") / length["o"] * (F.col(f"p{a}") / length["p"]) for a in "xyz"), F.lit(0.0))
    kept = rows.filter("valid")
    return kept.agg((F.sum(far) / (F.count(F.lit(1)) + 1e-6)).alias("norm_loss"), (F.sum(turn) / (F.count(F.lit(1)) + 1e-6)).alias("direction_loss"))


def instance_info(points: DataFrame, instance: str) -> DataFrame:
    """Each point with the mean, least and greatest place of its instance and its size; IGNORED for points without one."""
    stats = points.filter(F.col(instance) != IGNORED).groupBy("scene", instance).agg(
        *[f(a).alias(f"{n}_{a}") for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max)) for a in "xyz"], F.count(F.lit(1)).alias("size")
    )
    rows = points.select("scene", "point_idx", instance)
    values = [c for c in stats.columns if c not in ("scene", instance)]
    return rows.join(stats, ["scene", instance], "left").select("scene", "point_idx", instance, *[F.coalesce(c, F.lit(IGNORED)).alias(c) for c in values])


def centre_offsets(points: DataFrame, part: str, whole: str) -> DataFrame:
    """(scene, part, offsets): from the centroid of each part to that of the whole in which most of its points are."""
    parts = points.groupBy("scene", part).agg(*[F.avg(a).alias(f"p{a}") for a in "xyz"])
    wholes = points.groupBy("scene", F.col(whole).alias("label")).agg(*[F.avg(a).alias(f"w{a}") for a in "xyz"])
    owned = mode_label(points, part, whole)
    return parts.join(owned, ["scene", part]).join(wholes, ["scene", "label"]).select("scene", part, *[(F.col(f"w{a}") - F.col(f"p{a}")).alias(f"o{a}") for a in "xyz"])


def instance_reach(points: DataFrame, instance: str) -> DataFrame:
    """(scene, instance, reach): the greatest distance of a point from its instance's centroid."""
    centre = points.groupBy("scene", instance).agg(*[F.avg(a).alias(f"m{a}") for a in "xyz"])
    far = F.sqrt(sum(((F.col(a) - F.col(f"m{a}")) * (F.col(a) - F.col(f"m{a}")) for a in "xyz"), F.lit(0.0)))
    return attach(points, centre, ["scene", instance]).groupBy("scene", instance).agg(F.max(far).alias("reach"))


def occupancy(cells: DataFrame, instance: str, cell: list[str]) -> DataFrame:
    """(scene, instance, voxels): the distinct voxels of each instance; distinct rows first, so a large instance is spread."""
    return cells.select("scene", instance, *cell).distinct().groupBy("scene", instance).agg(F.count(F.lit(1)).alias("voxels"))


def weak_label_report(points: DataFrame, truth: str, given: Column) -> DataFrame:
    """One row: how many points are labelled, how many rightly, and the shares."""
    labelled = given != IGNORED
    return points.agg(
        F.count(F.lit(1)).alias("points"), F.count_if(labelled).alias("labelled"), F.count_if(labelled & (given == F.col(truth))).alias("right"),
    ).select("points", "labelled", "right", F.try_divide("labelled", "points").alias("coverage"), F.try_divide("right", "labelled").alias("accuracy"))


def weighted_sample(rows: DataFrame, group: list[str], weight: Column, u: Column, k: int) -> DataFrame:
    """k rows of each group without replacement, by weight: those of the smallest -ln(u) / weight.

    Every task keeps k rows of a group at most before anything is shuffled, so a large group is no burden.
    """
    keyed = rows.withColumn("__key", -F.ln(u) / weight).withColumn("__part", F.spark_partition_id())
    first = W.partitionBy(*group, "__part").orderBy("__key")
    near = keyed.withColumn("__rank", F.row_number().over(first)).filter(F.col("__rank") <= k)
    return near.withColumn("__rank", F.row_number().over(W.partitionBy(*group).orderBy("__key"))).filter(F.col("__rank") <= k).drop("__key", "__part", "__rank")


def discriminative_terms(points: DataFrame, instance: str, near: float = 0.1, far: float = 1.5) -> DataFrame:
    """(scene, variance, separation, size): how far points are from their instance's mean beyond `near` (squared), how
    far pairs of means are closer than 2 `far` (L1, squared), and the mean length of the means."""
    means = points.groupBy("scene", instance).agg(*[F.avg(a).alias(f"m{a}") for a in "xyz"])
    rows = attach(points, means, ["scene", instance])
    gap = F.sqrt(sum(((F.col(a) - F.col(f"m{a}")) * (F.col(a) - F.col(f"m{a}")) for a in "xyz"), F.lit(0.0)))
    pull = rows.withColumn("over", F.greatest(gap - near, F.lit(0.0))).groupBy("scene", instance).agg(F.avg(F.col("over") * F.col("over")).alias("v"))
    variance = pull.groupBy("scene").agg(F.avg("v").alias("variance"))
    at = cut(means.select("scene", F.col(instance).alias("id"), *[F.col(f"m{a}").alias(a) for a in "xyz"]), "means")
    pairs = near_pairs(at, at, 2 * far, blocks).filter(F.col("src") != F.col("dst"))
    short = F.greatest(2 * far - F.col("dist"), F.lit(0.0))
    numbers = at.groupBy("scene").agg(F.count(F.lit(1)).alias("n"))
    close = pairs.groupBy("scene").agg(F.sum(short * short).alias("sum"))
    separation = close.join(numbers, "scene").select("scene", (F.col("sum") / (F.col("n") * (F.col("n") - 1))).alias("separation"))
    size = means.groupBy("scene").agg(F.avg(F.sqrt(sum((F.col(f"m{a}") * F.col(f"m{a}") for a in "xyz"), F.lit(0.0)))).alias("size"))
    return variance.join(separation, "scene", "left").join(size, "scene").select("scene", "variance", F.coalesce("separation", F.lit(0.0)).alias("separation"), "size")
