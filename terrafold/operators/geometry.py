"""Covariances by aggregation, and the features that follow from their eigenvalues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.plans import cut
from .order import running

PAIRS = ("xx", "xy", "xz", "yy", "yz", "zz")
COVARIANCE = [f"c{p}" for p in PAIRS]


def covariances(sample: bool = False) -> list[Column]:
    of = F.covar_samp if sample else F.covar_pop
    return [of(p[0], p[1]).alias(f"c{p}") for p in PAIRS]


def local_covariance(points: DataFrame, edges: DataFrame) -> DataFrame:
    """(scene, point_idx, covariances) of each point and its neighbours, divided by their number."""
    members = edges.select("scene", "src", "dst").unionByName(points.select("scene", F.col("point_idx").alias("src"), F.col("point_idx").alias("dst")))
    there = points.select("scene", F.col("point_idx").alias("dst"), *"xyz")
    return members.join(there, ["scene", "dst"]).groupBy("scene", F.col("src").alias("point_idx")).agg(*covariances())


def with_eigenvalues(rows: DataFrame) -> DataFrame:
    """Adds l1, l2, l3, the eigenvalues of the covariances in descending order, none below 0, by the closed form for symmetric matrices."""
    c = {p: F.coalesce(F.col(f"c{p}"), F.lit(0.0)) for p in PAIRS}
    rows = rows.withColumns({f"__{p}": v for p, v in c.items()})
    rows = rows.withColumn("__q", (F.col("__xx") + F.col("__yy") + F.col("__zz")) / 3)
    off = F.col("__xy") * F.col("__xy") + F.col("__xz") * F.col("__xz") + F.col("__yz") * F.col("__yz")
    on = [F.col(f"__{a}{a}") - F.col("__q") for a in "xyz"]
    rows = rows.withColumns({"__p": F.sqrt((on[0] * on[0] + on[1] * on[1] + on[2] * on[2] + 2 * off) / 6), **{f"__d{a}": d for a, d in zip("xyz", on, strict=True)}})
    dx, dy, dz, xy, xz, yz, p = (F.col(f"__{x}") for x in ("dx", "dy", "dz", "xy", "xz", "yz", "p"))
    det = dx * (dy * dz - yz * yz) - xy * (xy * dz - yz * xz) + xz * (xy * yz - dy * xz)
    rows = rows.withColumn("__r", F.when(p > 0, F.greatest(F.least(det / (2 * p * p * p), F.lit(1.0)), F.lit(-1.0))).otherwise(1.0))
    rows = rows.withColumn("__t", F.acos("__r") / 3)
    first, last = F.col("__q") + 2 * p * F.cos("__t"), F.col("__q") + 2 * p * F.cos(F.col("__t") + 2.0943951023931953)
    rows = rows.withColumns({"__l1": first, "__l3": last}).withColumn("__l2", 3 * F.col("__q") - F.col("__l1") - F.col("__l3"))
    return rows.withColumns({f"l{i}": F.greatest(f"__l{i}", F.lit(0.0)) for i in (1, 2, 3)}).drop("__q", "__p", "__dx", "__dy", "__dz", "__r", "__t", "__l1", "__l2", "__l3")


def _cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _norm(v: list[Column]) -> Column:
    return F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])


def _with_vector(rows: DataFrame, name: str, value: str) -> DataFrame:
    """Adds (name)0..2, a vector that the matrix less `value` maps to 0, the longest product of two of its rows, and its length (name)n."""
    m = [[F.col(f"__{min(a, b)}{max(a, b)}") - (F.col(value) if a == b else 0.0) for b in "xyz"] for a in "xyz"]
    products = [_cross(m[i], m[j]) for i, j in ((0, 1), (0, 2), (1, 2))]
    best = F.array_max(F.array(*[F.struct(_norm(v).alias("n"), v[0].alias("a"), v[1].alias("b"), v[2].alias("c")) for v in products]))
    rows = rows.withColumn("__v", best)
    return rows.withColumns({f"{name}n": F.col("__v.n"), **{f"{name}{i}": F.col(f"__v.{x}") for i, x in enumerate("abc")}}).drop("__v")


def shape_features(covariance: DataFrame) -> DataFrame:
    """linearity, planarity, scattering and verticality of each neighbourhood; 0 where it is a single place.

    Verticality is the part of z in the sum of the eigenvectors' absolute parts, weighed by the eigenvalues.  A direction that equal
    eigenvalues leave open is an axis, or what is square to the directions that are known.
    """
    rows = with_eigenvalues(covariance)
    rows = _with_vector(_with_vector(rows, "__a", "l1"), "__c", "l3")
    small = 1e-14 * F.col("l1") * F.col("l1")
    known = F.col("__an") > small
    rows = rows.withColumns({f"__a{i}": F.when(known, F.col(f"__a{i}") / F.col("__an")).otherwise(1.0 if i == 0 else 0.0) for i in range(3)})
    a, c = [F.col(f"__a{i}") for i in range(3)], [F.when(F.col("__cn") > small, F.col(f"__c{i}") / F.col("__cn")).otherwise(0.0) for i in range(3)]
    rows = rows.withColumns({f"__c{i}": x for i, x in enumerate(c)})
    c = [F.col(f"__c{i}") for i in range(3)]
    dot = a[0] * c[0] + a[1] * c[1] + a[2] * c[2]
    rows = rows.withColumns({f"__e{i}": c[i] - dot * a[i] for i in range(3)})
    free = [-a[2] * a[0], -a[2] * a[1], 1 - a[2] * a[2]]  # z less its part along the first vector
    flat = [1 - a[0] * a[0], -a[0] * a[1], -a[0] * a[2]]
    e = [F.col(f"__e{i}") for i in range(3)]
    rows = rows.withColumns({f"__f{i}": F.when(_norm(e) > 1e-6, e[i]).when(_norm(free) > 1e-6, free[i]).otherwise(flat[i]) for i in range(3)})
    f = [F.col(f"__f{i}") for i in range(3)]
    rows = rows.withColumn("__fn", _norm(f)).withColumns({f"__f{i}": F.col(f"__f{i}") / F.col("__fn") for i in range(3)})
    b = _cross(f, a)
    rows = rows.withColumns({f"__u{i}": F.col("l1") * F.abs(a[i]) + F.col("l2") * F.abs(b[i]) + F.col("l3") * F.abs(f[i]) for i in range(3)})
    norm, root = _norm([F.col(f"__u{i}") for i in range(3)]), [F.sqrt(f"l{i}") for i in (1, 2, 3)]
    shape = {"linearity": root[0] - root[1], "planarity": root[1] - root[2], "scattering": root[2]}
    return rows.select("scene", "point_idx", *[F.when(root[0] > 0, v / root[0]).otherwise(0.0).alias(n) for n, v in shape.items()], F.when(norm > 0, F.col("__u2") / norm).otherwise(0.0).alias("verticality"))


def superpoint_features(points: DataFrame, by: str) -> DataFrame:
    """Centroid, length, surface, volume and number of points of each superpoint.

    From the sample covariance; one point gives 0, and two give the root of their summed variances as length, and 0 for the rest.
    """
    stats = points.groupBy("scene", by).agg(*[F.avg(a).alias(a) for a in "xyz"], F.count(F.lit(1)).alias("n"), *covariances(sample=True), F.sqrt(F.var_pop("x") + F.var_pop("y") + F.var_pop("z")).alias("spread"))
    rows, many = with_eigenvalues(stats), F.col("n") > 2
    length = F.when(many, F.col("l1")).when(F.col("n") == 2, F.col("spread")).otherwise(0.0)
    surface = F.when(many, F.sqrt(F.col("l1") * F.col("l2") + 1e-10)).otherwise(0.0)
    volume = F.when(many, F.sqrt(F.col("l1") * F.col("l2") * F.col("l3") + 1e-10)).otherwise(0.0)
    return rows.select("scene", by, *"xyz", "n", length.alias("length"), surface.alias("surface"), volume.alias("volume"))


def observations(features: DataFrame, points: DataFrame, colours: list[str]) -> DataFrame:
    """points with obs: linearity, planarity, scattering, twice the verticality, and the colours over 255."""
    shape = F.array("linearity", "planarity", "scattering", 2 * F.col("verticality"), *[F.col(c) / 255.0 for c in colours])
    return points.join(features, ["scene", "point_idx"]).select(*points.columns, shape.alias("obs"))


def edge_features(edges: DataFrame, points: DataFrame, by: str) -> DataFrame:
    """The 13 features of each edge (scene, a, b) between superpoints, and the mean length of the offsets as delta_norm.

    Mean and spread are of the offsets between points of both, as many as the smaller has: points are paired by their place in an order by
    hash, which is a random equal sample of either.  The rest compares centroids, length, surface, volume and number of points.
    """
    placed = running(points.select("scene", F.col(by).alias("sp"), *"xyz", F.md5(F.col("point_idx").cast("string")).alias("__h")), ["scene", "sp"], ["__h"], []).drop("__h")
    placed = cut(placed, "placed")
    a = placed.select("scene", F.col("sp").alias("a"), "place", *[F.col(c).alias(f"a{c}") for c in "xyz"])
    b = placed.select("scene", F.col("sp").alias("b"), "place", *[F.col(c).alias(f"b{c}") for c in "xyz"])
    pairs = edges.select("scene", "a", "b").join(a, ["scene", "a"]).join(b, ["scene", "b", "place"])
    d = {c: F.col(f"a{c}") - F.col(f"b{c}") for c in "xyz"}
    norm = F.sqrt(d["x"] * d["x"] + d["y"] * d["y"] + d["z"] * d["z"])
    deltas = pairs.groupBy("scene", "a", "b").agg(*[F.avg(d[c]).alias(f"mean_{c}") for c in "xyz"], *[F.stddev_pop(d[c]).alias(f"std_{c}") for c in "xyz"], F.avg(norm).alias("delta_norm"))
    return compared(deltas, superpoint_features(points, by), by)


def compared(edges: DataFrame, features: DataFrame, by: str) -> DataFrame:
    """edges (scene, a, b) with the offsets of the centroids and the ratios of length, surface, volume and number of points."""
    left = features.select("scene", F.col(by).alias("a"), *[F.col(c).alias(f"__a{c}") for c in ("x", "y", "z", "length", "surface", "volume", "n")])
    right = features.select("scene", F.col(by).alias("b"), *[F.col(c).alias(f"__b{c}") for c in ("x", "y", "z", "length", "surface", "volume", "n")])
    both = edges.join(left, ["scene", "a"]).join(right, ["scene", "b"])
    ratios = {"length": "length_ratio", "surface": "surface_ratio", "volume": "volume_ratio", "n": "count_ratio"}
    return both.select(*edges.columns, *[(F.col(f"__a{c}") - F.col(f"__b{c}")).alias(f"centroid_{c}") for c in "xyz"], *[(F.col(f"__a{c}") / (F.col(f"__b{c}") + 1e-6)).alias(r) for c, r in ratios.items()])
