"""Queries on neighbour graphs, local geometry and label transfer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.plans import cut
from ..operators import geometry, graph, neighbors, order
from ..sources import scans
from ..sources.fixtures import POINTS, points, table

DIST = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"


def ids(df: DataFrame, id_col: str = "point_idx") -> DataFrame:
    return df.withColumnRenamed(id_col, "id")


def edges(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    p = ids(points(spark, sf_dir))
    return neighbors.knn(p, p, k, other=True)


def edges_sql(k: int, name: str = "edges") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT a.scene, a.point_idx AS src, b.point_idx AS dst, {DIST} AS dist, row_number() OVER (PARTITION BY a.scene, a.point_idx ORDER BY {DIST}, b.point_idx) AS rank
      FROM points a JOIN points b ON a.scene = b.scene AND a.point_idx <> b.point_idx) WHERE rank <= {k})"""


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Superpoints: scene, id, their centroid and points, and a class."""
    means = [F.avg(a).alias(a) for a in "xyz"]
    return points(spark, sf_dir).groupBy("scene", F.col("sp").alias("id")).agg(*means, F.count(F.lit(1)).alias("n")).withColumn("class", F.col("id") % 3)


CENTROIDS = "centroids AS (SELECT scene, sp AS id, avg(x) AS x, avg(y) AS y, avg(z) AS z, count(*) AS n, sp % 3 AS class FROM points GROUP BY scene, sp)"


def knn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir, 10).select("scene", "src", "dst", F.col("rank").cast("long").alias("rank"), F.round("dist", 6).alias("dist"))


def knn_dual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search for the wider graph; the narrower one is its first ranks."""
    return edges(spark, sf_dir, 12).select("scene", "src", "dst", (F.col("rank") <= 4).alias("narrow"))


def sp_knn_symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cut(centroids(spark, sf_dir))
    return neighbors.both_ways(neighbors.knn(c, c, 3, other=True))


def radius_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges up to a radius that the narrow graph doesn't have, at most five for a point."""
    p = ids(points(spark, sf_dir))
    found = neighbors.near_beyond(p, cut(neighbors.knn(p, p, 3, other=True).select("scene", "src", "dst")), 5, 0.15)
    return found.withColumn("rank", F.col("rank").cast("long"))


def face_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Superpoints that meet in a face; here a face is an order, and its corners are parts."""
    return neighbors.face_adjacency(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("face"), (F.col("l_partkey") % 50).alias("group")))


def nearest_label_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points take the label of the nearest point of a pruned set."""
    p = ids(points(spark, sf_dir))
    found = neighbors.transferred(p, p.filter("id % 3 = 0"), ["noisy"])
    return found.select("scene", F.col("id").alias("point_idx"), "nearest", F.col("noisy").alias("label"))


CUTOFF = 0.12


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Superpoints without a label (id 3 and more) and the nearest labelled one of their class, up to the cutoff."""
    c = cut(centroids(spark, sf_dir))
    return neighbors.nearest_of_class(c.filter("id >= 3"), c.filter("id < 3"), CUTOFF)


ASSIGNED = f"""assigned AS (SELECT scene, id, prior, dist FROM (SELECT a.scene, a.id, b.id AS prior, {DIST} AS dist, row_number() OVER (PARTITION BY a.scene, a.id ORDER BY {DIST}, b.id) AS k
    FROM centroids a JOIN centroids b ON a.scene = b.scene AND a.class = b.class AND a.id >= 3 AND b.id < 3) WHERE k = 1 AND dist <= {CUTOFF})"""


def nearest_instance_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assigned(spark, sf_dir).select("scene", "id", "prior", F.round("dist", 6).alias("dist"))


def whole_scene_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offset of each assigned superpoint to the point-weighted centre of all that belong to its prior."""
    c, a = centroids(spark, sf_dir), cut(assigned(spark, sf_dir))
    members = a.select("scene", "id", "prior").unionByName(c.filter("id < 3").select("scene", "id", F.col("id").alias("prior")))
    return graph.pooled_offsets(members, c).select("scene", "id", "prior", *[F.round(f"o{v}", 6).alias(f"o{v}") for v in "xyz"])


def edge_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.closeness(cut(edges(spark, sf_dir, 5))).select("scene", "src", "dst", F.round("weight", 6).alias("weight"))


def local_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    found = geometry.local_covariance(p, edges(spark, sf_dir, 10))
    return found.select("scene", "point_idx", *[F.round(c, 8).alias(c) for c in geometry.COVARIANCE])


def local_geometric_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = geometry.shape_features(geometry.local_covariance(points(spark, sf_dir), edges(spark, sf_dir, 10)))
    return found.select("scene", "point_idx", *[F.round(c, 5).alias(c) for c in found.columns[2:]])


def partition_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven values by which points are partitioned: shape, verticality twice, and colour."""
    p = points(spark, sf_dir)
    features = geometry.shape_features(geometry.local_covariance(p, edges(spark, sf_dir, 10)))
    coloured = p.select("scene", "point_idx", *[(F.col("point_idx") * k % 256).alias(c) for c, k in (("r", 1), ("g", 3), ("b", 7))])
    found = geometry.observations(features, coloured, ["r", "g", "b"])
    return found.select("scene", "point_idx", *[F.round(F.get("obs", F.lit(i)), 5).alias(f"f{i}") for i in range(7)])


def superpoint_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = geometry.superpoint_features(points(spark, sf_dir), "sp")
    return found.select("scene", "sp", *[F.round(c, 6).alias(c) for c in ("x", "y", "z", "length", "surface", "volume")], "n")


def superpoint_edge_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features of the edges between nearest superpoints."""
    c = cut(centroids(spark, sf_dir))
    e = neighbors.both_ways(neighbors.knn(c, c, 3, other=True)).select("scene", F.col("src").alias("a"), F.col("dst").alias("b"))
    found = geometry.edge_features(e, points(spark, sf_dir), "sp")
    return found.select("scene", "a", "b", *[F.round(c, 5).alias(c) for c in found.columns[3:]])


def object_point_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of a room with the class and number of the object whose point is nearest to them; the later object wins."""
    p = points(spark, sf_dir)
    objects = p.filter("point_idx % 3 = 0").select("scene", (F.col("sp") + 1).alias("ordinal"), F.col("sem").alias("label"), F.col("point_idx").alias("id"), *[(F.col(a) + 0.01).alias(a) for a in "xyz"])
    return scans.object_labels(ids(p), objects).select("scene", F.col("id").alias("point_idx"), "ordinal", "label")


def submission_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of superpoints, given to their points and from these to the full cloud's nearest ones; files count from 1."""
    p = ids(points(spark, sf_dir))
    classes = p.groupBy("scene", "sp").agg(F.min("noisy").alias("label"))
    near = neighbors.transferred(p, p.filter("id % 3 = 0"), ["sp"])
    return near.join(classes, ["scene", "sp"]).select("scene", F.col("id").alias("point_idx"), (F.col("label") + 1).alias("code"))


def knn_graph_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three neighbours of each point of the large cloud, whose places repeat and crowd."""
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 4).alias("scene"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * 100).alias("z"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"
    )
    placed = order.numbered(rows, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "x", "y", "z"], "id", ["scene", *"xyz"])
    return neighbors.knn(placed, placed, 3, other=True).select("scene", "src", "dst", F.round("dist", 6).alias("dist"))


def standardise_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """z-scores of edge lengths per scene; a scene without spread is divided by 1."""
    return graph.standardised(cut(edges(spark, sf_dir, 5)), ["dist"]).select("scene", "src", "dst", F.round("z_dist", 5).alias("z"))


QUERIES = {
    f.__name__: f
    for f in (
        knn_graph, knn_dual, sp_knn_symmetric, radius_capped, face_adjacency, nearest_label_transfer, nearest_instance_centre, whole_scene_propagation, edge_weight,
        local_covariance, local_geometric_features, partition_observations, superpoint_geometry, superpoint_edge_features, object_point_labels, submission_labels, knn_graph_cloud, standardise_features,
    )
}

def eigen_sql(source: str, name: str = "eigen") -> str:
    """Common tables that end in `name`: source, which has the covariances, with l1, l2 and l3."""
    det = "(cxx - q) * ((cyy - q) * (czz - q) - cyz * cyz) - cxy * (cxy * (czz - q) - cyz * cxz) + cxz * (cxy * cyz - (cyy - q) * cxz)"
    return f"""e0 AS (SELECT *, (cxx + cyy + czz) / 3 AS q FROM {source}), e1 AS (SELECT *, sqrt(((cxx - q) * (cxx - q) + (cyy - q) * (cyy - q) + (czz - q) * (czz - q) + 2 * (cxy * cxy + cxz * cxz + cyz * cyz)) / 6) AS p FROM e0),
        e2 AS (SELECT *, acos(CASE WHEN p > 0 THEN greatest(least(({det}) / (2 * p * p * p), 1), -1) ELSE 1 END) / 3 AS t FROM e1),
        e3 AS (SELECT *, q + 2 * p * cos(t) AS m1, q + 2 * p * cos(t + CAST(2.0943951023931953 AS DOUBLE)) AS m3 FROM e2), {name} AS (SELECT *, greatest(m1, 0) AS l1, greatest(3 * q - m1 - m3, 0) AS l2, greatest(m3, 0) AS l3 FROM e3)"""


def vector_sql(value: str) -> str:
    """The longest product of two rows of the covariances less `value`, as a list of its length and parts."""
    m = [[f"c{min(a, b)}{max(a, b)}" if a != b else f"(c{a}{a} - {value})" for b in "xyz"] for a in "xyz"]
    products = []
    for i, j in ((0, 1), (0, 2), (1, 2)):
        v = [f"({m[i][k]} * {m[j][n]} - {m[i][n]} * {m[j][k]})" for k, n in ((1, 2), (2, 0), (0, 1))]
        products.append(f"[sqrt({' + '.join(f'{x} * {x}' for x in v)}), {', '.join(v)}]")
    return f"list_sort([{', '.join(products)}])[3]"


_SHAPE = f"""m AS (SELECT scene, src, dst FROM edges UNION ALL SELECT scene, point_idx, point_idx FROM points),
    cov AS (SELECT m.scene, m.src AS point_idx, {", ".join(f"covar_pop({a}, {b}) AS c{a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz"))} FROM m JOIN points p ON p.scene = m.scene AND p.point_idx = m.dst GROUP BY m.scene, m.src), {eigen_sql("cov")},
    v0 AS (SELECT *, {vector_sql("l1")} AS a, {vector_sql("l3")} AS c FROM eigen), v1 AS (SELECT * REPLACE (list_transform(a[2:4], lambda x: x / a[1]) AS a, list_transform(c[2:4], lambda x: x / c[1]) AS c) FROM v0),
    v2 AS (SELECT *, a[1] * c[1] + a[2] * c[2] + a[3] * c[3] AS d FROM v1), v3 AS (SELECT *, [c[1] - d * a[1], c[2] - d * a[2], c[3] - d * a[3]] AS e FROM v2),
    v4 AS (SELECT *, list_transform(e, lambda x: x / sqrt(e[1] * e[1] + e[2] * e[2] + e[3] * e[3])) AS f FROM v3),
    v5 AS (SELECT *, [l1 * abs(a[1]) + l2 * abs(f[2] * a[3] - f[3] * a[2]) + l3 * abs(f[1]), l1 * abs(a[2]) + l2 * abs(f[3] * a[1] - f[1] * a[3]) + l3 * abs(f[2]), l1 * abs(a[3]) + l2 * abs(f[1] * a[2] - f[2] * a[1]) + l3 * abs(f[3])] AS u FROM v4),
    shape AS (SELECT scene, point_idx, (sqrt(l1) - sqrt(l2)) / sqrt(l1) AS linearity, (sqrt(l2) - sqrt(l3)) / sqrt(l1) AS planarity, sqrt(l3) / sqrt(l1) AS scattering, u[3] / sqrt(u[1] * u[1] + u[2] * u[2] + u[3] * u[3]) AS verticality FROM v5)"""
SP_FEATURES = f"""sp0 AS (SELECT scene, sp, avg(x) AS x, avg(y) AS y, avg(z) AS z, count(*) AS n, {", ".join(f"coalesce(covar_samp({a}, {b}), 0) AS c{a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz"))}, sqrt(var_pop(x) + var_pop(y) + var_pop(z)) AS spread FROM points GROUP BY scene, sp), {eigen_sql("sp0")},
    features AS (SELECT scene, sp, x, y, z, n, CASE WHEN n > 2 THEN l1 WHEN n = 2 THEN spread ELSE 0 END AS length, CASE WHEN n > 2 THEN sqrt(l1 * l2 + CAST(1e-10 AS DOUBLE)) ELSE 0 END AS surface, CASE WHEN n > 2 THEN sqrt(l1 * l2 * l3 + CAST(1e-10 AS DOUBLE)) ELSE 0 END AS volume FROM eigen)"""
COMPARED = ", ".join([f"round(u.{c} - v.{c}, {{0}}) AS centroid_{c}" for c in "xyz"] + [f"round(u.{c} / (v.{c} + CAST(0.000001 AS DOUBLE)), {{0}}) AS {r}" for c, r in (("length", "length_ratio"), ("surface", "surface_ratio"), ("volume", "volume_ratio"), ("n", "count_ratio"))])
_DELTA = {c: f"(p.{c} - q.{c})" for c in "xyz"}
_COV = ", ".join(f"round(covar_pop({a}, {b}), 8) AS c{a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz"))
ORACLES = {
    "knn_graph": f"WITH {POINTS}, {edges_sql(10)} SELECT scene, src, dst, rank, round(dist, 6) AS dist FROM edges",
    "knn_dual": f"WITH {POINTS}, {edges_sql(12)} SELECT scene, src, dst, rank <= 4 AS narrow FROM edges",
    "sp_knn_symmetric": f"""WITH {POINTS}, {CENTROIDS}, e AS (SELECT a.scene, a.id AS src, b.id AS dst, row_number() OVER (PARTITION BY a.scene, a.id ORDER BY {DIST}, b.id) AS k FROM centroids a JOIN centroids b ON a.scene = b.scene AND a.id <> b.id)
        SELECT scene, src, dst FROM e WHERE k <= 3 UNION SELECT scene, dst, src FROM e WHERE k <= 3""",
    "radius_capped": f"""WITH {POINTS}, {edges_sql(3)}, r AS (SELECT a.scene, a.point_idx AS src, b.point_idx AS dst, {DIST} AS dist FROM points a JOIN points b ON a.scene = b.scene AND a.point_idx <> b.point_idx AND {DIST} <= 0.15),
        n AS (SELECT scene, src, dst, row_number() OVER (PARTITION BY scene, src ORDER BY dist, dst) AS rank FROM r ANTI JOIN edges USING (scene, src, dst)) SELECT * FROM n WHERE rank <= 5""",
    "face_adjacency": "WITH c AS (SELECT DISTINCT l_orderkey AS face, l_partkey % 50 AS sp FROM lineitem) SELECT DISTINCT a.sp AS src, b.sp AS dst FROM c a JOIN c b ON a.face = b.face AND a.sp <> b.sp",
    "nearest_label_transfer": f"""WITH {POINTS}, r AS (SELECT a.scene, a.point_idx, b.point_idx AS nearest, b.noisy AS label, row_number() OVER (PARTITION BY a.scene, a.point_idx ORDER BY {DIST}, b.point_idx) AS k
        FROM points a JOIN points b ON a.scene = b.scene AND b.point_idx % 3 = 0) SELECT scene, point_idx, nearest, label FROM r WHERE k = 1""",
    "nearest_instance_centre": f"WITH {POINTS}, {CENTROIDS}, {ASSIGNED} SELECT scene, id, prior, round(dist, 6) AS dist FROM assigned",
    "whole_scene_propagation": f"""WITH {POINTS}, {CENTROIDS}, {ASSIGNED}, m AS (SELECT scene, id, prior FROM assigned UNION ALL SELECT scene, id, id FROM centroids WHERE id < 3), j AS (SELECT * FROM m JOIN centroids USING (scene, id))
        SELECT scene, id, prior, {", ".join(f"round(sum({v} * n) OVER w / sum(n) OVER w - {v}, 6) AS o{v}" for v in "xyz")} FROM j WINDOW w AS (PARTITION BY scene, prior)""",
    "edge_weight": f"WITH {POINTS}, {edges_sql(5)} SELECT scene, src, dst, round(1 / (1 + dist / avg(dist) OVER (PARTITION BY scene)), 6) AS weight FROM edges",
    "local_covariance": f"""WITH {POINTS}, {edges_sql(10)}, m AS (SELECT scene, src, dst FROM edges UNION ALL SELECT scene, point_idx, point_idx FROM points)
        SELECT m.scene, m.src AS point_idx, {_COV} FROM m JOIN points p ON p.scene = m.scene AND p.point_idx = m.dst GROUP BY m.scene, m.src""",
    "local_geometric_features": f"WITH {POINTS}, {edges_sql(10)}, {_SHAPE} SELECT scene, point_idx, round(linearity, 5) AS linearity, round(planarity, 5) AS planarity, round(scattering, 5) AS scattering, round(verticality, 5) AS verticality FROM shape",
    "partition_observations": f"""WITH {POINTS}, {edges_sql(10)}, {_SHAPE} SELECT scene, point_idx, round(linearity, 5) AS f0, round(planarity, 5) AS f1, round(scattering, 5) AS f2, round(2 * verticality, 5) AS f3,
        {", ".join(f"round(point_idx * {k} % 256 / CAST(255 AS DOUBLE), 5) AS f{i}" for i, k in ((4, 1), (5, 3), (6, 7)))} FROM shape""",
    "superpoint_geometry": f"WITH {POINTS}, {SP_FEATURES} SELECT scene, sp, {', '.join(f'round({c}, 6) AS {c}' for c in ('x', 'y', 'z', 'length', 'surface', 'volume'))}, n FROM features",
    "superpoint_edge_features": f"""WITH {POINTS}, {CENTROIDS}, k AS (SELECT a.scene, a.id AS src, b.id AS dst, row_number() OVER (PARTITION BY a.scene, a.id ORDER BY {DIST}, b.id) AS k FROM centroids a JOIN centroids b ON a.scene = b.scene AND a.id <> b.id),
        w AS (SELECT scene, src AS a, dst AS b FROM k WHERE k <= 3 UNION SELECT scene, dst, src FROM k WHERE k <= 3), {SP_FEATURES}, o AS (SELECT *, row_number() OVER (PARTITION BY scene, sp ORDER BY md5(CAST(point_idx AS VARCHAR))) AS place FROM points),
        d AS (SELECT w.scene, w.a, w.b, {", ".join(f"round(avg({_DELTA[c]}), 5) AS mean_{c}" for c in "xyz")}, {", ".join(f"round(stddev_pop({_DELTA[c]}), 5) AS std_{c}" for c in "xyz")}, round(avg(sqrt({" + ".join(f"{d} * {d}" for d in _DELTA.values())})), 5) AS delta_norm
          FROM w JOIN o p ON p.scene = w.scene AND p.sp = w.a JOIN o q ON q.scene = w.scene AND q.sp = w.b AND q.place = p.place GROUP BY w.scene, w.a, w.b)
        SELECT d.*, {COMPARED.format(5)} FROM d JOIN features u ON u.scene = d.scene AND u.sp = d.a JOIN features v ON v.scene = d.scene AND v.sp = d.b""",
    "object_point_labels": f"""WITH {POINTS}, o AS (SELECT scene, sp + 1 AS ordinal, sem AS label, point_idx, x + CAST(0.01 AS DOUBLE) AS x, y + CAST(0.01 AS DOUBLE) AS y, z + CAST(0.01 AS DOUBLE) AS z FROM points WHERE point_idx % 3 = 0),
        n AS (SELECT a.scene, a.ordinal, a.label, b.point_idx, row_number() OVER (PARTITION BY a.scene, a.point_idx ORDER BY {DIST}, b.point_idx) AS k FROM o a JOIN points b ON a.scene = b.scene)
        SELECT scene, point_idx, max(ordinal) AS ordinal, max_by(label, ordinal) AS label FROM n WHERE k = 1 GROUP BY scene, point_idx""",
    "submission_labels": f"""WITH {POINTS}, c AS (SELECT scene, sp, min(noisy) AS label FROM points GROUP BY scene, sp), r AS (SELECT a.scene, a.point_idx, b.sp, row_number() OVER (PARTITION BY a.scene, a.point_idx ORDER BY {DIST}, b.point_idx) AS k
        FROM points a JOIN points b ON a.scene = b.scene AND b.point_idx % 3 = 0) SELECT r.scene, point_idx, label + 1 AS code FROM r JOIN c ON c.scene = r.scene AND c.sp = r.sp WHERE k = 1""",
    "standardise_features": f"WITH {POINTS}, {edges_sql(5)} SELECT scene, src, dst, round((dist - avg(dist) OVER w) / CASE WHEN stddev_pop(dist) OVER w > 0 THEN stddev_pop(dist) OVER w ELSE 1 END, 5) AS z FROM edges WINDOW w AS (PARTITION BY scene)",
}
