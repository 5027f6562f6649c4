"""Queries on grouping, absorption, suppression and superpoint edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.plans import cut
from ..operators import cluster, components, graph, instances, planes, pursuit
from ..operators.neighbors import distance
from ..sources.fixtures import POINTS, cloud, points, table
from .neighbours import COMPARED, DIST, SP_FEATURES, edges, edges_sql, ids
from .scores import scene_masks, scene_sql

NEAR, REACH, LONGEST, GROW, STRENGTH, SMALL = 0.2, 0.25, 0.3, 0.8, 0.01, 4


def component_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of one class and within a distance of each other."""
    n = ids(points(spark, sf_dir)).select("scene", "id", "sem", *"xyz")
    joined = (F.col("s_sem") == F.col("d_sem")) & (distance("s_", "d_") < NEAR)
    return cluster.grouped(edges(spark, sf_dir, 4), n, joined)


def fragment_absorption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points whose id is a multiple of 6 are primaries, the others fragments."""
    p = ids(points(spark, sf_dir)).select("scene", F.col("sem").alias("class"), "id", *"xyz").withColumn("reach", F.lit(REACH))
    return cluster.absorbed(p.filter("id % 6 != 0"), p.filter("id % 6 = 0"), "reach")


def nms_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of all scenes, of which those suppress each other that share a ground truth for a tenth of both."""
    _, preds, found = scene_masks(spark, sf_dir, 1)
    box = (F.col("scene") * 10 + F.col("pred")).alias("id")
    part = found.filter(F.col("iou") > 0.1).select("scene", "gt", box)
    pairs = part.alias("u").join(part.alias("v"), ["scene", "gt"]).filter(F.col("u.id") < F.col("v.id")).select(F.col("u.id").alias("a"), F.col("v.id").alias("b"))
    return cluster.suppressed(cut(preds.select(box, F.col("conf").alias("score"))), cut(pairs))


def superedge_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Superedges over point edges shorter than a bound."""
    found = cluster.superedges(cut(edges(spark, sf_dir, 6)), points(spark, sf_dir), "sp", LONGEST)
    return found.select("scene", "a", "b", "edges", *[F.round(c, 6).alias(c) for c in found.columns[4:]])


def wall_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to four planes of the large cloud's scenes."""
    found = planes.walls(cloud(spark, sf_dir), 1.0, 4, 100)
    return found.select("scene", "wall", *[F.round(c, 6).alias(c) for c in "abcd"], "points")


def random_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.random_subgraph(cut(edges(spark, sf_dir, 3)), ids(points(spark, sf_dir)), 20)


def superpoint_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in the part of superpoints: a class, a predicted centre and a size."""
    return ids(points(spark, sf_dir)).select("scene", "id", F.col("sem").alias("class"), *"xyz", (0.1 + F.col("id") % 5 / 20).alias("size"))


def seeded_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.seeded(cut(edges(spark, sf_dir, 4)), cut(superpoint_nodes(spark, sf_dir)), GROW)


def absorption_in_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of the growth; small ones go to the nearest large one of their class."""
    n = cut(superpoint_nodes(spark, sf_dir))
    grown = cut(cluster.seeded(cut(edges(spark, sf_dir, 4)), n, GROW))
    groups = grown.join(n, ["scene", "id"]).groupBy("scene", "class", F.col("cluster").alias("id")).agg(
        *[F.avg(a).alias(a) for a in "xyz"], F.count(F.lit(1)).alias("points"), F.count(F.lit(1)).alias("parts"), F.avg(40 + F.col("id") % 7).alias("voxels"), F.avg("size").alias("size")
    )
    return cluster.absorbed_in_turn(cut(groups.withColumn("fragment", F.col("points") < 2)))


def instance_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points over expected voxels, the mean over an instance's superpoints of the exponential of what is predicted for them."""
    p = points(spark, sf_dir)
    parts = p.groupBy("scene", "ins", "sp").agg(F.count(F.lit(1)).alias("n"), F.exp(F.ln(F.lit(3.0) + F.col("sp"))).alias("voxels"))
    found = cluster.confidence(parts.groupBy("scene", "ins").agg(F.sum("n").alias("points"), F.avg("voxels").alias("voxels")))
    return found.select("scene", "ins", "points", F.round("conf", 6).alias("conf"))


def superpoint_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of near-equal places over the neighbour graph, edges weighed by their length, by splits and merges in turn."""
    e = cut(edges(spark, sf_dir, 5)).withColumn("weight", 1 / (1 + F.col("dist")))
    values = ids(points(spark, sf_dir)).select("scene", "id", F.array(*[F.col(a) for a in "xyz"]).alias("value"))
    return pursuit.cut_pursuit(e, values, STRENGTH)


def components_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components over short edges; those of few points go to the largest component that any edge leads to."""
    e, p = cut(edges(spark, sf_dir, 5)), points(spark, sf_dir)
    labels = cut(components.scene_components(e.filter(F.col("dist") < 0.1)))
    found = components.merged_small(p.select("scene", F.col("point_idx").alias("node")), labels, e, SMALL)
    return found.select("scene", F.col("node").alias("point_idx"), "component")


def order_part_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and parts linked by lines; parts have negative numbers."""
    links = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), (-1 - F.col("l_partkey")).alias("dst"))
    return components.connected_components(links)


def _assembled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All instances of scenes whose superpoints are the points' remainders by 16: the first three of five classes are ceiling, floor and walls."""
    p = points(spark, sf_dir).select("scene", "point_idx", (F.col("point_idx") % 16).alias("sp"), *"xyz")
    parts = p.groupBy("scene", F.col("sp").alias("id")).agg(*[F.avg(a).alias(a) for a in "xyz"])
    parts = cut(parts.select("scene", "id", (F.col("id") % 5).alias("class"), *"xyz", (0.1 + F.col("id") % 4 / 10).alias("size"), F.ln(3.0 + F.col("id") % 7 * 3).alias("occupancy")))
    links = cut(parts.select("scene", F.col("id").alias("src"), F.explode(F.array((F.col("id") + 5) % 16, (F.col("id") + 1) % 16)).alias("dst")))
    return instances.scene_instances(links, parts, p, stuff_points=8, wall_points_=6, wall_distance=0.1, most_walls=2)


def scene_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each scene's instances, from superpoints to things, ceiling, floor and walls."""
    return _assembled(spark, sf_dir)[0]


def scene_instance_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assembled(spark, sf_dir)[1]


QUERIES = {f.__name__: f for f in (component_grouping, fragment_absorption, nms_greedy, superedge_features, wall_planes, random_subgraph, seeded_growth, absorption_in_turn, instance_confidence, superpoint_partition, components_cutoff, order_part_components, scene_instances, scene_instance_points)}

_CROSS = ", ".join([f"round(avg(a.{c} - b.{c}), 6) AS mean_{c}" for c in "xyz"] + [f"round(stddev_pop(a.{c} - b.{c}), 6) AS std_{c}" for c in "xyz"])
ORACLES = {
    "component_grouping": f"""WITH RECURSIVE {POINTS}, {edges_sql(4)}, k AS (SELECT e.src, e.dst FROM edges e JOIN points a ON a.point_idx = e.src JOIN points b ON b.point_idx = e.dst WHERE a.sem = b.sem AND {DIST} < CAST({NEAR} AS DOUBLE)),
        s AS (SELECT src AS u, dst AS v FROM k UNION SELECT dst, src FROM k), r AS (SELECT point_idx AS a, point_idx AS c FROM points UNION SELECT r.a, s.v FROM r JOIN s ON r.c = s.u)
        SELECT p.scene, r.a AS id, min(r.c) AS cluster FROM r JOIN points p ON p.point_idx = r.a GROUP BY p.scene, r.a""",
    "fragment_absorption": f"""WITH {POINTS}, c AS (SELECT a.scene, a.point_idx AS id, b.point_idx AS "into", {DIST} AS dist, row_number() OVER (PARTITION BY a.point_idx ORDER BY {DIST}, b.point_idx) AS k
        FROM points a JOIN points b ON a.scene = b.scene AND a.sem = b.sem AND a.point_idx % 6 <> 0 AND b.point_idx % 6 = 0) SELECT scene, id, "into" FROM c WHERE k = 1 AND dist <= CAST({REACH} AS DOUBLE)""",
    "nms_greedy": f"""WITH RECURSIVE {scene_sql(1)}, b AS (SELECT scene * 10 + pred AS id, conf AS score, row_number() OVER (ORDER BY conf DESC, scene * 10 + pred) AS k FROM preds),
        part AS (SELECT scene, gt, scene * 10 + pred AS id FROM found WHERE iou > CAST(0.1 AS DOUBLE)), o AS (SELECT DISTINCT u.id AS a, v.id AS b FROM part u JOIN part v ON u.scene = v.scene AND u.gt = v.gt AND u.id <> v.id),
        w AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept UNION ALL SELECT b.k, CASE WHEN EXISTS (SELECT 1 FROM o WHERE o.a = b.id AND list_contains(w.kept, o.b)) THEN w.kept ELSE list_append(w.kept, b.id) END FROM w JOIN b ON b.k = w.k + 1)
        SELECT id, list_contains((SELECT kept FROM w ORDER BY k DESC LIMIT 1), id) AS kept FROM b""",
    "superedge_features": f"""WITH {POINTS}, {edges_sql(6)}, {SP_FEATURES},
        s AS (SELECT e.scene, a.sp AS a, b.sp AS b, count(*) AS edges, {_CROSS}, round(avg({DIST}), 6) AS delta_norm FROM edges e JOIN points a ON a.scene = e.scene AND a.point_idx = e.src JOIN points b ON b.scene = e.scene AND b.point_idx = e.dst WHERE a.sp <> b.sp AND {DIST} < {LONGEST} GROUP BY e.scene, a.sp, b.sp)
        SELECT s.*, {COMPARED.format(6)} FROM s JOIN features u ON u.scene = s.scene AND u.sp = s.a JOIN features v ON v.scene = s.scene AND v.sp = s.b""",
    "instance_confidence": f"""WITH {POINTS}, p AS (SELECT scene, ins, sp, count(*) AS n, exp(ln(3 + sp)) AS voxels FROM points GROUP BY scene, ins, sp)
        SELECT scene, ins, CAST(sum(n) AS BIGINT) AS points, round(least(sum(n) / avg(voxels), 1), 6) AS conf FROM p GROUP BY scene, ins""",
    "components_cutoff": f"""WITH RECURSIVE {POINTS}, {edges_sql(5)}, b AS (SELECT scene, src AS u, dst AS v FROM edges WHERE dist < CAST(0.1 AS DOUBLE) UNION SELECT scene, dst, src FROM edges WHERE dist < CAST(0.1 AS DOUBLE)),
        r AS (SELECT scene, point_idx AS a, point_idx AS c FROM points UNION SELECT r.scene, r.a, b.v FROM r JOIN b ON r.scene = b.scene AND r.c = b.u), l AS (SELECT scene, a AS node, min(c) AS comp FROM r GROUP BY scene, a),
        z AS (SELECT scene, comp, count(*) AS size FROM l GROUP BY scene, comp), w AS (SELECT scene, src, dst FROM edges UNION SELECT scene, dst, src FROM edges),
        t AS (SELECT l.scene, l.comp, m.comp AS other, row_number() OVER (PARTITION BY l.scene, l.comp ORDER BY y.size DESC, m.comp) AS k FROM w JOIN l ON l.scene = w.scene AND l.node = w.src JOIN l m ON m.scene = w.scene AND m.node = w.dst AND m.comp <> l.comp
          JOIN z ON z.scene = l.scene AND z.comp = l.comp AND z.size < {SMALL} JOIN z y ON y.scene = m.scene AND y.comp = m.comp AND (y.size > z.size OR (y.size = z.size AND y.comp < z.comp))),
        g AS (SELECT scene, comp, comp AS into_, 0 AS d FROM z UNION ALL SELECT g.scene, g.comp, t.other, d + 1 FROM g JOIN t ON t.scene = g.scene AND t.comp = g.into_ AND t.k = 1)
        SELECT l.scene, l.node AS point_idx, max_by(g.into_, g.d) AS component FROM l JOIN g ON g.scene = l.scene AND g.comp = l.comp GROUP BY l.scene, l.node""",
}
