"""Queries on neighbour graphs as graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.plans import cut
from ..operators import graph
from ..operators.components import scene_components
from ..sources.fixtures import POINTS, points
from .neighbours import edges, edges_sql, ids


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids(points(spark, sf_dir)).withColumn("label", F.when(F.col("id") % 5 == 0, graph.UNLABELLED).otherwise(F.col("ins")))


NODES = f"{POINTS}, nodes AS (SELECT *, point_idx AS id, CASE WHEN point_idx % 5 = 0 THEN -100 ELSE ins END AS label FROM points)"


def edge_same_instance_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = graph.with_ends(edges(spark, sf_dir, 5), nodes(spark, sf_dir), "label")
    return e.select("scene", "src", "dst", graph.same_instance(F.col("src_label"), F.col("dst_label")).cast("long").alias("flag"))


def induced_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.induced(edges(spark, sf_dir, 5), nodes(spark, sf_dir).filter("sem != 2")).select("scene", "src", "dst")


def edge_in_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.in_degree(edges(spark, sf_dir, 2), nodes(spark, sf_dir))


def edge_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes in shards of about 40 edges, in the order of their ids."""
    found = graph.running_sum(cut(graph.in_degree(edges(spark, sf_dir, 3), nodes(spark, sf_dir))), "scene", "id", "degree")
    return found.select("scene", "id", F.expr("upto div 40").alias("shard"))


def neighbour_mean_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.neighbour_mean(edges(spark, sf_dir, 3), nodes(spark, sf_dir), "x", F.exp(-F.col("dist")))
    return found.select("scene", "id", F.round("mean", 6).alias("mean"))


def edge_softmax_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.attention(edges(spark, sf_dir, 5), nodes(spark, sf_dir), -F.col("dist"), "y")
    return found.select("scene", "id", F.round("attended", 6).alias("attended"))


def graph_pool_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest and mean value per pool; pools 8 and 9 have no node and get 0."""
    p = points(spark, sf_dir)
    pooled = p.groupBy("scene", "sp").agg(F.max("x").alias("top"), F.avg("x").alias("mean"))
    pools = p.select("scene").distinct().withColumn("sp", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))))
    return pools.join(pooled, ["scene", "sp"], "left").select("scene", "sp", *[F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c) for c in ("top", "mean")])


def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components over the edges to nearest neighbours; each point has one, so none is alone."""
    found = scene_components(edges(spark, sf_dir, 1))
    return found.select(F.col("node").alias("point_idx"), "component")


def label_propagation_2hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unlabelled nodes take the label of the seed of the highest two-step weight among nodes predicted alike, the lowest seed of a tie."""
    n = nodes(spark, sf_dir)
    e = graph.with_ends(edges(spark, sf_dir, 6), n, "sem").filter("src_sem = dst_sem").withColumn("w", F.exp(-F.col("dist")))
    seeds = n.filter("label >= 0 and id % 3 = 0")
    reach = graph.propagated(cut(e), seeds, "w", 2).withColumn("score", F.round("score", 9))
    best = reach.groupBy("scene", "id").agg(F.max(F.struct("score", (-F.col("seed")).alias("seed"))).alias("best")).select("scene", "id", (-F.col("best.seed")).alias("seed"))
    labels = seeds.select("scene", F.col("id").alias("seed"), F.col("label").alias("given"))
    return n.filter(F.col("label") == graph.UNLABELLED).join(best, ["scene", "id"]).join(labels, ["scene", "seed"]).select("scene", "id", "seed", F.col("given").alias("label"))


def extend_label_1hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels go along edges to unlabelled nodes predicted alike and near enough; the last source wins."""
    n = nodes(spark, sf_dir)
    e = graph.with_ends(graph.with_ends(edges(spark, sf_dir, 6), n, "label"), n, "sem")
    ok = (F.col("dst_label") == graph.UNLABELLED) & (F.col("src_label") != graph.UNLABELLED) & (F.col("src_sem") == F.col("dst_sem")) & (F.exp(-F.col("dist")) > 0.8)
    return e.filter(ok).groupBy("scene", F.col("dst").alias("id")).agg(F.max_by("src_label", "src").alias("label"))


def predicted_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in the part of superpoints: a predicted class with its probability, and a label for every fourth."""
    label = F.when(F.col("id") % 4 == 0, F.col("sem")).otherwise(graph.UNLABELLED)
    return ids(points(spark, sf_dir)).select("scene", "id", *"xyz", label.alias("label"), F.col("sem").alias("pred"), (1 - F.col("id") % 10 / 20).alias("prob"), *[(F.col(a) / 2).alias(f"o{a}") for a in "xyz"])


PREDICTED = "nodes AS (SELECT scene, point_idx AS id, x, y, z, CASE WHEN point_idx % 4 = 0 THEN sem ELSE -100 END AS label, sem AS pred, 1 - point_idx % 10 / CAST(20 AS DOUBLE) AS prob, x / 2 AS ox, y / 2 AS oy, z / 2 AS oz FROM points)"


def weak_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels spread by two steps of affinity among nodes predicted alike and surely; labels, offsets to instances and scores."""
    n = cut(predicted_nodes(spark, sf_dir))
    e = cut(edges(spark, sf_dir, 6)).withColumn("affinity", F.exp(-F.col("dist")))
    found = cut(graph.propagated_labels(e, n, 2))
    given = n.select("scene", F.col("id").alias("seed"), "label")
    offsets = graph.moved_offsets(found.withColumnRenamed("seed", "source"), n)
    rows = found.join(given, ["scene", "seed"]).join(offsets, ["scene", "id"])
    return rows.select("scene", "id", "seed", "label", F.round("score", 6).alias("score"), *[F.round(f"o{a}", 6).alias(f"o{a}") for a in "xyz"])


def propagate_label_1hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels go to all neighbours that are predicted alike, however surely."""
    return graph.extended(edges(spark, sf_dir, 4), predicted_nodes(spark, sf_dir)).select("scene", "id", "source", "label")


def clique_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Superpoints and the instances that they lie in."""
    found = graph.cliques(points(spark, sf_dir).select("scene", F.col("noisy").alias("group"), F.col("sp").alias("node")))
    return found.select("scene", F.col("row").alias("i"), F.col("col").alias("j"), F.round("weight", 6).alias("weight"))


QUERIES = {
    f.__name__: f
    for f in (
        edge_same_instance_flag, induced_subgraph, edge_in_degree, edge_shards, neighbour_mean_aggregate, edge_softmax_attention, graph_pool_max, graph_components,
        label_propagation_2hop, extend_label_1hop, weak_label_propagation, propagate_label_1hop, clique_adjacency,
    )
}

_ENDS = "edges e JOIN nodes a ON a.scene = e.scene AND a.id = e.src JOIN nodes b ON b.scene = e.scene AND b.id = e.dst"
ORACLES = {
    "edge_same_instance_flag": f"""WITH {NODES}, {edges_sql(5)} SELECT e.scene, e.src, e.dst, CAST(CASE WHEN a.label = -100 OR b.label = -100 THEN 0 WHEN a.label = b.label THEN -1 ELSE 1 END AS BIGINT) AS flag FROM {_ENDS}""",
    "induced_subgraph": f"WITH {NODES}, {edges_sql(5)} SELECT e.scene, e.src, e.dst FROM {_ENDS} WHERE a.sem <> 2 AND b.sem <> 2",
    "edge_in_degree": f"WITH {NODES}, {edges_sql(2)} SELECT n.scene, n.id, count(e.src) AS degree FROM nodes n LEFT JOIN edges e ON e.scene = n.scene AND e.dst = n.id GROUP BY n.scene, n.id",
    "edge_shards": f"""WITH {NODES}, {edges_sql(3)}, d AS (SELECT n.scene, n.id, count(e.src) AS degree FROM nodes n LEFT JOIN edges e ON e.scene = n.scene AND e.dst = n.id GROUP BY n.scene, n.id)
        SELECT scene, id, CAST(sum(degree) OVER (PARTITION BY scene ORDER BY id) AS BIGINT) // 40 AS shard FROM d""",
    "neighbour_mean_aggregate": f"""WITH {NODES}, {edges_sql(3)} SELECT n.scene, n.id, round(coalesce(avg(exp(-e.dist) * a.x), 0), 6) AS mean
        FROM nodes n LEFT JOIN edges e ON e.scene = n.scene AND e.dst = n.id LEFT JOIN nodes a ON a.scene = e.scene AND a.id = e.src GROUP BY n.scene, n.id""",
    "edge_softmax_attention": f"WITH {NODES}, {edges_sql(5)} SELECT e.scene, e.src AS id, round(sum(exp(-e.dist) * b.y) / sum(exp(-e.dist)), 6) AS attended FROM {_ENDS} GROUP BY e.scene, e.src",
    "graph_pool_max": f"""WITH {POINTS}, p AS (SELECT DISTINCT scene, k AS sp FROM points, range(10) t(k))
        SELECT p.scene, p.sp, round(coalesce(max(x), 0), 6) AS top, round(coalesce(avg(x), 0), 6) AS mean FROM p LEFT JOIN points USING (scene, sp) GROUP BY p.scene, p.sp""",
    "graph_components": f"""WITH RECURSIVE {POINTS}, {edges_sql(1)}, b AS (SELECT src AS u, dst AS v FROM edges UNION SELECT dst, src FROM edges),
        r AS (SELECT u AS a, u AS c FROM b UNION SELECT r.a, b.v FROM r JOIN b ON r.c = b.u) SELECT a AS point_idx, min(c) AS component FROM r GROUP BY a""",
    "label_propagation_2hop": f"""WITH {NODES}, {edges_sql(6)}, w AS (SELECT e.scene, e.src, e.dst, exp(-e.dist) / sum(exp(-e.dist)) OVER (PARTITION BY e.scene, e.src) AS w FROM {_ENDS} WHERE a.sem = b.sem),
        s AS (SELECT * FROM nodes WHERE label >= 0 AND id % 3 = 0),
        r AS (SELECT s.scene, s.id AS seed, y.dst AS id, round(sum(x.w * y.w), 9) AS score FROM s JOIN w x ON x.scene = s.scene AND x.src = s.id JOIN w y ON y.scene = s.scene AND y.src = x.dst GROUP BY s.scene, s.id, y.dst),
        k AS (SELECT *, row_number() OVER (PARTITION BY scene, id ORDER BY score DESC, seed) AS k FROM r)
        SELECT k.scene, k.id, k.seed, s.label FROM k JOIN nodes n ON n.scene = k.scene AND n.id = k.id AND n.label = -100 JOIN s ON s.scene = k.scene AND s.id = k.seed WHERE k.k = 1""",
    "extend_label_1hop": f"""WITH {NODES}, {edges_sql(6)} SELECT e.scene, e.dst AS id, max_by(a.label, e.src) AS label FROM {_ENDS}
        WHERE b.label = -100 AND a.label <> -100 AND a.sem = b.sem AND exp(-e.dist) > CAST(0.8 AS DOUBLE) GROUP BY e.scene, e.dst""",
    "weak_label_propagation": f"""WITH {POINTS}, {PREDICTED}, {edges_sql(6)}, w AS (SELECT e.scene, e.src, e.dst, exp(-e.dist) / sum(exp(-e.dist)) OVER (PARTITION BY e.scene, e.src) AS w FROM {_ENDS} WHERE a.pred = b.pred AND a.prob > CAST(0.7 AS DOUBLE) AND b.prob > CAST(0.7 AS DOUBLE)),
        s AS (SELECT * FROM nodes WHERE label = pred AND prob > CAST(0.7 AS DOUBLE)),
        r AS (SELECT s.scene, s.id AS seed, y.dst AS id, round(sum(x.w * y.w), 9) AS score FROM s JOIN w x ON x.scene = s.scene AND x.src = s.id JOIN w y ON y.scene = s.scene AND y.src = x.dst GROUP BY s.scene, s.id, y.dst),
        k AS (SELECT *, row_number() OVER (PARTITION BY scene, id ORDER BY score DESC, seed) AS k FROM r WHERE score > 0)
        SELECT k.scene, k.id, k.seed, s.label, round(k.score, 6) AS score, {", ".join(f"round(s.{a} + s.o{a} - n.{a}, 6) AS o{a}" for a in "xyz")} FROM k JOIN nodes n ON n.scene = k.scene AND n.id = k.id AND n.label = -100 JOIN s ON s.scene = k.scene AND s.id = k.seed WHERE k.k = 1""",
    "propagate_label_1hop": f"""WITH {POINTS}, {PREDICTED}, {edges_sql(4)}, w AS (SELECT scene, src, dst FROM edges UNION SELECT scene, dst, src FROM edges)
        SELECT w.scene, w.dst AS id, max(w.src) AS source, max_by(a.label, w.src) AS label FROM w JOIN nodes a ON a.scene = w.scene AND a.id = w.src AND a.label <> -100 JOIN nodes b ON b.scene = w.scene AND b.id = w.dst AND b.label = -100 AND b.pred = a.label GROUP BY w.scene, w.dst""",
    "clique_adjacency": f"""WITH {POINTS}, p AS (SELECT DISTINCT scene, sp AS a, -1 - noisy AS b FROM points), n AS (SELECT scene, a FROM p UNION SELECT scene, b FROM p), l AS (SELECT scene, a AS i, b AS j FROM p UNION ALL SELECT scene, b, a FROM p UNION ALL SELECT scene, a, a FROM n)
        SELECT scene, i, j, round(1 / CAST(count(*) OVER (PARTITION BY scene, j) AS DOUBLE), 6) AS weight FROM l""",
}
