"""Micro-fixtures: ties, single points, duplicates, collinear and planar sets, nodes without edges, empty classes, ignored rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.operators import cluster, geometry, graph, labels, metrics, neighbors, planes, series, voxel
from terrafold.operators.components import connected_components

POINT = "scene int, point_idx long, x double, y double, z double, label long"


def points(spark, rows):
    return spark.createDataFrame([(s, i, float(x), float(y), float(z), lab) for s, i, x, y, z, lab in rows], POINT)


def test_majority_ignores_zero_and_takes_the_lowest_of_a_tie(spark):
    p = points(spark, [(0, 0, 0, 0, 0, 0), (0, 1, 0, 0, 0, 0), (0, 2, 0, 0, 0, 3), (0, 3, 0, 0, 0, 2), (1, 4, 5, 5, 5, 0)])
    got = {r["scene"]: (r["points"], r["label"]) for r in voxel.downsampled(p, 1.0, "label").collect()}
    assert got == {0: (4, 2), 1: (1, 0)}


def test_voxel_ids_follow_the_first_points(spark):
    p = points(spark, [(0, 0, 9, 0, 0, 1), (0, 1, 0, 0, 0, 1), (0, 2, 9.5, 0, 0, 1)])
    got = {r["point_idx"]: r["voxel_id"] for r in voxel.point_to_voxel(p, 1.0).collect()}
    assert got == {0: 0, 1: 1, 2: 0}


def test_subsample_is_exact_and_does_not_depend_on_partitions(spark):
    p = points(spark, [(i % 3, i, i, 0, 0, 1) for i in range(103)])
    a = {(r["scene"], r["point_idx"]) for r in voxel.hash_subsample(p, ["point_idx"]).collect()}
    b = {(r["scene"], r["point_idx"]) for r in voxel.hash_subsample(p.repartition(9), ["point_idx"]).collect()}
    assert a == b and len(a) == sum(sum(i % 3 == s for i in range(103)) // 4 for s in range(3))


def test_knn_with_duplicates_far_points_and_small_scenes(spark):
    rng = random.Random(1)
    rows = [(0, i, rng.random(), rng.random(), 0.0) for i in range(60)] + [(0, 100 + i, 0.5, 0.5, 0.0) for i in range(5)] + [(0, 200, 1000.0, 0.0, 0.0), (1, 300, 0.0, 0.0, 0.0), (1, 301, 7.0, 0.0, 0.0), (2, 400, 1.0, 1.0, 1.0)]
    p = spark.createDataFrame(rows, "scene int, id long, x double, y double, z double")
    got = {}
    for r in neighbors.knn(p, p, 4, other=True).collect():
        got.setdefault(r["src"], []).append((r["rank"], r["dst"]))
    for s, i, x, y, _ in rows:
        near = sorted((((x - u) ** 2 + (y - v) ** 2 + 0.0) ** 0.5, j) for t, j, u, v, _ in rows if t == s and j != i)[:4]
        assert [j for _, j in sorted(got.get(i, []))] == [j for _, j in near]


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(1, 200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)] + [(5000, 5000)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert got == {x: find(x) for x in root if x != 5000}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_superpoints_of_one_two_collinear_and_planar_points(spark):
    rows = [(0, 0, 1, 1, 1, 0), (0, 1, 0, 0, 0, 1), (0, 2, 2, 0, 0, 1)] + [(0, 10 + i, i, 2 * i, 0, 2) for i in range(5)] + [(0, 20 + i, i % 3, i // 3, 0, 3) for i in range(9)]
    got = {r["label"]: r for r in geometry.superpoint_features(points(spark, rows), "label").collect()}
    assert (got[0]["length"], got[0]["surface"], got[0]["volume"]) == (0, 0, 0)
    assert got[1]["length"] == pytest.approx(1.0) and got[1]["surface"] == 0
    line = np.linalg.eigvalsh(np.cov(np.array([(i, 2 * i, 0) for i in range(5)]).T))[-1]
    assert got[2]["length"] == pytest.approx(line) and got[2]["volume"] == pytest.approx(1e-5, abs=1e-6)
    assert got[3]["surface"] > 0.1 and got[3]["volume"] == pytest.approx(1e-5, abs=1e-6)


def test_shape_features_of_a_line_and_of_one_place(spark):
    p = points(spark, [(0, i, 0, 0, i, 1) for i in range(6)] + [(1, 10 + i, 3, 3, 3, 1) for i in range(3)])
    e = neighbors.knn(p.withColumnRenamed("point_idx", "id"), p.withColumnRenamed("point_idx", "id"), 2, other=True)
    got = {r["point_idx"]: r for r in geometry.shape_features(geometry.local_covariance(p, e)).collect()}
    assert got[2]["linearity"] == pytest.approx(1.0) and got[2]["verticality"] == pytest.approx(1.0)
    assert got[10]["linearity"] == 0 and got[10]["verticality"] == 0


def nodes_and_edges(spark):
    nodes = spark.createDataFrame([(0, i, float(i)) for i in range(5)], "scene int, id long, v double")
    return nodes, spark.createDataFrame([(0, 1, 2, 1.0), (0, 3, 2, 1.0), (0, 2, 1, 2.0)], "scene int, src long, dst long, dist double")


def test_nodes_without_edges_count_as_zero(spark):
    nodes, edges = nodes_and_edges(spark)
    assert {r["id"]: r["degree"] for r in graph.in_degree(edges, nodes).collect()} == {0: 0, 1: 1, 2: 2, 3: 0, 4: 0}
    assert {r["id"]: r["mean"] for r in graph.neighbour_mean(edges, nodes, "v", F.lit(1.0)).collect()} == {0: 0, 1: 2, 2: 2, 3: 0, 4: 0}


def test_running_sum_does_not_depend_on_blocks(spark):
    df = spark.createDataFrame([(s, i, (i * 7) % 5) for s in range(2) for i in range(50)], "g int, id long, v long")
    for block in (1, 7, 1000):
        got = {(r["g"], r["id"]): r["upto"] for r in graph.running_sum(df, "g", "id", "v", block).collect()}
        assert got == {(s, i): sum((j * 7) % 5 for j in range(i + 1)) for s in range(2) for i in range(50)}


def test_labels_of_edges(spark):
    df = spark.createDataFrame([(-100, 1), (1, -100), (2, 2), (1, 2)], "a int, b int")
    assert [r[0] for r in df.select(graph.same_instance(F.col("a"), F.col("b"))).collect()] == [0, 0, -1, 1]


def test_absent_class_scores_zero_and_others_are_left_out(spark):
    counts = spark.createDataFrame([(0, 0, 5), (0, 1, 1), (7, 0, 9)], "gt int, pred int, n long")
    assert {r["class"]: round(r["iou"], 3) for r in metrics.semantic_iou(counts, [0, 1, 2]).collect()} == {0: 83.333, 1: 0, 2: 0}


def masks(spark, found, gts, preds):
    return (
        spark.createDataFrame(gts, "scene int, gt long, class long, gt_size long"),
        spark.createDataFrame(preds, "scene int, pred long, class long, pred_size long, conf double"),
        spark.createDataFrame([(s, c, g, p, n, a, b, n / (a + b - n)) for s, c, g, p, n, a, b in found], "scene int, class long, gt long, pred long, common long, gt_size long, pred_size long, iou double"),
    )


def test_both_matchings_agree_from_one_half_on(spark):
    gts = [(0, 1, 0, 200), (0, 2, 0, 300), (0, 3, 0, 50), (1, 1, 0, 150), (1, 2, 1, 120)]
    preds = [(0, 1, 0, 190, 0.9), (0, 2, 0, 280, 0.9), (0, 3, 0, 110, 0.4), (1, 1, 0, 400, 0.7)]
    found = [(0, 0, 1, 1, 180, 200, 190), (0, 0, 2, 2, 250, 300, 280), (0, 0, 3, 3, 45, 50, 110), (1, 0, 1, 1, 100, 150, 400)]
    args = masks(spark, found, gts, preds)
    for threshold in (0.5, 0.7):
        a, b = (sorted(map(tuple, f(*args, threshold).select("class", "tp", "fp", "missed", F.coalesce("score", F.lit(-1.0))).collect())) for f in (metrics.scored_matches, metrics.sequential_matches))
        assert a == b
    ap = {r["class"]: r["ap"] for r in metrics.average_precision(metrics.scored_matches(*args, 0.5)).collect()}
    assert ap[1] == 0 and 0 < ap[0] < 1


def test_one_prediction_over_two_objects(spark):
    """At 0.25 the first object takes it and the second is missed."""
    args = masks(spark, [(0, 0, 1, 1, 100, 100, 210), (0, 0, 2, 1, 110, 110, 210)], [(0, 1, 0, 100), (0, 2, 0, 110)], [(0, 1, 0, 210, 0.5)])
    got = metrics.sequential_matches(*args, 0.25).agg(F.sum("tp"), F.sum("fp"), F.sum("missed")).first()
    assert tuple(got) == (1, 0, 1)


def test_perfect_and_missing_predictions(spark):
    rows = spark.createDataFrame([(0, 0.9, 1, 0, 0), (0, 0.8, 1, 0, 0), (1, None, 0, 0, 1), (2, 0.5, 0, 1, 0)], "class int, score double, tp int, fp int, missed int")
    assert {r["class"]: r["ap"] for r in metrics.average_precision(rows).collect()} == {0: 1.0, 1: 0.0, 2: None}


def test_suppression_equals_the_walk_in_order(spark):
    rng = random.Random(3)
    scores = {i: rng.randrange(10) / 10 for i in range(40)}
    pairs = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(70)}
    kept = []
    for i in sorted(scores, key=lambda i: (-scores[i], i)):
        if not any(tuple(sorted((i, j))) in pairs for j in kept):
            kept.append(i)
    found = cluster.suppressed(spark.createDataFrame(list(scores.items()), "id long, score double"), spark.createDataFrame(list(pairs), "a long, b long"))
    assert {r["id"] for r in found.collect() if r["kept"]} == set(kept)


def test_mode_and_histogram_of_ignored_labels(spark):
    p = points(spark, [(0, 0, 0, 0, 0, -100), (0, 1, 0, 0, 0, -100), (0, 2, 0, 0, 0, 1)]).withColumn("sp", F.lit(0))
    assert labels.mode_label(p, "sp", "label").first()["label"] == -100
    assert {r["label"]: round(r["share"], 3) for r in labels.soft_histogram(p, "sp", "label").collect()} == {-100: 0.667, 1: 0.333}


def test_report_without_labels(spark):
    got = labels.weak_label_report(points(spark, [(0, 0, 0, 0, 0, 1)]), "label", F.lit(-100)).first()
    assert (got["points"], got["labelled"], got["coverage"], got["accuracy"]) == (1, 0, 0.0, None)


def test_weighted_sample_takes_k_of_each_group(spark):
    p = points(spark, [(i % 2, i, i, 0, 0, 1) for i in range(41)])
    u = (F.conv(F.substring(F.md5(F.col("point_idx").cast("string")), 1, 8), 16, 10).cast("double") + 0.5) / 2**32
    a = {r["point_idx"] for r in labels.weighted_sample(p, ["scene"], F.lit(1.0), u, 5).collect()}
    b = {r["point_idx"] for r in labels.weighted_sample(p.repartition(8), ["scene"], F.lit(1.0), u, 5).collect()}
    assert a == b and len(a) == 10


def test_running_median(spark):
    df = spark.createDataFrame([(1, i, float(v), 1.0) for i, v in enumerate([5, 1, 4, 2, 8])], "k int, t int, v double, w double")
    assert [r["median"] for r in series.running(df, "k", ["t"], "v", "w", 3).orderBy("t").collect()] == [5, 3, 4, 2, 4]


def test_walls_of_two_planes_and_noise(spark):
    rng = random.Random(4)
    rows = [(0, i, rng.random() * 10, rng.random() * 10, 0.0, 1) for i in range(300)] + [(0, 1000 + i, 4.0, rng.random() * 10, rng.random() * 10, 1) for i in range(200)] + [(1, 2000, 0, 0, 0, 1)]
    got = sorted((r["wall"], r["points"], tuple(round(abs(r[c]), 3) for c in "abcd")) for r in planes.walls(points(spark, rows), 0.01, 2, 50).collect())
    assert [(w, v) for w, _, v in got] == [(0, (0.0, 0.0, 1.0, 0.0)), (1, (1.0, 0.0, 0.0, 4.0))]
    assert got[0][1] >= 300 and got[1][1] >= 195


def test_random_subgraph_is_connected_and_bounded(spark):
    pairs = [(i, i + 1) for i in range(50)] + [(100, 101)]
    nodes = spark.createDataFrame([(0 if i < 100 else 1, i) for i in [*range(51), 100, 101]], "scene int, id long")
    edges = spark.createDataFrame([(0 if a < 100 else 1, *p) for a, b in pairs for p in ((a, b), (b, a))], "scene int, src long, dst long")
    got = graph.random_subgraph(edges, nodes, 8).collect()
    line = sorted(r["id"] for r in got if r["scene"] == 0)
    assert len(line) == 8 and line[-1] - line[0] == 7
    assert sorted(r["id"] for r in got if r["scene"] == 1) == [100, 101]


def test_random_subgraph_goes_on_from_a_new_seed(spark):
    """Two components of five nodes give 8 nodes, and a smaller graph gives all of its own."""
    nodes = spark.createDataFrame([(0, i) for i in range(10)] + [(1, i) for i in range(3)], "scene int, id long")
    edges = spark.createDataFrame([(0, *p) for i in range(9) if i != 4 for p in ((i, i + 1), (i + 1, i))], "scene int, src long, dst long")
    got = graph.random_subgraph(edges, nodes, 8).collect()
    found = [{r["id"] for r in got if r["scene"] == s} for s in (0, 1)]
    assert len(got) == 11 and len(found[0]) == 8 and found[1] == {0, 1, 2}
    assert found[0] >= set(range(5)) or found[0] >= set(range(5, 10))
