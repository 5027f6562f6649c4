"""Average-linkage trees, their cuts and proposals against plain loops."""

import collections
import random

import numpy as np
import pytest

from terrafold.operators import hierarchy

PAIRS, LEAVES = "scene string, a long, b long, dist double", "scene string, id long, count long, soft array<double>"


def plain_tree(pairs, count, soft):
    """The nearest two clusters at a time: a list of (lowest left leaf, lowest right leaf, leaves, height, score)."""
    clusters = {i: [i] for i in count}
    out = []
    while len(clusters) > 1:
        best = None
        for a in clusters:
            for b in clusters:
                if a < b:
                    met = [(pairs[min(x, y), max(x, y)], count[x] * count[y]) for x in clusters[a] for y in clusters[b]]
                    far = sum(d * w for d, w in met) / sum(w for _, w in met)
                    best = min(best or (np.inf,), (far, a, b))
        far, a, b = best
        mean = lambda c: sum(count[i] * np.array(soft[i]) for i in clusters[c]) / sum(count[i] for i in clusters[c])
        out.append((a, b, frozenset(clusters[a] + clusters[b]), far, float(mean(a) @ mean(b))))
        clusters[a] = clusters[a] + clusters.pop(b)
    return out


def data(n=14, scenes=("s", "t")):
    rng = random.Random(8)
    made = {}
    for scene in scenes:
        places = {i * 3: [rng.random() for _ in range(3)] for i in range(n)}
        made[scene] = {(a, b): float(np.linalg.norm(np.subtract(places[a], places[b]))) for a in places for b in places if a < b}, {i: rng.randint(1, 9) for i in places}, {i: [p := rng.random(), 1 - p] for i in places}
    return made


@pytest.fixture(scope="module")
def tree(spark):
    made = data()
    pairs = spark.createDataFrame([(s, a, b, d) for s, (pairs, _, _) in made.items() for (a, b), d in pairs.items()], PAIRS)
    leaves = spark.createDataFrame([(s, i, n, soft[i]) for s, (_, count, soft) in made.items() for i, n in count.items()] + [("alone", 5, 1, [0.5, 0.5])], LEAVES)
    return made, hierarchy.merge_tree(pairs.unionByName(pairs.selectExpr("scene", "b AS a", "a AS b", "dist").limit(20)), leaves)


def members(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r["node"]):
        out[r["node"]] = out.get(r["left"], frozenset([r["left"]])) | out.get(r["right"], frozenset([r["right"]]))
    return out


def test_tree_equals_the_plain_loop(tree):
    made, found = tree
    rows = found.collect()
    assert {r["scene"] for r in rows} == {"s", "t"}
    for scene, (pairs, count, soft) in made.items():
        mine = sorted((r for r in rows if r["scene"] == scene), key=lambda r: r["node"])
        below = members(mine)
        expected = plain_tree(pairs, count, soft)
        assert [r["node"] for r in mine] == [max(count) + 1 + k for k in range(len(expected))]
        for r, (a, b, leaves, far, score) in zip(mine, expected, strict=True):
            left, right = (below.get(r[c], frozenset([r[c]])) for c in ("left", "right"))
            assert (min(left), min(right), below[r["node"]]) == (a, b, leaves)
            assert r["height"] == pytest.approx(far, abs=1e-9) and r["score"] == pytest.approx(score) and r["count"] == sum(count[i] for i in leaves)


@pytest.mark.parametrize("share", [0.0, 0.3, 0.7, 1.0])
def test_cuts_equal_a_walk_from_the_root(spark, tree, share):
    _, found = tree
    rows, rng = found.collect(), random.Random(int(share * 10))
    fused = [(r["scene"], r["node"]) for r in rows if rng.random() < share]
    got = {(r["scene"], r["id"]): r["cluster"] for r in hierarchy.top_clusters(found, spark.createDataFrame(fused, "scene string, node long")).collect()}
    expected = {}
    for scene in ("s", "t"):
        mine = {r["node"]: r for r in rows if r["scene"] == scene}
        below, queue = members(mine.values()), [max(mine)]
        while queue:
            node = queue.pop(0)
            if (scene, node) in fused:
                expected |= {(scene, leaf): node for leaf in below[node]}
            else:
                queue += [c for c in (mine[node]["left"], mine[node]["right"]) if c in mine]
    assert got == expected


def test_proposals_of_enough_points(spark):
    points = spark.createDataFrame([(0, i, i % 4) for i in range(40)] + [(1, 0, 9)], "scene int, point_idx long, sp long")
    clusters = spark.createDataFrame([(0, 0, 10), (0, 1, 10), (0, 2, 12), (0, 3, 11), (1, 9, 20)], "scene int, id long, cluster long")
    got = collections.Counter((r["scene"], r["proposal"], r["point_idx"] % 4) for r in hierarchy.proposals(points, clusters, "sp", 10).collect())
    assert got == {(0, 0, 2): 10, (0, 1, 3): 10, (0, 2, 0): 10, (0, 2, 1): 10}
    assert hierarchy.proposals(points, clusters, "sp", 21).count() == 0


def test_a_sparse_graph_and_none(spark):
    """Two groups without a pair between them have a tree each; without pairs there is no tree."""
    pairs = spark.createDataFrame([("s", 0, 1, 1.0), ("s", 1, 2, 4.0), ("s", 5, 6, 2.0), ("s", 6, 6, 0.0)], PAIRS)
    leaves = spark.createDataFrame([("s", i, 1, None) for i in (0, 1, 2, 5, 6)], LEAVES).drop("soft")
    got = {(r["left"], r["right"], r["height"], r["score"]) for r in hierarchy.merge_tree(pairs, leaves).collect()}
    assert got == {(0, 1, 1.0, None), (5, 6, 2.0, None), (7, 2, 4.0, None)}
    assert hierarchy.merge_tree(pairs.limit(0), leaves).count() == 0


@pytest.mark.parametrize("few", [0, 20])
def test_rounds_in_tasks_equal_rounds_by_joins(spark, tree, monkeypatch, few):
    """A scene whose pairs fit a task from the start, from a later round, or never has the same tree; equal distances included."""
    monkeypatch.setattr(hierarchy, "FEW_PAIRS", few)
    _, found = tree
    made = data()
    pairs = spark.createDataFrame([(s, a, b, d) for s, (pairs, _, _) in made.items() for (a, b), d in pairs.items()] + [("grid", i, i + k, 1.0) for i in range(16) for k in (1, 4) if i + k < 16], PAIRS)
    leaves = spark.createDataFrame([(s, i, n, soft[i]) for s, (_, count, soft) in made.items() for i, n in count.items()] + [("grid", i, 1, [0.5, 0.5]) for i in range(16)], LEAVES)
    flat = lambda df: sorted((r["scene"], r["node"], r["left"], r["right"], round(r["height"], 9), r["count"], round(r["score"], 9)) for r in df.collect())
    got = flat(hierarchy.merge_tree(pairs, leaves))
    assert [r for r in got if r[0] != "grid"] == flat(found)
    monkeypatch.setattr(hierarchy, "FEW_PAIRS", 1 << 16)
    assert [r for r in got if r[0] == "grid"] == flat(hierarchy.merge_tree(pairs.filter("scene = 'grid'"), leaves.filter("scene = 'grid'")))
