"""Operators on graphs, orders, partitions, files and streams against brute force."""

import io
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.functions import plans
from terrafold.operators import cluster, components
from terrafold.operators import graph as graphs
from terrafold.operators import labels, metrics, neighbors, order, planes, prepare
from terrafold.sources import scans
from terrafold.streaming import windows


def found_root(edges, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in nodes}


def test_components_of_a_path_take_logarithmic_rounds(spark, monkeypatch):
    steps = []
    monkeypatch.setattr(components, "saved", lambda df, path: (steps.append(path), plans.saved(df, path))[1])
    path = spark.range(10_000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = components.connected_components(path)
    assert got.count() == 10_001 and got.select("component").distinct().count() == 1
    assert len(steps) <= 2 * math.log2(10_000) + 6


def test_components_keep_scenes_apart(spark):
    edges = spark.createDataFrame([(0, 1, 2), (1, 2, 3), (1, 5, 5)], "scene int, src long, dst long")
    got = {(r["scene"], r["node"]): r["component"] for r in components.scene_components(edges).collect()}
    assert got == {(0, 1): 1, (0, 2): 1, (1, 2): 2, (1, 3): 2}


def test_order_part_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), -1 - rng.randrange(80)) for _ in range(70)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == found_root(edges, {x for e in edges for x in e})


def test_small_components_go_to_the_largest_neighbour(spark):
    nodes = spark.createDataFrame([(0, i) for i in range(12)], "scene int, node long")
    labels_ = spark.createDataFrame([(0, i, 0) for i in range(5)] + [(0, i, 5) for i in (5, 6, 7)] + [(0, 8, 8), (0, 9, 8)], "scene int, node long, component long")
    edges = spark.createDataFrame([(0, 8, 7), (0, 8, 4), (0, 10, 9), (0, 6, 0)], "scene int, src long, dst long")
    got = {r["node"]: r["component"] for r in components.merged_small(nodes, labels_, edges, 3).collect()}
    assert got == {**dict.fromkeys(range(5), 0), 5: 5, 6: 5, 7: 5, 8: 0, 9: 0, 10: 0, 11: 11}


def test_running_sums_by_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.randrange(50), i, rng.randrange(9)) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, k long, i long, v long")
    got = {r["i"]: (r["place"], r["upto_v"]) for r in order.running(df.repartition(7), ["g"], [F.desc("k"), "i"], ["v"]).collect()}
    for g in "ab":
        total = 0
        for place, (_, _, i, v) in enumerate(sorted((x for x in rows if x[0] == g), key=lambda x: (-x[1], x[2])), 1):
            total += v
            assert got[i] == (place, total)
    assert order.running(df.limit(0), ["g"], ["k"], ["v"]).count() == 0


def test_labels_are_compacted_from_the_top(spark):
    rows = [(s, x) for s, xs in ((0, [0, 2, 3, 7, 9, 7]), (1, [0, 1, 2]), (2, [5]), (3, [-100, 4, 1])) for x in xs]
    got = {(r["scene"], r["ins"]): r["compact"] for r in prepare.compacted(spark.createDataFrame(rows, "scene int, ins long"), ["scene"], "ins").collect()}
    expected = {}
    for s in range(4):
        now = {x: x for t, x in rows if t == s and x >= 0}
        j = 0
        while j < max(now.values()):
            if j not in now.values():
                top = max(now, key=now.get)
                now[top] = j
            j += 1
        expected |= {(s, a): b for a, b in now.items()}
    assert got == expected


def test_random_box_holds_few_enough(spark):
    rng = random.Random(2)
    points = spark.createDataFrame([(s, rng.uniform(0, 90), rng.uniform(0, 90), rng.uniform(0, 5)) for s in (0, 1) for _ in range(300)] + [(2, 1.0, 1.0, 1.0)], "scene int, x double, y double, z double")
    got = prepare.random_box(points, 100.0, 20.0, 120, 6).collect()
    for s in range(3):
        held = [r for r in got if r["scene"] == s]
        assert len(held) <= 120 and all(min(r["x"], r["y"], r["z"]) >= 0 for r in held)
    assert [(r["x"], r["step"]) for r in got if r["scene"] == 2] == [(0.0, 0)]


def test_softmax_takes_the_first_of_equal_scores(spark):
    p = spark.createDataFrame([([1.0, 3.0, 3.0],), ([1000.0, 0.0],)], "s array<double>").select(prepare.softmax(F.col("s")).alias("p"))
    got = p.select(prepare.first_largest(F.col("p")).alias("c"), F.aggregate("p", F.lit(0.0), lambda a, b: a + b).alias("t")).collect()
    assert [(r["c"], round(r["t"], 9)) for r in got] == [(1, 1.0), (0, 1.0)]


def graph(seed, n=60):
    rng = random.Random(seed)
    nodes = [(s, i, rng.randrange(3), rng.uniform(0.1, 0.5), rng.random(), rng.random(), 0.0) for s in (0, 1) for i in range(n)]
    edges = [(s, *rng.sample(range(n), 2)) for s in (0, 1) for _ in range(4 * n)]
    return nodes, edges


def test_growth_from_seeds_in_turn(spark):
    nodes, edges = graph(4)
    got = {(r["scene"], r["id"]): r["cluster"] for r in cluster.seeded(spark.createDataFrame(edges, "scene int, src long, dst long"), spark.createDataFrame(nodes, "scene int, id long, class int, size double, x double, y double, z double"), 0.8).collect()}
    for s in (0, 1):
        at = {i: (k, size, (x, y, z)) for t, i, k, size, x, y, z in nodes if t == s}
        near = {i: sorted({b for t, a, b in edges if t == s and a == i} | {a for t, a, b in edges if t == s and b == i}) for i in at}
        taken = {}
        for seed in sorted(at):
            if seed in taken:
                continue
            taken[seed], queue = seed, [seed]
            while queue:
                i = queue.pop(0)
                for j in near[i]:
                    if j not in taken and at[j][0] == at[seed][0] and math.dist(at[i][2], at[j][2]) < 0.8 * at[seed][1]:
                        taken[j] = seed
                        queue.append(j)
        assert {i: got[s, i] for i in at} == taken


def test_absorption_follows_moving_centres(spark):
    rows = [(0, 1, 0, False, 0.0, 0.0, 0.0, 100, 400.0, 0.3, 2), (0, 1, 1, True, 0.35, 0.0, 0.0, 100, 400.0, 0.3, 1), (0, 1, 2, True, 0.65, 0.0, 0.0, 10, 10.0, 0.1, 1), (0, 1, 3, True, 5.0, 0.0, 0.0, 10, 10.0, 0.1, 1), (0, 2, 4, True, 0.0, 0.0, 0.0, 10, 10.0, 0.1, 1)]
    groups = spark.createDataFrame(rows, "scene int, class int, id long, fragment boolean, x double, y double, z double, points long, voxels double, size double, parts long")
    # reach 0.4 at first; after the first absorption the centre is at 0.175, and the second fragment lies 0.475 away, beyond the reach of 0.4
    assert {(r["id"], r["into"]) for r in cluster.absorbed_in_turn(groups).collect()} == {(1, 0)}
    nearer = spark.createDataFrame([r if r[2] != 2 else (*r[:4], 0.55, *r[5:]) for r in rows], groups.schema)
    assert {(r["id"], r["into"]) for r in cluster.absorbed_in_turn(nearer).collect()} == {(1, 0), (2, 0)}


def test_regions_merge_as_in_a_plain_loop(spark):
    rng = random.Random(6)
    values = {(s, i): [rng.random() + (i // 10), rng.random()] for s in (0, 1) for i in range(25)}
    edges = [(s, i, j, rng.uniform(0.2, 1)) for s in (0, 1) for i in range(25) for j in (i + 1, i + 5) if j < 25]
    df = spark.createDataFrame(edges, "scene int, src long, dst long, weight double")
    got = {(r["scene"], r["id"]): r["region"] for r in cluster.merged_regions(df, spark.createDataFrame([(s, i, v) for (s, i), v in values.items()], "scene int, id long, value array<double>"), 0.3).collect()}
    region = {n: n for n in values}
    while True:
        members = {r: [n for n in region if region[n] == r] for r in set(region.values())}
        mean = {r: np.mean([values[n] for n in m], axis=0) for r, m in members.items()}
        weight = {}
        for s, i, j, w in edges:
            a, b = sorted((region[s, i], region[s, j]))
            if a != b:
                weight[a, b] = weight.get((a, b), 0) + w
        gain = {(a, b): round(0.3 * w - 0.5 * len(members[a]) * len(members[b]) / (len(members[a]) + len(members[b])) * float(((mean[a] - mean[b]) ** 2).sum()), 12) for (a, b), w in weight.items()}
        gain = {k: g for k, g in gain.items() if g > 0}
        if not gain:
            break
        best = {}
        for r in {x for k in gain for x in k}:
            best[r] = min((-g, b if a == r else a) for (a, b), g in gain.items() if r in (a, b))[1]
        for a, b in list(best.items()):
            if best[b] == a and a < b:
                region = {n: a if r == b else r for n, r in region.items()}
    assert got == {n: r[1] for n, r in region.items()}
    three = spark.createDataFrame([(0, 0, [10.0, 20.0]), (0, 1, [0.0, 1.0]), (0, 2, [0.0, 0.0])], "scene int, id long, value array<double>")
    links = spark.createDataFrame([(0, 0, 1, 1.0), (0, 1, 2, 1.0)], "scene int, src long, dst long, weight double")
    assert {r["id"]: r["region"] for r in cluster.merged_regions(links, three, 1.0).collect()} == {0: 0, 1: 1, 2: 1}


def test_neighbours_in_crowds_and_copies(spark):
    """A dense object, a place with many copies, and a wide scene: exact, with ties by id."""
    rng = random.Random(8)
    rows = [(0, i, rng.random() * 100, rng.random() * 100, 0.0) for i in range(60)] + [(0, 100 + i, 50 + rng.random() / 1000, 50 + rng.random() / 1000, 0.0) for i in range(200)] + [(0, 400 + i, 3.0, 3.0, 3.0) for i in range(100)]
    p = spark.createDataFrame(rows, "scene int, id long, x double, y double, z double")
    got = {}
    for r in neighbors.knn(p, p, 3, other=True).collect():
        got.setdefault(r["src"], []).append((r["rank"], r["dst"]))
    at = np.array([r[2:] for r in rows])
    numbers = np.array([r[1] for r in rows])
    for row, i in zip(at, numbers.tolist(), strict=True):
        d = at - row
        far = np.sqrt(d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2])
        expected = [int(numbers[j]) for j in np.lexsort((numbers, far)) if numbers[j] != i][:3]
        assert [j for _, j in sorted(got[i])] == expected


def test_void_and_small_regions_are_no_false_positives(spark):
    gts = spark.createDataFrame([(0, 1, 0, 200), (0, 2, 0, 150)], "scene int, gt long, class long, gt_size long")
    preds = spark.createDataFrame([(0, 1, 0, 200, 0.9), (0, 5, 0, 100, 0.8), (0, 6, 0, 100, 0.7)], "scene int, pred long, class long, pred_size long, conf double")
    found = spark.createDataFrame([(0, 0, 1, 1, 180, 200, 200, 180 / 220)], "scene int, class long, gt long, pred long, common long, gt_size long, pred_size long, iou double")
    void = spark.createDataFrame([(0, 5, 80)], "scene int, pred long, void long")
    for ignored, wrong in ((None, 2), (void, 1)):
        rows = metrics.scored_at(gts, preds, found, [0.5], ignored).collect()
        again = metrics.sequential_matches(gts, preds, found, 0.5, ignored).collect()
        for x in (rows, again):
            assert (sum(r["tp"] for r in x), sum(r["fp"] for r in x), sum(r["missed"] for r in x)) == (1, wrong, 1)
    table = metrics.precision_table(gts, preds, found, void).first()
    assert table["ap50"] == pytest.approx(table["ap25"]) and table["ap"] == pytest.approx(table["ap50"] * 7 / 9)


def test_walls_of_few_points_and_many_copies(spark):
    rng = random.Random(5)
    rows = [(0, 2.0, rng.uniform(0, 9), rng.uniform(0, 3)) for _ in range(250)] + [(0, rng.uniform(0, 9), rng.uniform(0, 9), rng.uniform(0, 3)) for _ in range(750)] + [(0, 5.0, 5.0, 1.0)] * 120
    got = planes.walls(spark.createDataFrame(rows, "scene int, x double, y double, z double"), 0.02, 1, 100).collect()
    assert len(got) == 1 and abs(abs(got[0]["a"]) - 1) < 0.01 and got[0]["points"] >= 250


def test_mask_operations_and_first_labels(spark):
    mask = lambda rows: spark.createDataFrame(rows, "scene int, point_idx long")
    assert tuple(labels.mask_operations(mask([(0, 1), (0, 2), (0, 2)]), mask([(0, 2), (0, 3)])).first()) == (0, 3, 1, 1)
    p = spark.createDataFrame([(0, 5, 1, 4), (0, 2, 1, -100), (0, 3, 2, 7)], "scene int, point_idx long, ins long, label long")
    assert {r["ins"]: r["label"] for r in labels.first_label(p, "ins", "label").collect()} == {1: 0, 2: 7}


def test_lines_are_numbered_over_blocks(spark, tmp_path):
    for name, n in (("a", 500), ("b", 3), ("c", 0)):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}{i}\n" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
    try:
        rows = scans.numbered_lines(spark, f"{tmp_path}/*.txt").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 503 and all(r["value"] == f"{r['path'][-5]}{r['line']}" for r in rows)


def test_binary_polygon_and_matrix_files(spark, tmp_path):
    head = b"ply\nformat binary_little_endian 1.0\ncomment x\nelement vertex 3\nproperty float x\nproperty float y\nproperty double z\nproperty uchar red\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n"
    (tmp_path / "s.ply").write_bytes(head + b"".join(struct.pack("<ffdB", i, i + 0.5, i * 2.0, 200 + i) for i in range(3)) + struct.pack("<Biii", 3, 0, 1, 2))
    got = scans.ply_vertices(spark, f"{tmp_path}/s.ply", ["x", "y", "z", "red", "label"]).orderBy("point_idx").collect()
    assert [tuple(r)[1:] for r in got] == [(i, float(i), i + 0.5, i * 2.0, 200.0 + i, None) for i in range(3)]
    buffer = io.BytesIO()
    np.save(buffer, np.arange(12.0).reshape(4, 3))
    (tmp_path / "m.npy").write_bytes(buffer.getvalue())
    got = scans.arrays(spark, f"{tmp_path}/m.npy", ["x", "y", "label"]).orderBy("point_idx").collect()
    assert [tuple(r)[1:] for r in got] == [(i, 3.0 * i, 3.0 * i + 1, 3.0 * i + 2) for i in range(4)]


def test_late_events_are_dropped_and_state_goes_on(spark, tmp_path):
    def day(name, *rows):
        spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    day("1", ("2024-01-01 05:00:00", "a", 1.0), ("2024-01-09 05:00:00", "a", 2.0))
    run = lambda: {(str(r["begin"])[:10], r["total"]) for r in windows.closed_windows(spark, f"{tmp_path}/in/*", f"file://{tmp_path}/work").collect()}
    assert run() == {("2024-01-01", 1.0), ("2024-01-09", 2.0)}
    day("2", ("2024-01-01 06:00:00", "a", 10.0), ("2024-01-10 05:00:00", "a", 4.0))
    assert run() == {("2024-01-01", 1.0), ("2024-01-09", 2.0), ("2024-01-10", 4.0)}


def test_near_beyond_known_edges_in_a_crowd(spark):
    """A crowd of 400 points within the radius, known edges of several numbers: the nearest five others of each, as of all pairs."""
    rng = random.Random(12)
    at = {i: [rng.random() * 0.1 for _ in range(3)] if i < 300 else [rng.random() for _ in range(3)] for i in range(400)}
    known = {(i, j) for i in at for j in rng.sample(range(400), i % 5)}
    points = spark.createDataFrame([(0, i, *map(float, v)) for i, v in at.items()], "scene int, id long, x double, y double, z double")
    got = {(r["src"], r["dst"]): r["rank"] for r in neighbors.near_beyond(points, spark.createDataFrame([(0, *e) for e in known], "scene int, src long, dst long"), 5, 0.3).collect()}
    expected = {}
    for i in at:
        order = sorted((math.dist(at[i], at[j]), j) for j in at if j != i and (i, j) not in known and math.dist(at[i], at[j]) <= 0.3)[:5]
        expected |= {(i, j): k + 1 for k, (_, j) in enumerate(order)}
    assert got == expected


def test_random_subgraph_is_a_walk_by_layers(spark):
    """Against a plain walk with the same hashes: layers, the layer that is cut, and new seeds."""
    rng = random.Random(3)
    edges = [(s, rng.randrange(30), rng.randrange(30)) for s in (0, 1) for _ in range(25)]
    nodes = spark.createDataFrame([(s, i) for s in (0, 1) for i in range(30)], "scene int, id long")
    h = {r["id"]: r["h"] for r in spark.range(30).select("id", F.xxhash64("id", F.lit(0)).alias("h")).collect()}
    got = {(r["scene"], r["id"]): r["hops"] for r in graphs.random_subgraph(spark.createDataFrame(edges, "scene int, src long, dst long"), nodes, 14).collect()}
    expected = {}
    for s in (0, 1):
        order, taken = sorted(range(30), key=lambda i: (h[i], i)), {}
        layer = {order[0]: 0}
        while layer:
            taken |= layer
            fresh = {b: min(layer[a] + 1 for x, a, c in edges if x == s and c == b and a in layer) for x, a, b in edges if x == s and a in layer and b not in taken}
            room = 14 - len(taken)
            layer = {b: fresh[b] for b in sorted(fresh, key=lambda b: (h[b], b))[: max(room, 0)]}
            if not layer and room > 0:
                layer = {next(i for i in order if i not in taken): 0}
        expected |= {(s, i): d for i, d in taken.items()}
    assert got == expected


def test_neighbours_in_small_parts_of_tiles(spark, monkeypatch):
    """Tiles of two cells whose candidates are dealt into parts of four rows: copies of a place, a far point, a small scene and a row without a place give what a plain loop gives."""
    monkeypatch.setattr(neighbors, "TILE", 2)
    monkeypatch.setattr(neighbors, "CANDIDATES", 4)
    rng = random.Random(5)
    spots = [tuple(rng.choice([-1.0, 1.0]) * rng.random() for _ in range(3)) for _ in range(60)] + [(0.5, 0.5, 0.5)] * 25 + [(40.0, -3.0, 2.0), (0.0, -0.0, 0.0)]
    rows = [("s", i, *p) for i, p in enumerate(spots)] + [("t", 500, 1.0, 1.0, 1.0), ("t", 501, 1.0, 2.0, 1.0)]
    p = spark.createDataFrame([*rows, ("s", 900, None, 0.0, 0.0)], "scene string, id long, x double, y double, z double")
    got = {}
    for r in neighbors.knn(p, p, 3, other=True).collect():
        got.setdefault((r["scene"], r["src"]), {})[r["rank"]] = r["dst"], r["dist"]
    for scene, i, *at in rows:
        far = sorted((math.dist(at, to), j) for s, j, *to in rows if s == scene and j != i)[:3]
        assert [got[scene, i][k + 1][0] for k in range(len(far))] == [j for _, j in far] and len(got[scene, i]) == len(far)
        assert [got[scene, i][k + 1][1] for k in range(len(far))] == pytest.approx([d for d, _ in far])
    assert len(got) == len(rows)


def test_points_near_planes_are_counted_in_chunks(spark, monkeypatch):
    """Chunks of three points of mixed scenes, a point without a place and one of no scene: as many as a plain loop counts."""
    monkeypatch.setattr(planes, "CHUNK", 3)
    rng = random.Random(2)
    rows = [(rng.choice("uv"), *[rng.random() for _ in range(3)]) for _ in range(40)]
    p = spark.createDataFrame([*rows, ("u", None, 0.5, 0.5), (None, 0.5, 0.5, 0.5)], "scene string, x double, y double, z double")
    through = {s: [(k, 0.6, 0.0, 0.8, -0.2 * k) for k in range(5)] + [(5, 0.0, 0.0, 1.0, 90.0)] for s in "uv"}
    h = spark.createDataFrame([(s, t) for s, t in through.items()], "scene string, planes array<struct<number: long, a: double, b: double, c: double, d: double>>")
    expected = {(s, i): n for s in "uv" for i, (_, a, b, c, d) in enumerate(through[s]) if (n := sum(abs(a * x + b * y + c * z + d) < 0.3 for t, x, y, z in rows if t == s))}
    assert {(r["scene"], r["at"]): r["points"] for r in planes.near_counts(p, h, 0.3).collect()} == expected and len(expected) > 4
