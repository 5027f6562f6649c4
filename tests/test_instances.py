"""Instances of whole scenes against a plain loop over superpoints and points."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.operators import instances, metrics, planes

SUPERPOINTS = "scene string, id long, class int, x double, y double, z double, size double, occupancy double"
POINTS = "scene string, point_idx long, sp long, x double, y double, z double"


def scene(seed):
    """Superpoints around a few objects; floors and ceilings; two walls at right angles; a superpoint without points, one without edges, classes with fragments only."""
    rng = random.Random(seed)
    centres = [(rng.uniform(-3, 3), rng.uniform(-3, 3), rng.uniform(0, 2), rng.choice([3, 4, 5])) for _ in range(6)]
    superpoints, points, edges = [], [], []
    for i in range(40):
        x, y, z, kind = centres[rng.randrange(6)]
        kind = (0, 1)[i % 2] if i < 6 else kind
        superpoints.append((i, kind, *(v + rng.gauss(0, 0.15) for v in (x, y, z)), rng.uniform(0.2, 0.6), math.log(rng.choice([4, 20, 90]))))
        for _ in range(0 if i == 20 else rng.randint(1, 25)):
            points.append((len(points), i, *(v + rng.gauss(0, 0.1) for v in (x, y, z))))
    for axis in (0, 1):
        superpoints.append((40 + axis, 2, 0.0, 0.0, 0.0, 0.1, 1.0))
        for _ in range(150 if axis == 0 else 90):
            place = [rng.uniform(-3, 3) for _ in range(3)]
            place[axis] = 3.5 + rng.gauss(0, 0.002)
            points.append((len(points), 40 + axis, *place))
    edges = [(rng.randrange(39), rng.randrange(39)) for _ in range(250)]
    return superpoints, points, edges


def plain(superpoints, points, edges, grow=0.8, full=0.3, voxel=0.02):
    """(class, conf, points) of the instances of things, in the order of their seeds."""
    sp = {s[0]: {"kind": s[1], "c": np.array(s[2:5]), "size": s[5], "vox": math.exp(s[6])} for s in superpoints}
    held = collections.defaultdict(list)
    for i, s, *place in points:
        held[s].append((i, place))
    near = collections.defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    met, groups = set(), []
    for seed in sorted(sp):
        if seed in met or sp[seed]["kind"] < 3:
            continue
        group, queue = [seed], [seed]
        met.add(seed)
        while queue:
            at = queue.pop(0)
            for o in sorted(near[at]):
                if o not in met and sp[o]["kind"] == sp[seed]["kind"] and np.linalg.norm(sp[at]["c"] - sp[o]["c"]) < grow * sp[seed]["size"]:
                    met.add(o)
                    group.append(o)
                    queue.append(o)
        groups.append([g for g in group if held[g]])
    count = lambda g: sum(len(held[s]) for s in g)
    centre = lambda g: sum(sp[s]["c"] * len(held[s]) for s in g) / count(g)
    mean = lambda g, k: sum(sp[s][k] for s in g) / len(g)
    primaries, fragments = [], []
    for g in groups:
        if not g:
            continue
        filled = {tuple(int(v / voxel) for v in place) for s in g for _, place in held[s]}
        if len(filled) < full * mean(g, "vox"):
            fragments.append(g)
        else:
            primaries.append({"g": g, "kind": sp[g[0]]["kind"], "c": centre(g), "r": max(0.02 * math.sqrt(mean(g, "vox")), 0.01 * math.sqrt(count(g)), mean(g, "size"))})
    absorbed = 0
    for f in fragments:
        same = [p for p in primaries if p["kind"] == sp[f[0]]["kind"]]
        best = min(same, key=lambda p: np.linalg.norm(p["c"] - centre(f)), default=None)
        if best and np.linalg.norm(best["c"] - centre(f)) < best["r"]:
            best["g"] = best["g"] + f
            g = best["g"]
            best["c"], best["r"] = centre(g), max(0.02 * math.sqrt(mean(g, "vox")), 0.01 * math.sqrt(count(g)), best["r"], mean(g, "size"))
            absorbed += 1
    return [(p["kind"], min(1.0, count(p["g"]) / mean(p["g"], "vox")), {i for s in p["g"] for i, _ in held[s]}) for p in primaries], len(fragments), absorbed


@pytest.fixture(scope="module")
def found(spark):
    made = {f"room{s}": scene(s) for s in (1, 2)}
    frame = lambda at, schema: spark.createDataFrame([(s, *r) for s, parts in made.items() for r in parts[at]], schema)
    got = instances.scene_instances(frame(2, "scene string, src long, dst long"), frame(0, SUPERPOINTS), frame(1, POINTS), stuff_points=20, wall_points_=60, wall_distance=0.05, most_walls=3)
    return made, got[0], got[1]


def test_instances_equal_a_plain_loop(found):
    made, table, members = found
    rows, held = table.collect(), collections.defaultdict(set)
    for r in members.collect():
        assert r["point_idx"] not in held[r["scene"], r["instance"]]
        held[r["scene"], r["instance"]].add(r["point_idx"])
    fragments = absorbed = 0
    for name, (superpoints, points, edges) in made.items():
        mine = sorted((r for r in rows if r["scene"] == name), key=lambda r: r["instance"])
        assert [r["instance"] for r in mine] == list(range(len(mine)))
        expected, f, a = plain(superpoints, points, edges)
        fragments, absorbed = fragments + f, absorbed + a
        things = [r for r in mine if r["class"] > 2]
        assert [(r["class"], held[name, r["instance"]]) for r in things] == [(k, ids) for k, _, ids in expected]
        assert [r["conf"] for r in things] == pytest.approx([c for _, c, _ in expected])
        assert all(r["points"] == len(held[name, r["instance"]]) for r in mine)
        kind = {s[0]: s[1] for s in superpoints}
        for c in (0, 1):
            whole = {i for i, s, *_ in points if kind[s] == c}
            assert [held[name, r["instance"]] for r in mine if r["class"] == c] == ([whole] if len(whole) > 20 else [])
        walls = [held[name, r["instance"]] for r in mine if r["class"] == 2]
        standing = [(i, s) for i, s, *_ in points if kind[s] == 2]
        assert len(walls) == 2 and len(walls[0] | walls[1]) == len(walls[0]) + len(walls[1])
        for wall, of in zip(walls, (40, 41), strict=True):  # the larger first; points near both planes go to it
            assert len(wall & {i for i, s in standing if s == of}) > 0.9 * sum(s == of for _, s in standing)
    assert fragments > absorbed > 0


def test_instances_feed_the_precision_table(spark, found):
    made, table, members = found
    truth = members.select("scene", "point_idx", F.col("instance").alias("gt"))
    classes = {(r["scene"], r["instance"]): r["class"] for r in table.collect()}
    class_of = F.coalesce(*[F.when((F.col("scene") == s) & (F.col("gt") == i), c) for (s, i), c in classes.items()])
    rows = {r["class"]: r["ap"] for r in metrics.precision_table(*instances.against(table, members, truth, class_of)).collect()}
    large = {r["class"] for r in table.collect() if r["points"] >= metrics.LEAST_POINTS}
    assert 2 in large and all(rows[c] == pytest.approx(1.0) for c in large)


def test_walls_keep_the_scenes_type_and_give_their_points(spark):
    rows = [("hall", i, 0, x, y, 1.0) for i, (x, y) in enumerate((a / 7, b / 5) for a in range(9) for b in range(9))] + [("hall", 500, 0, 0.0, 0.0, 9.0)]
    points = spark.createDataFrame(rows, POINTS)
    planes_ = planes.walls(points, 0.01, 1, 50)
    got = planes.wall_points(points, planes_, 0.01)
    assert {r["point_idx"] for r in got.collect()} == set(range(81)) and planes_.first()["points"] == 81
    none = planes.walls(points, 0.01, 1, 5000)
    assert none.count() == 0 and none.schema["scene"].dataType.simpleString() == "string"
    assert planes.wall_points(points, none, 0.01).count() == 0
