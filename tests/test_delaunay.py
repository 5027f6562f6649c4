"""Delaunay edges against the empty spheres of all tetrahedra."""

import itertools

import numpy as np
import pytest

from terrafold.operators import delaunay

POINTS = "scene string, id long, x double, y double, z double"


def empty_spheres(p, radius):
    """{(i, j): least radius} of the edges of all tetrahedra with an empty circumsphere of at most this radius."""
    near = np.linalg.norm(p[:, None] - p[None], axis=2) <= 2 * radius
    quads = np.array([q for q in itertools.combinations(range(len(p)), 4) if all(near[a, b] for a, b in itertools.combinations(q, 2))]).reshape(-1, 4)
    out = {}
    for part in np.array_split(quads, max(1, len(quads) // 20000)):
        e = p[part[:, 1:]] - p[part[:, :1]]
        to = np.linalg.solve(2 * e, (e * e).sum(axis=2)[..., None])[..., 0]
        r = np.linalg.norm(to, axis=1)
        keep = r <= radius
        part, r, centre = part[keep], r[keep], (p[part[:, 0]] + to)[keep]
        far = np.linalg.norm(centre[:, None] - p[None], axis=2)
        np.put_along_axis(far, part, np.inf, axis=1)
        for q, s in zip(part[far.min(axis=1) > r].tolist(), r[far.min(axis=1) > r].tolist(), strict=True):
            for pair in itertools.combinations(q, 2):
                out[pair] = min(out.get(pair, np.inf), s)
    return out


@pytest.mark.parametrize("radius,tile", [(0.2, None), (0.3, 0.3), (0.15, 0.1)])
def test_edges_equal_empty_spheres(spark, radius, tile):
    """160 points in two scenes, evenly and in a dense corner; tiles of several widths."""
    rng = np.random.default_rng(3)
    scenes = {"a": rng.random((90, 3)), "b": np.concatenate([rng.random((35, 3)) - 0.5, rng.random((35, 3)) * 0.2])}
    rows = [(s, i, *map(float, v)) for s, p in scenes.items() for i, v in enumerate(p)]
    found = delaunay.delaunay_edges(spark.createDataFrame([*rows, ("a", 900, *rows[5][2:])], POINTS), radius, tile).collect()
    got = {(r["scene"], r["src"], r["dst"]): (r["length"], r["radius"]) for r in found}
    assert len(got) == len(found)
    expected = {(s, *pair): (float(np.linalg.norm(p[pair[0]] - p[pair[1]])), r) for s, p in scenes.items() for pair, r in empty_spheres(p, radius).items()}
    assert set(got) == set(expected) and len(got) > 100
    for k, v in expected.items():
        assert got[k] == pytest.approx(v, abs=1e-6)


def test_a_whole_triangulation_fills_the_hull():
    """The volumes of all tetrahedra of a tile add up to that of a box whose corners are among the points."""
    rng = np.random.default_rng(1)
    p = np.concatenate([np.array(list(itertools.product((0.0, 1.0), repeat=3))), rng.random((120, 3))])
    t, _, _ = delaunay.tetrahedra(delaunay.shifted(p, np.arange(len(p)), 1e-9))
    assert np.abs(np.linalg.det(p[t[:, 1:]] - p[t[:, :1]])).sum() / 6 == pytest.approx(1.0, abs=1e-6)


def test_grids_planes_and_few_points(spark):
    """Points of a grid, where eight lie on every sphere: all grid edges are found; a plane and three points have none."""
    rows = [("grid", 16 * i + 4 * j + k, float(i), float(j), float(k)) for i in range(4) for j in range(4) for k in range(4)]
    rows += [("plane", i, float(i % 4), float(i // 4), 0.0) for i in range(16)] + [("few", i, float(i), float(i * i), 1.0) for i in range(3)]
    found = delaunay.delaunay_edges(spark.createDataFrame(rows, POINTS), 1.0).collect()
    unit = {(r["src"], r["dst"]) for r in found if r["length"] == 1.0}
    assert {r["scene"] for r in found} == {"grid"} and len(unit) == 3 * 3 * 16
    assert all(r["length"] <= 2.0 for r in found)
    assert delaunay.delaunay_edges(spark.createDataFrame([], POINTS), 1.0).count() == 0


def test_union_with_nearest(spark):
    edges = spark.createDataFrame([("s", 0, 1, 1.0, 1.0), ("s", 1, 2, 3.0, 1.0)], "scene string, src long, dst long, length double, radius double")
    nearest = spark.createDataFrame([("s", 0, 1), ("s", 2, 0)], "scene string, src long, dst long")
    got = {(r["src"], r["dst"]) for r in delaunay.with_nearest(edges, nearest, 2.0).collect()}
    assert got == {(0, 1), (1, 0), (2, 0)}


def test_short_edges_alone(spark):
    """Without nearest neighbours no search for them is needed."""
    edges = spark.createDataFrame([("s", 0, 1, 1.0, 1.0), ("s", 1, 2, 3.0, 1.0)], "scene string, src long, dst long, length double, radius double")
    assert {(r["src"], r["dst"]) for r in delaunay.with_nearest(edges, None, 2.0).collect()} == {(0, 1), (1, 0)}


def test_steps_grow_with_the_points(monkeypatch):
    """Four times as many points in the same tile take less than six times as many steps, and parts of any size find the same tetrahedra."""
    rng, steps, whole = np.random.default_rng(5), [], delaunay.apexes
    monkeypatch.setattr(delaunay, "apexes", lambda p, faces, sides: (steps.append(len(p) * len(faces)), whole(p, faces, sides))[1])
    taken = []
    for n in (1500, 6000):
        steps.clear()
        delaunay.owned(rng.normal(size=(n, 3)) * 0.12, 0.8, 0.2, 16)
        taken.append(sum(steps))
    assert taken[1] < 6 * taken[0]
    p = np.concatenate([rng.normal(size=(250, 3)) * 0.05, rng.random((30, 3))]) + 0.2
    found = []
    for few in (1 << 20, 60, 10):
        monkeypatch.setattr(delaunay, "FEW", few)
        corners, radii = delaunay.owned(p, 0.8, 0.2, 16)
        found.append({(*sorted(t), round(r, 9)) for t, r in zip(corners.tolist(), radii.tolist(), strict=True)})
    assert found[0] == found[1] == found[2] and len(found[0]) > 500


def test_points_of_a_sphere_are_not_split(monkeypatch):
    """All parts near the centre would see all points, so the tile stays as it is as soon as parts don't help."""
    monkeypatch.setattr(delaunay, "FEW", 50)
    v = np.random.default_rng(2).normal(size=(300, 3))
    p = v / np.linalg.norm(v, axis=1)[:, None] * 0.1 + 0.4
    assert sum(len(seen) ** 2 for seen, _, _ in delaunay.tiles(p, 0.8, 0.2, 16)) <= len(p) ** 2


def test_split_tiles_find_the_same_edges(spark, monkeypatch):
    """Tiles that see many points are split by rounds of jobs, more than once where points are dense; each edge and its radius stay."""
    rng, widths, split = np.random.default_rng(4), [], delaunay._split
    p = rng.normal(size=(3000, 3)) * 0.12
    points = spark.createDataFrame([("s", i, *map(float, v)) for i, v in enumerate(p)], POINTS)
    monkeypatch.setattr(delaunay, "_split", lambda rows, width, radius: (widths.append(width), split(rows, width, radius))[1])
    found = []
    for seen in (1 << 15, 300):
        monkeypatch.setattr(delaunay, "SEEN", seen)
        found.append({(r["src"], r["dst"]): (r["length"], r["radius"]) for r in delaunay.delaunay_edges(points, 0.2).collect()})
    assert len(widths) > 1 and widths[0] == 0.8
    assert set(found[0]) == set(found[1]) and len(found[0]) > 5000
    for k, v in found[0].items():
        assert found[1][k] == pytest.approx(v, abs=1e-6)


def test_both_ways_take_the_edges_once(spark):
    """The tiles are wrapped once in the plan of the edges both ways, without counting on Spark to find equal parts of it."""
    points = spark.createDataFrame([("s", i, *map(float, v)) for i, v in enumerate(np.random.default_rng(6).random((40, 3)))], POINTS)
    both = delaunay.with_nearest(delaunay.delaunay_edges(points, 0.3), None, 0.25)
    assert both._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInPandas") == 1


def test_cells_of_split_tiles_go_to_all_tasks(spark, monkeypatch):
    """The search of how far parts see is dealt to as many tasks as a shuffle has, however few bytes the cells take."""
    parts, cut = {}, delaunay.cut
    monkeypatch.setattr(delaunay, "cut", lambda df, name="cut": (parts.update({name: df.rdd.getNumPartitions()}) if name == "delaunay-parts" else None, cut(df, name))[1])
    rng = np.random.default_rng(7)
    rows = [(s, i, *map(float, v)) for s in "abcdefgh" for i, v in enumerate(rng.random((60, 3)) * 0.4)]
    monkeypatch.setattr(delaunay, "SEEN", 50)
    delaunay.delaunay_edges(spark.createDataFrame(rows, POINTS), 0.2)
    assert parts == {"delaunay-parts": int(spark.conf.get("spark.sql.shuffle.partitions"))}
