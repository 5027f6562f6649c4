"""Neighbours in a large cloud: copies of places aren't searched, tiles have many rows, and rows are numbered in their order."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.operators import neighbors, order

SCHEMA = "scene int, id long, x double, y double, z double"


def nearest(rows, k):
    """{(scene, id): ids and distances of its k nearest} of all pairs."""
    found = {}
    for scene in {r[0] for r in rows}:
        ids = np.array([r[1] for r in rows if r[0] == scene])
        at = np.array([r[2:] for r in rows if r[0] == scene])
        for i, here in zip(ids, at, strict=True):
            d = at - here
            far = np.sqrt(d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2])
            found[scene, int(i)] = [(int(ids[j]), float(far[j])) for j in np.lexsort((ids, far)) if ids[j] != i][:k]
    return {key: near for key, near in found.items() if near}


def searched(spark, rows, k, farthest=None):
    p, got = spark.createDataFrame(rows, SCHEMA), {}
    for r in sorted(neighbors.knn(p, p, k, other=True, farthest=farthest).collect(), key=lambda r: r["rank"]):
        got.setdefault((r["scene"], r["src"]), []).append((r["dst"], r["dist"]))
    return got


def lines(rng, n):
    """Points on lines one apart, as rows with two whole coordinates are."""
    return [(float(rng.randrange(10)), rng.randrange(5000) / 50, float(rng.randrange(5))) for _ in range(n)]


def test_copies_of_places_are_not_searched(spark, monkeypatch):
    rng = random.Random(1)
    spots = lines(rng, 40)
    rows = [(s % 2, i, *spots[s]) for i, s in enumerate(list(range(40)) * 5)]
    monkeypatch.setattr(neighbors, "_searched", lambda *_: pytest.fail("a place with five rows was searched for the nearest four"))
    assert searched(spark, rows, 3) == nearest(rows, 3)


def test_tiles_have_many_rows(spark, monkeypatch):
    """Distinct places on lines: as many tiles as their rows ask for, in one round."""
    rng, tiles, search = random.Random(2), [], neighbors._searched

    def counted(places, right, h, k, farthest):
        tiles.append(places.select("scene", *neighbors._tiles(h, 0)).distinct().count())
        return search(places, right, h, k, farthest)

    monkeypatch.setattr(neighbors, "_searched", counted)
    rows = [(i % 2, i, *p) for i, p in enumerate(lines(rng, 1500))]
    assert searched(spark, rows, 3) == nearest(rows, 3)
    assert len(tiles) == 1 and tiles[0] <= 2 * 8


def test_copies_lines_and_odd_places(spark, monkeypatch):
    """Places of one to six rows, zeros of both signs, coordinates whose distance is 0, a small scene, a far point and a crowd in it: exact in small tiles and parts."""
    rng = random.Random(3)
    spots = lines(rng, 120) + [(0.0, 0.0, 0.0), (-0.0, 0.0, -0.0), (3.0, 400.0, 2.0)] + [(5.0, 50 + rng.random(), 2.0) for _ in range(60)]
    monkeypatch.setattr(neighbors, "CANDIDATES", 128)
    monkeypatch.setattr(neighbors, "PAIRS", 100)
    rows = [p for i, spot in enumerate(spots) for p in [(i % 2, *spot)] * rng.choice([1, 1, 2, 3, 4, 6])] + [(2, 1.0, 2.0, 3.0), (2, 1.0, 2.5, 3.0), (3, 1.0, 1.0, 1.0)]
    rng.shuffle(rows)
    rows = [(scene, i, *at) for i, (scene, *at) in enumerate(rows)]
    assert searched(spark, rows, 3) == nearest(rows, 3)
    tiny = [(0, i, x, 0.0, 0.0) for i, x in enumerate([0.0, 1e-200, 1e-170, 0.0, 1e-200, 0.0, 1e-200, 0.0, 1e-150, 2.0])]
    assert searched(spark, tiny, 3) == nearest(tiny, 3)


def test_nearest_up_to_a_distance(spark):
    """A neighbour at the very distance that is asked for counts."""
    rows = [(0, i, float(x), 0.0, 0.0) for i, x in enumerate([0, 1, 2, 2, 2, 2, 5, 6, 100])]
    assert searched(spark, rows, 3, farthest=1.0) == {key: kept for key, near in nearest(rows, 3).items() if (kept := [n for n in near if n[1] <= 1.0])}


def test_rows_are_numbered_in_their_order(spark):
    rng = random.Random(4)
    rows = [(i, rng.randrange(50), rng.random()) for i in range(3000)]
    df = spark.createDataFrame(rows, "i int, a int, b double").repartition(7)
    got = {r["i"]: r["number"] for r in order.numbered(df, ["a", F.desc("b")], "number", ["i"]).collect()}
    assert got == {i: n for n, (i, _, _) in enumerate(sorted(rows, key=lambda r: (r[1], -r[2])))}
    assert order.numbered(df.filter("i < 0"), ["a"], "number", ["i"]).count() == 0
