"""Colours against NumPy and the colour conversions of the standard library."""

import colorsys
import random

import numpy as np
import pytest

from terrafold.operators import colours

ROWS = "id long, v array<float>"


def test_embedding_colours_are_those_of_the_leading_components(spark):
    """All 64 values of each vector, a row without one, and copies."""
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(150, 64)) * np.linspace(0.05, 0.5, 64)).astype("float32")
    x = np.concatenate([x, x[:20]])
    rows = spark.createDataFrame([*[(i, v.tolist()) for i, v in enumerate(x)], (999, None)], ROWS).repartition(4)
    got = {r["id"]: (r["red"], r["green"], r["blue"]) for r in colours.embedding_colours(rows, "v").collect()}
    centred = x.astype(float) - x.astype(float).mean(axis=0)
    axes = np.linalg.eigh(centred.T @ centred)[1][:, ::-1][:, :3]
    axes *= np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(3)])
    value = np.clip((centred @ axes + 1) / 2, 0, 1) * 255
    for i, v in enumerate(value):
        assert np.abs(np.array(got[i]) - v).max() <= 1 + 1e-6 and all(abs(g - np.floor(e)) == 0 or abs(e - round(e)) < 1e-6 for g, e in zip(got[i], v, strict=True))
    assert got[999] == (127, 127, 127)


def test_narrow_embeddings_and_none(spark):
    rows = spark.createDataFrame([(0, [0.0, 1.0]), (1, [-1.0, 3.0])], ROWS)
    assert {tuple(r)[2:] for r in colours.embedding_colours(rows, "v").collect()} == {(127, 255, 127), (0, 255, 127)}
    assert colours.embedding_colours(rows.limit(0), "v").count() == 0
    assert [tuple(r)[2:] for r in colours.embedding_colours(rows.filter("id = 1"), "v").collect()] == [(127, 127, 127)]


def test_error_colours_follow_the_hue(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(3), rng.randrange(3), *(rng.choice([0, 255, rng.randrange(256)]) for _ in range(3))) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, truth int, predicted int, red int, green int, blue int")
    got = {r["id"]: (r["red"], r["green"], r["blue"]) for r in colours.error_colours(df, "truth", "predicted").collect()}
    for i, truth, predicted, *rgb in rows:
        _, s, v = colorsys.rgb_to_hsv(*(c / 255 for c in rgb))
        hue = 1 / 3 if truth in (predicted, 0) else 0.0
        expected = np.array(colorsys.hsv_to_rgb(hue, min(1, s + 0.3), min(1, v + 0.1))) * 255
        assert np.abs(np.array(got[i]) - expected).max() <= 1 + 1e-9


def test_features_and_regions(spark):
    df = spark.createDataFrame([(0, 1, 0.0, 1.0, 0.5), (0, 2, 2.0, -1.0, 0.25), (0, 1, 0.1, 0.2, 0.3)], "scene int, region int, linearity double, planarity double, verticality double")
    got = [tuple(r)[-3:] for r in colours.feature_colours(df).collect()]
    assert got[0] == (0, 255, 127) and got[1] == (255, 0, 63)
    regions = [tuple(r)[-3:] for r in colours.region_colours(df, ["scene", "region"]).collect()]
    assert regions[0] == regions[2] != regions[1] and all(0 <= c < 256 for r in regions for c in r)


@pytest.mark.parametrize("k", [1, 3])
def test_axes_are_unit_vectors(spark, k):
    rows = spark.createDataFrame([(i, [float(i), float(i * i % 7), 1.0, float(-i % 5)]) for i in range(30)], ROWS)
    mean, axes = colours.principal_axes(rows, "v", k)
    assert len(axes) == k and mean[2] == 1.0 and np.allclose(np.array(axes) @ np.array(axes).T, np.eye(k))
