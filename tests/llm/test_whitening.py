"""Rank-one updates against full eigendecompositions, and whole whitenings against NumPy."""

import math

import numpy as np
import pyarrow.compute  # noqa: F401
import pytest
from pyspark.sql import functions as F

from terrafold.llm import whitening
from terrafold.llm.spectra import Spectrum, updated

SCHEMA = "vec_id long, embedding array<float>"


def close(spectrum, x):
    c = (x - x[0]).astype(float)
    c -= c.mean(axis=0)
    m = c.T @ c
    scale = max(abs(m).max(), 1.0)
    assert abs((spectrum.vectors * spectrum.values) @ spectrum.vectors.T - m).max() < 1e-11 * scale
    assert abs(spectrum.vectors.T @ spectrum.vectors - np.eye(x.shape[1])).max() < 1e-12
    assert (np.diff(spectrum.values) >= 0).all() and spectrum.sums == x.sum(axis=0).tolist() and spectrum.n == len(x)


@pytest.mark.parametrize("case", ["spread", "few", "equal values", "equal columns", "two rows often", "scales", "one column", "no variance"])
def test_spectra_of_blocks_and_parts(case):
    rng = np.random.default_rng(7)
    x = rng.integers(-40, 40, (3, 6) if case == "few" else (90, 1) if case == "one column" else (120, 8))
    if case == "equal values":
        x = np.concatenate([np.eye(8, dtype=int) * 3, -np.eye(8, dtype=int) * 3])
    elif case == "equal columns":
        x[:, 3], x[:, 5] = x[:, 2], 7
    elif case == "two rows often":
        x = np.repeat(x[:2], 25, axis=0)
    elif case == "scales":
        x = (rng.normal(size=(120, 8)) * 10.0 ** np.arange(8)).astype(int)
    elif case == "no variance":
        x = np.full((9, 4), 5)
    x = x + 1_000_000
    whole = Spectrum.empty(x.shape[1])
    for part in np.array_split(x, 3):
        spectrum = Spectrum.empty(x.shape[1])
        for block in np.array_split(part, 2):
            spectrum = spectrum.with_rows(block)
        whole = whole.merged(spectrum)
    close(whole, x)


def test_one_update_is_that_of_the_formed_matrix():
    rng = np.random.default_rng(2)
    for size in (1, 2, 5, 20):
        values = np.sort(rng.integers(0, 4, size).astype(float))  # with ties
        vectors = np.linalg.qr(rng.normal(size=(size, size)))[0]
        v = rng.normal(size=size)
        found, turned = updated(values, vectors, 0.7, v)
        formed = (vectors * values) @ vectors.T + 0.7 * np.outer(v, v)
        assert abs((turned * found) @ turned.T - formed).max() < 1e-13 * max(1, abs(formed).max())
        assert abs(found - np.linalg.eigvalsh(formed)).max() < 1e-13 * max(1, abs(formed).max())


def brute_force(data, components=16):
    """What the contract says, from whole matrices: {(vec_id, component): (n, deviation, |whitened|, explained)}."""
    x = {i: [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for i, v in data if v and all(c is not None and math.isfinite(c) for c in v)}
    fit = np.array(sorted({tuple(v) for v in x.values()}))
    n, sums = len(fit), fit.sum(axis=0).tolist()
    centred = (n * fit - np.array(sums)) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for i, v in x.items():
        y = [n * c - s for c, s in zip(v, sums, strict=True)]
        for k in range(min(components, len(values))):
            if values[k] > 1e-9 * values[0]:
                out[i, k + 1] = (n, sum(c * c for c in y), abs(np.array(y) / n @ vectors[:, k]) / math.sqrt(values[k]), values[k] / values.sum())
    return out


def held(spark, data, **more):
    docs = spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v]) for i, v in data], SCHEMA).withColumn("x", F.lit(1)).withColumn("v", F.lit(2)).withColumn("n", F.lit(3))
    got = whitening.whitened(docs.repartition(5), **more).collect()
    expected = brute_force(data)
    assert len(got) == len(expected) == len({(r["vec_id"], r["component"]) for r in got})
    for r in got:
        n, deviation, value, explained = expected[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert abs(r["whitened"]) == pytest.approx(value, abs=1e-8) and r["explained"] == pytest.approx(explained, rel=1e-9) and r["identity_error"] < 1e-9
    return got


def test_whole_table(spark, monkeypatch):
    """Copies, nulls, null and non-finite entries, empty vectors; blocks and a fan-in that are small against the data."""
    monkeypatch.setattr(whitening, "BLOCK", 50)
    monkeypatch.setattr(whitening, "FAN", 2)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 20)) * np.linspace(0.2, 3, 20)
    data = [(i, v.tolist()) for i, v in enumerate(base)] + [(1000 + i, base[7].tolist()) for i in range(200)]
    data += [(2000, None), (2001, [None] * 20), (2002, [1.0] * 19 + [math.nan]), (2003, [math.inf] + [0.0] * 19), (2004, [])]
    got = held(spark, data)
    assert {r["component"] for r in got} == set(range(1, 17)) and len({r["vec_id"] for r in got}) == 500


def test_few_dimensions_and_directions_without_variance(spark):
    rng = np.random.default_rng(5)
    flat = [(i, [a, b, a + b, 0.5]) for i, (a, b) in enumerate(rng.integers(-9, 9, (40, 2)).astype(float).tolist())]
    assert {r["component"] for r in held(spark, flat)} == {1, 2}


def test_lists_without_variance_and_other_lengths(spark):
    frame = lambda data: spark.createDataFrame(data, SCHEMA)
    assert whitening.whitened(frame([])).count() == 0
    assert whitening.whitened(frame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, None)])).count() == 0
    mixed = whitening.whitened(frame([(1, [1.0, 2.0]), (2, [3.0, 2.5]), (None, [3.0, 7.0]), (3, [1.0]), (4, [1e30, 0.0])]))
    assert sorted((r["vec_id"] or 0, r["component"]) for r in mixed.collect()) == [(0, 1), (0, 2), (1, 1), (1, 2), (2, 1), (2, 2)]


def test_deviations_beyond_64_bits():
    y = whitening.centred(np.array([[1 << 40, 0], [2, 0]]), 1 << 30, [0, 0])
    assert whitening.deviations(y) == [None, (2 << 30) ** 2]
