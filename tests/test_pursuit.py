"""Minimum cuts against all labellings, fidelities against plain loops, and partitions by energy against all partitions of small graphs."""

import itertools
import math
import random

import numpy as np
import pytest

from terrafold.operators import cluster, fidelity, mincut, pursuit

NODES, EDGES = "scene int, id long, lean double", "scene int, src long, dst long, capacity double"
VALUES, LINKS = "scene int, id long, value array<double>", "scene int, src long, dst long, weight double"


def cut_value(lean, edges, far):
    return sum(abs(x) for i, x in lean.items() if x and (x > 0) != (i in far)) + sum(c for a, b, c in edges if (a in far) != (b in far))


@pytest.mark.parametrize("block", [4096, 4])
def test_cuts_equal_the_best_of_all_labellings(spark, block):
    """Graphs of up to 12 nodes in one block and in several; loops, parallel edges, nodes without a lean or an edge, an end that is no node."""
    rng = random.Random(block)
    graphs = {}
    for scene in range(6):
        n = rng.randint(1, 12)
        lean = {i: float(rng.choice([0, rng.randint(-6, 6)])) for i in range(n)}
        edges = [(i, j, float(rng.randint(1, 4))) for i in range(n) for j in range(i) if rng.random() < 0.3]
        graphs[scene] = lean, [*edges, *edges[:1]]
    nodes = spark.createDataFrame([(s, i, x) for s, (lean, _) in graphs.items() for i, x in lean.items()], NODES)
    edges = spark.createDataFrame([(s, *e) for s, (_, es) in graphs.items() for e in es] + [(0, 0, 0, 9.0), (0, 0, 99, 9.0)], EDGES)
    got = mincut.minimum_cut(nodes, edges, block).collect()
    assert len(got) == sum(len(lean) for lean, _ in graphs.values())
    for scene, (lean, es) in graphs.items():
        best = min(cut_value(lean, es, set(f)) for k in range(len(lean) + 1) for f in itertools.combinations(lean, k))
        assert cut_value(lean, es, {r["id"] for r in got if r["scene"] == scene and r["far"]}) == pytest.approx(best)


def test_a_long_way_through_many_blocks(spark):
    """All of the source's flow goes down a path of 40 nodes in blocks of 8; its narrowest edge is the cut."""
    nodes = spark.createDataFrame([(0, i, 10.0 if i == 0 else -10.0 if i == 39 else 0.0) for i in range(40)], NODES)
    edges = spark.createDataFrame([(0, i, i + 1, 2.0 if i == 25 else 5.0) for i in range(39)], EDGES)
    assert {r["id"] for r in mincut.minimum_cut(nodes, edges, 8).filter("far").collect()} == set(range(26))


def test_an_empty_network(spark):
    assert mincut.minimum_cut(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES)).count() == 0


def plain(kind, smoothing=0.1):
    """cost of a node at a centre, best centre of a list of (weight, value)."""
    smooth = lambda p: smoothing / len(p) + (1 - smoothing) * np.asarray(p, float)
    mean = lambda rows: sum(w * np.array(y) for w, y in rows) / sum(w for w, _ in rows)

    def label(rows):
        total = sum(w * np.array(y) for w, y in rows)
        return np.eye(len(total))[int(total.argmax())]

    return {
        "squared": (lambda w, y, c: 0.5 * w * float(((np.array(y) - c) ** 2).sum()), mean, fidelity.SQUARED),
        "divergence": (lambda w, y, c: w * float((smooth(y) * (np.log(smooth(y)) - np.log(smooth(c)))).sum()), mean, fidelity.divergence(smoothing)),
        "linear": (lambda w, y, c: -w * float((np.array(y) * c).sum()), label, fidelity.LINEAR),
    }[kind]


def sample(rng, n, size=3):
    rows = []
    for _ in range(n):
        p = [rng.random() for _ in range(size)]
        rows.append((rng.choice([0.5, 1.0, 2.0]), [x / sum(p) for x in p]))
    return rows


def total_energy(kind, rows, edges, region, strength):
    cost, centre, _ = plain(kind)
    out = sum(strength * w for a, b, w in edges if region[a] != region[b])
    for r in set(region.values()):
        members = [rows[i] for i in region if region[i] == r]
        c = centre(members)
        out += sum(cost(w, y, c) for w, y in members)
    return out


@pytest.mark.parametrize("kind", ["squared", "divergence", "linear"])
def test_fidelities_equal_plain_loops(spark, kind):
    """Energies of a partition, and the merges that a plain loop makes."""
    rng = random.Random(4)
    rows = sample(rng, 14)
    edges = [(i, j, rng.uniform(0.5, 1)) for i in range(14) for j in (i + 1, i + 4) if j < 14]
    values = spark.createDataFrame([(0, i, y, w) for i, (w, y) in enumerate(rows)], f"{VALUES}, weight double")
    links = spark.createDataFrame([(0, *e) for e in edges], LINKS)
    cost, centre, own = plain(kind)
    region = {i: i // 3 * 3 for i in range(14)}
    parts = spark.createDataFrame([(0, i, r) for i, r in region.items()], "scene int, id long, region long")
    row = pursuit.energies(links, values, parts, 0.2, own).first()
    assert row["energy"] == pytest.approx(total_energy(kind, rows, edges, region, 0.2)) and row["energy"] == pytest.approx(row["fit"] + row["cut"])

    fit = lambda members: sum(cost(rows[i][0], rows[i][1], centre([rows[j] for j in members])) for i in members)
    region = {i: i for i in range(14)}
    while True:
        members = {r: [i for i in region if region[i] == r] for r in set(region.values())}
        border = {}
        for a, b, w in edges:
            key = tuple(sorted((region[a], region[b])))
            if key[0] != key[1]:
                border[key] = border.get(key, 0) + w
        gain = {k: round(0.05 * w + fit(members[k[0]]) + fit(members[k[1]]) - fit(members[k[0]] + members[k[1]]), 12) for k, w in border.items()}
        gain = {k: g for k, g in gain.items() if g > 1e-11}
        if not gain:
            break
        best = {r: min((-g, b if a == r else a) for (a, b), g in gain.items() if r in (a, b))[1] for r in {x for k in gain for x in k}}
        region = {i: best[r] if r in best and best[best[r]] == r and best[r] < r else r for i, r in region.items()}
    assert {r["id"]: r["region"] for r in cluster.merged_regions(links, values, 0.05, own).collect()} == region


def partitions(items):
    if not items:
        yield []
        return
    for rest in partitions(items[1:]):
        yield [[items[0]], *rest]
        for k in range(len(rest)):
            yield [*rest[:k], [items[0], *rest[k]], *rest[k + 1 :]]


def test_the_smoke_case(spark):
    values = spark.createDataFrame([(0, 0, [10.0, 20.0]), (0, 1, [0.0, 1.0]), (0, 2, [0.0, 0.0])], VALUES)
    links = spark.createDataFrame([(0, 0, 1, 1.0), (0, 1, 2, 1.0)], LINKS)
    assert {r["id"]: r["region"] for r in pursuit.cut_pursuit(links, values, 1.0).collect()} == {0: 0, 1: 1, 2: 1}


@pytest.mark.parametrize("kind", ["squared", "divergence", "linear"])
def test_energy_never_rises(spark, kind):
    """Seven nodes in each of two scenes: more rounds never give more energy, and never less than the least of all partitions."""
    rng = random.Random(9)
    rows = {s: sample(rng, 7) for s in range(2)}
    edges = {s: [(i, j, rng.uniform(0.5, 1)) for i in range(7) for j in range(i) if rng.random() < 0.5 or i == j + 1] for s in range(2)}
    values = spark.createDataFrame([(s, i, y, w) for s in rows for i, (w, y) in enumerate(rows[s])], f"{VALUES}, weight double")
    links = spark.createDataFrame([(s, *e) for s in edges for e in edges[s]], LINKS)
    own, strength = plain(kind)[2], 0.05
    before = {s: total_energy(kind, rows[s], edges[s], dict.fromkeys(range(7), 0), strength) for s in rows}
    for rounds in (1, 4):
        got = pursuit.cut_pursuit(links, values, strength, own, rounds=rounds).collect()
        for s in rows:
            region = {r["id"]: r["region"] for r in got if r["scene"] == s}
            assert all(min(i for i in region if region[i] == r) == r for r in region.values())
            now = total_energy(kind, rows[s], edges[s], region, strength)
            assert now <= before[s] + 1e-9
            before[s] = now
    for s in rows:
        least = min(total_energy(kind, rows[s], edges[s], {i: k for k, part in enumerate(p) for i in part}, strength) for p in partitions(list(range(7))))
        assert least - 1e-9 <= before[s]


def test_steps_of_a_noisy_signal(spark):
    """A chain of three levels in blocks of 16 nodes, a lonely node and a second scene: the levels are the regions, and the merges alone don't find less."""
    rng = random.Random(2)
    level = [0.0] * 25 + [3.0] * 20 + [1.5] * 15
    values = spark.createDataFrame([(0, i, [v + rng.gauss(0, 0.2)]) for i, v in enumerate(level)] + [(0, 99, [7.0]), (1, 0, [1.0]), (1, 1, [1.0])], VALUES)
    links = spark.createDataFrame([(0, i, i + 1, 1.0) for i in range(59)] + [(1, 1, 0, 1.0)], LINKS)
    found = pursuit.cut_pursuit(links, values, 1.0, block=16)
    got = {(r["scene"], r["id"]): r["region"] for r in found.collect()}
    assert got == {**{(0, i): 0 if i < 25 else 25 if i < 45 else 45 for i in range(60)}, (0, 99): 99, (1, 0): 0, (1, 1): 0}
    assert got == {(r["scene"], r["id"]): r["region"] for r in pursuit.cut_pursuit(links, values, 1.0).collect()}  # whole regions in tasks
    energy = lambda parts: pursuit.energies(links, values, parts, 1.0).filter("scene = 0").first()["energy"]
    assert energy(found) <= energy(cluster.merged_regions(links, values, 1.0)) + 1e-9
    small = pursuit.cut_pursuit(links, values, 1.0, block=16, smallest=18)
    assert {r["region"] for r in small.filter("scene = 0 and id < 60").collect()} == {0, 25}
    assert math.isfinite(energy(small))


def test_merges_in_tasks_equal_merges_by_joins(spark, monkeypatch):
    """By two fidelities that share one table: all scenes in tasks, the smaller one, or none give the same regions."""
    rng = random.Random(3)
    sizes = {0: 20, 1: 9}
    share = lambda: [a := rng.random(), 1 - a]
    values = spark.createDataFrame([(s, i, share()) for s, n in sizes.items() for i in range(n)], VALUES)
    links = spark.createDataFrame([(s, i, j, rng.random()) for s, n in sizes.items() for i in range(n) for j in range(i + 1, n) if rng.random() < 0.2], LINKS)
    for kind in (fidelity.divergence(0.1), fidelity.LINEAR):
        got = []
        for few in (1 << 16, 0):
            monkeypatch.setattr(cluster, "FEW_PAIRS", few)
            got.append(sorted(map(tuple, cluster.merged_regions(links, values, 0.1, kind).collect())))
        assert got[0] == got[1] and len({r[2] for r in got[0]}) < len(got[0])
