"""Grouping, absorption and suppression without an order of scenes' points: each is a join, components, or rounds of joins."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.plans import cut, small
from .components import scene_components
from .fidelity import SQUARED, Fidelity
from .geometry import compared, superpoint_features
from .neighbors import knn


def grouped(edges: DataFrame, nodes: DataFrame, joined: Column) -> DataFrame:
    """(scene, id, cluster): components over the edges that satisfy `joined`, a condition on s_ and d_ columns of the nodes.

    A growth from seeds in turn depends on their order; components over a symmetric condition don't, and take no
    scene into one task.  cluster is the smallest id of its scene.
    """
    a = nodes.select(*[F.col(c).alias(c if c == "scene" else f"s_{c}") for c in nodes.columns])
    b = nodes.select(*[F.col(c).alias(c if c == "scene" else f"d_{c}") for c in nodes.columns])
    kept = edges.select("scene", F.col("src").alias("s_id"), F.col("dst").alias("d_id")).join(a, ["scene", "s_id"]).join(b, ["scene", "d_id"]).filter(joined)
    found = scene_components(kept.select("scene", F.col("s_id").alias("src"), F.col("d_id").alias("dst"))).withColumnRenamed("node", "id")
    return nodes.select("scene", "id").join(found, ["scene", "id"], "left").select("scene", "id", F.coalesce("component", "id").alias("cluster"))


def absorbed(fragments: DataFrame, primaries: DataFrame, reach: str) -> DataFrame:
    """(scene, id, into): the nearest primary of a fragment's class, if the fragment lies within the primary's reach.

    Centres are those before any absorption, so the result has no order.  Rows are (scene, class, id, x, y, z, reach).
    """
    key = F.concat_ws(":", F.col("scene").cast("string"), F.col("class").cast("string")).alias("scene")
    near = knn(fragments.select(key, "id", *"xyz"), primaries.select(key, "id", *"xyz"), 1)
    limit = primaries.select(key, F.col("id").alias("dst"), F.col(reach).alias("limit"))
    hit = near.join(limit, ["scene", "dst"]).filter(F.col("dist") <= F.col("limit")).select("scene", F.col("src").alias("id"), F.col("dst").alias("into"))
    return fragments.select(key, F.col("scene").alias("of"), "id").join(hit, ["scene", "id"]).select(F.col("of").alias("scene"), "id", "into")


def absorbed_in_turn(groups: DataFrame) -> DataFrame:
    """(scene, id, into): fragments in the order of their ids go to the nearest primary of their class if it is nearer than its reach, which, like its
    centre and size, follows every absorption.

    groups: (scene, class, id, fragment, x, y, z, points, voxels, size), a row per group of superpoints; a class of a scene is one group here, because
    each absorption changes what the next one meets.  Rows are instances, not points, so such a group is small.
    A primary's reach is the largest of 0.02 times the root of its expected voxels, 0.01 times the root of its points, its mean size, and its reach before.
    """

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        main = pdf[~pdf["fragment"]]
        centre, points = main[list("xyz")].to_numpy(float), main["points"].to_numpy(float)
        parts, voxels, sizes = main["parts"].to_numpy(float), main["voxels"].to_numpy(float) * main["parts"].to_numpy(float), main["size"].to_numpy(float) * main["parts"].to_numpy(float)
        reach = np.maximum.reduce([0.02 * np.sqrt(main["voxels"].to_numpy(float)), 0.01 * np.sqrt(points), main["size"].to_numpy(float)]) if len(main) else np.zeros(0)
        out = []
        for r in pdf[pdf["fragment"]].itertuples():
            if not len(main):
                break
            far = np.sqrt(((centre - np.array([r.x, r.y, r.z])) ** 2).sum(axis=1))
            i = int(far.argmin())
            if far[i] < reach[i]:
                centre[i] = (centre[i] * points[i] + np.array([r.x, r.y, r.z]) * r.points) / (points[i] + r.points)
                points[i] += r.points
                parts[i] += r.parts
                voxels[i] += r.voxels * r.parts
                sizes[i] += r.size * r.parts
                reach[i] = max(reach[i], 0.02 * np.sqrt(voxels[i] / parts[i]), 0.01 * np.sqrt(points[i]), sizes[i] / parts[i])
                out.append((r.scene, r.id, main["id"].iloc[i]))
        return pd.DataFrame(out, columns=["scene", "id", "into"])

    kind = groups.schema["scene"].dataType.simpleString()
    return groups.select("scene", "class", "id", "fragment", *"xyz", "points", "voxels", "size", "parts").groupBy("scene", "class").applyInPandas(walk, f"scene {kind}, id long, into long")


def seeded(edges: DataFrame, nodes: DataFrame, factor: float) -> DataFrame:
    """(scene, id, cluster): growth from seeds in the order of their ids.  A neighbour joins if it has the seed's class, no cluster yet, and lies
    nearer than factor times the seed's size to the node that reaches it.

    edges: (scene, src, dst), taken both ways; nodes: (scene, id, class, size, x, y, z), a row per superpoint with its predicted centre.
    What a seed takes the next one can't have, so a class of a scene is one group; classes don't meet, and rows are superpoints, not points.
    """
    ends = [nodes.select("scene", F.col("id").alias(e), F.col("class").alias(f"{e}_class")) for e in ("src", "dst")]
    ways = edges.select("scene", "src", "dst").unionByName(edges.select("scene", F.col("dst").alias("src"), F.col("src").alias("dst")))
    near = ways.join(ends[0], ["scene", "src"]).join(ends[1], ["scene", "dst"]).filter("src_class = dst_class and src != dst")
    near = near.groupBy("scene", F.col("src").alias("id")).agg(F.sort_array(F.collect_set("dst")).alias("near"))
    rows = nodes.select("scene", "class", "id", "size", *"xyz").join(near, ["scene", "id"], "left")

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        ids = pdf["id"].tolist()
        place, near, size = dict(zip(ids, pdf[list("xyz")].to_numpy(float), strict=True)), dict(zip(ids, pdf["near"], strict=True)), dict(zip(ids, pdf["size"], strict=True))
        cluster: dict[int, int] = {}
        for seed in ids:
            if seed in cluster:
                continue
            cluster[seed], queue = seed, deque([seed])
            while queue:
                at = queue.popleft()
                for other in near[at] if near[at] is not None else ():
                    if other not in cluster and np.sqrt(((place[at] - place[other]) ** 2).sum()) < factor * size[seed]:
                        cluster[other] = seed
                        queue.append(other)
        return pd.DataFrame({"scene": pdf["scene"], "id": ids, "cluster": [cluster[i] for i in ids]})

    kind = nodes.schema["scene"].dataType.simpleString()
    return rows.groupBy("scene", "class").applyInPandas(grow, f"scene {kind}, id long, cluster long")


def confidence(groups: DataFrame) -> DataFrame:
    """groups (points, voxels) with conf: points over expected voxels, 1 at most."""
    return groups.withColumn("conf", F.least(F.col("points") / F.col("voxels"), F.lit(1.0)))


#: The regions of a scene with at most so many pairs left are merged in a task.
FEW_PAIRS = 1 << 16


def _merged_in_task(stats: pd.DataFrame, links: pd.DataFrame, strength: float, fidelity: Fidelity) -> pd.DataFrame:
    """(old, into): the regions of one scene and what they are merged into in the end, round by round."""
    stats = stats.sort_values("id")
    ids, w, t = stats["id"].to_numpy(), stats["w"].to_numpy(float).copy(), np.array(stats["total"].tolist(), float).reshape(len(stats), -1)
    a, b = (np.searchsorted(ids, links[c].to_numpy()) for c in "ab")
    weight, root = links["weight"].to_numpy(float), np.arange(len(ids))
    while len(a):
        gain = np.round(strength * weight - fidelity.losses(w[a], t[a], w[b], t[b]), 12)
        up = gain > 0
        if not up.any():
            break
        u, v, g = np.concatenate([a[up], b[up]]), np.concatenate([b[up], a[up]]), np.tile(gain[up], 2)
        order = np.lexsort((v, -g, u))
        first = order[np.flatnonzero(np.diff(u[order], prepend=-1))]
        best = np.full(len(ids), -1)
        best[u[first]] = v[first]
        met = first[(best[v[first]] == u[first]) & (v[first] < u[first])]
        old, into = u[met], v[met]
        w[into] += w[old]
        t[into] += t[old]
        to = np.arange(len(ids))
        to[old] = into
        root, a, b = to[root], to[a], to[b]
        apart = a != b
        pairs, at = np.unique(np.minimum(a, b)[apart] * len(ids) + np.maximum(a, b)[apart], return_inverse=True)
        weight = np.bincount(at, weight[apart], len(pairs))
        a, b = pairs // len(ids), pairs % len(ids)
    return pd.DataFrame({"old": ids, "into": ids[root]})


def merged_regions(edges: DataFrame, values: DataFrame, strength: float, fidelity: Fidelity = SQUARED, start: DataFrame | None = None) -> DataFrame:
    """(scene, id, region): a partition that lowers the cost of the values at their regions' centres plus strength * sum of the weights of cut edges.

    Regions start as single nodes, or as `start` (scene, id, region) has them.  In a round every region finds the neighbour whose merge lowers the energy most (the lowest id of
    a tie), and those that choose each other merge, each once a round; it ends when no merge lowers the energy.  It is the merging half of a
    cut pursuit (`pursuit` has the splits): all scenes at once, and each round is an aggregation and three joins.  The rounds of a scene that has few pairs left are gone
    through in a task, by the same rules.
    edges: (scene, src, dst, weight); values: (scene, id, value array) and, if nodes count differently, weight.
    """
    size = len(values.select("value").first()[0]) if not values.isEmpty() else 0
    node = F.struct("scene", F.col("id").alias("id"))
    first = values.select(node.alias("node"), node.alias("region")) if start is None else start.select(node.alias("node"), F.struct("scene", F.col("region").alias("id")).alias("region"))
    regions = cut(first, "regions")
    weight = F.col("weight") if "weight" in values.columns else F.lit(1.0)
    obs = cut(values.select(node.alias("node"), weight.cast("double").alias("w"), F.transform("value", lambda v: v * weight).alias("total")), "region-values")
    links = edges.select(F.struct("scene", F.col("src").alias("id")).alias("a"), F.struct("scene", F.col("dst").alias("id")).alias("b"), "weight")
    totals = [F.sum("w").alias("w"), F.array(*[F.sum(F.get("total", F.lit(i))) for i in range(size)]).alias("total")]
    if start is None:
        stats = obs.select(F.col("node").alias("region"), "w", "total")
    else:
        stats = obs.join(regions, "node").groupBy("region").agg(*totals)
        a, b = regions.select(F.col("node").alias("a"), F.col("region").alias("ra")), regions.select(F.col("node").alias("b"), F.col("region").alias("rb"))
        links = links.join(a, "a").join(b, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"), "weight")
    links = cut(links.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight").groupBy("a", "b").agg(F.sum("weight").alias("weight")), "region-links")
    stats = cut(stats, "region-stats")
    kinds = {f.name: f.dataType.simpleString() for f in values.schema.fields}

    def finish(key: tuple, of: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        found = _merged_in_task(of, pairs, strength, fidelity)
        found.insert(0, "scene", key[0])
        return found

    while not links.isEmpty():
        few = small(cut(links.groupBy("a.scene").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= FEW_PAIRS).select("scene"), "region-few"))
        if not few.isEmpty():
            at = stats.select("region.scene", "region.id", "w", "total").join(few, "scene", "left_semi")
            pairs = links.select("a.scene", F.col("a.id").alias("a"), F.col("b.id").alias("b"), "weight").join(few, "scene", "left_semi")
            found = cut(at.groupBy("scene").cogroup(pairs.groupBy("scene")).applyInPandas(finish, f"scene {kinds['scene']}, old {kinds['id']}, into {kinds['id']}"), "region-finished")
            to = found.filter("old != into").select(F.struct("scene", F.col("old").alias("id")).alias("region"), F.struct("scene", F.col("into").alias("id")).alias("into"))
            regions = cut(regions.join(to, "region", "left").select("node", F.coalesce("into", "region").alias("region")), "regions")
            links = cut(links.withColumn("scene", F.col("a.scene")).join(few, "scene", "left_anti").drop("scene"), "region-links")
            if links.isEmpty():
                break
        one = stats.select(F.col("region").alias("a"), F.col("w").alias("wa"), F.col("total").alias("ta"))
        two = stats.select(F.col("region").alias("b"), F.col("w").alias("wb"), F.col("total").alias("tb"))
        gain = F.round(strength * F.col("weight") - fidelity.loss(F.col("wa"), F.col("ta"), F.col("wb"), F.col("tb")), 12)
        gains = cut(links.join(one, "a").join(two, "b").select("a", "b", gain.alias("gain")).filter("gain > 0"), "region-gains")
        if gains.isEmpty():
            break
        ways = gains.unionByName(gains.select(F.col("b").alias("a"), F.col("a").alias("b"), "gain"))
        best = ways.groupBy("a").agg(F.min(F.struct((-F.col("gain")).alias("gain"), "b")).alias("best")).select("a", "best.b")
        back = best.select(F.col("a").alias("b"), F.col("b").alias("c"))
        moves = cut(best.join(back, "b").filter((F.col("c") == F.col("a")) & (F.col("b") < F.col("a"))).select(F.col("a").alias("old"), F.col("b").alias("into")), "region-moves")
        to = moves.select(F.col("old").alias("region"), "into")
        regions = cut(regions.join(to, "region", "left").select("node", F.coalesce("into", "region").alias("region")), "regions")
        stats = cut(stats.join(to, "region", "left").select(F.coalesce("into", "region").alias("region"), "w", "total").groupBy("region").agg(*totals), "region-stats")
        a, b = moves.select(F.col("old").alias("a"), F.col("into").alias("to_a")), moves.select(F.col("old").alias("b"), F.col("into").alias("to_b"))
        moved = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b"), "weight").filter("a != b")
        links = cut(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight").groupBy("a", "b").agg(F.sum("weight").alias("weight")), "region-links")
    return regions.select("node.scene", "node.id", F.col("region.id").alias("region"))


def suppressed(boxes: DataFrame, overlaps: DataFrame) -> DataFrame:
    """(id, kept) of greedy suppression: by falling score, a box is kept if no kept one before it overlaps it.

    boxes: (id, score), overlaps: (a, b) in any direction.  In each round all boxes without an undecided better
    neighbour are decided at once; that gives what the walk in order gives.  Equal scores go by id.
    """
    order = boxes.select(F.col("id").alias("a"), F.col("score").alias("sa")), boxes.select(F.col("id").alias("b"), F.col("score").alias("sb"))
    both = overlaps.select("a", "b").unionByName(overlaps.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct()
    better = (F.col("sa") > F.col("sb")) | ((F.col("sa") == F.col("sb")) & (F.col("a") < F.col("b")))
    blocks = cut(both.join(order[0], "a").join(order[1], "b").filter(better).select("a", "b"))
    left, kept = cut(boxes.select("id")), None
    while not left.isEmpty():
        free = cut(left.join(blocks.select(F.col("b").alias("id")), "id", "left_anti"))
        kept = free if kept is None else kept.unionByName(free)
        out = blocks.join(free.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        gone = cut(free.unionByName(out).distinct())
        left = cut(left.join(gone, "id", "left_anti"))
        blocks = cut(blocks.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti"))
    if kept is None:
        return boxes.select("id", F.lit(True).alias("kept")).limit(0)
    return boxes.select("id").join(kept.withColumn("kept", F.lit(True)), "id", "left").select("id", F.coalesce("kept", F.lit(False)).alias("kept"))


def superedges(edges: DataFrame, points: DataFrame, by: str, longest: float = 0.0) -> DataFrame:
    """A row per ordered pair of groups that point edges cross (shorter than `longest`, if it is above 0): their number, mean and spread of
    the offsets, their mean length, and how the groups compare."""
    ends = points.select("scene", "point_idx", by, *"xyz")
    a = ends.select("scene", F.col("point_idx").alias("src"), F.col(by).alias("a"), *[F.col(c).alias(f"a{c}") for c in "xyz"])
    b = ends.select("scene", F.col("point_idx").alias("dst"), F.col(by).alias("b"), *[F.col(c).alias(f"b{c}") for c in "xyz"])
    crossing = edges.select("scene", "src", "dst").join(a, ["scene", "src"]).join(b, ["scene", "dst"]).filter("a != b")
    d = {c: F.col(f"a{c}") - F.col(f"b{c}") for c in "xyz"}
    length = F.sqrt(d["x"] * d["x"] + d["y"] * d["y"] + d["z"] * d["z"])
    if longest > 0:
        crossing = crossing.filter(length < longest)
    stats = crossing.groupBy("scene", "a", "b").agg(
        F.count(F.lit(1)).alias("edges"), *[F.avg(d[c]).alias(f"mean_{c}") for c in "xyz"], *[F.stddev_pop(d[c]).alias(f"std_{c}") for c in "xyz"], F.avg(length).alias("delta_norm")
    )
    return compared(stats, superpoint_features(points, by), by)
