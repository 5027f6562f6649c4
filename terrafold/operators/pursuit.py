"""Partitions of a graph's nodes by energy, by alternate splits and merges of regions, all regions and scenes at once.

The energy is what the nodes cost at their regions' centres (`fidelity`) plus strength times the weights of the edges between regions.  A region is split by the best labelling
of its nodes with one of two centres: these start from the two values that lie far apart and some rounds of two means, then centres and labelling follow each other, the labelling
being a minimum cut (`mincut`).  Regions of at most WHOLE nodes are split in a task each, larger ones by joins and the cut of all their blocks, by the same rules.  What hangs together on either side becomes a region, if that lowers the energy.  Then regions are merged as long as a merge lowers the
energy (`cluster.merged_regions`).  Regions that neither changed are left alone from then on; it ends when no region is left or after so many rounds.  So the energy never rises.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.plans import cut, small
from .cluster import merged_regions
from .components import merged_small, scene_components
from .fidelity import SQUARED, Fidelity, best_label, second_label
from .mincut import BLOCK, cut_sides, minimum_cut

MEANS, FLOWS, ROUNDS = 3, 2, 10
LEAST_GAIN = 1e-9
#: A region of at most so many nodes is split in a task, unless a size of blocks is given.
WHOLE = 1 << 16


def linked(edges: DataFrame) -> DataFrame:
    """(scene, src, dst, weight): a row per pair with an edge of either direction, src < dst, the weights added up."""
    pairs = edges.filter("src != dst").select("scene", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight")
    return pairs.groupBy("scene", "src", "dst").agg(F.sum("weight").alias("weight"))


def weighed(values: DataFrame) -> DataFrame:
    """(scene, id, weight, value); nodes without a column of weights weigh 1."""
    weight = F.col("weight").cast("double") if "weight" in values.columns else F.lit(1.0)
    return values.select("scene", "id", weight.alias("weight"), F.col("value").cast("array<double>").alias("value"))


def _totals(nodes: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    total = F.array(*[F.sum(F.col("weight") * F.get("value", F.lit(i))) for i in range(size)])
    return nodes.groupBy(*keys).agg(F.sum("weight").alias("w"), total.alias("t"))


def _width(values: DataFrame) -> int:
    row = values.select(F.size("value").alias("size")).first()
    return row["size"] if row else 0


def node_costs(nodes: DataFrame, size: int, fidelity: Fidelity) -> DataFrame:
    """nodes (scene, region, id, weight, value) with what each costs at its region's centre."""
    centres = _totals(nodes, ["scene", "region"], size).select("scene", "region", fidelity.centre(F.col("w"), F.col("t")).alias("centre"))
    return nodes.join(centres, ["scene", "region"]).withColumn("cost", fidelity.cost(F.col("weight"), F.col("value"), F.col("centre")))


def energies(edges: DataFrame, values: DataFrame, regions: DataFrame, strength: float, fidelity: Fidelity = SQUARED) -> DataFrame:
    """(scene, fit, cut, energy) of a partition; cut is strength times the weights between regions."""
    nodes = weighed(values).join(regions, ["scene", "id"])
    fit = node_costs(nodes, _width(values), fidelity).groupBy("scene").agg(F.sum("cost").alias("fit"))
    border = _across(linked(edges), regions).groupBy("scene").agg((strength * F.sum("weight")).alias("cut"))
    return fit.join(border, "scene", "left").select("scene", "fit", F.coalesce("cut", F.lit(0.0)).alias("cut"), (F.col("fit") + F.coalesce("cut", F.lit(0.0))).alias("energy"))


def _ends(links: DataFrame, regions: DataFrame) -> DataFrame:
    a = regions.select("scene", F.col("id").alias("src"), F.col("region").alias("a"))
    b = regions.select("scene", F.col("id").alias("dst"), F.col("region").alias("b"))
    return links.join(a, ["scene", "src"]).join(b, ["scene", "dst"])


def _across(links: DataFrame, regions: DataFrame) -> DataFrame:
    return _ends(links, regions).filter("a != b")


def _two_means(nodes: DataFrame, size: int, fidelity: Fidelity) -> DataFrame:
    """nodes with `side`, 0 or 1, from the values that lie far apart and a few rounds of two means."""
    key = ["scene", "region"]
    weight, value = F.col("weight"), F.col("value")
    if fidelity.corners:
        centres = _totals(nodes, key, size).select(*key, best_label(F.col("t")).alias("c0"), second_label(F.col("t")).alias("c1"))
        return _sided(nodes.join(centres, key), fidelity)
    far = lambda cost: F.max_by("value", F.struct(cost.alias("cost"), (-F.col("id")).alias("id")))
    first = node_costs(nodes, size, fidelity).groupBy(*key).agg(far(F.col("cost")).alias("c0"))
    second = nodes.join(first, key).groupBy(*key).agg(F.first("c0").alias("c0"), far(fidelity.cost(weight, value, F.col("c0"))).alias("c1"))
    sided = _sided(nodes.join(second, key), fidelity)
    for _ in range(MEANS):
        sided = cut(sided, "two-means")
        sided = _sided(nodes.join(_centres(sided, size, fidelity), key), fidelity)
    return sided


def _sided(nodes: DataFrame, fidelity: Fidelity) -> DataFrame:
    cost = [fidelity.cost(F.col("weight"), F.col("value"), F.col(c)) for c in ("c0", "c1")]
    return nodes.withColumn("side", (cost[1] < cost[0]).cast("int")).select("scene", "region", "id", "weight", "value", "side", "c0", "c1")


def _centres(sided: DataFrame, size: int, fidelity: Fidelity) -> DataFrame:
    """(scene, region, c0, c1) of regions that have nodes on both sides; corners stay as they are."""
    if fidelity.corners:
        return sided.groupBy("scene", "region").agg(F.first("c0").alias("c0"), F.first("c1").alias("c1"))
    found = _totals(sided, ["scene", "region", "side"], size).select("scene", "region", "side", fidelity.centre(F.col("w"), F.col("t")).alias("c"))
    both = found.groupBy("scene", "region").agg(*[F.first(F.when(F.col("side") == s, F.col("c")), ignorenulls=True).alias(f"c{s}") for s in (0, 1)])
    return both.filter("c0 is not null and c1 is not null")


def split_regions(links: DataFrame, values: DataFrame, regions: DataFrame, strength: float, fidelity: Fidelity = SQUARED, flows: int = FLOWS, decay: float = 1.0, block: int | None = None) -> DataFrame:
    """(scene, id, region, part): the regions (scene, id, region) with the part of its region that each node would be in after a split; equal to region where that lowers no energy.

    decay: the fidelity counts decay^(step - flows) in each of the `flows` steps, so that early cuts follow it more if decay is below 1.
    """
    key = ["scene", "region"]
    nodes = cut(values.join(regions, ["scene", "id"]).select("scene", "region", "id", "weight", "value"), "split-nodes")
    inner = cut(_ends(links, regions).filter("a = b").select("scene", "src", "dst", "weight", F.col("a").alias("region")), "split-links")
    counts = cut(nodes.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), "split-counts")
    few, many = small(counts.filter(f"n between 2 and {block or WHOLE}").select(*key)), small(counts.filter(F.col("n") > (block or WHOLE)).select(*key))
    here, between = nodes.join(few, key, "left_semi"), inner.join(few, key, "left_semi")
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema.fields}
    work = lambda k, a, b: _split_in_task(a, b, strength, fidelity, flows, decay)
    found = here.groupBy(*key).cogroup(between.groupBy(*key)).applyInPandas(work, f"scene {kinds['scene']}, id {kinds['id']}, region {kinds['region']}, part {kinds['id']}")
    if not many.isEmpty():
        found = found.unionByName(_split_large(nodes.join(many, key, "left_semi"), inner.join(many, key, "left_semi"), strength, fidelity, flows, decay, block or BLOCK))
    parts = found.select("scene", "id", "part")
    return nodes.join(parts, ["scene", "id"], "left").select("scene", "id", "region", F.coalesce("part", "region").alias("part"))


def _split_in_task(nodes: pd.DataFrame, links: pd.DataFrame, strength: float, fidelity: Fidelity, flows: int, decay: float) -> pd.DataFrame:
    """split_regions of one region that fits into a task."""
    nodes = nodes.sort_values("id")
    ids, w, y = nodes["id"].to_numpy(), nodes["weight"].to_numpy(float), np.array(nodes["value"].tolist(), float)
    ends = np.stack([np.searchsorted(ids, links[c].to_numpy()) for c in ("src", "dst")], axis=1)
    lengths = strength * links["weight"].to_numpy(float)
    centre = lambda rows: fidelity.best(float(w[rows].sum()), (w[rows, None] * y[rows]).sum(axis=0))
    whole = np.ones(len(ids), bool)
    before = fidelity.costs(w, y, centre(whole))
    if fidelity.corners:
        total = (w[:, None] * y).sum(axis=0)
        first = int(total.argmax())
        second = int(np.where(np.arange(len(total)) == first, -np.inf, total).argmax())
        c = [np.eye(len(total))[i] for i in (first, second)]
    else:
        c = [y[int(before.argmax())]]
        c.append(y[int(fidelity.costs(w, y, c[0]).argmax())])
    sided = lambda: fidelity.costs(w, y, c[1]) < fidelity.costs(w, y, c[0])
    side = sided()
    for step in range(-MEANS, (1 if fidelity.corners else flows)):
        if not fidelity.corners:
            if side.all() or not side.any():
                break
            c = [centre(~side), centre(side)]
        if step < 0:
            side = sided()
        else:
            lean = (fidelity.costs(w, y, c[0]) - fidelity.costs(w, y, c[1])) * float(decay) ** (step + 1 - flows)
            side = cut_sides(lean, ends, lengths)
    part = np.arange(len(ids))  # the lowest place of what hangs together on a side
    inside = ends[side[ends[:, 0]] == side[ends[:, 1]]]
    while True:
        low = part.copy()
        np.minimum.at(low, inside[:, 0], part[inside[:, 1]])
        np.minimum.at(low, inside[:, 1], part[inside[:, 0]])
        low = low[low]
        if (low == part).all():
            break
        part = low
    order = np.argsort(part, kind="stable")
    rows = np.split(order, np.flatnonzero(np.diff(part[order])) + 1)
    after = sum(float(fidelity.costs(w[r], y[r], centre(r)).sum()) for r in rows) + float(lengths[part[ends[:, 0]] != part[ends[:, 1]]].sum())
    better = after < before.sum() - LEAST_GAIN * (1 + abs(before.sum()))
    return pd.DataFrame({"scene": nodes["scene"].to_numpy(), "id": ids, "region": nodes["region"].to_numpy(), "part": ids[part] if better else nodes["region"].to_numpy()})


def _split_large(nodes: DataFrame, inner: DataFrame, strength: float, fidelity: Fidelity, flows: int, decay: float, block: int) -> DataFrame:
    """split_regions of regions of any size, all at once: aggregations, joins and one minimum cut over all of them per step."""
    size, key = _width(nodes), ["scene", "region"]
    sided = cut(_two_means(nodes, size, fidelity), "split-sides")
    weight, value = F.col("weight"), F.col("value")
    for step in range(1, (1 if fidelity.corners else flows) + 1):
        placed = cut(nodes.join(_centres(sided, size, fidelity), key), "split-centres")
        if placed.isEmpty():
            break
        lean = (fidelity.cost(weight, value, F.col("c0")) - fidelity.cost(weight, value, F.col("c1"))) * float(decay) ** (step - flows)
        sides = minimum_cut(placed.select("scene", "id", lean.alias("lean")), inner.select("scene", "src", "dst", (strength * F.col("weight")).alias("capacity")), block)
        sided = cut(placed.join(sides, ["scene", "id"]).withColumn("side", F.col("far").cast("int")).drop("far"), "split-sides")
    at = lambda end: sided.select("scene", F.col("id").alias(end), F.col("side").alias(f"{end}_side"))
    whole = inner.join(at("src"), ["scene", "src"]).join(at("dst"), ["scene", "dst"]).filter("src_side = dst_side")
    found = scene_components(whole.select("scene", "src", "dst")).select("scene", F.col("node").alias("id"), "component")
    parts = nodes.join(sided.select("scene", "id", "side"), ["scene", "id"], "left").join(found, ["scene", "id"], "left")
    parts = cut(parts.select("scene", "region", "id", "weight", "value", F.when(F.col("side").isNull(), F.col("region")).otherwise(F.coalesce("component", "id")).alias("part")), "split-parts")
    before = node_costs(nodes, size, fidelity).groupBy(*key).agg(F.sum("cost").alias("before"))
    cost = node_costs(parts.withColumnsRenamed({"region": "of", "part": "region"}), size, fidelity).groupBy("scene", F.col("of").alias("region")).agg(F.sum("cost").alias("cost"))
    border = _across(inner, parts.select("scene", "id", F.col("part").alias("region"))).groupBy(*key).agg((strength * F.sum("weight")).alias("border"))
    better = before.join(cost, key).join(border, key, "left").filter(F.col("cost") + F.coalesce("border", F.lit(0.0)) < F.col("before") - LEAST_GAIN * (1 + F.abs("before"))).select(*key)
    better = small(cut(better.withColumn("better", F.lit(True)), "split-better"))
    return parts.join(better, key, "left").select("scene", "id", "region", F.when(F.col("better"), F.col("part")).otherwise(F.col("region")).alias("part"))


def cut_pursuit(
    edges: DataFrame, values: DataFrame, strength: float, fidelity: Fidelity = SQUARED, rounds: int = ROUNDS, flows: int = FLOWS, decay: float = 1.0, smallest: int = 0, block: int | None = None
) -> DataFrame:
    """(scene, id, region): a partition of low energy; region is the lowest id in it.

    edges: (scene, src, dst, weight), taken both ways; values: (scene, id, value array) and, if nodes count differently, weight.  It starts from what hangs together.
    smallest: regions of fewer nodes go to the largest region that an edge leads to at the end, whatever that costs.  block: the most nodes of a region that is split in a task, and those of a minimum cut's blocks.
    """
    links, obs = cut(linked(edges), "pursuit-links"), cut(weighed(values), "pursuit-values")
    start = scene_components(links.select("scene", "src", "dst")).select("scene", F.col("node").alias("id"), "component")
    regions = cut(obs.select("scene", "id").join(start, ["scene", "id"], "left").select("scene", "id", F.coalesce("component", "id").alias("region")), "pursuit-regions")
    left = regions
    for _ in range(rounds):
        parts = cut(split_regions(links, obs.join(left, ["scene", "id"], "left_semi"), left, strength, fidelity, flows, decay, block), "pursuit-parts")
        split = parts.select("scene", "id", "part")
        after = cut(regions.join(split, ["scene", "id"], "left").select("scene", "id", F.coalesce("part", "region").alias("region")), "pursuit-split")
        merged = cut(merged_regions(links, obs, strength, fidelity, after), "pursuit-merged")
        left = _changed(regions, merged)
        regions = merged
        if left.isEmpty():
            break
    if smallest > 1:
        found = merged_small(obs.select("scene", F.col("id").alias("node")), regions.select("scene", F.col("id").alias("node"), F.col("region").alias("component")), links, smallest)
        regions = found.select("scene", F.col("node").alias("id"), F.col("component").alias("region"))
    return regions


def _changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """The rows of `after` in regions that aren't also regions of `before`."""
    count = before.groupBy("scene", F.col("region").alias("old")).agg(F.count(F.lit(1)).alias("nodes"))
    met = after.join(before.withColumnRenamed("region", "old"), ["scene", "id"])
    same = met.groupBy("scene", "region").agg(F.min("old").alias("old"), F.max("old").alias("last"), F.count(F.lit(1)).alias("now")).join(count, ["scene", "old"])
    same = same.filter("old = last and now = nodes").select("scene", "region")
    return cut(after.join(small(cut(same, "pursuit-same")), ["scene", "region"], "left_anti").select("scene", "id", "region"), "pursuit-left")

