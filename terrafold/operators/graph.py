"""Operators on directed edges (scene, src, dst, ...) and nodes (scene, id, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.plans import attach, cut

UNLABELLED = -100


def with_ends(edges: DataFrame, nodes: DataFrame, value: str) -> DataFrame:
    """Adds the nodes' value at both ends, as src_value and dst_value."""
    a = nodes.select("scene", F.col("id").alias("src"), F.col(value).alias(f"src_{value}"))
    b = nodes.select("scene", F.col("id").alias("dst"), F.col(value).alias(f"dst_{value}"))
    return edges.join(a, ["scene", "src"]).join(b, ["scene", "dst"])


def same_instance(a: Column, b: Column) -> Column:
    """0 if an end has no label, -1 within an instance, 1 between two."""
    return F.when((a == UNLABELLED) | (b == UNLABELLED), 0).when(a == b, -1).otherwise(1)


def closeness(edges: DataFrame, strength: float = 1.0) -> DataFrame:
    """edges with weight: 1 / (strength + dist / mean dist of the scene)."""
    mean = edges.groupBy("scene").agg(F.avg("dist").alias("__mean"))
    return attach(edges, mean, ["scene"]).select(*edges.columns, (1 / (strength + F.col("dist") / F.col("__mean"))).alias("weight"))


def standardised(rows: DataFrame, values: list[str]) -> DataFrame:
    """rows with z_value of each value: less its scene's mean, over its deviation, or over 1 without any."""
    spread = rows.groupBy("scene").agg(*[f(v).alias(f"__{n}{v}") for v in values for n, f in (("mean", F.avg), ("sd", F.stddev_pop))])
    z = [((F.col(v) - F.col(f"__mean{v}")) / F.when(F.col(f"__sd{v}") > 0, F.col(f"__sd{v}")).otherwise(1.0)).alias(f"z_{v}") for v in values]
    return attach(rows, spread, ["scene"]).select(*rows.columns, *z)


def pooled_offsets(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(scene, id, prior, ox, oy, oz): from each member's centre to the point-weighted centre of all members of its prior.

    members: (scene, id, prior); nodes: (scene, id, x, y, z, n).
    """
    rows = members.join(nodes.select("scene", "id", *"xyz", "n"), ["scene", "id"])
    centre = rows.groupBy("scene", "prior").agg(*[(F.sum(F.col(v) * F.col("n")) / F.sum("n")).alias(f"c{v}") for v in "xyz"])
    return rows.join(centre, ["scene", "prior"]).select("scene", "id", "prior", *[(F.col(f"c{v}") - F.col(v)).alias(f"o{v}") for v in "xyz"])


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges with both ends among the nodes."""
    a, b = nodes.select("scene", F.col("id").alias("src")), nodes.select("scene", F.col("id").alias("dst"))
    return edges.join(a, ["scene", "src"], "left_semi").join(b, ["scene", "dst"], "left_semi")


def in_degree(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(scene, id, degree) of all nodes, also of those without an edge."""
    degree = edges.groupBy("scene", F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("scene", "id").join(degree, ["scene", "id"], "left").select("scene", "id", F.coalesce("degree", F.lit(0)).alias("degree"))


def neighbour_mean(edges: DataFrame, nodes: DataFrame, value: str, weight: Column) -> DataFrame:
    """(scene, id, mean): the mean of weight times the value at the source over the edges into a node; 0 without any."""
    there = nodes.select("scene", F.col("id").alias("src"), F.col(value).alias("__value"))
    mean = edges.withColumn("__weight", weight).join(there, ["scene", "src"]).groupBy("scene", F.col("dst").alias("id")).agg(F.avg(F.col("__weight") * F.col("__value")).alias("mean"))
    return nodes.select("scene", "id").join(mean, ["scene", "id"], "left").select("scene", "id", F.coalesce("mean", F.lit(0.0)).alias("mean"))


def attention(edges: DataFrame, nodes: DataFrame, score: Column, value: str) -> DataFrame:
    """(scene, id, attended): per source, the values at the ends of its edges weighted by the softmax of the scores.

    The largest score is subtracted first; both sums are combined before the shuffle.
    """
    scored = edges.withColumn("__score", score)
    top = scored.groupBy("scene", "src").agg(F.max("__score").alias("__top"))
    there = nodes.select("scene", F.col("id").alias("dst"), F.col(value).alias("__value"))
    e = F.exp(F.col("__score") - F.col("__top"))
    sums = scored.join(top, ["scene", "src"]).join(there, ["scene", "dst"]).groupBy("scene", "src").agg(F.sum(e * F.col("__value")).alias("a"), F.sum(e).alias("b"))
    return sums.select("scene", F.col("src").alias("id"), (F.col("a") / F.col("b")).alias("attended"))


def running_sum(df: DataFrame, group: str, order: str, value: str, block: int = 1024) -> DataFrame:
    """Adds `upto`, the sum of the value up to and with each row of its group in the order of a whole number.

    Blocks of the order are summed first, so that no task sorts a whole group.
    """
    rows = df.withColumn("__block", F.floor(F.col(order) / block))
    sums = rows.groupBy(group, "__block").agg(F.sum(value).alias("__sum"))
    before = sums.select(group, "__block", (F.sum("__sum").over(W.partitionBy(group).orderBy("__block")) - F.col("__sum")).alias("__before"))
    within = F.sum(value).over(W.partitionBy(group, "__block").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return rows.join(before, [group, "__block"]).withColumn("upto", F.col("__before") + within).drop("__block", "__before")


def propagated(edges: DataFrame, seeds: DataFrame, weight: str, hops: int) -> DataFrame:
    """(scene, seed, id, score): the row-normalised weights to the power `hops`, of the seeds' rows only."""
    total = edges.groupBy("scene", "src").agg(F.sum(weight).alias("__total"))
    step = edges.join(total, ["scene", "src"]).select("scene", "src", "dst", (F.col(weight) / F.col("__total")).alias("w"))
    reach = seeds.select("scene", F.col("id").alias("seed"), F.col("id"), F.lit(1.0).alias("score"))
    for _ in range(hops):
        reach = reach.join(step, (reach["scene"] == step["scene"]) & (reach["id"] == step["src"])).groupBy(reach["scene"], "seed", F.col("dst").alias("id")).agg(F.sum(F.col("score") * F.col("w")).alias("score"))
    return reach


def propagated_labels(edges: DataFrame, nodes: DataFrame, hops: int, least: float = 0.7) -> DataFrame:
    """(scene, id, seed, score): for unlabelled nodes, the labelled node of the highest weight after `hops` steps, the lowest of a tie.

    nodes: (scene, id, label, pred, prob), label UNLABELLED where unknown; edges: (scene, src, dst, affinity).  A step goes between nodes that are both predicted
    as one class with more than `least`; as a node is predicted as one class only, all classes go at once.
    Affinities are normalised by row, seeds are the nodes whose label is their predicted class.
    """
    sure = nodes.filter(F.col("prob") > least).select("scene", "id", "pred", "label")
    a, b = sure.select("scene", F.col("id").alias("src"), F.col("pred").alias("__a")), sure.select("scene", F.col("id").alias("dst"), F.col("pred").alias("__b"))
    steps = cut(edges.filter("src != dst and affinity > 0").join(a, ["scene", "src"]).join(b, ["scene", "dst"]).filter("__a = __b").select("scene", "src", "dst", "affinity"), "steps")
    seeds = sure.filter("label = pred")
    reach = propagated(steps, seeds, "affinity", hops).withColumn("score", F.round("score", 9)).filter("score > 0")
    best = reach.groupBy("scene", "id").agg(F.max(F.struct("score", (-F.col("seed")).alias("seed"))).alias("best"))
    open_ = nodes.filter(F.col("label") == UNLABELLED).select("scene", "id")
    return best.join(open_, ["scene", "id"]).select("scene", "id", (-F.col("best.seed")).alias("seed"), F.col("best.score").alias("score"))


def extended(edges: DataFrame, nodes: DataFrame, least: float | None = None) -> DataFrame:
    """(scene, id, source, label): unlabelled nodes next to labelled ones, along edges of either direction, that are predicted as the
    neighbour's label (with more than `least`, if given); the neighbour of the highest id counts.  nodes as for propagated_labels."""
    ways = edges.select("scene", "src", "dst").unionByName(edges.select("scene", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    given = nodes.filter(F.col("label") != UNLABELLED).select("scene", F.col("id").alias("src"), F.col("label").alias("given"))
    free = nodes.filter(F.col("label") == UNLABELLED)
    free = (free if least is None else free.filter(F.col("prob") > least)).select("scene", F.col("id").alias("dst"), "pred")
    met = ways.join(given, ["scene", "src"]).join(free, ["scene", "dst"]).filter("given = pred")
    return met.groupBy("scene", F.col("dst").alias("id")).agg(F.max("src").alias("source"), F.max_by("given", "src").alias("label"))


def moved_offsets(taken: DataFrame, offsets: DataFrame) -> DataFrame:
    """(scene, id, ox, oy, oz): from the centre of a node to the instance centre of the one it took its label from.

    taken: (scene, id, source); offsets: (scene, id, x, y, z, ox, oy, oz), a node's centre and its offset to its instance's centre.
    """
    there = offsets.select("scene", F.col("id").alias("source"), *[(F.col(a) + F.col(f"o{a}")).alias(f"c{a}") for a in "xyz"])
    return taken.select("scene", "id", "source").join(there, ["scene", "source"]).join(offsets.select("scene", "id", *"xyz"), ["scene", "id"]).select("scene", "id", *[(F.col(f"c{a}") - F.col(a)).alias(f"o{a}") for a in "xyz"])


def cliques(members: DataFrame) -> DataFrame:
    """(scene, row, col, weight): nodes and their groups linked both ways and each with itself, the weights of a column summing to 1.

    members: (scene, group, node); a group is the number -1 - group among the nodes.
    """
    root = (-1 - F.col("group")).alias("root")
    pairs = members.select("scene", "node", root).distinct()
    ends = pairs.select("scene", F.col("node").alias("at")).unionByName(pairs.select("scene", F.col("root").alias("at"))).distinct()
    links = pairs.select("scene", F.col("node").alias("row"), F.col("root").alias("col")).unionByName(pairs.select("scene", F.col("root").alias("row"), F.col("node").alias("col")))
    links = links.unionByName(ends.select("scene", F.col("at").alias("row"), F.col("at").alias("col")))
    sums = links.groupBy("scene", "col").agg(F.count(F.lit(1)).alias("n"))
    return links.join(sums, ["scene", "col"]).select("scene", "row", "col", (1 / F.col("n")).alias("weight"))


def random_subgraph(edges: DataFrame, nodes: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """(scene, id, hops): a sample of `size` nodes per scene (all of a smaller one), breadth first from the node of the smallest hash.

    Of the layer that leads past the size, the nodes of the smallest hashes are taken.  A scene whose search ends before goes on from
    its unseen node of the smallest hash, with hops from 0; that node is always among the scene's first `size`.
    """
    hashed = F.xxhash64("id", F.lit(seed)).alias("h")
    order = W.partitionBy("scene").orderBy("h", "id")
    seeds = cut(nodes.select("scene", "id", hashed).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= size), "seeds")
    layer = cut(seeds.filter("place = 1").select("scene", "id", F.lit(0).alias("hops")), "layer")
    taken = layer
    while not layer.isEmpty():
        room = taken.groupBy("scene").agg((F.lit(size) - F.count(F.lit(1))).alias("room"))
        reached = layer.select("scene", F.col("id").alias("src"), (F.col("hops") + 1).alias("hops")).join(edges.select("scene", "src", F.col("dst").alias("id")), ["scene", "src"]).groupBy("scene", "id").agg(F.min("hops").alias("hops"))
        fresh = reached.join(taken.select("scene", "id"), ["scene", "id"], "left_anti").join(room.filter("room > 0"), "scene").withColumn("h", F.xxhash64("id", F.lit(seed)))
        grown = cut(fresh.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= F.col("room")).select("scene", "id", "hops"), "grown")
        unseen = seeds.join(taken.select("scene", "id"), ["scene", "id"], "left_anti").join(room.filter("room > 0").select("scene"), "scene", "left_semi").join(grown.select("scene"), "scene", "left_anti")
        again = unseen.groupBy("scene").agg(F.min_by("id", "place").alias("id")).select("scene", "id", F.lit(0).alias("hops"))
        layer = cut(grown.unionByName(again), "layer")
        taken = cut(taken.unionByName(layer), "taken")
    return taken
