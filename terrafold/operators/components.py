"""Connected components by contraction: hook each node to its smallest neighbour, jump to the roots, merge, until no edge is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.plans import saved, work_dir


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", folder: str | None = None) -> DataFrame:
    """(node, component) of all nodes that have an edge to another node; component is the smallest node of it.

    Nodes are of any type with an order, such as a struct of scene and id.  A node hooks to its smallest neighbour if that is smaller than
    itself, and jumps go on until every node points to the root of its tree, so a path in the order of its ids is
    one tree, found in logarithmically many jumps.  A root alone in its tree has a smaller neighbour after the merge, so every two
    merges halve the nodes at least.  Every step writes its table to the shared folder: no plan grows, and no step is lost
    with an executor.  Null ends and loops are no edges.  folder: where the tables go, a new one by default.
    """
    folder = folder or work_dir(edges.sparkSession, "components")
    left = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u != v")
    left = saved(left.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), f"{folder}/edges-0")
    labels: DataFrame | None = None
    turn = 0
    while not left.isEmpty():
        turn += 1
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hooks = both.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("node"), F.least("u", "least").alias("up"))
        roots = _rooted(saved(hooks, f"{folder}/hooks-{turn}"), f"{folder}/jumps-{turn}")
        labels = roots.withColumnRenamed("up", "component") if labels is None else saved(_moved(labels, roots), f"{folder}/labels-{turn}")
        a, b = roots.select(F.col("node").alias("u"), F.col("up").alias("a")), roots.select(F.col("node").alias("v"), F.col("up").alias("b"))
        left = left.join(a, "u").join(b, "v").filter("a != b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
        left = saved(left, f"{folder}/edges-{turn}")
    if labels is None:
        return left.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return labels


def scene_components(edges: DataFrame) -> DataFrame:
    """(scene, node, component) of edges (scene, src, dst), whose ids are numbers within their scene."""
    ends = edges.select(F.struct("scene", F.col("src").alias("id")).alias("src"), F.struct("scene", F.col("dst").alias("id")).alias("dst"))
    return connected_components(ends).select("node.scene", F.col("node.id").alias("node"), F.col("component.id").alias("component"))


def _rooted(hooks: DataFrame, folder: str) -> DataFrame:
    """(node, up) with `up` the root of the node's tree; every jump halves the way to it."""
    step = 0
    while True:
        step += 1
        further = hooks.select(F.col("node").alias("via"), F.col("up").alias("further"))
        jumped = hooks.join(further, hooks["up"] == further["via"]).select("node", F.col("further").alias("up"), (F.col("up") != F.col("further")).alias("moved"))
        jumped = saved(jumped, f"{folder}-{step}")
        hooks = jumped.select("node", "up")
        if jumped.filter("moved").isEmpty():
            return hooks


def _moved(labels: DataFrame, roots: DataFrame) -> DataFrame:
    to = roots.select(F.col("node").alias("component"), F.col("up").alias("to"))
    return labels.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component"))


def merged_small(nodes: DataFrame, labels: DataFrame, edges: DataFrame, cutoff: int) -> DataFrame:
    """(scene, node, component): each component of fewer than `cutoff` nodes goes to the largest component that an edge leads to.

    nodes: (scene, node); labels: (scene, node, component); edges: (scene, src, dst) between nodes, those that made no component
    included.  All small ones move at once by the sizes before any move, the lowest component of equally large ones wins, and
    a chain of moves leads to its last component.  A small one without such an edge, or that is the larger of its neighbours, stays.
    """
    named = nodes.join(labels, ["scene", "node"], "left").select("scene", "node", F.coalesce("component", "node").alias("component"))
    size = named.groupBy("scene", "component").agg(F.count(F.lit(1)).alias("size"))
    at = named.join(size, ["scene", "component"])
    a = at.select("scene", F.col("node").alias("src"), F.col("component").alias("a"), F.col("size").alias("size_a"))
    b = at.select("scene", F.col("node").alias("dst"), F.col("component").alias("b"), F.col("size").alias("size_b"))
    ways = edges.select("scene", "src", "dst").unionByName(edges.select("scene", F.col("dst").alias("src"), F.col("src").alias("dst")))
    larger = (F.col("size_b") > F.col("size_a")) | ((F.col("size_b") == F.col("size_a")) & (F.col("b") < F.col("a")))
    met = ways.join(a.filter(F.col("size_a") < cutoff), ["scene", "src"]).join(b, ["scene", "dst"]).filter((F.col("a") != F.col("b")) & larger)
    best = met.groupBy("scene", "a").agg(F.max(F.struct("size_b", (-F.col("b")).alias("b"))).alias("to")).select("scene", F.col("a").alias("component"), (-F.col("to.b")).alias("into"))
    folder = work_dir(nodes.sparkSession, "merged-components")
    every = size.select("scene", "component").join(best, ["scene", "component"], "left")
    key = F.struct("scene", F.col("component").alias("id"))
    hooks = saved(every.select(key.alias("node"), F.struct("scene", F.coalesce("into", "component").alias("id")).alias("up")), f"{folder}/hooks")
    to = _rooted(hooks, f"{folder}/jumps").select(F.col("node.scene").alias("scene"), F.col("node.id").alias("component"), F.col("up.id").alias("into"))
    return named.join(to, ["scene", "component"]).select("scene", "node", F.col("into").alias("component"))
