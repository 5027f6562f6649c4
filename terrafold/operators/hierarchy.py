"""Average-linkage trees over a graph of distances, their cuts from the top, and proposals of points.

The distance of two clusters is the mean of the distances between their leaves, each pair counted as often as the leaves' points have pairs: sums and
weights of pairs add up when clusters merge, so that a merge is an aggregation.  In a round all clusters merge that are each other's nearest: for average linkage over
all pairs that gives the tree of the loop that merges the nearest two at a time, because a merge brings no cluster nearer to a third.  With fewer pairs, such as those of near neighbours,
clusters without a pair between them stay apart until one comes up, and the rounds define the tree.
Scenes don't meet, so the rounds of a scene that has few pairs left are gone through in a task, by the same rules; late rounds merge few clusters each, and there are many of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.plans import cut, dropped, saved, small, work_dir
from .order import running
from .vectors import inner_product

LEAST_POINTS = 50
#: A scene with at most so many pairs left is merged in a task.
FEW_PAIRS = 1 << 16


def _merged_in_task(clusters: pd.DataFrame, links: pd.DataFrame, step: int) -> pd.DataFrame:
    """The merges of one scene after the round `step`, round by round: (step, into, old, height, last0, last1, count, score)."""
    clusters = clusters.sort_values("id")
    ids, count, last = clusters["id"].to_numpy(), clusters["count"].to_numpy(np.int64).copy(), clusters["last"].to_numpy(np.int64).copy()
    total = None if clusters["total"].isna().any() else np.array(clusters["total"].tolist(), float)
    a, b = (np.searchsorted(ids, links[c].to_numpy()) for c in "ab")
    w, s, out = links["w"].to_numpy(float), links["s"].to_numpy(float), []
    while len(a):
        step += 1
        u, v, far = np.concatenate([a, b]), np.concatenate([b, a]), np.tile(np.round(s / w, 12), 2)
        order = np.lexsort((v, far, u))
        first = order[np.flatnonzero(np.diff(u[order], prepend=-1))]
        best = np.full(len(ids), -1)
        best[u[first]] = v[first]
        met = first[(best[v[first]] == u[first]) & (u[first] < v[first])]
        into, old = u[met], v[met]
        score = None if total is None else ((total[into] / count[into, None]) * (total[old] / count[old, None])).sum(axis=1)
        out.append(pd.DataFrame({"step": step, "into": ids[into], "old": ids[old], "height": far[met], "last0": last[into], "last1": last[old], "count": count[into] + count[old], "score": score}))
        count[into] += count[old]
        last[into] = step
        if total is not None:
            total[into] += total[old]
        to = np.arange(len(ids))
        to[old] = into
        a, b = to[a], to[b]
        apart = a != b
        pairs, at = np.unique(np.minimum(a, b)[apart] * len(ids) + np.maximum(a, b)[apart], return_inverse=True)
        w, s = (np.bincount(at, x[apart], len(pairs)) for x in (w, s))
        a, b = pairs // len(ids), pairs % len(ids)
    return pd.concat(out) if out else pd.DataFrame(columns=["step", "into", "old", "height", "last0", "last1", "count", "score"])


def merge_tree(pairs: DataFrame, leaves: DataFrame) -> DataFrame:
    """(scene, node, left, right, height, count, score), a row per merge.

    pairs: (scene, a, b, dist), each once or in both directions (then with equal distances); leaves: (scene, id, count) and, if wanted, soft, an array.  node numbers go on after the scene's largest id by rising height; left has
    the lower lowest leaf.  score is the inner product of both sides' mean soft labels, null without any.  Distances count to 12 digits, ties go by the lowest leaf.
    """
    spark = leaves.sparkSession
    folder = work_dir(spark, "tree")
    width = 0
    if "soft" in leaves.columns:
        row = leaves.select(F.size("soft").alias("n")).first()
        width = row["n"] if row else 0
    total = F.transform("soft", lambda s: s * F.col("count")) if width else F.lit(None).cast("array<double>")
    clusters = saved(leaves.select("scene", F.col("id").cast("long").alias("id"), F.col("count").cast("long").alias("count"), total.alias("total"), F.lit(0).alias("last")), f"{folder}/clusters-0")
    once = pairs.filter("a != b").select("scene", F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b"), "dist").groupBy("scene", "a", "b").agg(F.min("dist").alias("dist"))
    counts = [clusters.select("scene", F.col("id").alias(e), F.col("count").alias(f"n{e}")) for e in "ab"]
    links = once.join(counts[0], ["scene", "a"]).join(counts[1], ["scene", "b"]).select("scene", "a", "b", (F.col("na") * F.col("nb")).cast("double").alias("w"), (F.col("dist") * F.col("na") * F.col("nb")).alias("s"))
    links, merges, step = saved(links, f"{folder}/links-0"), None, 0
    kind = leaves.schema["scene"].dataType.simpleString()
    rows = f"scene {kind}, step int, into long, old long, height double, last0 int, last1 int, count long, score double"

    def finish(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = _merged_in_task(a, b, int(b["step"].iloc[0])) if len(b) else _merged_in_task(a, pd.DataFrame(columns=["a", "b", "w", "s"]), 0)
        found.insert(0, "scene", key[0])
        return found

    while not links.isEmpty():
        few = small(saved(links.groupBy("scene").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= FEW_PAIRS).select("scene"), f"{folder}/few-{step}"))
        if not few.isEmpty():
            pairs_left = links.join(few, "scene", "left_semi").withColumn("step", F.lit(step))
            met = clusters.join(few, "scene", "left_semi").groupBy("scene").cogroup(pairs_left.groupBy("scene")).applyInPandas(finish, rows)
            met = saved(met, f"{folder}/finished-{step}")
            merges = met if merges is None else merges.unionByName(met)
            links = saved(links.join(few, "scene", "left_anti"), f"{folder}/links-left-{step}")
            if links.isEmpty():
                break
        step += 1
        far = F.round(F.col("s") / F.col("w"), 12).alias("far")
        ways = links.select("scene", F.col("a").alias("id"), F.col("b").alias("other"), far).unionByName(links.select("scene", F.col("b").alias("id"), F.col("a").alias("other"), far))
        best = ways.groupBy("scene", "id").agg(F.min(F.struct("far", "other")).alias("best")).select("scene", "id", F.col("best.far").alias("height"), F.col("best.other").alias("other"))
        back = best.select("scene", F.col("id").alias("other"), F.col("other").alias("again"))
        mutual = best.join(back, ["scene", "other"]).filter((F.col("again") == F.col("id")) & (F.col("id") < F.col("other"))).select("scene", F.col("id").alias("into"), F.col("other").alias("old"), "height")
        side = lambda end, n: clusters.select("scene", F.col("id").alias(end), F.col("count").alias(f"count{n}"), F.col("total").alias(f"total{n}"), F.col("last").alias(f"last{n}"))
        met = mutual.join(side("into", 0), ["scene", "into"]).join(side("old", 1), ["scene", "old"])
        mean = [_over(f"total{n}", f"count{n}") for n in (0, 1)]
        met = met.select(
            "scene", F.lit(step).alias("step"), "into", "old", "height", "last0", "last1", (F.col("count0") + F.col("count1")).alias("count"),
            inner_product(*mean).alias("score"), F.zip_with("total0", "total1", lambda x, y: x + y).alias("total"),
        )
        met = saved(met, f"{folder}/merges-{step}")
        merges = met.drop("total") if merges is None else merges.unionByName(met.drop("total"))
        gone = met.select("scene", F.col("old").alias("id"), "into")
        grown = met.select("scene", F.col("into").alias("id"), F.col("count").alias("new_count"), F.col("total").alias("new_total"), F.col("step").alias("new_last"))
        left = clusters.join(gone, ["scene", "id"], "left_anti").join(grown, ["scene", "id"], "left")
        clusters = saved(left.select("scene", "id", *[F.coalesce(f"new_{c}", c).alias(c) for c in ("count", "total", "last")]), f"{folder}/clusters-{step}")
        to = [gone.select("scene", F.col("id").alias(e), F.col("into").alias(f"to_{e}")) for e in "ab"]
        moved = links.join(to[0], ["scene", "a"], "left").join(to[1], ["scene", "b"], "left").select("scene", F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b"), "w", "s").filter("a != b")
        links = saved(moved.groupBy("scene", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("w").alias("w"), F.sum("s").alias("s")), f"{folder}/links-{step}")
    if merges is None:
        return leaves.limit(0).select("scene", *[F.lit(0).cast("long").alias(c) for c in ("node", "left", "right")], F.lit(0.0).alias("height"), F.lit(0).cast("long").alias("count"), F.lit(0.0).alias("score"))
    top = leaves.groupBy("scene").agg(F.max("id").alias("largest"))
    numbered = cut(running(merges, ["scene"], ["height", "step", "into"], []).join(top, "scene").withColumn("node", F.col("largest") + F.col("place")), "tree-nodes")
    name = lambda leaf, last, out: numbered.select("scene", F.col("into").alias(leaf), F.col("step").alias(last), F.col("node").alias(out))
    named = numbered.join(name("into", "last0", "l"), ["scene", "into", "last0"], "left").join(name("old", "last1", "r"), ["scene", "old", "last1"], "left")
    result = cut(named.select("scene", "node", F.coalesce("l", "into").alias("left"), F.coalesce("r", "old").alias("right"), "height", "count", "score"), "tree")
    dropped(spark, folder)
    return result


def _over(total: str, count: str) -> Column:
    return F.transform(total, lambda t: t / F.col(count))


def top_clusters(tree: DataFrame, fused: DataFrame) -> DataFrame:
    """(scene, id, cluster) of the leaves below the topmost fused nodes (scene, node): what a walk from the root downwards meets first.

    Leaves without a fused node above them are in no cluster.  Every node jumps to where its upper one already is, so the rounds are the logarithm of the tree's depth.
    """
    ends = tree.select("scene", F.col("left").alias("v"), F.col("node").alias("up")).unionByName(tree.select("scene", F.col("right").alias("v"), F.col("node").alias("up")))
    every = tree.select("scene", F.col("node").alias("v")).unionByName(ends.select("scene", "v")).distinct()
    flagged = fused.select("scene", F.col("node").alias("v"), F.col("node").alias("top")).distinct()
    inner = tree.select("scene", F.col("node").alias("v"), F.lit(True).alias("inner"))
    rows = every.join(ends, ["scene", "v"], "left").join(inner, ["scene", "v"], "left").join(flagged, ["scene", "v"], "left")
    rows = cut(rows.select("scene", "v", F.coalesce("inner", F.lit(False)).alias("inner"), "up", F.when(F.col("inner"), F.col("top")).alias("top")), "tops")
    while not rows.filter("up is not null").isEmpty():
        above = rows.select("scene", F.col("v").alias("up"), F.col("up").alias("further"), F.col("top").alias("higher"))
        rows = cut(rows.join(above, ["scene", "up"], "left").select("scene", "v", "inner", F.col("further").alias("up"), F.coalesce("higher", "top").alias("top")), "tops")
    return rows.filter("not inner and top is not null").select("scene", F.col("v").alias("id"), F.col("top").alias("cluster"))


def proposals(points: DataFrame, clusters: DataFrame, by: str, least: int = LEAST_POINTS) -> DataFrame:
    """(scene, point_idx, proposal): the points of the clusters (scene, id, cluster) that have `least` points or more, numbered from 0 by falling node.

    points: (scene, point_idx, by), by being the id of the leaf that a point belongs to.
    """
    rows = points.select("scene", "point_idx", F.col(by).alias("id")).join(clusters, ["scene", "id"])
    large = rows.groupBy("scene", "cluster").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    numbered = large.select("scene", "cluster", (F.row_number().over(W.partitionBy("scene").orderBy(F.desc("cluster"))) - 1).alias("proposal"))
    return rows.join(numbered, ["scene", "cluster"]).select("scene", "point_idx", "proposal")
