"""Minimum cuts of graphs of any size, by discharging blocks of nodes in turn with their borders.

The network's nodes are dealt into blocks of bounded size.  In a sweep every block with a node that still has an excess sends it, inside one task, along augmenting paths: first
to the sink, then over its border to nodes of label 0, 1 and so on, where a label is how many borders a way to the sink crosses at least.  All blocks go at
once; what was sent over a border counts if the labels of its ends still fit, else it goes back.  Before every sweep the labels are made exact, by rounds in which blocks
only pass labels on; nodes without a way to the sink drop out there, and when no node with an excess has one, the flow is the largest and these labels are the cut.
What a task holds is a block with its border, never a region or a scene.
The cut is exact for capacities rounded to 2^-40 of the largest of their scene.
"""

from __future__ import annotations

import heapq
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.plans import attach, dropped, saved, small, work_dir

BLOCK, UNITS = 4096, float(1 << 40)


class Flow:
    """A block's network; arc 2i and its opposite 2i + 1."""

    def __init__(self, n: int):
        self.source, self.sink = n, n + 1
        self.out: list[list[int]] = [[] for _ in range(n + 2)]
        self.to: list[int] = []
        self.left: list[int] = []

    def arc(self, u: int, v: int, forth: int, back: int = 0) -> int:
        at = len(self.to)
        self.to += [v, u]
        self.left += [forth, back]
        self.out[u].append(at)
        self.out[v].append(at + 1)
        return at

    def augment(self) -> None:
        """Paths by layers until the sink can't be reached."""
        to, left, out = self.to, self.left, self.out
        while True:
            layer = [-1] * len(out)
            layer[self.source] = 0
            queue = deque([self.source])
            while queue:
                u = queue.popleft()
                for a in out[u]:
                    if left[a] and layer[to[a]] < 0:
                        layer[to[a]] = layer[u] + 1
                        queue.append(to[a])
            if layer[self.sink] < 0:
                return
            turn = [0] * len(out)
            path: list[int] = []
            u = self.source
            while True:
                if u == self.sink:
                    most = min(left[a] for a in path)
                    for a in path:
                        left[a] -= most
                        left[a ^ 1] += most
                    stop = next(i for i, a in enumerate(path) if not left[a])
                    u = to[path[stop] ^ 1]
                    del path[stop:]
                    continue
                while turn[u] < len(out[u]):
                    a = out[u][turn[u]]
                    if left[a] and layer[to[a]] == layer[u] + 1:
                        break
                    turn[u] += 1
                if turn[u] < len(out[u]):
                    path.append(out[u][turn[u]])
                    u = to[path[-1]]
                elif path:
                    u = to[path.pop() ^ 1]
                    turn[u] += 1
                else:
                    break


OUT = "kind int, u long, v long, a long, b long, label long"  # of kind 0 nodes (u; excess, room, label), 1 arcs within (u, v; forth, back), 2 what crosses a border (u, v; amount)


def discharged(nodes: pd.DataFrame, arcs: pd.DataFrame, limit: int, push: bool) -> pd.DataFrame:
    """One block's turn.  nodes: id, excess, room (to the sink), label; arcs: u, v, forth, back, label: that of v if v is outside, else null."""
    ids = nodes["id"].tolist()
    place = {i: k for k, i in enumerate(ids)}
    n, flow = len(ids), Flow(len(ids))
    excess = [flow.arc(flow.source, k, e if push else 0) for k, e in enumerate(nodes["excess"].tolist())]
    room = [flow.arc(k, flow.sink, r) for k, r in enumerate(nodes["room"].tolist())]
    inner, border = [], []
    for u, v, forth, back, label in zip(arcs["u"].tolist(), arcs["v"].tolist(), arcs["forth"].tolist(), arcs["back"].tolist(), arcs["label"].tolist(), strict=True):
        if label != label or label is None:
            inner.append((u, v, flow.arc(place[u], place[v], forth, back)))
        else:
            border.append((int(label), u, v, forth, flow.arc(place[u], flow.sink, 0)))
    if push:
        flow.augment()
        for level in sorted({b[0] for b in border if b[0] < limit}):
            for label, _, _, forth, a in border:
                if label == level:
                    flow.left[a] = forth
            flow.augment()
    labels = [limit] * n
    queue = [(0, k) for k in range(n) if flow.left[room[k]]]
    queue += [(label + 1, place[u]) for label, u, _, forth, a in border if label < limit and (flow.left[a] if push else forth)]
    heapq.heapify(queue)
    while queue:
        label, k = heapq.heappop(queue)
        if label < labels[k]:
            labels[k] = label
            for a in flow.out[k]:
                j = flow.to[a]
                if j < n and flow.left[a ^ 1] and labels[j] > label:
                    heapq.heappush(queue, (label, j))
    if push:
        labels = [max(a, b) for a, b in zip(labels, nodes["label"].tolist(), strict=True)]
    rows = [(0, i, 0, flow.left[excess[k]] if push else e, flow.left[room[k]], labels[k]) for k, (i, e) in enumerate(zip(ids, nodes["excess"].tolist(), strict=True))]
    rows += [(1, u, v, flow.left[a], flow.left[a + 1], 0) for u, v, a in inner]
    rows += [(2, u, v, flow.left[a + 1], 0, 0) for label, u, v, forth, a in border if push and flow.left[a + 1]]
    return pd.DataFrame(rows, columns=["kind", "u", "v", "a", "b", "label"])


def cut_sides(lean: np.ndarray, links: np.ndarray, capacity: np.ndarray) -> np.ndarray:
    """Which nodes of a graph that fits into a task are far, as in minimum_cut; links are pairs of places."""
    top = max(float(np.abs(lean).max(initial=0)), float(capacity.max(initial=0)), 1e-300)
    units = lambda c: np.round(c / top * UNITS).astype(np.int64)
    nodes = pd.DataFrame({"id": np.arange(len(lean)), "excess": units(np.maximum(lean, 0)), "room": units(np.maximum(-lean, 0)), "label": 0})
    arcs = pd.DataFrame({"u": links[:, 0], "v": links[:, 1], "forth": units(capacity), "back": units(capacity), "label": np.nan})
    found = discharged(nodes, arcs, 1, True)
    return found.loc[found["kind"] == 0, "label"].to_numpy() >= 1


def minimum_cut(nodes: DataFrame, edges: DataFrame, block: int = BLOCK) -> DataFrame:
    """(scene, id, far): far nodes lie on the source's side of the minimum cut: those that can't reach the sink any more.

    nodes: (scene, id, lean): a lean above 0 is a capacity from the source, below 0 one to the sink.  edges: (scene, src, dst, capacity), in both directions;
    parallel ones add up, loops and ends that aren't nodes count nothing.  Nodes are dealt into blocks by `block` neighbouring ids.
    """
    spark = nodes.sparkSession
    folder = work_dir(spark, "cut")
    kind = nodes.schema["scene"].dataType.simpleString()
    of = F.floor(F.col("id") / block)
    known = nodes.select("scene", F.col("id").cast("long").alias("id"), of.alias("block"), "lean")
    ends = [known.select("scene", F.col("id").alias(e), F.col("block").alias(b)) for e, b in (("u", "ub"), ("v", "vb"))]
    paired = edges.filter("src != dst and capacity > 0").select("scene", F.least("src", "dst").cast("long").alias("u"), F.greatest("src", "dst").cast("long").alias("v"), "capacity")
    paired = paired.groupBy("scene", "u", "v").agg(F.sum("capacity").alias("capacity")).join(ends[0], ["scene", "u"]).join(ends[1], ["scene", "v"])
    paired = saved(paired, f"{folder}/paired")
    known = saved(known, f"{folder}/known")
    top = known.select("scene", F.abs("lean").alias("c")).unionByName(paired.select("scene", F.col("capacity").alias("c"))).groupBy("scene").agg(F.greatest(F.max("c"), F.lit(1e-300)).alias("top"))
    units = lambda c: F.round(c / F.col("top") * UNITS).cast("long")
    state = attach(known, top, ["scene"]).select("scene", "id", "block", units(F.greatest("lean", F.lit(0.0))).alias("excess"), units(F.greatest(-F.col("lean"), F.lit(0.0))).alias("room"), F.lit(0).cast("long").alias("label"))
    state = saved(state, f"{folder}/nodes-0")
    scaled = attach(paired, top, ["scene"]).select("scene", "u", "ub", "v", "vb", units(F.col("capacity")).alias("forth"), units(F.col("capacity")).alias("back"))
    inner = saved(scaled.filter("ub = vb").select("scene", F.col("ub").alias("block"), "u", "v", "forth", "back"), f"{folder}/inner-0")
    border = saved(scaled.filter("ub != vb"), f"{folder}/border-0")
    limit = border.select("scene", F.col("u").alias("id")).unionByName(border.select("scene", F.col("v").alias("id"))).distinct().count() + 1
    schema = f"scene {kind}, block long, {OUT}"

    def turn(state: DataFrame, inner: DataFrame, border: DataFrame, push: bool, every: bool = False) -> DataFrame:
        labels = state.select("scene", F.col("id").alias("v"), "label")
        there = border.select("scene", F.col("ub").alias("block"), "u", "v", "forth", "back").unionByName(border.select("scene", F.col("vb").alias("block"), F.col("v").alias("u"), F.col("u").alias("v"), F.col("back").alias("forth"), F.col("forth").alias("back")))
        arcs = inner.withColumn("label", F.lit(None).cast("double")).unionByName(there.join(labels, ["scene", "v"]).select("scene", "block", "u", "v", "forth", "back", F.col("label").cast("double").alias("label")))
        if push and not every:
            busy = state.filter((F.col("excess") > 0) & (F.col("label") < limit)).select("scene", "block").distinct()
            state, arcs = state.join(busy, ["scene", "block"], "left_semi"), arcs.join(busy, ["scene", "block"], "left_semi")

        def work(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            found = discharged(a, b, limit, push)
            found.insert(0, "block", key[1])
            found.insert(0, "scene", key[0])
            return found

        return state.groupBy("scene", "block").cogroup(arcs.groupBy("scene", "block")).applyInPandas(work, schema)

    if limit == 1:  # no edge leaves its block: one turn is all
        found = turn(state, inner, border, True, every=True).filter("kind = 0").select("scene", F.col("u").alias("id"), (F.col("label") >= limit).alias("far"))
        result = saved(found, work_dir(spark, "cut-sides"))
        dropped(spark, folder)
        return result

    def labelled(state: DataFrame, step: int) -> DataFrame:
        state, total, pass_ = state.withColumn("label", F.lit(limit).cast("long")), None, 0
        while True:
            pass_ += 1
            found = turn(state, inner, border, False).filter("kind = 0").select("scene", F.col("u").alias("id"), "block", F.col("a").alias("excess"), F.col("b").alias("room"), "label")
            state = saved(found, f"{folder}/labels-{step}-{pass_}")
            before, total = total, state.agg(F.sum("label")).first()[0]
            if total == before:
                return state

    step = 0
    while True:
        state = labelled(state, step)
        if state.filter((F.col("excess") > 0) & (F.col("label") < limit)).isEmpty():
            break
        step += 1
        found = saved(turn(state, inner, border, True), f"{folder}/turn-{step}")
        busy = small(found.filter("kind = 0").select("scene", "block").distinct())
        met = found.filter("kind = 0").select("scene", F.col("u").alias("id"), "block", F.col("a").alias("excess"), F.col("b").alias("room"), "label")
        state = met.unionByName(state.join(busy, ["scene", "block"], "left_anti"))
        inner = saved(found.filter("kind = 1").select("scene", "block", "u", "v", F.col("a").alias("forth"), F.col("b").alias("back")).unionByName(inner.join(busy, ["scene", "block"], "left_anti")), f"{folder}/inner-{step}")
        crossing = found.filter("kind = 2").select("scene", "u", "v", "a")
        ends = [state.select("scene", F.col("id").alias(e), F.col("label").alias(f"{e}_label")) for e in "uv"]
        moved = border.join(crossing.withColumnRenamed("a", "uv"), ["scene", "u", "v"], "left").join(crossing.select("scene", F.col("u").alias("v"), F.col("v").alias("u"), F.col("a").alias("vu")), ["scene", "u", "v"], "left")
        moved = moved.join(ends[0], ["scene", "u"]).join(ends[1], ["scene", "v"]).fillna(0, ["uv", "vu"])
        moved = moved.withColumns({"uv_goes": F.col("v_label") <= F.col("u_label") + 1, "vu_goes": F.col("u_label") <= F.col("v_label") + 1})
        moved = saved(moved.select("scene", "u", "ub", "v", "vb", "forth", "back", "uv", "vu", "uv_goes", "vu_goes"), f"{folder}/moved-{step}")
        gets = lambda end, own, goes, other, comes: moved.filter(f"{own} > 0 and not {goes} or {other} > 0 and {comes}").select("scene", F.col(end).alias("id"), (F.when(~F.col(goes), F.col(own)).otherwise(0) + F.when(F.col(comes), F.col(other)).otherwise(0)).alias("more"))
        more = gets("u", "uv", "uv_goes", "vu", "vu_goes").unionByName(gets("v", "vu", "vu_goes", "uv", "uv_goes")).groupBy("scene", "id").agg(F.sum("more").alias("more"))
        net = F.when(F.col("uv_goes"), F.col("uv")).otherwise(0) - F.when(F.col("vu_goes"), F.col("vu")).otherwise(0)
        border = saved(moved.select("scene", "u", "ub", "v", "vb", (F.col("forth") - net).alias("forth"), (F.col("back") + net).alias("back")), f"{folder}/border-{step}")
        state = state.join(more, ["scene", "id"], "left").withColumn("excess", F.col("excess") + F.coalesce("more", F.lit(0))).drop("more")
        state = saved(state.select("scene", "id", "block", "excess", "room", "label"), f"{folder}/nodes-{step}")
    result = saved(state.select("scene", "id", (F.col("label") >= limit).alias("far")), work_dir(spark, "cut-sides"))
    dropped(spark, folder)
    return result
