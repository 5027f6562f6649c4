"""Delaunay edges of points in space, by tiles with halos.

A tetrahedron belongs to the tile that has the centre of its circumsphere.  A tile sees all points up to `radius` beyond its box, so it has the whole sphere of each of its
tetrahedra of at most that circumradius: these are Delaunay among all points just if they are among those it sees.  Larger ones are left out: they
join points far apart, or lie along the hull.

Where points are dense, no sphere in a tile is large: an empty one reaches at most as far as the points nearest to its centre.  A tile that sees many is split,
and its parts see only so far, first by rounds of Spark jobs until a task has few enough, then in the task.  A tile stays whole where its parts would take more steps in all, as
between surfaces of many points that all lie on the spheres between them: there the steps of a tile are still quadratic.

In a tile faces are wrapped: the apex of a face is, of all points on its open side, the one whose sphere reaches least far to that side.  All open faces of a wave are wrapped at
once.  Places are shifted by a billionth of the radius, by their ids, so that no five points lie on a sphere and tiles agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.plans import cut, small

SHIFT, SLACK, FLAT, PAIRS = 1e-9, 1e-6, 1e-7, 1 << 20
#: Points that a task's tile sees before it is split, and a tile in a task; how often a width is halved at most.
SEEN, FEW, HALVINGS = 1 << 15, 600, 16
#: Parts of a tile along an axis that a round and a step in a task make, and cells of such a part along an axis.
SPLIT, HALF, CELLS = 4, 2, 4
#: How many steps in a task may look worse in turn, and how many times as many steps as a tile its parts of a round may take: they run side by side and are split on in tasks.
PATIENCE, LOSS = 2, 4
NONE = np.zeros((0, 4), np.int64), np.zeros((0, 3)), np.zeros(0)


def shifted(places: np.ndarray, ids: np.ndarray, by: float) -> np.ndarray:
    """The places moved by up to `by` along each axis, each id in its own way."""
    h = ids.astype(np.uint64)[:, None] * np.uint64(3) + np.arange(3, dtype=np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    h ^= h >> np.uint64(31)
    return places + (h / 2.0**63 - 1.0) * by


def circles(p: np.ndarray, faces: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, squared radius and unit normal of each face's circle."""
    a = p[faces[:, 0]]
    u, v = p[faces[:, 1]] - a, p[faces[:, 2]] - a
    n = np.cross(u, v)
    nn = (n * n).sum(axis=1, keepdims=True)
    nn = np.where(nn == 0, np.finfo(float).tiny, nn)
    to = (np.cross(n, u) * (v * v).sum(axis=1, keepdims=True) + np.cross(v, n) * (u * u).sum(axis=1, keepdims=True)) / (2 * nn)
    return a + to, (to * to).sum(axis=1), n / np.sqrt(nn)


def apexes(p: np.ndarray, faces: np.ndarray, sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each face and side (1: that of its normal) the point that ends its tetrahedron there, -1 without any, and how far the sphere's centre is along the side."""
    best, far = np.full(len(faces), -1), np.full(len(faces), np.inf)
    step = max(1, PAIRS // len(p))
    for at in range(0, len(faces), step):
        part = faces[at : at + step]
        centre, square, normal = circles(p, part)
        normal = normal * sides[at : at + step, None]
        height = p @ normal.T - (centre * normal).sum(axis=1)
        reach = ((p * p).sum(axis=1)[:, None] - 2 * p @ centre.T + (centre * centre).sum(axis=1) - square) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.where(height > 0, reach / height, np.inf)
        for corner in part.T:
            t[corner, np.arange(len(part))] = np.inf
        k = t.argmin(axis=0)
        far[at : at + step] = t[k, np.arange(len(part))]
        best[at : at + step] = np.where(np.isfinite(far[at : at + step]), k, -1)
    return best, far


def tetrahedra(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All Delaunay tetrahedra of the points: their corners, and the centres and radii of their spheres (endless for one that only the shifts keep from being flat)."""
    if len(p) < 4:
        return NONE
    p = p - p.mean(axis=0)
    a = 0
    gap = ((p - p[a]) ** 2).sum(axis=1)
    gap[a] = np.inf
    b = int(gap.argmin())  # the nearest point of any is a neighbour
    rest = np.array([i for i in range(len(p)) if i not in (a, b)])
    _, square, _ = circles(p, np.stack([np.full(len(rest), a), np.full(len(rest), b), rest], axis=1))
    first = np.sort(np.array([[a, b, rest[int(square.argmin())]]]), axis=1)
    faces, sides = np.repeat(first, 2, axis=0), np.array([1.0, -1.0])
    met = {(*f, s) for f, s in zip(faces.tolist(), sides.tolist(), strict=True)}
    found: dict[tuple[int, ...], None] = {}
    while len(faces):
        apex, _ = apexes(p, faces, sides)
        new = []
        for f, k in zip(faces.tolist(), apex.tolist(), strict=True):
            corners = tuple(sorted((*f, k)))
            if k >= 0 and corners not in found:
                found[corners] = None
                new.append(corners)
        if not new:
            break
        t = np.array(new)
        faces = np.concatenate([np.delete(t, i, axis=1) for i in range(4)])
        inside = np.concatenate([t[:, i] for i in range(4)])
        _, _, normal = circles(p, faces)
        sides = np.where(((p[inside] - p[faces[:, 0]]) * normal).sum(axis=1) > 0, 1.0, -1.0)
        met.update((*f, s) for f, s in zip(faces.tolist(), sides.tolist(), strict=True))
        outside = [(*f, -s) for f, s in zip(faces.tolist(), sides.tolist(), strict=True)]
        left = dict.fromkeys(x for x in outside if x not in met)
        met.update(left)
        faces, sides = np.array([x[:3] for x in left], np.int64).reshape(-1, 3), np.array([x[3] for x in left])
    t = np.array(list(found), np.int64).reshape(-1, 4)
    edges = p[t[:, 1:]] - p[t[:, :1]]
    with np.errstate(all="ignore"):
        volume = np.linalg.det(edges)
        x, y, z = edges[:, 0], edges[:, 1], edges[:, 2]
        square = lambda v: (v * v).sum(axis=1, keepdims=True)
        to = (square(x) * np.cross(y, z) + square(y) * np.cross(z, x) + square(z) * np.cross(x, y)) / (2 * volume[:, None])
    radii = np.sqrt((to * to).sum(axis=1))
    return t, to + p[t[:, 0]], np.where(np.abs(volume) > FLAT * radii**3, radii, np.inf)


def grid(n: int) -> np.ndarray:
    return np.stack(np.meshgrid(*[np.arange(n)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)


def parts(p: np.ndarray, width: float, radius: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """The corners of the halves of a tile at 0, and the points that each must see: those that may lie on an empty sphere, of at most this radius, around a point of one of its cells."""
    half = width / HALF
    cell, slack, found = half / CELLS, SLACK * width, []
    reach = cell * 3**0.5 / 2
    for step in grid(HALF):
        middles = step * half + (grid(CELLS) + 0.5) * cell
        gaps = np.sqrt(sum((middles[:, [c]] - p[:, c]) ** 2 for c in range(3)))
        nearest = gaps.min(axis=1, initial=np.inf)
        live = nearest - reach <= radius + slack
        upto = np.minimum(nearest + 2 * reach, radius + reach) + slack
        found.append((step * half, np.flatnonzero((gaps[live] <= upto[live, None]).any(axis=0))))
    return found


def tiles(p: np.ndarray, width: float, radius: float, halvings: int) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """(points, corner, width) of the tile at 0, or of parts of it that together take fewer steps; these go with the square of what a part sees.

    A crowd that is small beside the tile is seen by many parts at first, so parts may take more steps for PATIENCE halvings in turn.
    """

    def best(seen: np.ndarray, low: np.ndarray, side: float, left: int, patience: int) -> list[tuple[np.ndarray, np.ndarray, float]]:
        whole = [(seen, low, side)]
        if not left or len(seen) <= FEW:
            return whole
        halves = [(seen[at], low + step) for step, at in parts(p[seen] - low, side, radius) if len(at) > 3]
        patience = PATIENCE if sum(len(at) ** 2 for at, _ in halves) < len(seen) ** 2 else patience - 1
        if patience < 0:
            return whole
        found = [x for at, corner in halves for x in best(at, corner, side / HALF, left - 1, patience)]
        return found if sum(len(at) ** 2 for at, _, _ in found) < len(seen) ** 2 else whole

    return best(np.arange(len(p)), np.zeros(3), width, halvings, PATIENCE)


def owned(p: np.ndarray, width: float, radius: float, halvings: int) -> tuple[np.ndarray, np.ndarray]:
    """The corners and radii of the tetrahedra of at most this radius whose sphere's centre is in the tile at 0."""
    found = [(np.zeros((0, 4), np.int64), np.zeros(0))]
    for seen, low, side in tiles(p, width, radius, halvings):
        middle = p[seen].mean(axis=0)
        corners, centres, radii = tetrahedra(p[seen])
        centres = centres + middle - low
        own = (radii <= radius) & (centres >= -SLACK * side).all(axis=1) & (centres <= (1 + SLACK) * side).all(axis=1)
        found.append((seen[corners[own]], radii[own]))
    return np.concatenate([c for c, _ in found]), np.concatenate([r for _, r in found])


TILE = ["scene", "tx", "ty", "tz"]


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _split(seen: DataFrame, width: float, radius: float) -> DataFrame:
    """The rows that tiles of this width see, dealt to their parts of a width less by SPLIT (cx, cy, cz), as far as an empty sphere in a part may reach.

    A group has the cells with points in what a tile sees, not the points.  The groups are small to read but long to search, so they are dealt to all tasks: adaptive execution would put them into one.
    """
    kind, n = seen.schema["scene"].dataType.simpleString(), SPLIT * CELLS
    cell, part = width / n, width / SPLIT
    cells = seen.select(*TILE, *[F.floor(F.col(c) / cell - F.col(f"t{c}") * n).cast("int").alias(f"g{c}") for c in "xyz"]).distinct().repartition(_tasks(seen), *TILE)

    def reaches(key: tuple, full: pd.DataFrame) -> pd.DataFrame:
        at, rows = full[["gx", "gy", "gz"]].to_numpy(), []
        for step in grid(SPLIT):
            own = step * CELLS + grid(CELLS)
            most, least = (np.full(len(own), np.inf) for _ in range(2))
            for begin in range(0, len(at), 4096):
                gaps = np.abs(own[:, None] - at[None, begin : begin + 4096])
                most = np.minimum(most, ((gaps + 1) ** 2).sum(axis=2).min(axis=1))
                least = np.minimum(least, (np.maximum(gaps - 1, 0) ** 2).sum(axis=2).min(axis=1))
            live = np.sqrt(least) * cell <= radius * (1 + SLACK)
            if live.any():
                rows.append((*key, *(np.array(key[1:]) * SPLIT + step).tolist(), min(radius, float(np.sqrt(most[live].max())) * cell) + SLACK * width))
        return pd.DataFrame(rows, columns=[*TILE, "cx", "cy", "cz", "halo"])

    steps = cut(cells.groupBy(*TILE).applyInPandas(reaches, f"scene {kind}, tx long, ty long, tz long, cx long, cy long, cz long, halo double"), "delaunay-parts")
    beyond = [F.greatest(F.col(f"c{c}") * part - F.col(c), F.col(c) - (F.col(f"c{c}") + 1) * part, F.lit(0.0)) for c in "xyz"]
    return seen.join(small(steps, 100_000), TILE).filter(sum((b * b for b in beyond), F.lit(0.0)) <= F.col("halo") * F.col("halo")).drop("halo")


def _dealt(seen: DataFrame, width: float, radius: float) -> DataFrame:
    """The rows (TILE, id, x, y, z) that tiles see, with `width`: tiles that see more than SEEN are split, unless their parts would take LOSS times as many steps in all."""
    done, per = None, F.count(F.lit(1)).alias("n")
    for left in range(HALVINGS // 2, -1, -1):
        full = cut(seen.groupBy(*TILE).agg(per).filter(F.col("n") > SEEN), "delaunay-full") if left else None
        if full is None or full.isEmpty():
            break
        parts = cut(_split(seen.join(small(full.select(*TILE)), TILE, "left_semi"), width, radius), "delaunay-split")
        steps = parts.groupBy(*TILE, "cx", "cy", "cz").agg(per).groupBy(*TILE).agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("steps"))
        gain = cut(full.join(steps, TILE).filter(F.col("steps") < LOSS * F.col("n").cast("double") * F.col("n")).select(*TILE), "delaunay-gain")
        whole = seen.join(small(gain), TILE, "left_anti").withColumn("width", F.lit(width))
        done = whole if done is None else done.unionByName(whole)
        seen = parts.join(small(gain), TILE, "left_semi").select("scene", *[F.col(f"c{c}").alias(f"t{c}") for c in "xyz"], "id", *"xyz")
        width /= SPLIT
    rest = seen.withColumn("width", F.lit(width))
    return rest if done is None else done.unionByName(rest)


def delaunay_edges(points: DataFrame, radius: float, tile: float | None = None) -> DataFrame:
    """(scene, src, dst, length, radius), src < dst: the edges of all Delaunay tetrahedra of at most this circumradius; `radius` is that of the smallest around the edge.

    points: (scene, id, x, y, z).  tile: the width of a tile, four radii by default.  Of points at one place the lowest id takes part.  Points of one plane have no tetrahedra.
    """
    width = 4 * radius if tile is None else tile
    halo = radius + SLACK * width
    one = cut(points.groupBy("scene", *[F.col(c).cast("double").alias(c) for c in "xyz"]).agg(F.min("id").cast("long").alias("id")), "delaunay-places")
    axis = lambda c: F.explode(F.sequence(F.floor((F.col(c) - halo) / width), F.floor((F.col(c) + halo) / width))).alias(f"t{c}")
    seen = one.select("scene", "id", *"xyz", axis("x")).select("*", axis("y")).select("*", axis("z"))
    kind = points.schema["scene"].dataType.simpleString()
    dealt = _dealt(seen, width, radius).repartition(_tasks(points), *TILE, "width")

    def wrap(key: tuple, seen: pd.DataFrame) -> pd.DataFrame:
        low, side = np.array([float(k) for k in key[1:4]]) * key[4], key[4]
        ids = seen["id"].to_numpy()
        places = shifted(seen[list("xyz")].to_numpy(float) - low, ids, SHIFT * radius)
        corners, radii = owned(places, side, radius, HALVINGS - round(np.log2(width / side)))
        pairs = np.concatenate([corners[:, [i, j]] for i in range(4) for j in range(i)])
        ends = np.sort(ids[pairs], axis=1)
        out = pd.DataFrame({"src": ends[:, 0], "dst": ends[:, 1], "radius": np.tile(radii, 6)}).groupby(["src", "dst"], as_index=False)["radius"].min()
        out.insert(0, "scene", key[0])
        return out

    found = dealt.groupBy(*TILE, "width").applyInPandas(wrap, f"scene {kind}, src long, dst long, radius double")
    edges = found.groupBy("scene", "src", "dst").agg(F.min("radius").alias("radius"))
    ends = [one.select("scene", F.col("id").alias(e), *[F.col(c).alias(f"{e}{c}") for c in "xyz"]) for e in ("src", "dst")]
    length = F.sqrt(sum((F.pow(F.col(f"src{c}") - F.col(f"dst{c}"), 2) for c in "xyz"), F.lit(0.0)))
    return edges.join(ends[0], ["scene", "src"]).join(ends[1], ["scene", "dst"]).select("scene", "src", "dst", length.alias("length"), "radius")


def with_nearest(edges: DataFrame, nearest: DataFrame | None, longest: float) -> DataFrame:
    """(scene, src, dst): the Delaunay edges shorter than `longest`, both ways, and the edges (scene, src, dst) to nearest neighbours, if given, each once."""
    ways = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    both = edges.filter(F.col("length") < longest).select("scene", F.inline(ways))  # one pass: a union of both ways would have the plan of the edges twice
    return (both if nearest is None else both.unionByName(nearest.select("scene", "src", "dst"))).distinct()
