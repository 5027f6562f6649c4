"""Neighbour joins in three dimensions, per scene, as equi-joins of grid cells; never a join of all pairs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.plans import BROADCAST_ROWS, cut, small

STEPS = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]


def distance(a: str, b: str) -> Column:
    """The Euclidean distance of (a)x, (a)y, (a)z and (b)x, (b)y, (b)z."""
    dx, dy, dz = (F.col(f"{a}{c}") - F.col(f"{b}{c}") for c in "xyz")
    return F.sqrt(dx * dx + dy * dy + dz * dz)


def blocks(a: str, b: str) -> Column:
    """The distance along the axes."""
    return sum((F.abs(F.col(f"{a}{c}") - F.col(f"{b}{c}")) for c in "xyz"), F.lit(0.0))


def _cells(df: DataFrame, prefix: str, h: float) -> DataFrame:
    return df.withColumns({f"__c{c}": F.floor(F.col(f"{prefix}{c}") / h) for c in "xyz"})


def near_pairs(left: DataFrame, right: DataFrame, h: float, measure: Callable[[str, str], Column] = distance) -> DataFrame:
    """(scene, src, dst, dist) of all pairs whose cells of width h touch; it has all pairs up to a distance of h."""
    a = _cells(left.select("scene", F.col("id").alias("src"), *[F.col(c).alias(f"a{c}") for c in "xyz"]), "a", h)
    steps = F.array(*[F.struct(*[(F.col(f"__c{c}") + d).alias(f"__c{c}") for c, d in zip("xyz", step, strict=True)]) for step in STEPS])
    a = a.select("scene", "src", "ax", "ay", "az", F.inline(steps))
    b = _cells(right.select("scene", F.col("id").alias("dst"), *[F.col(c).alias(f"b{c}") for c in "xyz"]), "b", h)
    return a.join(b, ["scene", "__cx", "__cy", "__cz"]).select("scene", "src", "dst", measure("a", "b").alias("dist"))


#: Cells of a tile along an axis, pairs that a task looks at at once, and about how many candidates a tile or a part of one has at most.
TILE, PAIRS, CANDIDATES = 8, 1 << 20, 1 << 16

#: The first width is halved so often at most; and what share of a cell's width counts as seen, so that no rounding of cells loses a neighbour.
HALVINGS, SEEN = 32, 0.999

#: Coordinates apart by less have a distance of 0; only coordinates below it can be, others are apart by more.
TINY = 1e-140

PLACE = ["scene", *"xyz"]


def _tiles(h: float, halo: int) -> list[Column]:
    """The tiles that see a row: its own, or with a halo also those of the cells next to its own."""
    cell = {c: F.floor(F.col(c) / h) for c in "xyz"}
    tile = lambda c, by: F.floor((cell[c] + by) / TILE)
    return [F.sequence(tile(c, -halo), tile(c, halo)).alias(f"__t{c}") if halo else tile(c, 0).alias(f"__t{c}") for c in "xyz"]


def _widths(places: DataFrame, right: DataFrame, farthest: float | None) -> tuple[float, float]:
    """A cell width at which no tile has more than half of CANDIDATES rows, and a width with which all that is asked for is found.

    The first is halved from that of a tile with half as many in the middle scene, a count of tiles each, so that a dense scene or object doesn't make pairs of all its points.
    """
    rows = right.select(*PLACE, F.lit(1).alias("n"))
    if places is not right:
        rows = rows.unionByName(places.select(*PLACE, F.lit(0).alias("n")))
    per = rows.groupBy("scene").agg(F.sum("n").alias("n"), F.greatest(*[F.max(c) - F.min(c) for c in "xyz"]).alias("side"), F.greatest(*[F.max(F.abs(c)) for c in "xyz"]).alias("reach"))
    tile = F.col("side") * F.pow(F.lit(CANDIDATES / 4) / F.greatest("n", F.lit(1)), 1 / 3)
    row = per.agg(F.percentile_approx(tile, 0.5).alias("tile"), F.max("n").alias("most"), F.max("side").alias("side"), F.max("reach").alias("reach")).first()
    least = max((row["reach"] or 0.0) * 2**-40, 1e-9)  # cells stay far wider than coordinates are rounded
    side = max((row["side"] or 0.0) / SEEN, least)
    side = side if farthest is None else min(side, max(farthest / SEEN, least))
    if (row["most"] or 0) <= CANDIDATES // 2:
        return side, side
    h = max((row["tile"] or 0.0) / TILE, side * 2**-10, least)

    def crowded(at: int) -> bool:
        return right.groupBy("scene", *_tiles(h / 2**at, 0)).count().agg(F.max("count")).first()[0] > CANDIDATES // 2

    low, high = 0, 0  # the fullest tile only loses rows when tiles are halved
    while high < HALVINGS and h / 2**high > least and crowded(high):
        low, high = high + 1, min(HALVINGS, 2 * high or 1)
    while low < high:
        at = (low + high) // 2
        low, high = (at + 1, high) if crowded(at) else (low, at)
    return max(h / 2**low, least), side


def _few_of_a_place(right: DataFrame, k: int) -> DataFrame:
    """The k rows of the lowest ids of each place: no point has more of its nearest there.  Spark keeps k of a place in each task before the shuffle.

    The first row of a place has in __ids the ids of all that are kept and in __n how many.  The place's hash goes first, because Spark sorts by the first key faster.
    """
    by = W.partitionBy("__hash", *PLACE).orderBy("id")
    few = right.withColumn("__hash", F.xxhash64(*PLACE)).withColumn("__k", F.row_number().over(by)).filter(F.col("__k") <= k)
    few = few.withColumn("__ids", F.collect_list("id").over(by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    return few.select(*PLACE, "id", F.when(F.col("__k") == 1, F.size("__ids")).alias("__n"), F.when(F.col("__k") == 1, F.col("__ids")).alias("__ids"))


def _nearest(
    asked: np.ndarray, places: list[np.ndarray], seen: np.ndarray, found: list[np.ndarray], ids: np.ndarray, h: float, k: int, farthest: float | None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each place the k nearest of `found` in its tile, ties by id: how many there are, and all their numbers and distances in a row.

    asked and seen are the tiles of the places and of what is found.  Cells are halved from h until few rows lie in the cell of a row; places whose last distance isn't within a cell's width go on with cells twice as wide, up to h.
    """
    tile = np.unique(np.concatenate([asked, seen]), return_inverse=True)[1]
    tiles, own, tile = int(tile.max(initial=-1)) + 1, tile[: len(asked)], tile[len(asked) :]
    least = [np.full(tiles, np.inf) for _ in "xyz"]
    for low, a, b in zip(least, places, found, strict=True):
        np.minimum.at(low, own, a)
        np.minimum.at(low, tile, b)
    from_low = [[v - low[of] for v, low in zip(values, least, strict=True)] for values, of in ((places, own), (found, tile))]
    wide = lambda w: [int(max(a.max(initial=0.0), b.max(initial=0.0)) / w) + 3 for a, b in zip(*from_low, strict=True)]

    def codes(w: float, which: int, of: np.ndarray) -> np.ndarray:
        code = of
        for v, n in zip(from_low[which], wide(w), strict=True):
            code = code * n + np.floor(v / w).astype(np.int64) + 1
        return code

    halvings = 0
    while len(tile) and tiles * float(np.prod(np.array(wide(h / 2 ** (halvings + 1)), float))) < 2.0**62:
        mates = np.unique(codes(h / 2**halvings, 1, tile), return_counts=True)[1].astype(float)
        if (mates * mates).sum() <= 2 * k * len(tile):
            break
        halvings += 1
    rank = ids if ids.dtype.kind in "iu" else np.unique(ids, return_inverse=True)[1]
    todo, out = np.arange(len(asked)), []
    for halved in range(halvings, -1, -1):
        w = h / 2**halved
        code = codes(w, 1, tile)
        order = np.argsort(code, kind="stable")
        code, fx, fy, fz, frank = code[order], *(v[order] for v in found), rank[order]
        _, ny, nz = wide(w)
        steps = np.array([(i * ny + j) * nz for i in (-1, 0, 1) for j in (-1, 0, 1)])
        mid = codes(w, 0, own)[todo][:, None] + steps
        first, many = np.searchsorted(code, mid - 1, "left"), np.searchsorted(code, mid + 1, "right")
        many -= first
        sizes = many.sum(axis=1)
        by = np.argsort(sizes, kind="stable")
        left, at = [], 0
        while at < len(by):
            rows = sizes[by[at:]]
            end = at + max(1, int(np.searchsorted(rows * np.arange(1, len(rows) + 1), PAIRS, "right")))
            part, at = by[at:end], end
            place, n, runs = todo[part], sizes[part], many[part].ravel()
            to = np.repeat(first[part].ravel() - np.cumsum(runs) + runs, runs) + np.arange(runs.sum())
            of = np.repeat(np.arange(len(part)), n)
            dx, dy, dz = (v[place][of] - f[to] for v, f in zip(places, (fx, fy, fz), strict=True))
            far = np.sqrt(dx * dx + dy * dy + dz * dz)
            if len(n) and n[-1] > k:
                table = np.full((len(part), n[-1]), np.inf)
                table[of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)] = far
                near = np.flatnonzero(far <= np.partition(table, k - 1, axis=1)[of, k - 1])
                of, to, far = of[near], to[near], far[near]
            if farthest is not None:
                of, to, far = of[far <= farthest], to[far <= farthest], far[far <= farthest]
            sort = np.lexsort((frank[to], far, of))
            of, to, far = of[sort], to[sort], far[sort]
            nth = np.arange(len(of)) - np.searchsorted(of, of, "left")
            of, to, far, nth = of[nth < k], to[nth < k], far[nth < k], nth[nth < k]
            settled = np.full(len(part), not halved)
            settled[of[(nth == k - 1) & (far <= SEEN * w)]] = True
            left.append(place[~settled])
            out.append((place[of[settled[of]]], order[to[settled[of]]], far[settled[of]]))
        todo = np.concatenate([todo[:0], *left])
    of, numbers, dists = (np.concatenate([np.zeros(0, t), *(o[i] for o in out)]) for i, t in enumerate((np.int64, np.int64, float)))
    sort = np.argsort(of, kind="stable")
    return np.bincount(of, minlength=len(asked)), numbers[sort], dists[sort]


def _searched(places: DataFrame, right: DataFrame, h: float, k: int, farthest: float | None) -> DataFrame:
    """places (scene, x, y, z and others) with near, up to k structs (dist, dst) of the nearest of right, ties by id; they are exact up to the first distance beyond SEEN of h.

    Tiles of TILE cells a side also see the rows of right in the cells around them; a task searches groups of tiles.  Where a tile would see more than CANDIDATES rows, they are
    dealt into parts by their ids, and the nearest of the parts are put together, so that no group grows with a scene.
    """
    tile = ["scene", "__tx", "__ty", "__tz"]
    more = places.columns[len(PLACE) :]
    asked = places.select(*PLACE, *more, *_tiles(h, 0))
    dealt = right.select(*PLACE, "id", *_tiles(h, 1))
    for c in "xyz":
        dealt = dealt.withColumn(f"__t{c}", F.explode(f"__t{c}"))
    tiles = small(cut(asked.select(*tile).distinct().withColumn("__tile", F.monotonically_increasing_id()), "knn-tiles"), 100_000)
    asked = asked.join(tiles, tile).select("__tile", *PLACE, *more)
    dealt = dealt.join(tiles, tile).select("__tile", *"xyz", "id")
    seen = cut(dealt.groupBy("__tile").agg(F.count(F.lit(1)).alias("n")), "knn-seen")
    row = seen.agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
    parts = -(-(row["most"] or 0) // CANDIDATES) or 1
    if parts > 1:
        crowds = small(seen.filter(F.col("n") > CANDIDATES).select("__tile", F.ceil(F.col("n") / CANDIDATES).cast("int").alias("__parts")))
        in_parts = F.coalesce("__parts", F.lit(1))
        part = {"dealt": F.pmod(F.xxhash64("id"), in_parts), "asked": F.explode(F.sequence(F.lit(0), in_parts - 1))}
        asked, dealt = (df.join(crowds, "__tile", "left").withColumn("__part", part[name]).withColumn("__tile", F.col("__tile") * parts + F.col("__part")) for name, df in (("asked", asked), ("dealt", dealt)))
    group = F.pmod(F.xxhash64("__tile"), F.lit(4 * (row["n"] or 0) // CANDIDATES + 1)).alias("__group")
    kinds = {f.name: f.dataType.simpleString() for f in [*places.schema.fields, *right.schema.fields]}

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        at, of = ([t.column(of + c).to_numpy() for c in "xyz"] for t, of in ((a, "__a"), (b, "")))
        counts, numbers, dists = _nearest(a.column("__of").to_numpy(), at, b.column("__tile").to_numpy(), of, b.column("id").to_numpy(), h, k, farthest)
        dst = b.column("id").combine_chunks().take(pa.array(numbers))
        near = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.StructArray.from_arrays([pa.array(dists), dst], ["dist", "dst"]))
        return pa.table([a.column("scene"), *(a.column(f"__a{c}") for c in "xyz"), *(a.column(c) for c in more), near], names=[*PLACE, *more, "near"])

    schema = f"{', '.join(f'{c} {kinds[c]}' for c in (*PLACE, *more))}, near array<struct<dist: double, dst: {kinds['id']}>>"
    asked, dealt = asked.select(group, F.col("__tile").alias("__of"), "scene", *[F.col(c).alias(f"__a{c}") for c in "xyz"], *more), dealt.select(group, "__tile", *"xyz", "id")
    found = asked.groupBy("__group").cogroup(dealt.groupBy("__group")).applyInArrow(search, schema)
    if parts == 1:
        return found
    return found.groupBy(*PLACE, *more).agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))


def knn(left: DataFrame, right: DataFrame, k: int, other: bool = False, farthest: float | None = None) -> DataFrame:
    """(scene, src, dst, dist, rank): for each row of left its k nearest of right (scene, id, x, y, z), ties by id.

    other: rows of equal id are not neighbours; then each place is asked for one more, as its rows leave out themselves.  A place is searched once, however many rows lie there, and if left is right,
    places with as many rows as are asked for aren't searched: those of the lowest ids are the nearest; what is found for the others goes to the ids that are kept with them.  What is found is exact once the last distance is
    within the cell width; the places for which it isn't go on with cells twice as wide, so the number of rounds is the logarithm of
    the extent.  A scene with fewer than k other points gives all it has.  farthest: neighbours beyond it aren't asked for.
    """
    axes, one = [F.col(c).cast("double").alias(c) for c in "xyz"], left is right and other
    left, n, hashed = left.select("scene", "id", *axes), k + other, F.xxhash64(*PLACE).alias("__hash")
    right = cut(_few_of_a_place(right.select("scene", "id", *axes).dropna(), n), "knn-right")
    if one:
        least = right.agg(*[F.min(F.when(F.col(c) != 0, F.abs(c))) for c in "xyz"]).first()
        one = all(x is None or x >= TINY for x in least)
    crowds = right.filter(F.col("__n") == n).select(hashed, *PLACE, "__ids") if one else None
    asked = places = right.filter(F.col("__n") < n).select(*PLACE, "__ids") if one else cut(left.select(*PLACE).dropna().distinct(), "knn-places")
    right, done, found = right.select(*PLACE, "id"), None, None
    if not one or not asked.isEmpty():
        h, side = _widths(right if one else places, right, farthest)
        while True:
            h = h if h * 2 < side else side
            full = F.lit(h >= side) | (F.size("near") == n) & (F.col("near")[n - 1]["dist"] <= SEEN * h)
            found = cut(_searched(asked, right, h, n, farthest).withColumn("full", F.coalesce(full, F.lit(False))), "knn")
            settled = found.filter("full").select(*places.columns, "near")
            done = settled if done is None else done.unionByName(settled)
            asked = found.filter("not full").select(*places.columns)
            if h >= side or asked.isEmpty():
                break
            h *= 2
        near = F.filter("near", lambda to: to["dst"] != F.col("id")) if other else F.col("near")
        rows = done.select("scene", F.explode("__ids").alias("id"), "near") if one else left.withColumn("__hash", hashed).join(done.withColumn("__hash", hashed), ["__hash", *PLACE])
        found = rows.select("scene", F.col("id").alias("src"), F.posexplode(F.slice(near, 1, k)).alias("rank", "to")).select("scene", "src", "to.dst", "to.dist", (F.col("rank") + 1).alias("rank"))
    if not one or found is not None and crowds.isEmpty():
        return found
    rows = left.withColumn("__hash", hashed).join(small(crowds, 4 * BROADCAST_ROWS // n), ["__hash", *PLACE])
    rows = rows.select("scene", F.col("id").alias("src"), F.posexplode(F.slice(F.array_remove("__ids", F.col("id")), 1, k)).alias("rank", "dst"))
    rows = rows.select("scene", "src", "dst", F.lit(0.0).alias("dist"), (F.col("rank") + 1).alias("rank"))
    return rows if found is None else found.unionByName(rows)


def nearest_of_class(left: DataFrame, right: DataFrame, farthest: float) -> DataFrame:
    """(scene, id, prior, dist): for each row of left the nearest of right of its scene and class, ties by id, up to the distance.

    Rows are (scene, class, id, x, y, z); scene and class together are the scene of the neighbour join, so no class is joined with all of itself.
    """
    key = F.to_json(F.struct("scene", "class")).alias("scene")
    near = knn(left.select(key, "id", *"xyz"), right.select(key, "id", *"xyz"), 1, farthest=farthest)
    here = left.select(key, F.col("scene").alias("of"), F.col("id").alias("src"))
    return near.join(here, ["scene", "src"]).select(F.col("of").alias("scene"), F.col("src").alias("id"), F.col("dst").alias("prior"), "dist")


def within(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """(scene, src, dst, dist) of all pairs of different ids up to the radius."""
    return near_pairs(left, right, radius).filter((F.col("dist") <= radius) & (F.col("src") != F.col("dst")))


def both_ways(edges: DataFrame) -> DataFrame:
    """The distinct edges (scene, src, dst) and their opposites."""
    one = edges.select("scene", "src", "dst")
    return one.unionByName(one.select("scene", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def capped(edges: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """(scene, src, dst, rank): the k nearest edges (scene, src, dst, dist) of each source that `known` doesn't have, ties by id."""
    place = F.row_number().over(W.partitionBy("scene", "src").orderBy("dist", "dst"))
    return edges.join(known, ["scene", "src", "dst"], "left_anti").withColumn("rank", place).filter(F.col("rank") <= k).select("scene", "src", "dst", "rank")


def near_beyond(points: DataFrame, known: DataFrame, k: int, radius: float) -> DataFrame:
    """(scene, src, dst, rank): of each point the k nearest up to the radius that it has no edge (scene, src, dst) of `known` to, ties by id.

    These are among its k + m nearest, m being the most known edges that a point has, so a crowd within the radius makes no pairs of all its points.
    """
    most = known.groupBy("scene", "src").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    return capped(knn(points, points, k + most, other=True, farthest=radius).drop("rank"), known, k)


def face_adjacency(corners: DataFrame) -> DataFrame:
    """(src, dst), both ways: groups that meet in a face, of rows (face, group); a face has few corners."""
    one = corners.select("face", F.col("group").alias("src")).distinct()
    return one.join(one.select("face", F.col("src").alias("dst")), "face").filter("src != dst").select("src", "dst").distinct()


def transferred(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """(scene, id, nearest, columns): each row of left with the columns of its nearest row of right."""
    named = right.select("scene", F.col("id").alias("dst"), *columns)
    return knn(left, right, 1).join(named, ["scene", "dst"]).select("scene", F.col("src").alias("id"), F.col("dst").alias("nearest"), *columns)
