"""Queries on vectors over neighbour graphs, on partitions by energy and on linkage trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.plans import cut
from ..operators import cluster, delaunay, fidelity, hierarchy, pursuit, vectors
from ..sources.fixtures import POINTS, points, table
from .neighbours import COMPARED, DIST, SP_FEATURES, edges, edges_sql, ids

IN, OUT, HEAD, STRENGTH = 10, 15, 8, 0.05
RADIUS, LONGEST = 0.2, 0.25


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with vectors: parts of the embeddings."""
    e = table(spark, sf_dir, "embeddings")
    part = lambda at, n: F.transform(F.slice("embedding", at, n), lambda x: x.cast("double"))
    return e.select(F.col("label").alias("scene"), F.col("vec_id").alias("id"), part(1, IN).alias("features"), part(11, HEAD).alias("query"), part(21, HEAD).alias("key"), part(31, HEAD).alias("value"))


def entries(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """A row per entry of an array, rounded."""
    return df.select(*keys, F.posexplode(column).alias("entry", "x")).select(*keys, F.col("entry").cast("long").alias("entry"), F.round("x", 6).alias("x"))


def edge_conditioned_convolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10 to 15 channels; an edge's matrix belongs to the sum of its ends' ids modulo 7, so that edges share matrices; edges into every fifth node are left out, which gives zeros there."""
    e = edges(spark, sf_dir, 3).filter("dst % 5 != 0").withColumn("filter", (F.col("src") + F.col("dst")) % 7)
    matrix = F.transform(F.sequence(F.lit(0), F.lit(IN * OUT - 1)), lambda k: ((k * 3 + F.col("filter") * 5) % 11 - 5).cast("double") / 10)
    filters = points(spark, sf_dir).select("scene").distinct().withColumn("filter", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long")))).select("scene", "filter", matrix.alias("matrix"))
    found = vectors.edge_conditioned_mean(e, embedded(spark, sf_dir), "features", OUT, filters)
    return entries(found, ["scene", "id"], "mean")


def vector_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means and largest entries of pools; pools 8 and 9 are empty."""
    n = embedded(spark, sf_dir)
    members = n.select("scene", (F.col("id") % 8).alias("pool"), "id")
    pools = n.select("scene").distinct().withColumn("pool", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))))
    both = [entries(vectors.pooled(members, n, pools, "features", IN, how), ["scene", "pool"], "pooled").withColumnRenamed("x", name) for how, name in ((F.avg, "mean"), (F.max, "top"))]
    return both[0].join(both[1], ["scene", "pool", "entry"])


def _attention(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return vectors.dot_attention(cut(edges(spark, sf_dir, 5)), embedded(spark, sf_dir), HEAD, 1 + F.col("dist"))


def vector_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each node gathers from its five nearest by the products of queries and keys, scaled by their distance."""
    return entries(_attention(spark, sf_dir)[1], ["scene", "id"], "attended")


def edge_affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attention(spark, sf_dir)[0].select("scene", "src", "dst", F.round("affinity", 6).alias("affinity"))


def distribution(name: str = "id") -> Column:
    """Three shares that add up to 1, by a node's id."""
    share = [(F.col(name) * m % p + 1).cast("double") for m, p in ((7, 5), (5, 7), (3, 11))]
    return F.array(*[s / (share[0] + share[1] + share[2]) for s in share])


def partition_energies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit and border of the superpoints as a partition, by three fidelities."""
    p = ids(points(spark, sf_dir))
    e = cut(edges(spark, sf_dir, 5)).withColumn("weight", 1 / (1 + F.col("dist")))
    n = p.select("scene", "id", distribution().alias("value"), (1 + F.col("id") % 3).cast("double").alias("weight"))
    parts = p.select("scene", "id", F.col("sp").alias("region"))
    found = [pursuit.energies(e, n, parts, STRENGTH, f).withColumn("fidelity", F.lit(name)) for name, f in (("squared", fidelity.SQUARED), ("divergence", fidelity.divergence(0.1)), ("linear", fidelity.LINEAR))]
    every = found[0].unionByName(found[1]).unionByName(found[2])
    return every.select("fidelity", "scene", *[F.round(c, 6).alias(c) for c in ("fit", "cut", "energy")])


def _partition(spark: SparkSession, sf_dir: str, of: fidelity.Fidelity, strength: float) -> DataFrame:
    e = cut(edges(spark, sf_dir, 5)).withColumn("weight", 1 / (1 + F.col("dist")))
    return pursuit.cut_pursuit(e, ids(points(spark, sf_dir)).select("scene", "id", distribution().alias("value")), strength, of, rounds=3)


def divergence_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of near distributions."""
    return _partition(spark, sf_dir, fidelity.divergence(0.1), STRENGTH)


def label_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of one label."""
    return _partition(spark, sf_dir, fidelity.LINEAR, 0.1)


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in the part of superpoints, linked to their five nearest; a soft label from three shares."""
    leaves = ids(points(spark, sf_dir)).select("scene", "id", (20 + F.col("id") % 9).alias("count"), distribution().alias("soft"))
    pairs = edges(spark, sf_dir, 5).select("scene", F.col("src").alias("a"), F.col("dst").alias("b"), "dist")
    return cut(hierarchy.merge_tree(cut(pairs), cut(leaves)))


def linkage_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The average-linkage tree of each scene's neighbour graph."""
    return _tree(spark, sf_dir)


def tree_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaves of the topmost clusters below a height, as proposals of five or more."""
    tree = _tree(spark, sf_dir)
    found = hierarchy.top_clusters(tree, tree.filter(F.col("height") < 0.2).select("scene", "node"))
    return hierarchy.proposals(points(spark, sf_dir), found, "point_idx", 5)


def delaunay_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the tetrahedra of bounded circumradius."""
    found = delaunay.delaunay_edges(ids(points(spark, sf_dir)), RADIUS)
    return found.select("scene", "src", "dst", F.round("length", 6).alias("length"))


def delaunay_dual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short Delaunay edges both ways and the three nearest neighbours."""
    found = cut(delaunay.delaunay_edges(ids(points(spark, sf_dir)), RADIUS))
    return delaunay.with_nearest(found, edges(spark, sf_dir, 3), LONGEST)


def delaunay_superedges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Superedges of the superpoints over short Delaunay edges, both ways."""
    p = points(spark, sf_dir)
    both = delaunay.with_nearest(cut(delaunay.delaunay_edges(ids(p), RADIUS)), None, LONGEST)
    found = cluster.superedges(cut(both), p, "sp", LONGEST)
    return found.select("scene", "a", "b", "edges", *[F.round(c, 6).alias(c) for c in found.columns[4:]])


QUERIES = {f.__name__: f for f in (edge_conditioned_convolution, vector_pools, vector_attention, edge_affinity, partition_energies, divergence_partition, label_partition, linkage_tree, tree_proposals, delaunay_neighbours, delaunay_dual, delaunay_superedges)}

_NODES = f"""n AS (SELECT label AS scene, vec_id AS id, CAST(embedding[1:{IN}] AS DOUBLE[]) AS f, CAST(embedding[11:{10 + HEAD}] AS DOUBLE[]) AS q, CAST(embedding[21:{20 + HEAD}] AS DOUBLE[]) AS k, CAST(embedding[31:{30 + HEAD}] AS DOUBLE[]) AS v FROM embeddings)"""
_ATTENTION = f"""{POINTS}, {edges_sql(5)}, {_NODES}, s AS (SELECT e.scene, e.src, e.dst, list_inner_product(a.q, b.k) / sqrt(CAST({HEAD} AS DOUBLE)) * (1 + e.dist) AS s, b.v FROM edges e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst),
    w AS (SELECT *, exp(s - max(s) OVER (PARTITION BY scene, src)) AS e FROM s), z AS (SELECT *, e / sum(e) OVER (PARTITION BY scene, src) AS affinity FROM w)"""
_SQUARE = {"u": "(ux * ux + uy * uy + uz * uz)", "v": "(vx * vx + vy * vy + vz * vz)", "w": "(wx * wx + wy * wy + wz * wz)"}
_TURN = {"x": ("y", "z"), "y": ("z", "x"), "z": ("x", "y")}
_CROSS = lambda a, b, c: f"({a}{_TURN[c][0]} * {b}{_TURN[c][1]} - {a}{_TURN[c][1]} * {b}{_TURN[c][0]})"
#: All tetrahedra of points within two radii of each other, the centres of their spheres, and those without a point inside.
_DELAUNAY = f"""g AS (SELECT a.scene, a.point_idx AS a, b.point_idx AS b FROM points a JOIN points b ON a.scene = b.scene AND a.point_idx < b.point_idx WHERE {DIST} <= {2 * RADIUS}),
    q0 AS (SELECT ab.scene, ab.a, ab.b, ac.b AS c, ad.b AS d FROM g ab JOIN g ac ON ac.a = ab.a AND ac.b > ab.b JOIN g bc ON bc.a = ab.b AND bc.b = ac.b JOIN g ad ON ad.a = ab.a AND ad.b > ac.b JOIN g bd ON bd.a = ab.b AND bd.b = ad.b JOIN g cd ON cd.a = ac.b AND cd.b = ad.b),
    q1 AS (SELECT q0.*, p.x, p.y, p.z, {", ".join(f"{o}.{e} - p.{e} AS {o}{e}" for o in "uvw" for e in "xyz")} FROM q0 JOIN points p ON p.point_idx = a JOIN points u ON u.point_idx = b JOIN points v ON v.point_idx = c JOIN points w ON w.point_idx = d),
    q2 AS (SELECT *, 2 * (ux * {_CROSS("v", "w", "x")} + uy * {_CROSS("v", "w", "y")} + uz * {_CROSS("v", "w", "z")}) AS det FROM q1),
    q3 AS (SELECT *, {", ".join(f"({_SQUARE['u']} * {_CROSS('v', 'w', e)} + {_SQUARE['v']} * {_CROSS('w', 'u', e)} + {_SQUARE['w']} * {_CROSS('u', 'v', e)}) / det AS t{e}" for e in "xyz")} FROM q2 WHERE det <> 0),
    q4 AS (SELECT *, tx * tx + ty * ty + tz * tz AS r FROM q3 WHERE tx * tx + ty * ty + tz * tz <= {RADIUS * RADIUS}),
    q AS (SELECT * FROM q4 WHERE NOT EXISTS (SELECT 1 FROM points o WHERE o.scene = q4.scene AND o.point_idx NOT IN (a, b, c, d) AND pow(o.x - q4.x - tx, 2) + pow(o.y - q4.y - ty, 2) + pow(o.z - q4.z - tz, 2) < r)),
    de AS (SELECT DISTINCT s.scene, src, dst, {DIST} AS length FROM (SELECT scene, unnest([a, a, a, b, b, c]) AS src, unnest([b, c, d, c, d, d]) AS dst FROM q) s JOIN points a ON a.point_idx = src JOIN points b ON b.point_idx = dst),
    dw AS (SELECT scene, src, dst FROM de WHERE length < {LONGEST} UNION SELECT scene, dst, src FROM de WHERE length < {LONGEST})"""
_SIDES = ", ".join([f"round(avg(a.{c} - b.{c}), 6) AS mean_{c}" for c in "xyz"] + [f"round(stddev_pop(a.{c} - b.{c}), 6) AS std_{c}" for c in "xyz"])
_SHARES = "[v / (p[1] + p[2] + p[3]) FOR v IN p]"
_FIT = {
    "squared": "sum(CAST(0.5 AS DOUBLE) * w * pow(y - c, 2))",
    "divergence": "sum(w * (CAST(0.1 AS DOUBLE) / 3 + CAST(0.9 AS DOUBLE) * y) * (ln(CAST(0.1 AS DOUBLE) / 3 + CAST(0.9 AS DOUBLE) * y) - ln(CAST(0.1 AS DOUBLE) / 3 + CAST(0.9 AS DOUBLE) * c)))",
    "linear": "-sum(CASE WHEN i = best THEN w * y ELSE 0 END)",
}
ORACLES = {
    "edge_conditioned_convolution": f"""WITH {POINTS}, {edges_sql(3)}, {_NODES}, c AS (SELECT unnest(range({OUT})) AS j), i AS (SELECT unnest(range({IN})) AS i),
        s AS (SELECT e.dst AS id, j, e.src, sum(a.f[i + 1] * ((((i * {OUT} + j) * 3 + (e.src + e.dst) % 7 * 5) % 11 - 5) / CAST(10 AS DOUBLE))) AS x FROM edges e JOIN n a ON a.id = e.src, c, i WHERE e.dst % 5 <> 0 GROUP BY e.dst, j, e.src),
        m AS (SELECT id, j, avg(x) AS x FROM s GROUP BY id, j) SELECT n.scene, n.id, c.j AS entry, round(coalesce(m.x, 0), 6) AS x FROM n CROSS JOIN c LEFT JOIN m ON m.id = n.id AND m.j = c.j""",
    "vector_pools": f"""WITH {_NODES}, i AS (SELECT unnest(range({IN})) AS i), g AS (SELECT DISTINCT scene, unnest(range(10)) AS pool FROM n), m AS (SELECT scene, id % 8 AS pool, i, avg(f[i + 1]) AS mean, max(f[i + 1]) AS top FROM n, i GROUP BY scene, id % 8, i)
        SELECT g.scene, g.pool, i.i AS entry, round(coalesce(m.mean, 0), 6) AS mean, round(coalesce(m.top, 0), 6) AS top FROM g CROSS JOIN i LEFT JOIN m ON m.scene = g.scene AND m.pool = g.pool AND m.i = i.i""",
    "vector_attention": f"WITH {_ATTENTION}, i AS (SELECT unnest(range({HEAD})) AS i) SELECT scene, src AS id, i AS entry, round(sum(affinity * v[i + 1]), 6) AS x FROM z, i GROUP BY scene, src, i",
    "edge_affinity": f"WITH {_ATTENTION} SELECT scene, src, dst, round(affinity, 6) AS affinity FROM z",
    "partition_energies": f"""WITH {POINTS}, {edges_sql(5)}, r AS (SELECT scene, point_idx AS id, sp, CAST(1 + point_idx % 3 AS DOUBLE) AS w, CAST([point_idx * 7 % 5 + 1, point_idx * 5 % 7 + 1, point_idx * 3 % 11 + 1] AS DOUBLE[]) AS p FROM points),
        v AS (SELECT scene, id, sp, w, i, ({_SHARES})[i] AS y FROM r, (SELECT unnest([1, 2, 3]) AS i)), c AS (SELECT scene, sp, i, sum(w * y) / sum(w) AS c, sum(w * y) AS t FROM v GROUP BY scene, sp, i),
        b AS (SELECT scene, sp, i AS best FROM (SELECT *, row_number() OVER (PARTITION BY scene, sp ORDER BY t DESC, i) AS k FROM c) WHERE k = 1), j AS (SELECT v.*, c.c, b.best FROM v JOIN c USING (scene, sp, i) JOIN b USING (scene, sp)),
        f AS ({" UNION ALL ".join(f"SELECT '{name}' AS fidelity, scene, {sql} AS fit FROM j GROUP BY scene" for name, sql in _FIT.items())}),
        x AS (SELECT e.scene, CAST({STRENGTH} AS DOUBLE) * sum(1 / (1 + e.dist)) AS cut FROM edges e JOIN points a ON a.point_idx = e.src JOIN points b ON b.point_idx = e.dst WHERE a.sp <> b.sp GROUP BY e.scene)
        SELECT f.fidelity, f.scene, round(f.fit, 6) AS fit, round(coalesce(x.cut, 0), 6) AS cut, round(f.fit + coalesce(x.cut, 0), 6) AS energy FROM f LEFT JOIN x USING (scene)""",
    "delaunay_neighbours": f"WITH {POINTS}, {_DELAUNAY} SELECT scene, src, dst, round(length, 6) AS length FROM de",
    "delaunay_dual": f"WITH {POINTS}, {_DELAUNAY}, {edges_sql(3)} SELECT * FROM dw UNION SELECT scene, src, dst FROM edges",
    "delaunay_superedges": f"""WITH {POINTS}, {_DELAUNAY}, {SP_FEATURES}, s AS (SELECT e.scene, a.sp AS a, b.sp AS b, count(*) AS edges, {_SIDES}, round(avg({DIST}), 6) AS delta_norm
        FROM dw e JOIN points a ON a.scene = e.scene AND a.point_idx = e.src JOIN points b ON b.scene = e.scene AND b.point_idx = e.dst WHERE a.sp <> b.sp GROUP BY e.scene, a.sp, b.sp)
        SELECT s.*, {COMPARED.format(6)} FROM s JOIN features u ON u.scene = s.scene AND u.sp = s.a JOIN features v ON v.scene = s.scene AND v.sp = s.b""",
}
