"""Queries on voxel grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import prepare, voxel
from ..sources.fixtures import CLOUD, POINTS, cloud, points, table

SIZE, WIDE = 0.05, 5.0


def cells_sql(source: str, size: float) -> str:
    cells = ", ".join(f"CAST(floor(({a} - min({a}) OVER s) / {size}) AS BIGINT) AS v{a}" for a in "xyz")
    return f"cells AS (SELECT *, {cells} FROM {source} WINDOW s AS (PARTITION BY scene))"


def voxel_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = voxel.downsampled(points(spark, sf_dir), SIZE, "noisy")
    return found.select("scene", *voxel.CELL, "points", *[F.round(f"mean_{a}", 6).alias(f"mean_{a}") for a in "xyz"], "label")


def voxel_label_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxel.label_histogram(cloud(spark, sf_dir), WIDE, "label")


def voxel_majority_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxel.downsampled(cloud(spark, sf_dir), WIDE, "label").select("scene", *voxel.CELL, "points", "label")


def point_to_voxel_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxel.point_to_voxel(points(spark, sf_dir), SIZE)


def centre_and_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates less their scene's mean, and a value of 0 to 255 (here the point's id) scaled to -1 to 1."""
    found = prepare.centred(points(spark, sf_dir), ["scene", "point_idx"])
    return found.select("scene", "point_idx", *[F.round(a, 6).alias(a) for a in "xyz"], F.round(prepare.byte_to_unit(F.col("point_idx") % 256), 6).alias("r"))


def crop_largest_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxel.largest_block(cloud(spark, sf_dir), 5000)


def hash_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the rows, which the seven values tell apart."""
    cents = [F.round(F.col(c) * 100).cast("long").alias(c) for c in ("l_quantity", "l_extendedprice", "l_discount")]
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 4).alias("scene"), *keys, *cents)
    return voxel.hash_subsample(rows, rows.columns[1:])


QUERIES = {f.__name__: f for f in (voxel_downsample, voxel_label_histogram, voxel_majority_label, point_to_voxel_map, centre_and_scale, crop_largest_block, hash_subsample)}

MAJORITY = """SELECT scene, vx, vy, vz, label FROM (SELECT scene, vx, vy, vz, {0} AS label, row_number() OVER (PARTITION BY scene, vx, vy, vz ORDER BY {0} = 0, count(*) DESC, {0}) AS k
  FROM cells GROUP BY scene, vx, vy, vz, {0}) WHERE k = 1"""

ORACLES = {
    "voxel_downsample": f"""WITH {POINTS}, {cells_sql("points", SIZE)}, m AS ({MAJORITY.format("noisy")}),
        v AS (SELECT scene, vx, vy, vz, count(*) AS points, round(avg(x), 6) AS mean_x, round(avg(y), 6) AS mean_y, round(avg(z), 6) AS mean_z FROM cells GROUP BY ALL)
        SELECT v.*, m.label FROM v JOIN m USING (scene, vx, vy, vz)""",
    "voxel_label_histogram": f"WITH {CLOUD}, {cells_sql('cloud', WIDE)} SELECT scene, vx, vy, vz, label, count(*) AS n FROM cells GROUP BY ALL",
    "voxel_majority_label": f"""WITH {CLOUD}, {cells_sql("cloud", WIDE)}, m AS ({MAJORITY.format("label")})
        SELECT scene, vx, vy, vz, points, m.label FROM (SELECT scene, vx, vy, vz, count(*) AS points FROM cells GROUP BY ALL) JOIN m USING (scene, vx, vy, vz)""",
    "point_to_voxel_map": f"""WITH {POINTS}, {cells_sql("points", SIZE)}, f AS (SELECT scene, vx, vy, vz, row_number() OVER (PARTITION BY scene ORDER BY min(point_idx)) - 1 AS voxel_id FROM cells GROUP BY scene, vx, vy, vz)
        SELECT scene, point_idx, voxel_id FROM cells JOIN f USING (scene, vx, vy, vz)""",
    "centre_and_scale": f"""WITH {POINTS} SELECT scene, point_idx, {", ".join(f"round({a} - avg({a}) OVER (PARTITION BY scene), 6) AS {a}" for a in "xyz")},
        round(point_idx % 256 / CAST(127.5 AS DOUBLE) - 1, 6) AS r FROM points""",
    "crop_largest_block": f"""WITH {CLOUD}, e AS (SELECT scene, (min(x) + max(x)) / 2 AS cx, (max(x) - min(x)) / 2 AS hx, (min(y) + max(y)) / 2 AS cy, (max(y) - min(y)) / 2 AS hy FROM cloud GROUP BY scene),
        s AS (SELECT e.scene, step, (SELECT count(*) FROM cloud c WHERE c.scene = e.scene AND ceil(greatest(abs(x - cx) / hx * 20, abs(y - cy) / hy * 20)) <= step) AS points FROM e, range(20) t(step))
        SELECT scene, max(step) AS step, max_by(points, step) AS points FROM s WHERE points <= 5000 GROUP BY scene""",
    "hash_subsample": """WITH r AS (SELECT l_suppkey % 4 AS scene, l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_quantity * 100) AS BIGINT) AS l_quantity, CAST(round(l_extendedprice * 100) AS BIGINT) AS l_extendedprice, CAST(round(l_discount * 100) AS BIGINT) AS l_discount FROM lineitem),
        k AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY md5(concat_ws(':', 's', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount)), l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount) AS k, count(*) OVER (PARTITION BY scene) AS n FROM r)
        SELECT * EXCLUDE (k, n) FROM k WHERE k <= n // 4""",
}
