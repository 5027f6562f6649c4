"""Queries on labels, instances, superpoints and metric series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import labels, series, voxel
from ..sources.fixtures import POINTS, points, table
from .voxels import cells_sql

SIZE = 0.05


def superpoint_mode_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each point with the majority of its superpoint."""
    p = points(spark, sf_dir)
    return p.select("scene", "point_idx", "sp").join(labels.mode_label(p, "sp", "noisy"), ["scene", "sp"])


def soft_label_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).withColumn("noisy", F.when(F.col("point_idx") % 7 == 0, labels.IGNORED).otherwise(F.col("noisy")))
    return labels.soft_histogram(p, "sp", "noisy").withColumn("share", F.round("share", 6))


def partly_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).withColumn("ins", F.when(F.col("point_idx") % 5 == 0, labels.IGNORED).otherwise(F.col("ins")))


PARTLY = "partly AS (SELECT * REPLACE (CASE WHEN point_idx % 5 = 0 THEN -100 ELSE ins END AS ins) FROM points)"


def instance_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = labels.instance_info(partly_labelled(spark, sf_dir), "ins")
    return found.select("scene", "point_idx", "ins", *[F.round(f"{n}_{a}", 6).alias(f"{n}_{a}") for n in ("mean", "min", "max") for a in "xyz"], F.col("size").cast("long").alias("size"))


def superpoint_centroid_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = labels.centre_offsets(points(spark, sf_dir), "sp", "ins")
    return found.select("scene", "sp", *[F.round(f"o{a}", 6).alias(f"o{a}") for a in "xyz"])


def instance_size_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return p.select("scene", "point_idx", "ins").join(labels.instance_reach(p, "ins"), ["scene", "ins"]).withColumn("reach", F.round("reach", 6))


def instance_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.occupancy(voxel.with_cells(partly_labelled(spark, sf_dir), SIZE), "ins", voxel.CELL)


def weak_label_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = labels.weak_label_report(points(spark, sf_dir), "sem", F.when(F.col("point_idx") % 5 == 0, F.col("noisy")).otherwise(labels.IGNORED))
    return found.withColumns({c: F.round(c, 6) for c in ("coverage", "accuracy")})


def weighted_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three points of each class of a scene, likelier the farther they are from the middle."""
    u = (F.conv(F.substring(F.md5(F.col("point_idx").cast("string")), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    weight = F.abs("x") + F.abs("y") + F.abs("z") + 0.001
    return labels.weighted_sample(points(spark, sf_dir).select("scene", "sem", "point_idx", *"xyz"), ["scene", "sem"], weight, u, 3).select("scene", "sem", "point_idx")


def gt_instance_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """class * 1000 + instance + 1, the class being the majority of the instance; 0 without an instance."""
    p = partly_labelled(spark, sf_dir)
    mode = labels.mode_label(p.filter(F.col("ins") != labels.IGNORED), "ins", "noisy")
    return labels.instance_codes(p, "ins", mode).select("scene", "point_idx", "code")


def discriminative_loss_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.discriminative_terms(points(spark, sf_dir), "ins").select("scene", *[F.round(c, 6).alias(c) for c in ("variance", "separation", "size")])


def metric_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value", (1.0 + F.col("event_id") % 3).alias("weight"))


def running_metric_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = series.running(metric_series(spark, sf_dir), "user_id", ["ts", "event_id"], "value", "weight", 5)
    return found.select("user_id", "event_id", F.round("mean", 5).alias("mean"), F.round("total", 5).alias("total"))


def running_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = series.running(metric_series(spark, sf_dir), "user_id", ["ts", "event_id"], "value", "weight", 5)
    return found.select("user_id", "event_id", F.round("median", 5).alias("median"))


def series_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = series.summary(metric_series(spark, sf_dir), "user_id", ["ts", "event_id"], "value", "weight")
    return found.select("user_id", "latest", F.round("mean", 5).alias("mean"), "n")


QUERIES = {
    f.__name__: f
    for f in (
        superpoint_mode_label, soft_label_histogram, instance_info, superpoint_centroid_offset, instance_size_broadcast, instance_occupancy, weak_label_report, weighted_sample,
        gt_instance_encoding, discriminative_loss_terms, running_metric_window, running_median, series_summary,
    )
}

_MODE = "SELECT scene, {0}, label FROM (SELECT scene, {0}, {1} AS label, row_number() OVER (PARTITION BY scene, {0} ORDER BY count(*) DESC, {1}) AS k FROM {2} GROUP BY scene, {0}, {1}) WHERE k = 1"
_INFO = ", ".join(f"round(CASE WHEN ins = -100 THEN -100 ELSE {f}({a}) OVER w END, 6) AS {n}_{a}" for n, f in (("mean", "avg"), ("min", "min"), ("max", "max")) for a in "xyz")
_MEANS = "means AS (SELECT scene, ins, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM points GROUP BY scene, ins)"
_GAP = "sqrt((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz))"
_SERIES = "s AS (SELECT user_id, ts, event_id, value, 1 + event_id % 3 AS weight FROM events)"
_FRAME = "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
ORACLES = {
    "superpoint_mode_label": f"WITH {POINTS}, m AS ({_MODE.format('sp', 'noisy', 'points')}) SELECT scene, sp, point_idx, label FROM points JOIN m USING (scene, sp)",
    "soft_label_histogram": f"""WITH {POINTS}, c AS (SELECT scene, sp, CAST(CASE WHEN point_idx % 7 = 0 THEN -100 ELSE noisy END AS BIGINT) AS label, count(*) AS n FROM points GROUP BY ALL)
        SELECT scene, sp, label, round(n / CAST(sum(n) OVER (PARTITION BY scene, sp) AS DOUBLE), 6) AS share FROM c""",
    "instance_info": f"WITH {POINTS}, {PARTLY} SELECT scene, point_idx, ins, {_INFO}, CASE WHEN ins = -100 THEN -100 ELSE count(*) OVER w END AS size FROM partly WINDOW w AS (PARTITION BY scene, ins)",
    "superpoint_centroid_offset": f"""WITH {POINTS}, m AS ({_MODE.format("sp", "ins", "points")}), {_MEANS}, p AS (SELECT scene, sp, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM points GROUP BY scene, sp)
        SELECT scene, sp, round(mx - x, 6) AS ox, round(my - y, 6) AS oy, round(mz - z, 6) AS oz FROM p JOIN m USING (scene, sp) JOIN means w ON w.scene = p.scene AND w.ins = m.label""".replace("SELECT scene, sp, round(mx", "SELECT p.scene, p.sp, round(mx"),
    "instance_size_broadcast": f"WITH {POINTS}, {_MEANS} SELECT scene, ins, point_idx, round(max({_GAP}) OVER (PARTITION BY scene, ins), 6) AS reach FROM points JOIN means USING (scene, ins)",
    "instance_occupancy": f"WITH {POINTS}, {PARTLY}, {cells_sql('partly', SIZE)} SELECT scene, ins, count(DISTINCT (vx, vy, vz)) AS voxels FROM cells GROUP BY scene, ins",
    "weak_label_report": f"""WITH {POINTS}, g AS (SELECT *, CASE WHEN point_idx % 5 = 0 THEN noisy ELSE -100 END AS given FROM points)
        SELECT count(*) AS points, count(*) FILTER (given <> -100) AS labelled, count(*) FILTER (given <> -100 AND given = sem) AS "right",
        round(count(*) FILTER (given <> -100) / CAST(count(*) AS DOUBLE), 6) AS coverage, round(count(*) FILTER (given <> -100 AND given = sem) / CAST(count(*) FILTER (given <> -100) AS DOUBLE), 6) AS accuracy FROM g""",
    "weighted_sample": f"""WITH {POINTS}, k AS (SELECT scene, sem, point_idx, row_number() OVER (PARTITION BY scene, sem ORDER BY
        -ln((CAST(CAST('0x' || substr(md5(CAST(point_idx AS VARCHAR)), 1, 8) AS BIGINT) AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)) / (abs(x) + abs(y) + abs(z) + CAST(0.001 AS DOUBLE))) AS k FROM points)
        SELECT scene, sem, point_idx FROM k WHERE k <= 3""",
    "gt_instance_encoding": f"""WITH {POINTS}, {PARTLY}, labelled AS (SELECT * FROM partly WHERE ins <> -100), m AS ({_MODE.format("ins", "noisy", "labelled")})
        SELECT scene, point_idx, coalesce(label * 1000 + ins + 1, 0) AS code FROM partly LEFT JOIN m USING (scene, ins)""",
    "discriminative_loss_terms": f"""WITH {POINTS}, {_MEANS}, v AS (SELECT scene, ins, avg(greatest({_GAP} - CAST(0.1 AS DOUBLE), 0) * greatest({_GAP} - CAST(0.1 AS DOUBLE), 0)) AS v FROM points JOIN means USING (scene, ins) GROUP BY scene, ins),
        d AS (SELECT a.scene, avg(power(greatest(3 - abs(a.mx - b.mx) - abs(a.my - b.my) - abs(a.mz - b.mz), 0), 2)) AS d FROM means a JOIN means b ON a.scene = b.scene AND a.ins <> b.ins GROUP BY a.scene)
        SELECT m.scene, round((SELECT avg(v) FROM v WHERE v.scene = m.scene), 6) AS variance, round(coalesce((SELECT d FROM d WHERE d.scene = m.scene), 0), 6) AS separation, round(avg(sqrt(mx * mx + my * my + mz * mz)), 6) AS size FROM means m GROUP BY m.scene""",
    "running_metric_window": f"WITH {_SERIES} SELECT user_id, event_id, round(sum(value * weight) OVER w / sum(weight) OVER w, 5) AS mean, round(sum(value) OVER w, 5) AS total FROM s {_FRAME}",
    "running_median": f"WITH {_SERIES} SELECT user_id, event_id, round(median(value) OVER w, 5) AS median FROM s {_FRAME}",
    "series_summary": f"WITH {_SERIES} SELECT user_id, max_by(value, (ts, event_id)) AS latest, round(sum(value * weight) / sum(weight), 5) AS mean, count(*) AS n FROM s GROUP BY user_id",
}
