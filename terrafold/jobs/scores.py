"""Queries on segmentation metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.plans import cut
from ..operators import metrics
from ..sources.fixtures import MASKS, masks, table


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return table(spark, sf_dir, "lineitem").select(code.alias("gt"), F.when(F.col("l_linestatus") == "F", 0).otherwise(1).alias("pred"))


CLASSES = "classes AS (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS gt, CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END AS pred FROM lineitem)"


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(classes(spark, sf_dir), "gt", "pred")


def semantic_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.semantic_iou(metrics.confusion(classes(spark, sf_dir), "gt", "pred"), [0, 1, 2]).select("class", F.round("iou", 6).alias("iou"))


def scene_masks(spark: SparkSession, sf_dir: str, parts: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ground truths, predictions (of LEAST_POINTS points or more) and their overlaps; a mask's class is its id modulo `parts`."""
    m = masks(spark, sf_dir)
    pairs = cut(m.groupBy("scene", "gt", "pred").agg(F.count(F.lit(1)).alias("n")))
    gts = pairs.groupBy("scene", "gt").agg(F.sum("n").alias("gt_size")).withColumn("class", F.col("gt") % parts)
    preds = pairs.groupBy("scene", "pred").agg(F.sum("n").alias("pred_size")).withColumn("class", F.col("pred") % parts)
    preds = preds.withColumn("conf", (F.col("pred") * 37 + F.col("scene") * 11) % 100 / 100.0).filter(F.col("pred_size") >= metrics.LEAST_POINTS)
    found = metrics.overlaps(m, F.col("gt") % parts, F.col("pred") % parts).filter(F.col("pred_size") >= metrics.LEAST_POINTS)
    return gts, preds, cut(found)


def scene_sql(parts: int = 3) -> str:
    return f"""{MASKS}, pairs AS (SELECT scene, gt, pred, count(*) AS common FROM masks GROUP BY ALL),
    gts AS (SELECT scene, gt, gt % {parts} AS class, CAST(sum(common) AS BIGINT) AS gt_size FROM pairs GROUP BY scene, gt),
    preds AS (SELECT scene, pred, pred % {parts} AS class, CAST(sum(common) AS BIGINT) AS pred_size, (pred * 37 + scene * 11) % 100 / CAST(100 AS DOUBLE) AS conf FROM pairs GROUP BY scene, pred HAVING sum(common) >= 100),
    found AS (SELECT scene, class, gt, pred, common, gt_size, pred_size, conf, common / CAST(gt_size + pred_size - common AS DOUBLE) AS iou FROM pairs JOIN gts USING (scene, gt) JOIN preds USING (scene, pred, class))"""


def instance_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scene_masks(spark, sf_dir)[2].select("scene", "class", "gt", "pred", "common", "gt_size", "pred_size", F.round("iou", 6).alias("iou"))


def instance_ap50(spark: SparkSession, sf_dir: str) -> DataFrame:
    gts, preds, found = scene_masks(spark, sf_dir)
    return metrics.average_precision(metrics.scored_matches(gts, preds, found, 0.5)).select("class", F.round("ap", 6).alias("ap"))


def instance_ap25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One class, so that predictions meet several ground truths and their order counts."""
    gts, preds, found = scene_masks(spark, sf_dir, 1)
    return metrics.average_precision(metrics.sequential_matches(gts, preds, found, 0.25)).select("class", F.round("ap", 6).alias("ap"))


EVALUATED = 2


def evaluated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """scene_masks without the last class, whose ground truth is void, and the void points of each prediction."""
    gts, preds, found = scene_masks(spark, sf_dir)
    void = masks(spark, sf_dir).filter(F.col("gt") % 3 >= EVALUATED).groupBy("scene", "pred").agg(F.count(F.lit(1)).alias("void"))
    known = F.col("class") < EVALUATED
    return gts.filter(known), preds.filter(known), found.filter(known), cut(void)


def instance_ap_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average precision over nine overlaps, at 0.5 and at 0.25, with void regions."""
    found = metrics.precision_table(*evaluated(spark, sf_dir))
    return found.select("class", *[F.round(c, 6).alias(c) for c in ("ap", "ap50", "ap25")])


def mean_ap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The means of the table over classes; classes without ground truth don't count."""
    found = metrics.precision_table(*evaluated(spark, sf_dir))
    return found.agg(*[F.round(F.avg(c), 6).alias(c) for c in ("ap", "ap50", "ap25")])


def instance_prec_recall_any_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall at an overlap of 0.5 of predictions of any size."""
    m = masks(spark, sf_dir)
    pairs = cut(m.groupBy("scene", "gt", "pred").agg(F.count(F.lit(1)).alias("n")))
    gts, preds = (pairs.groupBy("scene", c).agg(F.sum("n").alias("size")).withColumn("class", F.col(c) % 3) for c in ("gt", "pred"))
    found = metrics.precision_recall(gts, preds, metrics.overlaps(m, F.col("gt") % 3, F.col("pred") % 3))
    return found.select("class", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


def coverage_mcov_mwcov(spark: SparkSession, sf_dir: str) -> DataFrame:
    gts, _, found = scene_masks(spark, sf_dir)
    return metrics.coverage(gts, found).select("class", F.round("m_cov", 6).alias("m_cov"), F.round("mw_cov", 6).alias("mw_cov"))


def instance_prec_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    gts, preds, found = scene_masks(spark, sf_dir)
    return metrics.precision_recall(gts, preds, found).select("class", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


def pr_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.curve(table(spark, sf_dir, "lineitem").select("l_quantity", "l_returnflag"), "l_quantity", F.col("l_returnflag") == "R")
    return found.select("score", "tp", "n", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


def topk_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the label is among the 1, 3 and 5 highest of the values of the vector."""
    e = table(spark, sf_dir, "embeddings").select("label", F.col("embedding").alias("scores"))
    return e.select(*[F.round(F.avg(metrics.in_top(F.col("scores"), F.col("label"), k).cast("int")) * 100, 6).alias(f"top{k}") for k in (1, 3, 5)])


def per_class_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels")
    return rows.groupBy(F.col("quality").alias("class")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("quality") == F.col("toxic")).cast("int")) * 100, 6).alias("accuracy"))


QUERIES = {
    f.__name__: f
    for f in (confusion_matrix, semantic_iou, instance_overlap, instance_ap50, instance_ap25, instance_ap_table, mean_ap, coverage_mcov_mwcov, instance_prec_recall, instance_prec_recall_any_size, pr_curve, topk_accuracy, per_class_accuracy)
}

_TABLE = f"""{scene_sql()}, th AS (SELECT CAST(unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.25]) AS DOUBLE) AS t),
        void AS (SELECT scene, pred, sum(common) AS v FROM pairs WHERE gt % 3 >= 2 GROUP BY scene, pred), g AS (SELECT * FROM gts WHERE class < 2), q AS (SELECT * FROM preds WHERE class < 2),
        h AS (SELECT t, f.*, row_number() OVER (PARTITION BY t, scene, gt ORDER BY conf DESC) AS k FROM found f, th WHERE class < 2 AND iou > t),
        r AS (SELECT t, class, conf AS score, CASE WHEN k = 1 THEN 1 ELSE 0 END AS tp, CASE WHEN k = 1 THEN 0 ELSE 1 END AS fp, 0 AS missed FROM h WHERE gt_size >= 100
          UNION ALL SELECT t, class, NULL, 0, 0, 1 FROM g, th WHERE gt_size >= 100 AND NOT EXISTS (SELECT 1 FROM h WHERE h.t = th.t AND h.scene = g.scene AND h.gt = g.gt)
          UNION ALL SELECT t, class, conf, 0, 1, 0 FROM q, th WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.t = th.t AND h.scene = q.scene AND h.pred = q.pred)
            AND (coalesce((SELECT sum(common) FROM found f WHERE f.scene = q.scene AND f.pred = q.pred AND f.gt_size < 100), 0) + coalesce((SELECT v FROM void WHERE void.scene = q.scene AND void.pred = q.pred), 0)) / pred_size <= t),
        w AS (SELECT t, class, sum(tp) + sum(missed) AS real FROM r GROUP BY t, class), a AS (SELECT t, class, score, sum(tp) AS tp, sum(tp + fp) AS n FROM r WHERE score IS NOT NULL GROUP BY t, class, score),
        c AS (SELECT t, class, score, sum(tp) OVER o / CAST(sum(n) OVER o AS DOUBLE) AS p, sum(tp) OVER o / CAST(real AS DOUBLE) AS q FROM a JOIN w USING (t, class) WINDOW o AS (PARTITION BY t, class ORDER BY score DESC)),
        s AS (SELECT t, class, p * (coalesce(lag(q) OVER u, q) - coalesce(lead(q) OVER u, 0)) / 2 + CASE WHEN lead(q) OVER u IS NULL THEN q / 2 ELSE 0 END AS area FROM c WINDOW u AS (PARTITION BY t, class ORDER BY score)),
        b AS (SELECT t, class, CASE WHEN real > 0 THEN coalesce((SELECT sum(area) FROM s WHERE s.t = w.t AND s.class = w.class), 0) END AS ap FROM w),
        e AS (SELECT class, avg(ap) FILTER (t > 0.3) AS ap, max(ap) FILTER (t = 0.5) AS ap50, max(ap) FILTER (t < 0.3) AS ap25 FROM b GROUP BY class)"""
_TOP = ", ".join(f"round(avg(CASE WHEN ahead < {k} THEN 1 ELSE 0 END) * 100, 6) AS top{k}" for k in (1, 3, 5))
ORACLES = {
    "confusion_matrix": f"WITH {CLASSES} SELECT gt, pred, count(*) AS n FROM classes GROUP BY ALL",
    "semantic_iou": f"""WITH {CLASSES} SELECT k AS class, round((SELECT count(*) FROM classes WHERE gt = k AND pred = k) / greatest((SELECT count(*) FROM classes WHERE gt = k OR pred = k), 1) * CAST(100 AS DOUBLE), 6) AS iou
        FROM (VALUES (0), (1), (2)) t(k)""",
    "instance_overlap": f"WITH {scene_sql()} SELECT scene, class, gt, pred, common, gt_size, pred_size, round(iou, 6) AS iou FROM found",
    "instance_ap50": f"""WITH {scene_sql()}, h AS (SELECT *, row_number() OVER (PARTITION BY scene, gt ORDER BY conf DESC) AS k FROM found WHERE iou > CAST(0.5 AS DOUBLE)),
        r AS (SELECT class, conf AS score, CASE WHEN k = 1 THEN 1 ELSE 0 END AS tp, CASE WHEN k = 1 THEN 0 ELSE 1 END AS fp, 0 AS missed FROM h WHERE gt_size >= 100
          UNION ALL SELECT class, NULL, 0, 0, 1 FROM gts WHERE gt_size >= 100 AND NOT EXISTS (SELECT 1 FROM h WHERE h.scene = gts.scene AND h.gt = gts.gt)
          UNION ALL SELECT class, conf, 0, 1, 0 FROM preds WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.scene = preds.scene AND h.pred = preds.pred)
            AND coalesce((SELECT sum(common) FROM found f WHERE f.scene = preds.scene AND f.pred = preds.pred AND f.gt_size < 100), 0) / pred_size <= CAST(0.5 AS DOUBLE)),
        t AS (SELECT class, sum(tp) + sum(missed) AS real FROM r GROUP BY class), a AS (SELECT class, score, sum(tp) AS tp, sum(tp + fp) AS n FROM r WHERE score IS NOT NULL GROUP BY class, score),
        c AS (SELECT class, score, sum(tp) OVER w / CAST(sum(n) OVER w AS DOUBLE) AS p, sum(tp) OVER w / CAST(real AS DOUBLE) AS q FROM a JOIN t USING (class) WINDOW w AS (PARTITION BY class ORDER BY score DESC)),
        s AS (SELECT class, p * (coalesce(lag(q) OVER u, q) - coalesce(lead(q) OVER u, 0)) / 2 + CASE WHEN lead(q) OVER u IS NULL THEN q / 2 ELSE 0 END AS area FROM c WINDOW u AS (PARTITION BY class ORDER BY score))
        SELECT t.class, round(CASE WHEN real > 0 THEN coalesce((SELECT sum(area) FROM s WHERE s.class = t.class), 0) END, 6) AS ap FROM t""",
    "instance_ap25": f"""WITH RECURSIVE {scene_sql(1)}, o AS (SELECT scene, gt, pred, conf, row_number() OVER (PARTITION BY scene ORDER BY gt, pred) AS k FROM found WHERE iou > CAST(0.25 AS DOUBLE) AND gt_size >= 100),
        w AS (SELECT DISTINCT scene, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS gt, CAST(NULL AS DOUBLE) AS best, CAST([] AS BIGINT[]) AS used, CAST(NULL AS DOUBLE) AS wrong FROM gts UNION ALL
          SELECT scene, k, gt, CASE WHEN skip THEN b ELSE greatest(coalesce(b, conf), conf) END, CASE WHEN NOT skip AND b IS NULL THEN list_append(used, pred) ELSE used END, CASE WHEN NOT skip AND b IS NOT NULL THEN least(b, conf) END
          FROM (SELECT o.*, w.used, list_contains(w.used, o.pred) AS skip, CASE WHEN o.gt = w.gt THEN w.best END AS b FROM w JOIN o ON o.scene = w.scene AND o.k = w.k + 1)),
        m AS (SELECT scene, gt, max_by(best, k) AS best FROM w WHERE gt IS NOT NULL AND best IS NOT NULL GROUP BY scene, gt),
        r AS (SELECT best AS score, 1 AS tp, 0 AS fp, 0 AS missed FROM m UNION ALL SELECT wrong, 0, 1, 0 FROM w WHERE wrong IS NOT NULL
          UNION ALL SELECT NULL, 0, 0, 1 FROM gts WHERE gt_size >= 100 AND NOT EXISTS (SELECT 1 FROM m WHERE m.scene = gts.scene AND m.gt = gts.gt)
          UNION ALL SELECT conf, 0, 1, 0 FROM preds q WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.scene = q.scene AND f.pred = q.pred AND f.iou > CAST(0.25 AS DOUBLE))
            AND coalesce((SELECT sum(common) FROM found f WHERE f.scene = q.scene AND f.pred = q.pred AND f.gt_size < 100), 0) / pred_size <= CAST(0.25 AS DOUBLE)),
        t AS (SELECT sum(tp) + sum(missed) AS real FROM r), a AS (SELECT score, sum(tp) AS tp, sum(tp + fp) AS n FROM r WHERE score IS NOT NULL GROUP BY score),
        c AS (SELECT score, sum(tp) OVER d / CAST(sum(n) OVER d AS DOUBLE) AS p, sum(tp) OVER d / CAST((SELECT real FROM t) AS DOUBLE) AS q FROM a WINDOW d AS (ORDER BY score DESC)),
        s AS (SELECT p * (coalesce(lag(q) OVER u, q) - coalesce(lead(q) OVER u, 0)) / 2 + CASE WHEN lead(q) OVER u IS NULL THEN q / 2 ELSE 0 END AS area FROM c WINDOW u AS (ORDER BY score))
        SELECT CAST(0 AS BIGINT) AS class, round(sum(area), 6) AS ap FROM s""",
    "instance_ap_table": f"WITH {_TABLE} SELECT class, round(ap, 6) AS ap, round(ap50, 6) AS ap50, round(ap25, 6) AS ap25 FROM e",
    "mean_ap": f"WITH {_TABLE} SELECT round(avg(ap), 6) AS ap, round(avg(ap50), 6) AS ap50, round(avg(ap25), 6) AS ap25 FROM e",
    "instance_prec_recall_any_size": f"""WITH {MASKS}, pairs AS (SELECT scene, gt, pred, CAST(count(*) AS DOUBLE) AS n FROM masks GROUP BY ALL), s AS (SELECT *, sum(n) OVER (PARTITION BY scene, gt) AS a, sum(n) OVER (PARTITION BY scene, pred) AS b FROM pairs),
        r AS (SELECT gt % 3 AS class, count(DISTINCT (scene, pred)) AS tp FROM s WHERE gt % 3 = pred % 3 AND n / (a + b - n) > CAST(0.5 AS DOUBLE) GROUP BY 1)
        SELECT class, round(coalesce(tp, 0) / CAST(made AS DOUBLE), 6) AS precision, round(coalesce(tp, 0) / CAST(real AS DOUBLE), 6) AS recall FROM (SELECT gt % 3 AS class, count(DISTINCT (scene, gt)) AS real FROM pairs GROUP BY 1)
        JOIN (SELECT pred % 3 AS class, count(DISTINCT (scene, pred)) AS made FROM pairs GROUP BY 1) USING (class) LEFT JOIN r USING (class)""",
    "coverage_mcov_mwcov": f"""WITH {scene_sql()}, b AS (SELECT g.scene, g.class, g.gt, gt_size, coalesce((SELECT max(iou) FROM found f WHERE f.scene = g.scene AND f.gt = g.gt), 0) AS best FROM gts g),
        s AS (SELECT scene, class, avg(best) AS cov, sum(best * gt_size) / sum(gt_size) AS w_cov FROM b GROUP BY scene, class)
        SELECT class, round(avg(cov), 6) AS m_cov, round(avg(w_cov), 6) AS mw_cov FROM s GROUP BY class""",
    "instance_prec_recall": f"""WITH {scene_sql()}, r AS (SELECT class, count(DISTINCT (scene, pred)) AS tp FROM found WHERE iou > CAST(0.5 AS DOUBLE) GROUP BY class)
        SELECT g.class, round(coalesce(tp, 0) / CAST(made AS DOUBLE), 6) AS precision, round(coalesce(tp, 0) / CAST(g.n AS DOUBLE), 6) AS recall
        FROM (SELECT class, count(*) AS n FROM gts GROUP BY class) g LEFT JOIN (SELECT class, count(*) AS made FROM preds GROUP BY class) p USING (class) LEFT JOIN r USING (class)""",
    "pr_curve": """WITH a AS (SELECT l_quantity AS score, count(*) FILTER (l_returnflag = 'R') AS tp, count(*) AS n FROM lineitem GROUP BY 1)
        SELECT score, CAST(sum(tp) OVER w AS BIGINT) AS tp, CAST(sum(n) OVER w AS BIGINT) AS n, round(sum(tp) OVER w / CAST(sum(n) OVER w AS DOUBLE), 6) AS precision, round(sum(tp) OVER w / CAST(sum(tp) OVER () AS DOUBLE), 6) AS recall
        FROM a WINDOW w AS (ORDER BY score DESC)""",
    "topk_accuracy": f"WITH e AS (SELECT label, embedding, len(list_filter(range(1, len(embedding) + 1), lambda i: embedding[i] > embedding[label + 1] OR (embedding[i] = embedding[label + 1] AND i < label + 1))) AS ahead FROM embeddings) SELECT {_TOP} FROM e",
    "per_class_accuracy": "SELECT quality AS class, count(*) AS n, round(avg(CASE WHEN quality = toxic THEN 1 ELSE 0 END) * 100, 6) AS accuracy FROM labels GROUP BY quality",
}
