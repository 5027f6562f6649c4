"""Segmentation metrics on long tables: overlaps, IoU, coverage, precision and recall, average precision, accuracies."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.plans import cut
from .order import running

LEAST_POINTS = 100


def confusion(rows: DataFrame, gt: str, pred: str) -> DataFrame:
    return rows.groupBy(F.col(gt).alias("gt"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def semantic_iou(counts: DataFrame, classes: list[int]) -> DataFrame:
    """(class, iou in percent) from a confusion table; other classes are left out on both sides, an absent class scores 0."""
    known = counts.filter(F.col("gt").isin(classes) & F.col("pred").isin(classes))
    parts = known.select(F.col("gt").alias("class"), F.when(F.col("gt") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("either"))
    other = known.filter("gt != pred").select(F.col("pred").alias("class"), F.lit(0).cast("long").alias("tp"), F.col("n").alias("either"))
    every = counts.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in classes])).alias("class"))
    sums = parts.unionByName(other).groupBy("class").agg(F.sum("tp").alias("tp"), F.sum("either").alias("either"))
    iou = F.coalesce(F.col("tp"), F.lit(0)) / F.greatest(F.coalesce(F.col("either"), F.lit(0)), F.lit(1)) * 100
    return every.join(sums, "class", "left").select("class", iou.alias("iou"))


def overlaps(masks: DataFrame, class_of: Column, pred_class_of: Column) -> DataFrame:
    """(scene, class, gt, pred, common, gt_size, pred_size, iou) of masks of the same class that meet.

    Points are counted per pair at once, and the sizes are sums of those counts; no mask meets all others.
    """
    pairs = masks.groupBy("scene", "gt", "pred").agg(F.count(F.lit(1)).alias("common"))
    sized = pairs.withColumn("gt_size", F.sum("common").over(W.partitionBy("scene", "gt"))).withColumn("pred_size", F.sum("common").over(W.partitionBy("scene", "pred")))
    same = sized.withColumn("class", class_of).filter(class_of == pred_class_of)
    return same.withColumn("iou", F.col("common") / (F.col("gt_size") + F.col("pred_size") - F.col("common")))


def coverage(gts: DataFrame, found: DataFrame) -> DataFrame:
    """(class, m_cov, mw_cov): per scene the mean of the ground truths' best IoU, plain and by size; then the mean over scenes."""
    best = gts.join(found.groupBy("scene", "gt").agg(F.max("iou").alias("best")), ["scene", "gt"], "left").withColumn("best", F.coalesce("best", F.lit(0.0)))
    per = best.groupBy("scene", "class").agg(F.avg("best").alias("cov"), (F.sum(F.col("best") * F.col("gt_size")) / F.sum("gt_size")).alias("w_cov"))
    return per.groupBy("class").agg(F.avg("cov").alias("m_cov"), F.avg("w_cov").alias("mw_cov"))


def precision_recall(gts: DataFrame, preds: DataFrame, found: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(class, precision, recall): a prediction is right if its best IoU is above the threshold, even if another has the same match."""
    right = found.filter(F.col("iou") > threshold).select("scene", "pred", "class").distinct().groupBy("class").agg(F.count(F.lit(1)).alias("tp"))
    total, made = gts.groupBy("class").agg(F.count(F.lit(1)).alias("gts")), preds.groupBy("class").agg(F.count(F.lit(1)).alias("made"))
    rows = total.join(made, "class", "full").join(right, "class", "left")
    tp = F.coalesce("tp", F.lit(0))
    return rows.select("class", F.try_divide(tp, F.col("made")).alias("precision"), F.try_divide(tp, F.col("gts")).alias("recall"))


def scored_at(gts: DataFrame, preds: DataFrame, found: DataFrame, thresholds: list[float], ignored: DataFrame | None = None) -> DataFrame:
    """(threshold, class, score, tp, fp, missed) rows for the curve, at thresholds of 0.5 or more.

    A prediction can then match one ground truth only, so the matching has no order: of the predictions of a ground
    truth the best score is right and the others are wrong.  Ground truths of under LEAST_POINTS points don't
    count; predictions without a match are wrong unless such small ones and `ignored` regions (scene, pred, void points) take more
    than the threshold of them.  Below 0.5 this holds where no prediction meets two ground truths of its class.
    """
    every = F.array(*[F.lit(float(t)) for t in thresholds])
    at = found.withColumn("threshold", F.explode(every)).filter(F.col("iou") > F.col("threshold"))
    hits = cut(at.join(preds.select("scene", "pred", "conf"), ["scene", "pred"]), "hits")
    ranked = hits.filter(F.col("gt_size") >= LEAST_POINTS).groupBy("threshold", "scene", "class", "gt").agg(F.max("conf").alias("best"), F.collect_list("conf").alias("all"))
    zero, one = F.lit(0), F.lit(1)
    right = ranked.select("threshold", "class", F.col("best").alias("score"), one.alias("tp"), zero.alias("fp"), zero.alias("missed"))
    again = ranked.select("threshold", "class", F.explode(F.slice(F.sort_array("all", asc=False), F.lit(2), F.size("all"))).alias("score"), zero.alias("tp"), one.alias("fp"), zero.alias("missed"))
    wanted = gts.filter(F.col("gt_size") >= LEAST_POINTS).withColumn("threshold", F.explode(every))
    missed = wanted.join(ranked, ["threshold", "scene", "class", "gt"], "left_anti").select("threshold", "class", F.lit(None).cast("double").alias("score"), zero.alias("tp"), zero.alias("fp"), one.alias("missed"))
    little = found.filter(F.col("gt_size") < LEAST_POINTS).select("scene", "pred", F.col("common").alias("void"))
    little = (little if ignored is None else little.unionByName(ignored.select("scene", "pred", "void"))).groupBy("scene", "pred").agg(F.sum("void").alias("void"))
    rest = preds.withColumn("threshold", F.explode(every)).join(hits, ["threshold", "scene", "pred"], "left_anti").join(little, ["scene", "pred"], "left")
    rest = rest.filter(F.coalesce("void", zero) / F.col("pred_size") <= F.col("threshold"))
    wrong = rest.select("threshold", "class", F.col("conf").alias("score"), zero.alias("tp"), one.alias("fp"), zero.alias("missed"))
    return right.unionByName(again).unionByName(missed).unionByName(wrong)


def scored_matches(gts: DataFrame, preds: DataFrame, found: DataFrame, threshold: float, ignored: DataFrame | None = None) -> DataFrame:
    """scored_at for one threshold."""
    return scored_at(gts, preds, found, [threshold], ignored).drop("threshold")


def average_precision(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, ap) of rows (by, score, tp, fp, missed), `by` being the class unless given: precision times half the recall step on either side,
    summed over distinct scores and an end point of precision 1 and recall 0.

    0 for a class with ground truth and no prediction, null for one without ground truth.  Scores are summed by ranges of their order.
    """
    by = by or ["class"]
    totals = rows.groupBy(*by).agg((F.sum("tp") + F.sum("missed")).alias("real"))
    at = rows.filter("score is not null").groupBy(*by, "score").agg(F.sum("tp").alias("tp"), F.sum(F.col("tp") + F.col("fp")).alias("n"))
    curve = cut(running(at, by, [F.desc("score")], ["tp", "n"]), "curve")
    lower = curve.select(*by, (F.col("place") - 1).alias("place"), F.col("upto_tp").alias("lower_tp"))
    curve = curve.join(lower, [*by, "place"], "left").join(totals, by)
    # Towards higher scores recall falls, to the end point of precision 1 and recall 0; towards lower ones it stays.
    step = F.try_divide(F.coalesce("lower_tp", "upto_tp") - (F.col("upto_tp") - F.col("tp")), F.col("real"))
    end = F.when(F.col("place") == 1, F.try_divide("upto_tp", "real") / 2).otherwise(0.0)
    area = curve.withColumn("area", F.col("upto_tp") / F.col("upto_n") * step / 2 + end).groupBy(*by).agg(F.sum("area").alias("ap"))
    return totals.join(area, by, "left").select(*by, F.when(F.col("real") > 0, F.coalesce("ap", F.lit(0.0))).alias("ap"))


#: Fixed: the overlaps over which precision is averaged, and the looser one that is given beside it.
OVERLAPS, LOOSE = [0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9], 0.25


def precision_table(gts: DataFrame, preds: DataFrame, found: DataFrame, ignored: DataFrame | None = None) -> DataFrame:
    """(class, ap, ap50, ap25): the mean over OVERLAPS, and the values at 0.5 and at LOOSE; null for a class without ground truth."""
    strict = average_precision(scored_at(gts, preds, found, OVERLAPS, ignored), ["threshold", "class"])
    loose = average_precision(sequential_matches(gts, preds, found, LOOSE, ignored)).withColumnRenamed("ap", "ap25")
    table = strict.groupBy("class").agg(F.avg("ap").alias("ap"), F.max(F.when(F.col("threshold") == 0.5, F.col("ap"))).alias("ap50"))
    return table.join(loose, "class", "full")


def sequential_matches(gts: DataFrame, preds: DataFrame, found: DataFrame, threshold: float, ignored: DataFrame | None = None) -> DataFrame:
    """The rows of scored_matches at any threshold, where a prediction may meet several ground truths and their order counts.

    Ground truths go by id.  A prediction that was right for one is not used again; one that was wrong for one may be.
    A group is one class of one scene, and has a row per pair of masks that meet, not per point.
    """
    pairs = found.join(preds.select("scene", "pred", "conf"), ["scene", "pred"]).select("scene", "class", "gt", "pred", "common", "gt_size", "pred_size", "iou", "conf")
    lone_gts = gts.join(found, ["scene", "class", "gt"], "left_anti").select("scene", "class", "gt", F.lit(None).cast("long").alias("pred"), F.lit(0).cast("long").alias("common"), "gt_size", F.lit(0).cast("long").alias("pred_size"), F.lit(0.0).alias("iou"), F.lit(0.0).alias("conf"))
    lone_preds = preds.join(found, ["scene", "class", "pred"], "left_anti").select("scene", "class", F.lit(None).cast("long").alias("gt"), "pred", F.lit(0).cast("long").alias("common"), F.lit(0).cast("long").alias("gt_size"), "pred_size", F.lit(0.0).alias("iou"), "conf")

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        out, used = [], set()
        real = pdf[pdf["gt"].notna() & (pdf["gt_size"] >= LEAST_POINTS)].sort_values(["gt", "pred"])
        for _, rows in real.groupby("gt"):
            best = None
            for r in rows[rows["pred"].notna() & (rows["iou"] > threshold)].itertuples():
                if r.pred in used:
                    continue
                if best is None:
                    best = r.conf
                    used.add(r.pred)
                else:
                    out.append((min(best, r.conf), 0, 1, 0))
                    best = max(best, r.conf)
            out.append((best, 1, 0, 0) if best is not None else (None, 0, 0, 1))
        for _, rows in pdf[pdf["pred"].notna()].groupby("pred"):
            small = rows.loc[rows["gt"].notna() & (rows["gt_size"] < LEAST_POINTS), "common"].sum() + rows["void"].iloc[0]
            if not (rows["iou"] > threshold).any() and small / rows["pred_size"].iloc[0] <= threshold:
                out.append((rows["conf"].iloc[0], 0, 1, 0))
        made = pd.DataFrame(out, columns=["score", "tp", "fp", "missed"])
        made.insert(0, "class", pdf["class"].iloc[0])
        return made

    every = pairs.unionByName(lone_gts).unionByName(lone_preds)
    if ignored is None:
        every = every.withColumn("void", F.lit(0).cast("long"))
    else:
        void = ignored.groupBy("scene", "pred").agg(F.sum("void").alias("void"))
        every = every.join(void, ["scene", "pred"], "left").withColumn("void", F.coalesce("void", F.lit(0).cast("long")))
    return every.groupBy("scene", "class").applyInPandas(match, "class long, score double, tp int, fp int, missed int")


def curve(rows: DataFrame, score: str, truth: Column) -> DataFrame:
    """(score, tp, n, precision, recall) at each distinct score, counting rows of that score or more; summed by ranges of the scores."""
    at = rows.groupBy(F.col(score).alias("score")).agg(F.count_if(truth).alias("tp"), F.count(F.lit(1)).alias("n")).withColumn("whole", F.lit(0))
    summed = cut(running(at, ["whole"], [F.desc("score")], ["tp", "n"]), "curve")
    total = F.lit(summed.agg(F.max("upto_tp")).first()[0])
    tp, n = F.col("upto_tp"), F.col("upto_n")
    return summed.select("score", tp.alias("tp"), n.alias("n"), (tp / n).alias("precision"), F.try_divide(tp, total).alias("recall"))


def in_top(scores: Column, target: Column, k: int) -> Column:
    """Whether the target is among the k highest scores; of equal scores the first counts as higher."""
    own = F.get(scores, target)
    ahead = F.size(F.filter(scores, lambda s, i: (s > own) | ((s == own) & (i < target))))
    return ahead < k
