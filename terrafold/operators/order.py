"""Ranks and running sums over an order of any size: range partitions are summed first, so no task sees a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.plans import cut


def running(rows: DataFrame, group: list[str], by: list[str | Column], sums: list[str]) -> DataFrame:
    """rows with `place` (from 1) in the order `by` within `group`, and for each column c of `sums` upto_c, its sum up to and with the row.

    Rows that tie in `by` get places in any order.  Rows are dealt out by ranges of (group, by); the sums of the ranges, one row per
    range and group, are all that a window over a whole group runs over.
    """
    orders = [F.col(c) if isinstance(c, str) else c for c in by]
    dealt = rows.repartitionByRange(*[F.col(g) for g in group], *orders).withColumn("__range", F.spark_partition_id())
    dealt = cut(dealt, "ranges")
    values = {"place": F.lit(1), **{f"upto_{c}": F.col(c) for c in sums}}
    parts = dealt.groupBy(*group, "__range").agg(*[F.sum(v).alias(f"__{n}") for n, v in values.items()])
    before = W.partitionBy(*group).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    parts = cut(parts.select(*group, "__range", *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in values]), "range-sums")
    within = W.partitionBy(*group, "__range").orderBy(*orders).rowsBetween(W.unboundedPreceding, W.currentRow)
    on = [*[dealt[g].eqNullSafe(parts[g]) for g in group], dealt["__range"] == parts["__range"]]
    joined = dealt.join(F.broadcast(parts) if parts.count() <= 1_000_000 else parts, on).select(dealt["*"], *[parts[f"__{n}"] for n in values])
    return joined.withColumns({n: F.col(f"__{n}") + F.sum(v).over(within) for n, v in values.items()}).drop("__range", *[f"__{n}" for n in values])


def numbered(rows: DataFrame, by: list[str | Column], name: str, keep: list[str]) -> DataFrame:
    """The columns `keep` of rows, with their number (from 0) in the order `by`, in any order among ties; rows are sorted and written once.

    A row's place in its range is a part of its id in the job that sorts; the ranges before it are counted and broadcast, one row per range.
    """
    orders = [F.col(c) if isinstance(c, str) else c for c in by]
    at = F.monotonically_increasing_id().alias("__at")  # the range, and in the 33 low bits the row
    dealt = cut(rows.repartitionByRange(*orders).sortWithinPartitions(*orders).select(*keep, at), "numbered")
    part = F.shiftright("__at", 33).alias("__range")
    parts = dealt.groupBy(part).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = cut(parts.select("__range", before.alias("__before")), "range-counts")
    joined = dealt.join(F.broadcast(parts), F.shiftright(dealt["__at"], 33) == parts["__range"])
    return joined.select(*keep, (F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).alias(name))
