"""Mixing sources to target weights by Pareto order sampling.

A source's target in words is its share by weight of `budget` times all words, at most `cap` times its own words; what is
above goes to the others by weight (water filling).  A document expects e copies: the ratio of target and words of its
source, tilted with its length so that the expected words still are the target.  floor(e) copies are certain.
The fraction that is left is its inclusion probability p in a sample without replacement: documents
are ranked by the random odds u/(1-u) divided by the inclusion odds p/(1-p), and a source takes its first ones up to a
fixed size, counted in words: the one that would lead past the rest of the target is taken if half of it fits.

u comes from the MD5 of seed and doc_id, for a row without an id from that of its text and its number among the rows of equal source and text, and what is summed is integers: reruns agree, whatever the partitions.
The prefix in rank order is found by a histogram of the ranks per source, so that only one bin of it is ever sorted by one task.

Defined results: a null text has size 0, null sources form a source, the last in order; sources and documents without words
take nothing (0 copies); documents without an id are drawn as others are; rows with the same doc_id are ranked by size, then alike, and each counts; an empty table gives
no rows.  Columns of docs other than the id, text and source columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORD, saved, small, work_dir

WEIGHTS = (5, 2, 1)
BUDGET, CAP, TILT, BINS = 1.5, 2.0, 0.5, 4096


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: Sequence[str] = ()) -> DataFrame:
    """The columns `keep`, doc_id, source, size: the words of each document; and __digest, that of its text if it has no id."""
    size = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")
    digest = F.when(F.col(id_col).isNull(), F.md5(F.coalesce(text_col, F.lit(""))))
    return docs.select(*keep, F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), digest.alias("__digest"))


def keyed(sized: DataFrame) -> DataFrame:
    """sized with `__key`, which a row's random number comes from: the id, or without one the digest and the row's number among those of equal source and digest.

    Such rows are alike, so it is all one which of them has which number.  They are numbered within partitions, and the partitions' counts are added up before: no
    task sees all copies of a text.
    """
    named = sized.filter("doc_id is not null").withColumn("__key", F.col("doc_id").cast("string"))
    nameless = sized.filter("doc_id is null")
    if nameless.isEmpty():
        return named
    dealt = saved(nameless.withColumn("__part", F.spark_partition_id()), work_dir(sized.sparkSession, "mixing-nameless"))
    counts = dealt.groupBy("source", "__digest", "__part").agg(F.count(F.lit(1)).alias("__rows"))
    before = F.sum("__rows").over(W.partitionBy("source", "__digest").orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select(F.col("source").alias("__of"), F.col("__digest").alias("__text"), F.col("__part").alias("__at"), F.coalesce(before, F.lit(0)).alias("__before"))
    counts = small(saved(counts, work_dir(sized.sparkSession, "mixing-copies")))
    joined = dealt.join(counts, F.col("source").eqNullSafe(F.col("__of")) & (F.col("__digest") == F.col("__text")) & (F.col("__part") == F.col("__at")))
    number = F.col("__before") + F.row_number().over(W.partitionBy("source", "__digest", "__part").orderBy("size"))
    return named.unionByName(joined.withColumn("__key", F.concat(F.col("__digest"), F.lit(":"), number.cast("string"))).select(*named.columns))


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """source, source_size, n_docs, target.  The window runs over one row per source."""
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranked = by_source.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1))
    filling = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    lower, upper = filling.rowsBetween(W.unboundedPreceding, -1), filling.rowsBetween(W.currentRow, W.unboundedFollowing)
    level = (budget * F.sum("source_size").over(everything) - F.coalesce(F.sum(cap * F.col("source_size")).over(lower), F.lit(0.0))) / F.sum("weight").over(upper)
    levels = ranked.withColumn("level", level)
    return levels.select("source", "source_size", "n_docs", F.least(cap * F.col("source_size"), F.max("level").over(everything) * F.col("weight")).alias("target"))


def unit_random(seed: str, key: Column) -> Column:
    """In (0, 1), the same for the same seed and key."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def expected_copies(sized: DataFrame, by_source: DataFrame, cap: float = CAP, tilt: float = TILT) -> DataFrame:
    """Adds copies that are certain and the inclusion probability p for one more.

    The lean of a document is size / (size + mean size) in millionths; its deviation from the mean by words is what tilts.
    """
    lean = F.expr("size * 1000000 * n_docs div (size * n_docs + source_size)")
    leaning = sized.filter("size > 0").join(small(by_source), sized["source"].eqNullSafe(by_source["source"])).select(sized["*"], "source_size", "n_docs", "target", lean.alias("lean"))
    means = leaning.groupBy("source").agg((F.sum(F.col("size").cast("decimal(20,0)") * F.col("lean")).cast("double") / F.max("source_size")).alias("mean_lean"))
    means = saved(means, work_dir(sized.sparkSession, "mixing-means"))
    ratio = F.col("target") / F.col("source_size")
    tilted = ratio * (1.0 + F.least(F.lit(tilt), cap / ratio - 1.0) * (F.col("lean") - F.col("mean_lean")) / 1000000.0)
    expects = leaning.join(small(means), leaning["source"].eqNullSafe(means["source"])).select(leaning["*"], F.least(F.greatest(tilted, F.lit(0.0)), F.lit(cap)).alias("expects"))
    certain = F.floor("expects").cast("long")
    return expects.withColumn("certain", certain).withColumn("p", F.col("expects") - certain)


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, cap: float = CAP, tilt: float = TILT, keep: Sequence[str] = ()) -> DataFrame:
    """Per row of docs: the columns `keep`, doc_id, source, size, source_size, target, copies."""
    spark = docs.sparkSession
    sized = saved(sizes(docs, id_col, text_col, source_col, keep), work_dir(spark, "mixing-sizes"))
    by_source = saved(targets(sized, weights, budget, cap), work_dir(spark, "mixing-targets"))
    planned = expected_copies(keyed(sized), by_source, cap, tilt)
    u, p = unit_random(seed, F.col("__key")), F.col("p")
    planned = planned.withColumn("rank", F.when(p > 0, u / (1.0 - u) / (p / (1.0 - p))))
    planned = planned.withColumn("bin", F.floor(F.col("rank") / (1.0 + F.col("rank")) * BINS).cast("int"))
    planned = saved(planned, work_dir(spark, "mixing-ranks"))

    rest = planned.groupBy("source").agg((F.max("target") - F.sum(F.col("certain") * F.col("size"))).alias("rest"))
    bins = planned.filter("rank is not null").groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    up_to = W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    bins = bins.withColumn("before", F.sum("bin_size").over(up_to) - F.col("bin_size")).alias("b").join(rest.alias("r"), F.col("b.source").eqNullSafe(F.col("r.source")))
    edge = saved(bins.filter("before <= rest and before + bin_size > rest").select("b.source", "bin", "before", "rest"), work_dir(spark, "mixing-edges"))
    edge = small(edge.withColumnsRenamed({"source": "edge_source", "bin": "edge_bin"}))

    at_edge = planned.join(edge, F.col("source").eqNullSafe(F.col("edge_source")) & (F.col("bin") == F.col("edge_bin")))
    in_order = W.partitionBy("source").orderBy("rank", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    fits = F.col("before") + F.sum("size").over(in_order) - F.col("size") / 2.0 <= F.col("rest")
    copies = F.col("certain") + F.coalesce("more", F.lit(0))
    shown = [*keep, "doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies")]
    of_edge = at_edge.withColumn("more", fits.cast("long")).select(shown)
    others = planned.join(edge, F.col("source").eqNullSafe(F.col("edge_source")), "left").filter("rank is null or edge_bin is null or bin != edge_bin")
    others = others.withColumn("more", F.when(F.col("rank").isNotNull() & (F.col("edge_bin").isNull() | (F.col("bin") < F.col("edge_bin"))), 1)).select(shown)
    wordless = sized.filter("size = 0").join(small(by_source), sized["source"].eqNullSafe(by_source["source"])).select(*[sized[c] for c in keep], sized["doc_id"], sized["source"], "size", "source_size", "target", F.lit(0).cast("long").alias("copies"))
    return of_edge.unionByName(others).unionByName(wordless)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, with all their columns.  Rows are told apart by a number, not by their ids."""
    rows = saved(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("doc")), work_dir(spark, "mixing-rows"))
    taken = mixed(rows.select("row", "doc.doc_id", "doc.text", "doc.source"), keep=["row"]).filter("copies > 0").select("row", F.col("copies").cast("int").alias("copies"))
    taken = saved(taken, work_dir(spark, "mixing-taken"))
    return rows.join(small(taken), "row").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs FROM d GROUP BY source),
s1 AS (SELECT *, CAST([5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS DOUBLE) AS weight FROM s0),
s2 AS (SELECT *, (CAST(1.5 AS DOUBLE) * CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(CAST(2 * source_size AS DOUBLE)) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
       FROM s1 WINDOW f AS (ORDER BY source_size / weight, source ASC NULLS LAST)),
s AS (SELECT source, source_size, n_docs, least(CAST(2 * source_size AS DOUBLE), max(level) OVER () * weight) AS target FROM s2),
l AS (SELECT d.doc_id, d.source, d.size, s.source_size, s.target, CASE WHEN d.size > 0 THEN d.size * 1000000 * n_docs // (d.size * n_docs + source_size) END AS lean FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
m AS (SELECT source, CAST(sum(CAST(size AS HUGEINT) * lean) AS DOUBLE) / max(source_size) AS mean_lean FROM l WHERE size > 0 GROUP BY source),
e AS (SELECT l.*, CASE WHEN size > 0 THEN least(greatest(target / source_size * (CAST(1 AS DOUBLE) + least(CAST(0.5 AS DOUBLE), CAST(2 AS DOUBLE) / (target / source_size) - CAST(1 AS DOUBLE)) * (lean - mean_lean) / CAST(1000000 AS DOUBLE)), 0), CAST(2 AS DOUBLE)) ELSE 0 END AS expects
      FROM l LEFT JOIN m ON l.source IS NOT DISTINCT FROM m.source),
p AS (SELECT *, CAST(floor(expects) AS BIGINT) AS certain, expects - floor(expects) AS p,
      (CAST(CAST('0x' || substr(md5('mix:' || CAST(doc_id AS VARCHAR)), 1, 12) AS BIGINT) AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(281474976710656 AS DOUBLE) AS u FROM e),
r AS (SELECT *, CASE WHEN p > 0 THEN u / (1 - u) / (p / (1 - p)) END AS rank FROM p),
t AS (SELECT *, max(target) OVER (PARTITION BY source) - sum(certain * size) OVER (PARTITION BY source) AS rest,
      sum(CASE WHEN rank IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rank ASC NULLS LAST, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM r)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, copies
FROM (SELECT *, CAST(certain + CASE WHEN rank IS NOT NULL AND upto - size / CAST(2 AS DOUBLE) <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies FROM t)
"""
