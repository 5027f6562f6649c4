"""Aggregates of vectors over a graph's edges: (scene, src, dst) and nodes (scene, id) with array columns.

Products and sums stay in the JVM: an entry of a product is an expression on arrays, and arrays are added up as so many sums, combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fidelity import added


def inner_product(a: Column, b: Column) -> Column:
    return added(F.zip_with(a, b, lambda x, y: x * y))


def times_matrix(row: Column, matrix: Column, columns: int) -> Column:
    """A row vector times a matrix, given by its rows one after the other."""
    entry = lambda j: F.aggregate(F.transform(row, lambda x, i: x * F.get(matrix, (i * columns + j).cast("int"))), F.lit(0.0), lambda s, x: s + x)
    return F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), entry)


def by_entry(values: str | Column, width: int, how) -> Column:  # noqa: ANN001
    """An aggregate of each entry of the arrays."""
    values = F.col(values) if isinstance(values, str) else values
    return F.array(*[how(F.get(values, F.lit(i))) for i in range(width)])


def zeros(width: int) -> Column:
    return F.array(*[F.lit(0.0)] * width)


def edge_conditioned_mean(edges: DataFrame, nodes: DataFrame, value: str, columns: int, filters: DataFrame | None = None) -> DataFrame:
    """(scene, id, mean array): the mean over the edges into a node of the source's vector times the edge's matrix; zeros for a node without any.

    edges have `matrix`, its rows one after the other, with `columns` columns, or, with filters (scene, filter, matrix), the `filter` whose matrix it is, so that edges
    of equal features share one.  It is combined by target before the shuffle.
    """
    there = nodes.select("scene", F.col("id").alias("src"), F.col(value).alias("__value"))
    edges = edges if filters is None else edges.join(filters.select("scene", "filter", "matrix"), ["scene", "filter"])
    product = times_matrix(F.col("__value"), F.col("matrix"), columns)
    sent = edges.join(there, ["scene", "src"]).select("scene", F.col("dst").alias("id"), product.alias("__sent"))
    mean = sent.groupBy("scene", "id").agg(by_entry("__sent", columns, F.avg).alias("mean"))
    return nodes.select("scene", "id").join(mean, ["scene", "id"], "left").select("scene", "id", F.coalesce("mean", zeros(columns)).alias("mean"))


def pooled(members: DataFrame, nodes: DataFrame, pools: DataFrame, value: str, width: int, how=F.avg) -> DataFrame:  # noqa: ANN001
    """(scene, pool, pooled array): each entry's mean (or with F.max its largest) over the pool's nodes; zeros for a pool of `pools` (scene, pool) without any.

    members: (scene, pool, id); a node can be in several pools.
    """
    rows = members.join(nodes.select("scene", "id", F.col(value).alias("__value")), ["scene", "id"])
    found = rows.groupBy("scene", "pool").agg(by_entry("__value", width, how).alias("pooled"))
    return pools.select("scene", "pool").distinct().join(found, ["scene", "pool"], "left").select("scene", "pool", F.coalesce("pooled", zeros(width)).alias("pooled"))


def dot_attention(edges: DataFrame, nodes: DataFrame, width: int, position: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Attention over each source's edges, and what it gathers: (scene, src, dst, affinity) and (scene, id, attended array).

    nodes: (scene, id, query, key, value), arrays; a score is the source's query times the target's key over the root of their width, times `position`, an expression on the
    edges' columns.  The softmax is over the edges of a source, its largest score subtracted first.  A source without edges attends to nothing: it has no row.
    """
    ends = nodes.select("scene", F.col("id").alias("src"), F.col("query").alias("__query")), nodes.select("scene", F.col("id").alias("dst"), F.col("key").alias("__key"), F.col("value").alias("__value"))
    score = inner_product(F.col("__query"), F.col("__key")) / F.sqrt(F.size("__key"))
    scored = edges.withColumn("__position", F.lit(1.0) if position is None else position).join(ends[0], ["scene", "src"]).join(ends[1], ["scene", "dst"])
    scored = scored.select("scene", "src", "dst", (score * F.col("__position")).alias("__score"), "__value")
    top = scored.groupBy("scene", "src").agg(F.max("__score").alias("__top"))
    risen = scored.join(top, ["scene", "src"]).withColumn("__e", F.exp(F.col("__score") - F.col("__top")))
    weighed = F.transform("__value", lambda v: v * F.col("__e"))
    sums = risen.groupBy("scene", "src").agg(F.sum("__e").alias("__total"), by_entry(weighed, width, F.sum).alias("__sum"))
    attended = sums.select("scene", F.col("src").alias("id"), F.transform("__sum", lambda s: s / F.col("__total")).alias("attended"))
    affinity = risen.join(sums.select("scene", "src", "__total"), ["scene", "src"]).select("scene", "src", "dst", (F.col("__e") / F.col("__total")).alias("affinity"))
    return affinity, attended
