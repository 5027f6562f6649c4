"""Exact duplicates by a stateful stream.

Rows arrive in batches of a content table: digest, doc_id, a number and the columns that are carried, the text among them.  A streaming
aggregation reads the slim columns; its state lives in RocksDB under the checkpoint folder and never expires.  Per
digest it retains the stable identifier (the row that stays), the content locator (batch and number of the row that came first) and the
number of rows seen.  A later run over the same folder goes on from that state and hashes only its own batch.
On a hit the full text of each new row is compared with the content that the locator leads to; only the batches that locators
name are read for it.  As the locator never changes, rows that were compared once stay so.

Defined results: a null text counts as empty; rows with equal text and equal doc_id are told apart by their
place in the content table, so exactly one row of a group stays; so it is for rows without an id, of which one stays if no row of the
group has an id; an empty table gives no rows; texts whose digests collide form groups of their own.
Input columns other than `id_col` and `text_col` are not read unless carried, and their names don't matter.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import dropped, lower_ascii, saved, small, stored, work_dir

#: Copies of one text that one task compares with it.
SALT_ROWS = 4096
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "100",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def normalised(text: Column) -> Column:
    return lower_ascii(F.coalesce(text, F.lit("")))


def append_arrivals(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, carry: Sequence[str] = ()) -> int:
    """Adds the rows as a new batch of the content table and returns its number; batch and row_no name a row once and for all."""
    batch = time.time_ns()
    row = F.struct(*[F.col(c) for c in dict.fromkeys([*carry, text_col])]).alias("row")
    docs.select(F.col(id_col).alias("doc_id"), digest(normalised(F.col(text_col))).alias("digest"), F.monotonically_increasing_id().alias("row_no"), row).write.parquet(f"{path}/batch={batch}")
    return batch


def advance(spark: SparkSession, arrivals: str, checkpoint: str) -> DataFrame:
    """Takes all new arrivals into the state and returns the state: digest, keep (doc_id, batch, row_no), first (batch, row_no), group_size."""
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(spark.read.parquet(arrivals).schema).parquet(arrivals)
        seen = stream.groupBy("digest").agg(F.max(F.struct("doc_id", "batch", "row_no")).alias("keep"), F.min(F.struct("batch", "row_no")).alias("first"), F.count(F.lit(1)).alias("group_size"))
        seen.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        state = spark.read.format("statestore").load(checkpoint)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    parts = {"group_size" if not isinstance(f.dataType, StructType) else "keep" if "doc_id" in f.dataType.names else "first": f.name for f in state.schema["value"].dataType}
    return state.select(F.col("key.digest").alias("digest"), *[F.col("value")[parts[x]].alias(x) for x in ("keep", "first", "group_size")])


def unequal(content: DataFrame, state: DataFrame, batch: int, text_col: str) -> DataFrame:
    """The digests of rows of the batch whose full text differs from the content that their digest's state points to.

    Only texts of digests with several rows are moved; a group is dealt out to a task per SALT_ROWS copies.
    """
    hits = small(state.filter("group_size > 1").select("digest", F.col("first.batch").alias("at_batch"), F.col("first.row_no").alias("at_row"), F.ceil(F.col("group_size") / SALT_ROWS).cast("int").alias("salts")))
    texts = content.select("digest", "batch", "row_no", normalised(F.col("row")[text_col]).alias("body"))
    place = (F.col("batch") == F.col("at_batch")) & (F.col("row_no") == F.col("at_row"))
    new = texts.filter(F.col("batch") == batch).join(hits, "digest").filter(~place).withColumn("salt", F.pmod(F.xxhash64("row_no"), F.col("salts")).cast("int"))
    there = hits.withColumnRenamed("digest", "of")
    first = texts.join(there, (texts["batch"] == there["at_batch"]) & (texts["row_no"] == there["at_row"])).select("digest", F.col("body").alias("other"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return new.join(first, ["digest", "salt"]).filter("body != other").select("digest").distinct()


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, new: DataFrame | None = None, digest: Callable[[Column], Column] = sha256, carry: Sequence[str] = ()
) -> DataFrame:
    """Per row that ever arrived: doc_id, digest, keep_id, group_size, kept, batch, row_no.  The largest doc_id of a group stays.

    folder: where content and state of earlier runs are; by default a new one.  new: the rows that arrive now, by default all of docs.
    """
    spark = docs.sparkSession
    folder = folder or work_dir(spark, "exact-dedup")
    batch = append_arrivals(docs if new is None else new, f"{folder}/arrivals", id_col, text_col, digest, carry)
    state = saved(advance(spark, f"{folder}/arrivals", f"{folder}/state"), f"{folder}/groups/{batch}")
    content = spark.read.parquet(f"{folder}/arrivals")
    unequal(content, state, batch, text_col).write.mode("append").parquet(f"{folder}/collisions")
    found = content.join(state, "digest").select("doc_id", "digest", F.col("keep.doc_id").alias("keep_id"), "group_size", ((F.col("keep.batch") == F.col("batch")) & (F.col("keep.row_no") == F.col("row_no"))).alias("kept"), "batch", "row_no")
    odd = stored(spark, f"{folder}/collisions", "digest string").distinct()
    return found if odd.isEmpty() else _regrouped(content, found, odd, text_col)


def _regrouped(content: DataFrame, found: DataFrame, odd: DataFrame, text_col: str) -> DataFrame:
    """The groups again for digests that stand for several texts, now by their whole texts."""
    rows = content.join(odd, "digest", "left_semi").select("digest", "doc_id", "batch", "row_no", normalised(F.col("row")[text_col]).alias("body"))
    groups = rows.groupBy("digest", "body").agg(F.max(F.struct("doc_id", "batch", "row_no")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    again = rows.join(groups, ["digest", "body"]).select("doc_id", "digest", F.col("keep.doc_id").alias("keep_id"), "group_size", ((F.col("keep.batch") == F.col("batch")) & (F.col("keep.row_no") == F.col("row_no"))).alias("kept"), "batch", "row_no")
    return found.join(odd, "digest", "left_anti").select(again.columns).unionByName(again)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    folder = work_dir(spark, "exact-dedup")
    gone = saved(exact_dedup(docs, folder=folder, carry=docs.columns).filter("not kept").select("batch", "row_no"), f"{folder}/gone")
    dropped(spark, f"{folder}/state")
    dropped(spark, f"{folder}/groups")
    return spark.read.parquet(f"{folder}/arrivals").join(small(gone), ["batch", "row_no"], "left_anti").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", F.col("digest").alias("text_sha256"))


ORACLE = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY body)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.body) AS text_sha256
FROM n JOIN g ON n.body = g.body
"""
