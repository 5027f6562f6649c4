"""Where tables are cut and how small sides are broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.  Only a one-process session without that setting gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="terrafold-")
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder of this run in the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Shuffle files go when the write that made them is done, not when the driver next collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, path: str) -> DataFrame:
    """The rows, written as Parquet and read again: cuts the lineage and survives the loss of executors."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a folder of this run in the shared one, when nothing reads it any more."""
    if not path.startswith(shared_dir(spark)):
        raise ValueError(f"{path} is not in the shared folder")
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    return saved(df, work_dir(df.sparkSession, name))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it has at most `rows` rows, else unchanged, for a shuffled join.

    df must be cheap to read again (a written table), and its rows must be of a fixed small width.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def attach(df: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """df with the aggregates of its keys; stats are written once and broadcast if they are few."""
    return df.join(small(cut(stats, "stats")), keys)
