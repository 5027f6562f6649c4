"""What the corpus operators share: the folder that all executors see, written tables, size-checked broadcasts."""

from __future__ import annotations

from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.plans import BROADCAST_ROWS, dropped, saved, shared_dir, small, work_dir

__all__ = ["BROADCAST_ROWS", "WORD", "bounded_batches", "dropped", "lower_ascii", "mounted_path", "saved", "shared_dir", "small", "stored", "work_dir"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"
#: What a worker gets at once; a longer text comes alone.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session sends workers batches of bounded bytes, so that long texts don't fill their memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at path, empty if nothing was written there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.range(0).select(F.from_json(F.lit("{}"), schema).alias("x")).select("x.*")


def mounted_path(url: str) -> str:
    """The path of a shared folder as every machine mounts it, for files that workers map into memory."""
    parts = urlparse(url)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{url} is not mounted; memory-mapped files need spark.checkpoint.dir on a mounted shared file system")
    return parts.path


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, nothing else.  A text of one byte a character is ASCII, for which lower() says the same faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
