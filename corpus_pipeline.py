"""From raw documents to packed training windows: each stage works on all that the one before it kept.

Defined results: rows go by numbers or by id and text, so documents without an id, or that share one, are told apart; a null or empty text
fails the quality rules; of equal texts the largest id stays, of near copies the smallest, and what ties is decided by the text's hash or the row's
place; a text of any length is read whole; extra columns, whatever their names, go along up to the last stage; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrafold.llm import exact_dedup, jaccard_join, mixing, packing, repetition
from terrafold.llm.common import saved, work_dir

STAGES = [
    ("quality rules", repetition.stage),
    ("exact dedup", exact_dedup.stage),
    ("n-gram Jaccard join", jaccard_join.stage),
    ("mixing sources", mixing.stage),
    ("packing", packing.stage),
]

#: Suffix arrays, Jaccard components and tokenisation are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of sf_dir's documents; every stage's rows are written and read again."""
    folder = work_dir(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = saved(stage(spark, docs, sf_dir), f"{folder}/{number}")
    return docs
