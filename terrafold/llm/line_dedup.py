"""Repeated runs of lines, found by winnowing.

A line is what lies between line feeds and has a word; lines of a document are numbered from 0 and known by two independent hashes, 128 bits.
Of every WINDOW lines that follow each other the one of the smallest hash is selected, whatever surrounds them; fingerprints are a
selected line with the line after it and with the line before it.  With a window of two, every repeated run of two lines
has its fingerprint in each copy, and no earlier match hides another.  Lines of at least `long_words` words are
fingerprints by themselves and always selected.  The first position of each fingerprint in the order (doc_id, version, line) is joined
with its later positions; each such match is extended both ways as long as lines are equal.  Runs of two lines or more, and
single long lines, are deleted where they repeat.  What is deleted always equals something that comes first, and
that is never deleted: a line that is the first of its kind equals nothing earlier.

Defined results: null texts have no lines; lines without a word stay and break no run; rows equal in id and text are one document
and get equal rows; rows equal in id only are ordered by the hash of the text; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, WORD, saved, work_dir

WINDOW, LONG_WORDS = 2, 50


def line_arrays(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, version, n_lines, and for lines with a word the arrays at (place among all lines), hash, check and words."""
    body = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.transform(F.split(body, "\n"), lambda x, i: F.struct(i.alias("at"), F.xxhash64(x).alias("hash"), F.xxhash64(F.lit(1), x).alias("check"), F.regexp_count(x, F.lit(WORD)).alias("words")))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(body).alias("version"), F.size(F.split(body, "\n")).alias("n_lines"), F.filter(lines, lambda x: x["words"] > 0).alias("lines"))
    return rows.select("doc_id", "version", "n_lines", *[F.col(f"lines.{x}").alias(x) for x in ("at", "hash", "check", "words")])


def fingerprints(arrays: DataFrame, window: int, long_words: int) -> DataFrame:
    """(doc_id, version, line, print, mark): the selected fingerprints, of 128 bits."""
    def chosen(i: Column, x: Column) -> Column:
        """Whether x is the smallest of some full window around it (or of all there are)."""
        whole = [F.array_min(F.slice("hash", F.greatest(i + 1 + shift, F.lit(1)), F.lit(window))) for shift in range(1 - window, 1)]
        found = F.lit(False)
        for low in whole:
            found = found | (x == low)
        return found

    def pair(i: Column) -> Column:
        return F.struct(i.alias("line"), F.xxhash64(F.get("hash", i), F.get("hash", i + 1)).alias("print"), F.xxhash64(F.get("check", i), F.get("check", i + 1)).alias("mark"))

    def prints(i: Column) -> Column:
        """The line with the one after it and with the one before it."""
        return F.filter(F.array(F.when(i + 1 < F.size("hash"), pair(i)), F.when(i > 0, pair(F.greatest(i - 1, F.lit(0))))), lambda p: p.isNotNull())

    picked = F.array_distinct(F.flatten(F.filter(F.transform("hash", lambda x, i: F.when(chosen(i, x), prints(i))), lambda s: s.isNotNull())))
    alone = F.transform(F.arrays_zip("hash", "check", "words"), lambda x, i: F.when(x["words"] >= long_words, F.struct(i.alias("line"), F.xxhash64(x["hash"]).alias("print"), F.xxhash64(x["check"]).alias("mark"))))
    return arrays.select("doc_id", "version", F.inline(F.concat(picked, F.filter(alone, lambda s: s.isNotNull()))))


def deletions(arrays: DataFrame, window: int = WINDOW, long_words: int = LONG_WORDS) -> DataFrame:
    """(doc_id, version, lines): the numbers of the lines to delete, counted among lines with a word."""
    prints = fingerprints(arrays, window, long_words)
    place = F.struct("doc_id", "version", "line")
    first = prints.groupBy("print", "mark").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first != last").select("print", "mark", "first")
    later = prints.join(first, ["print", "mark"]).filter(place > F.col("first"))
    matches = later.select("doc_id", "version", F.col("first.doc_id").alias("from_id"), F.col("first.version").alias("from_version"), (F.col("line") - F.col("first.line")).alias("shift")).distinct()
    there = arrays.select(F.col("doc_id").alias("from_id"), F.col("version").alias("from_version"), F.col("hash").alias("from_hash"), F.col("check").alias("from_check")).dropDuplicates(["from_id", "from_version"])
    here = arrays.select("doc_id", "version", "hash", "check", "words").dropDuplicates(["doc_id", "version"])
    both = matches.join(there, ["from_id", "from_version"]).join(here, ["doc_id", "version"])

    def same(i: Column) -> Column:
        at = F.greatest(i - F.col("shift"), F.lit(0))
        return F.coalesce((i >= F.col("shift")) & (F.get("hash", i) == F.get("from_hash", at)) & (F.get("check", i) == F.get("from_check", at)), F.lit(False))

    gone = F.filter(F.sequence(F.lit(0), F.size("hash") - 1), lambda i: same(i) & ((F.get("words", i) >= long_words) | ((i > 0) & same(F.greatest(i - 1, F.lit(0)))) | same(i + 1)))
    return both.select("doc_id", "version", F.explode(gone).alias("line")).groupBy("doc_id", "version").agg(F.sort_array(F.collect_set("line")).alias("lines"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, long_words: int = LONG_WORDS) -> DataFrame:
    """Per row of docs: doc_id, n_lines, deleted (places of the deleted lines among all lines, from 0), text (what is left)."""
    folder = work_dir(docs.sparkSession, "line-dedup")
    arrays = saved(line_arrays(docs, id_col, text_col), f"{folder}/lines")
    found = deletions(arrays, window, long_words)
    at = arrays.select("doc_id", "version", "at").dropDuplicates(["doc_id", "version"])
    found = found.join(at, ["doc_id", "version"]).select("doc_id", "version", F.transform("lines", lambda i: F.get("at", i)).alias("deleted"))
    found = saved(found, f"{folder}/deleted")
    if (found.agg(F.sum(F.size("deleted"))).first()[0] or 0) <= BROADCAST_ROWS:
        found = F.broadcast(found)
    body = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(body).alias("version"), body.alias("text")).join(found, ["doc_id", "version"], "left")
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("deleted", i)), "\n")
    return rows.select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("n_lines"), F.coalesce("deleted", F.array().cast("array<int>")).alias("deleted"), F.when(F.col("deleted").isNull(), F.col("text")).otherwise(left).alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_lines", F.size("deleted").cast("long").alias("n_deleted"), F.array_join(F.col("deleted").cast("array<string>"), ",").alias("deleted"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


ORACLE = rf"""
WITH x AS (SELECT doc_id, i AS place, lines[i + 1] AS line FROM (SELECT doc_id, lines, unnest(range(len(lines))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
w AS (SELECT doc_id, place, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM x),
o AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY place) AS after FROM w WHERE words > 0),
g AS (SELECT *, after IS NOT NULL AND row_number() OVER (PARTITION BY line, after ORDER BY doc_id, place) > 1 AS again, words >= {LONG_WORDS} AND row_number() OVER (PARTITION BY line ORDER BY doc_id, place) > 1 AS long FROM o),
r AS (SELECT doc_id, place, again OR long OR coalesce(lag(again) OVER (PARTITION BY doc_id ORDER BY place), FALSE) AS gone FROM g),
a AS (SELECT x.doc_id, x.place, x.line, coalesce(r.gone, FALSE) AS gone FROM x LEFT JOIN r ON r.doc_id = x.doc_id AND r.place = x.place)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_deleted, coalesce(string_agg(CAST(place AS VARCHAR), ',' ORDER BY place) FILTER (gone), '') AS deleted,
sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS text_sha256 FROM a GROUP BY doc_id
"""
