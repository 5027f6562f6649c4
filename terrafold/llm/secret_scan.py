"""Secret scans over an incremental ledger of blobs.

A document's text is a blob, named by its SHA-256; every version of a document that ever arrived is a row (path, blob) of the ledger.
A scan takes the arrived blobs of which the ledger has no record for this version of the rules, finds spans in one copy of each, records
blob and rule version, and joins the findings back to all paths of the ledger that hold the blob, also those of earlier calls.
Findings are written first and versions last, so a run that breaks off loses nothing: the next one scans again what isn't recorded, and
a span found twice counts once.

Matches are leftmost and don't overlap: pieces between them come from split() and the matches from
regexp_extract_all(), so a match starts after all pieces and matches before it.

Defined results: a null text is the empty text and has no span; a null path is a path; equal rows of one call get equal rows, and a
(path, blob) that the ledger has is not entered again; an empty table gives no rows but those of the ledger; offsets are code points, ends exclusive; other columns are not read.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import saved, small, stored, work_dir


class Rule(NamedTuple):
    kind: str
    pattern: str
    #: A cheap test that every text with a match passes.
    hints: tuple[str, ...]
    #: Of the matches, those count of which this group has at least so many characters.
    group: int = 0
    least: int = 0


#: Runs of [0-9a-f] and of AKIA[A-Z0-9] are matched at their least length at once, which finds the same spans.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", ("passw", "secret", "token", "api"), 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}", ("akia",)),
    Rule("hex", r"[0-9a-f]{24,}", ()),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", ("private key-----",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", ("eyj",)),
)
BASE, VERSION = 3, "1"


def may_match(rule: Rule, text: Column, lowered: Column) -> Column:
    if not rule.hints:
        return F.rlike(text, F.lit(rule.pattern))
    found = F.lit(False)
    for hint in rule.hints:
        found = found | F.contains(lowered, F.lit(hint))
    return found


def matches(number: int, rule: Rule, text: Column) -> Column:
    """Array of (kind, at, gap, length, counts): each match, the length of the piece before it, and whether it counts."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    parts = F.arrays_zip(F.split(text, rule.pattern, -1).alias("piece"), found.alias("match"), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)).alias("part"))
    rows = F.transform(
        parts, lambda x, i: F.struct(F.lit(number).alias("kind"), i.alias("at"), F.char_length(x["piece"]).alias("gap"), F.char_length(x["match"]).alias("length"), (F.char_length(x["part"]) >= rule.least).alias("counts"))
    )
    return F.filter(rows, lambda x: x["length"].isNotNull())


def find(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, kind, start, end) of all spans that count, from rows (blob, text, may_0, may_1 and so on)."""
    none = F.array().cast("array<struct<kind:int,at:int,gap:int,length:int,counts:boolean>>")
    every = [F.when(F.col(f"may_{i}"), matches(i, rule, F.col("text"))).otherwise(none) for i, rule in enumerate(rules)]
    rows = texts.select("blob", F.inline(F.concat(*every)))
    end = F.sum(F.col("gap").cast("long") + F.col("length")).over(W.partitionBy("blob", "kind").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.withColumn("end", end).filter("counts").select("blob", "kind", (F.col("end") - F.col("length")).alias("start"), "end")


def spans_text(spans: Column, rules: tuple[Rule, ...]) -> Column:
    """kind:start:end, comma-joined; spans are sorted structs (start, kind, end)."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, rules: tuple[Rule, ...] = RULES, version: str = VERSION) -> DataFrame:
    """Per version of a document in the ledger: path, blob, spans (start, kind, end), kind being the number of the rule.

    folder: the ledger, which grows with each call; a new one by default, whose versions are the rows of docs.
    """
    spark = docs.sparkSession
    folder = folder or work_dir(spark, "secret-ledger")
    body = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("path"), body.alias("text"), F.sha2(body.cast("binary"), 256).alias("blob"))
    arrived = saved(rows.select("path", "blob"), work_dir(spark, "secret-arrived"))
    path_type = arrived.schema["path"].dataType.simpleString()
    done = stored(spark, f"{folder}/scanned", "blob string, rules string").filter(F.col("rules") == version)
    known = stored(spark, f"{folder}/versions", f"path {path_type}, blob string")
    first_time, new_ledger = done.isEmpty(), known.isEmpty()
    unseen = arrived.select("blob").distinct()
    if not first_time:
        unseen = unseen.join(done, "blob", "left_anti")
    unseen = saved(unseen, work_dir(spark, "secret-unseen"))

    new = rows.select("blob", "text") if first_time else rows.select("blob", "text").join(small(unseen), "blob", "left_semi")
    hinted = new.withColumn("__lowered", F.lower("text"))
    for i, rule in enumerate(rules):
        hinted = hinted.withColumn(f"may_{i}", may_match(rule, F.col("text"), F.col("__lowered")))
    may = F.lit(False)
    for i in range(len(rules)):
        may = may | F.col(f"may_{i}")
    once = hinted.filter(may).drop("__lowered").dropDuplicates(["blob"])
    find(once, rules).withColumn("rules", F.lit(version)).write.mode("append").parquet(f"{folder}/findings")
    unseen.withColumn("rules", F.lit(version)).write.mode("append").parquet(f"{folder}/scanned")
    entered = arrived
    if not new_ledger:
        other = known.select(F.col("path").alias("__path"), F.col("blob").alias("__blob"))
        entered = saved(arrived.join(other, arrived["path"].eqNullSafe(other["__path"]) & (arrived["blob"] == other["__blob"]), "left_anti"), work_dir(spark, "secret-entered"))
    entered.write.mode("append").parquet(f"{folder}/versions")

    versions = stored(spark, f"{folder}/versions", f"path {path_type}, blob string")
    findings = stored(spark, f"{folder}/findings", "blob string, kind int, start long, end long, rules string").filter(F.col("rules") == version)
    by_blob = findings.groupBy("blob").agg(F.sort_array(F.collect_set(F.struct("start", "kind", "end"))).alias("spans"))
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return versions.join(by_blob, "blob", "left").select("path", "blob", F.coalesce("spans", empty).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["kind"] < BASE)
    counts = [F.size(F.filter("spans", _of_kind(i))).cast("long").alias(f"n_{RULES[i].kind}") for i in range(BASE)]
    return found.select(F.col("path").alias("doc_id"), *counts, F.sha2(spans_text(base, RULES).cast("binary"), 256).alias("base_sha256"), spans_text(F.col("spans"), RULES).alias("spans"))


def _of_kind(number: int):
    return lambda s: s["kind"] == number


def _sql(number: int, rule: Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""SELECT doc_id, {number} AS kind, '{rule.kind}' AS name, unnest(range(len(f))) AS i, string_split_regex(body, p) AS pieces, f AS found, g AS part, {rule.least} AS least
FROM (SELECT doc_id, body, p, regexp_extract_all(body, p) AS f, regexp_extract_all(body, p, {rule.group}) AS g FROM (SELECT doc_id, coalesce(text, '') AS body, '{pattern}' AS p FROM documents))"""


ORACLE = f"""
WITH m AS ({" UNION ALL ".join(_sql(i, r) for i, r in enumerate(RULES))}),
s AS (SELECT doc_id, kind, name, list_sum(list_transform(pieces[1:i + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i], lambda x: length(x))), 0) AS start, length(found[i + 1]) AS len FROM m WHERE length(part[i + 1]) >= least),
t AS (SELECT doc_id, kind, CAST(start AS BIGINT) AS start, name || ':' || CAST(start AS BIGINT) || ':' || CAST(start + len AS BIGINT) AS span FROM s),
a AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
      coalesce(string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3), '') AS base, string_agg(span, ',' ORDER BY start, kind) AS spans FROM t GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN a USING (doc_id)
"""
