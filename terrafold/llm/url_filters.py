"""URL rules by cascades of Bloom filters: exact membership for all keys of a corpus, and no join when urls are judged.

A rule is a host and the beginning of a path; its key is both in one string.  The keys that a url could match are the
suffixes of its host with the beginnings of its path, in the shapes (labels, path length) that the list has.  All those of the
corpus are the key universe.  Level 1 of a cascade encodes the listed keys, level 2 the keys of the universe that
level 1 takes for listed, level 3 the listed keys that level 2 takes for those, and so on until none is left.  For keys of the
universe the answer is exact.  There is a cascade for each verdict; the longest listed key gives the rule.

Sizes follow the list, not the corpus: level 1 has so many bits that about as many others pass as there are listed keys, and each further level halves.
Tasks hold the cascades of at most about PART_KEYS listed keys of a verdict at once.  A longer list is dealt into parts by a hash of its keys, and the
urls go through the parts one after the other, each of which betters what the parts before it found: one scan a part, and still no join.

Defined results: a null url, or one without ://, has empty host and path, which no rule fits; equal rows are judged alike; a rule with a
null host or path fits nothing; of a key with two verdicts the first in order counts; an empty table gives no rows; an empty list gives no rule; columns that
aren't in `keep` are not read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, saved, work_dir

PART_KEYS = 1 << 19
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
Level = tuple[str, int, int]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    host = lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules])
    return spark.range(1).select(F.inline(rows.cast("array<struct<verdict:string,host:string,path:string>>")))


def shapes(rules: DataFrame) -> dict[int, list[int]]:
    """The lengths of the paths by the number of the host's labels; there are few, however long the list."""
    found = rules.select(F.size(F.split("host", r"\.")).alias("labels"), F.char_length("path").alias("length")).dropna()
    return {r["labels"]: r["lengths"] for r in found.groupBy("labels").agg(F.sort_array(F.collect_set("length")).alias("lengths")).collect()}


def candidates(host: Column, path: Column, of: dict[int, list[int]]) -> Column:
    """The keys that a url could match, the longest first and, of equally long ones, that with the longest host."""
    if not of:
        return F.array().cast("array<string>")
    lengths = F.create_map(*[x for k, found in of.items() for x in (F.lit(k), F.array(*map(F.lit, found)))])
    labels = F.split(host, r"\.")

    def keys(k: Column) -> Column:
        """Those of the last k labels."""
        suffix = F.array_join(F.slice(labels, F.size(labels) - k + 1, k), ".")
        fitting = F.filter(F.coalesce(F.try_element_at(lengths, k), F.array().cast("array<int>")), lambda n: n <= F.char_length(path))
        return F.transform(fitting, lambda n: F.struct((-F.char_length(suffix) - n).alias("order"), (-F.char_length(suffix)).alias("then"), F.concat(suffix, F.substr(path, F.lit(1), n)).alias("key")))

    every = F.flatten(F.transform(F.sequence(F.lit(1), F.size(labels)), keys))
    return F.when(host != "", F.transform(F.sort_array(every), lambda x: x["key"])).otherwise(F.array().cast("array<string>"))


def positions(key: Column, level: int, hashes: int, bits: int) -> list[Column]:
    """Double hashing: position i is a + i b."""
    a, b = F.xxhash64(F.lit(2 * level), key), F.xxhash64(F.lit(2 * level + 1), key)  # the number first, so that levels hash independently
    return [F.pmod(F.pmod(a, F.lit(bits)) + i * F.pmod(b, F.lit(bits)), F.lit(bits)) for i in range(hashes)]


def size_of(n_keys: int, rate: float) -> tuple[int, int]:
    """Bits and hashes of a Bloom filter of n_keys keys at this rate of false positives."""
    return max(64, 64 * math.ceil(n_keys * math.log2(1 / rate) / math.log(2) / 64)), max(1, round(math.log2(1 / rate)))


def levels_of(keys: DataFrame, number: int, rates: dict[str, tuple[int, float]]) -> dict[str, Level]:
    """A Bloom filter for each verdict of `rates` (keys and rate) of the rows (verdict, key): its words as JSON, its bits, its hashes."""
    sizes = {v: size_of(n, rate) for v, (n, rate) in rates.items()}
    at = reduce(DataFrame.unionByName, [keys.filter(F.col("verdict") == v).select("verdict", F.explode(F.array(*positions(F.col("key"), number, hashes, bits))).alias("at")) for v, (bits, hashes) in sizes.items()])
    words = at.groupBy("verdict", F.expr("at div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("value"))
    filled = {v: [0] * (bits // 64) for v, (bits, _) in sizes.items()}
    for row in words.collect():
        filled[row["verdict"]][row["word"]] = row["value"]
    return {v: ("[" + ",".join(map(str, filled[v])) + "]", *sizes[v]) for v in sizes}


def in_level(key: Column, number: int, level: Level) -> Column:
    words = F.from_json(F.lit(level[0]), "array<bigint>")
    found = F.lit(True)
    for at in positions(key, number, level[2], level[1]):
        found = found & (F.getbit(F.get(words, F.floor(at / 64).cast("int")), (at % 64).cast("int")) == 1)
    return found


def listed(key: Column, cascade: list[Level]) -> Column:
    """Whether a key of the universe is listed: it is if the first level that rejects it has an even number."""
    found = F.lit(False)
    for number in range(len(cascade), 0, -1):
        found = in_level(key, number, cascade[number - 1]) & ~found
    return found


def first_listed(keys: str, cascade: list[Level]) -> Column:
    """The place of the first listed key, from 1; null without any."""
    return F.nullif(F.array_position(F.transform(keys, lambda key: listed(key, cascade)), F.lit(True)), F.lit(0))


def cascades_of(rules: DataFrame, universe: DataFrame, n_universe: int) -> dict[str, list[Level]]:
    """The levels of each verdict for the listed keys (verdict, key); all verdicts go through a level at once."""
    folder = work_dir(rules.sparkSession, "cascade")
    inside, outside = saved(rules.select("verdict", "key").distinct(), f"{folder}/listed"), None
    cascades: dict[str, list[Level]] = {}
    number = 0
    while counts := {r["verdict"]: r["count"] for r in inside.groupBy("verdict").count().collect()}:
        number += 1
        rates = {v: (n, min(0.5, n / max(1, n_universe)) if number == 1 else 0.5) for v, n in counts.items()}
        levels = levels_of(inside, number, rates)
        others = {v: universe.join(inside.filter(F.col("verdict") == v).select("key"), "key", "left_anti") if outside is None else outside.filter(F.col("verdict") == v) for v in levels}
        passed = [others[v].filter(in_level(F.col("key"), number, level)).select(F.lit(v).alias("verdict"), "key") for v, level in levels.items()]
        for v, level in levels.items():
            cascades.setdefault(v, []).append(level)
        inside, outside = saved(reduce(DataFrame.unionByName, passed), f"{folder}/passed-{number}"), inside
    return cascades


def judged(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", keep: Sequence[str] = (), part_keys: int = PART_KEYS) -> DataFrame:
    """The columns `keep` of each row, host, path, rule (null if none fits) and verdict (`default` then)."""
    folder = work_dir(pages.sparkSession, "url-filters")
    host, path = url_parts(F.col(url_col))
    rows = pages.select(*keep, host.alias("__host"), path.alias("__path")).withColumn("__keys", candidates(F.col("__host"), F.col("__path"), shapes(rules)))
    universe = saved(rows.select(F.explode("__keys").alias("key")).distinct(), f"{folder}/universe")
    named = saved(rules.select("verdict", F.concat("host", "path").alias("key")).dropna().distinct(), f"{folder}/rules")
    n_universe, longest = universe.count(), named.groupBy("verdict").count().agg(F.max("count")).first()[0] or 0
    rows = rows.withColumn("__best", F.lit(None).cast("struct<at:bigint,verdict:string>"))
    n_parts = -(-longest // part_keys)
    for part in range(n_parts):
        cascades = cascades_of(named.filter(F.pmod(F.xxhash64("key", F.lit("part")), F.lit(n_parts)) == part), universe, n_universe)
        if part:
            rows = saved(rows, f"{folder}/part-{part}")
        found = [F.struct(first_listed("__keys", c).alias("at"), F.lit(v).alias("verdict")) for v, c in sorted(cascades.items())]
        best = F.array_min(F.filter(F.array(F.col("__best"), *found), lambda x: x["at"].isNotNull()))
        rows = rows.withColumn("__best", best)
    return rows.select(*keep, F.col("__host").alias("host"), F.col("__path").alias("path"), F.get("__keys", F.col("__best.at") - 1).alias("rule"), F.coalesce("__best.verdict", F.lit(default)).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"), rule_table(spark), keep=["page_id"])


ORACLE = r"""
WITH r(verdict, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
p AS (SELECT page_id, coalesce(CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END, '') AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
m AS (SELECT u.page_id, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.host) + length(r.path) DESC, length(r.host) DESC) AS k
      FROM u JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path))
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM u LEFT JOIN m ON m.page_id = u.page_id AND m.k = 1
"""
