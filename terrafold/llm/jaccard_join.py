"""Jaccard self-join of word shingles by prefix filters under several global token orders.

Under any one order of all tokens, two sets of similarity t share a token among the first n - ceil(t n) + 1 tokens of each, and
l tokens among the first n - ceil(t n) + l.  Three orders are used, and a pair must pass each of them before it is verified:

1. the order of the hashes.  Its l-prefix filter works on single sets: a set that has fewer than l tokens of its longer
   prefix in common with the prefixes of any other sets has no partner.  It leaves few sets.
2. rarest first, by document frequencies among those sets.  Its prefix makes the candidate buckets.
3. the order of a second hash.

Equal sets are one class from the start, so copies are never compared.  A bucket is the classes that have a token in their prefix; one of up to
BUCKET classes gives pairs, which is linear in the rows.  A pair all of whose common tokens in the second order have larger buckets
consists of two classes with such tokens: among these alone, buckets are made again in the order of the hashes, and among
those with larger buckets there, in the order of the second hash.  What shares larger buckets in every order forms clusters (components over
the last ones), which are dealt out in blocks of near-equal set sizes: a task compares two blocks whose sizes allow a link and returns a
spanning forest and the number of links, never pairs.  No link is lost.

Defined results: a text without words or null has the empty set and no link (component_id is its own doc_id); texts with fewer words than a shingle
have one shingle; rows of equal ids count one by one and an id that stands for several texts belongs to several
classes; rows without an id link as others do and have the least id of their group, null if no row of it has one; an empty table gives no rows;
columns that aren't in `keep` are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import bounded_batches, dropped, saved, small, work_dir
from .words import Words, combine, mix, slices

WIDTH, PERCENT = 3, 90
STAGE_WIDTH, STAGE_PERCENT = 5, 80
BUCKET, BLOCK, CHUNK = 16, 128, 8192
_SECOND, _THIRD = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def shingle_sets(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each document in ascending order, and the bounds of each document's."""
    hashes, doc, n_docs = words.hashes(), words.doc, len(words.counts)
    n = len(hashes) - width + 1
    tokens, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if n > 0:
        tokens = hashes[:n]
        for j in range(1, width):
            tokens = combine(tokens, hashes[j : j + n])
        whole = doc[:n] == doc[width - 1 :]
        tokens, owner = tokens[whole], doc[:n][whole]
    short = np.flatnonzero((words.counts > 0) & (words.counts < width))
    if len(short):
        whole_text = []
        for d in short.tolist():
            h = np.full(1, words.counts[d], np.uint64)
            for j in range(words.bounds[d], words.bounds[d + 1]):
                h = combine(h, hashes[j : j + 1])
            whole_text.append(h)
        tokens, owner = np.concatenate([tokens, *whole_text]), np.concatenate([owner, short])
    order = np.lexsort((tokens, owner))
    tokens, owner = tokens[order], owner[order]
    once = np.ones(len(tokens), bool)
    once[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
    tokens, owner = tokens[once], owner[once]
    return tokens, np.searchsorted(owner, np.arange(n_docs + 1))


def class_keys(tokens: np.ndarray, bounds: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """A 128-bit key per set, as two columns; equal sets have equal keys."""
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)]) for x in (tokens, mix(tokens ^ _SECOND), mix(tokens + _THIRD))]
    first, second, third = (s[bounds[1:]] - s[bounds[:-1]] for s in sums)
    return tuple(pa.array(x.view(np.int64)) for x in (combine(first, second), combine(third, np.diff(bounds).astype(np.uint64))))


def least_common(n: np.ndarray, percent: int) -> np.ndarray:
    """The fewest tokens that a set of n has in common with a partner."""
    return -(-percent * n // 100)


def extra(n):
    """By how many tokens less one the first filter's prefix is longer than need be: about as long as that, so that half must be common."""
    return n // 10


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]), values.view(np.int64)).cast(pa.list_(pa.int64()))


def _take(bounds: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the first `sizes` entries of each range."""
    ends = np.cumsum(sizes)
    return np.repeat(bounds[:-1] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def probe_rows(batches: Iterable[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """All columns but the last, which is the text, then k1, k2, n, and the longer prefix in the order of the hashes."""
    for batch in batches:
        kept = batch.columns[:-1]
        for first, last, data, offsets in slices(batch.column(len(kept))):
            tokens, bounds = shingle_sets(Words(data, offsets), width)
            n = np.diff(bounds)
            size = np.minimum(n, n - least_common(n, percent) + 1 + extra(n))
            yield pa.RecordBatch.from_arrays(
                [*[x.slice(first, last - first) for x in kept], *class_keys(tokens, bounds), pa.array(n, pa.int64()), _lists(tokens[_take(bounds, size)], size)],
                names=[*batch.schema.names[:-1], "k1", "k2", "n", "probe"],
            )


def token_rows(batches: Iterable[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """k1, k2, n, all tokens in the order of the hashes, and the prefix in the order of the second hash."""
    for batch in batches:
        for _, _, data, offsets in slices(batch.column(0)):
            tokens, bounds = shingle_sets(Words(data, offsets), width)
            n = np.diff(bounds)
            size = np.minimum(n, n - least_common(n, percent) + 1)
            again = np.lexsort((mix(tokens + _SECOND), np.repeat(np.arange(len(n)), n)))
            yield pa.RecordBatch.from_arrays([*class_keys(tokens, bounds), pa.array(n, pa.int64()), _lists(tokens, n), _lists(tokens[again][_take(bounds, size)], size)], names=["k1", "k2", "n", "tokens", "other"])


def _least(n: Column, percent: int) -> Column:
    return F.ceil(n * percent / 100)


def survivors(classes: DataFrame, percent: int, folder: str) -> DataFrame:
    """The classes (cls, n, probe) that the first filter leaves.  Tokens in common are written first, so the two shuffles of all probes don't lie on disk at once."""
    probes = classes.select("cls", F.explode("probe").alias("token"))
    common = saved(probes.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1").select("token"), f"{folder}/common")
    shared = saved(probes.join(common, "token").groupBy("cls").agg(F.count(F.lit(1)).alias("shared")), f"{folder}/shared")
    return shared.join(classes.select("cls", "n"), "cls").filter(F.col("shared") >= 1 + F.floor(_least(F.col("n"), percent) / 10)).select("cls")


def rarest_first(full: DataFrame, percent: int) -> DataFrame:
    """cls, n, prefix: what the prefix in the order of document frequency has besides tokens of a single class."""
    tokens = full.select("cls", "n", F.explode("tokens").alias("token"))
    common = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    lists = tokens.join(common, "token").groupBy("cls", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("ranked"))
    length = F.col("n") - _least(F.col("n"), percent) + 1 - (F.col("n") - F.size("ranked"))
    return lists.withColumn("length", length.cast("int")).filter("length > 0").select("cls", "n", F.slice("ranked", F.lit(1), F.col("length"))["token"].alias("prefix"))


def head(percent: int) -> Column:
    """The prefix in the order of the hashes."""
    return F.slice("tokens", F.lit(1), (F.col("n") - _least(F.col("n"), percent) + 1).cast("int"))


def dealt(prefixes: DataFrame, percent: int, folder: str) -> tuple[DataFrame, DataFrame]:
    """Of rows (cls, n, token): pairs (src, dst) from buckets of up to BUCKET classes, and the rows (cls, token, least) of larger ones."""
    prefixes = saved(prefixes, f"{folder}-prefixes")
    buckets = prefixes.groupBy("token").agg(F.count(F.lit(1)).alias("classes"), F.min("cls").alias("least")).filter("classes > 1")
    buckets = saved(buckets, f"{folder}-buckets")
    pairs = small_pairs(prefixes.join(buckets.filter(F.col("classes") <= BUCKET).select("token"), "token"), percent)
    return pairs, saved(prefixes.join(buckets.filter(F.col("classes") > BUCKET), "token").select("cls", "token", "least"), f"{folder}-large")


def candidates(full: DataFrame, percent: int, folder: str) -> tuple[DataFrame, DataFrame]:
    """Pairs (src, dst), and the clusters (node, component) of what has larger buckets in all three orders."""
    pairs, large = dealt(rarest_first(full, percent).select("cls", "n", F.explode("prefix").alias("token")), percent, f"{folder}/rare")
    for name, prefix in (("hash", head(percent)), ("second", F.col("other"))):
        among = full.join(large.select("cls").distinct(), "cls", "left_semi").select("cls", "n", F.explode(prefix).alias("token"))
        more, large = dealt(among, percent, f"{folder}/{name}")
        pairs = pairs.unionByName(more)
    clusters = saved(connected_components(large.select(F.col("cls").alias("src"), F.col("least").alias("dst")), folder=f"{folder}/among-clusters"), f"{folder}/clusters")
    one, two = clusters.select(F.col("node").alias("src"), F.col("component").alias("one")), clusters.select(F.col("node").alias("dst"), F.col("component").alias("two"))
    apart = pairs.distinct().join(one, "src", "left").join(two, "dst", "left").filter("one is null or two is null or one != two").select("src", "dst")
    return saved(apart, f"{folder}/pairs"), clusters


def small_pairs(prefixes: DataFrame, percent: int) -> DataFrame:
    """(src, dst) of classes in a bucket of at most BUCKET classes, of sizes that allow a link."""
    a, b = prefixes.select("token", F.col("cls").alias("src"), F.col("n").alias("src_n")), prefixes.select("token", F.col("cls").alias("dst"), F.col("n").alias("dst_n"))
    fits = (F.least("src_n", "dst_n") * 100 >= F.greatest("src_n", "dst_n") * percent) & (F.col("src") < F.col("dst"))
    return a.join(b, "token").filter(fits).select("src", "dst").distinct()


def verified(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs that pass the prefix filters of the two hash orders, and then the measure itself."""
    heads = full.select("cls", head(percent).alias("head"), "other")
    a, b = heads.select(F.col("cls").alias("src"), F.col("head").alias("a"), F.col("other").alias("c")), heads.select(F.col("cls").alias("dst"), F.col("head").alias("b"), F.col("other").alias("d"))
    left = pairs.join(a, "src").join(b, "dst").filter(F.arrays_overlap("a", "b") & F.arrays_overlap("c", "d")).select("src", "dst")
    a, b = full.select(F.col("cls").alias("src"), F.col("tokens").alias("a")), full.select(F.col("cls").alias("dst"), F.col("tokens").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    return left.join(a, "src").join(b, "dst").filter(both * 100 >= (F.size("a") + F.size("b") - both) * percent).select("src", "dst")


def common_counts(lists: list[np.ndarray], rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets `rows` with the sets `columns`, by products of bounded incidence matrices."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    _, column = np.unique(np.concatenate(lists), return_inverse=True)
    row = np.repeat(np.arange(len(lists)), sizes)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(rows), len(columns)), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, CHUNK):
        a, b = np.searchsorted(column, [low, low + CHUNK])
        part = np.zeros((len(lists), CHUNK), np.float32)
        part[row[a:b], column[a:b] - low] = 1
        out += part[rows] @ part[columns].T
    return out.astype(np.int64)


def linked_blocks(table: pa.Table, percent: int) -> pa.Table:
    """Links between two blocks (or within one) of a cluster: a spanning forest, and each class's number of links."""
    low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
    cls, block, n = (table.column(x).to_numpy() for x in ("cls", "block", "n"))
    rows, columns = np.flatnonzero(block == low), np.flatnonzero(block == high)
    src, dst, links = [], [], []
    if len(rows) and len(columns):
        tokens = [x.values.to_numpy() for x in table.column("tokens")]
        smaller = least_common(n, percent)
        heads = [t[: k - s + 1] for t, k, s in zip(tokens, n.tolist(), smaller.tolist(), strict=True)]
        ok = np.minimum.outer(n[rows], n[columns]) * 100 >= np.maximum.outer(n[rows], n[columns]) * percent
        for lists in (heads, [x.values.to_numpy() for x in table.column("other")]):
            ok &= common_counts(lists, rows, columns) > 0
        both = common_counts(tokens, rows, columns)
        ok &= both * 100 >= (np.add.outer(n[rows], n[columns]) - both) * percent
        if low == high:
            ok &= rows[:, None] < columns[None, :]
        i, j = np.nonzero(ok)
        i, j = rows[i], columns[j]
        degree = np.bincount(i, minlength=len(cls)) + np.bincount(j, minlength=len(cls))
        root = list(range(len(cls)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            ra, rb = find(a), find(b)
            if ra != rb:
                root[rb] = ra
                src.append(cls[a])
                dst.append(cls[b])
                links.append(0)
        for a in np.flatnonzero(degree).tolist():
            src.append(cls[a])
            dst.append(cls[a])
            links.append(int(degree[a]))
    return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64()), "links": pa.array(links, pa.int64())})


def block_links(clusters: DataFrame, full: DataFrame, percent: int, folder: str) -> DataFrame:
    """(src, dst, links) within clusters (node, component): each pair of blocks of a cluster is a group of its own.

    A block has sets of one band of sizes, and meets the blocks of its band and of the next ones only: sets of a link are no farther apart.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / (math.log(100 / percent) * 1.001))
    members = clusters.select(F.col("node").alias("cls"), "component").join(full.select("cls", "n"), "cls").select("cls", "component", band.alias("band"))
    sizes = members.groupBy("component", "band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("blocks"))
    sizes = saved(sizes, f"{folder}/blocks")
    near = sizes.select("component", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), F.col("band").alias("of"), "blocks")
    near = near.groupBy("component", "band").agg(F.max(F.when(F.col("band") == F.col("of"), F.col("blocks"))).alias("own"), F.collect_list(F.struct("of", "blocks")).alias("others")).filter("own is not null")
    number = F.pmod(F.xxhash64(F.lit(7), F.col("cls")), F.col("own"))
    placed = members.join(near, ["component", "band"]).select("cls", "component", (F.col("band") * (1 << 40) + number).alias("block"), F.explode("others").alias("other"))
    placed = placed.select("cls", "component", "block", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("other.blocks") - 1), lambda i: F.col("other.of") * (1 << 40) + i)).alias("with"))
    placed = placed.select("cls", "component", "block", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"))
    return placed.join(full, "cls").select("cls", "component", "block", "low", "high", "n", "tokens", "other").groupBy("component", "low", "high").applyInArrow(lambda t: linked_blocks(t, percent), "src long, dst long, links long")


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, keep: Sequence[str] = (), folder: str | None = None) -> DataFrame:
    """Per row of docs: the columns `keep`, doc_id, n_shingles, component_id, n_links (links of its set to other sets), group (null for an empty set).

    folder: where the tables go, a new one by default; what the result doesn't read is deleted.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = folder or work_dir(spark, "jaccard")
    texts = docs.select(*keep, docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields[:-1])
    probed = saved(texts.mapInArrow(lambda x: probe_rows(x, width, percent), f"{schema}, k1 long, k2 long, n long, probe array<long>"), f"{folder}/probed")
    sets = saved(probed.drop("probe"), f"{folder}/sets")
    classes = probed.filter("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("probe").alias("probe"))
    classes = saved(classes.withColumn("cls", F.monotonically_increasing_id()), f"{folder}/probes")
    dropped(spark, f"{folder}/probed")
    left = saved(survivors(classes, percent, folder), f"{folder}/survivors")
    classes = saved(classes.drop("n", "probe"), f"{folder}/classes")
    for name in ("probes", "common", "shared"):
        dropped(spark, f"{folder}/{name}")
    reps = saved(classes.select("cls", "rep", "k1", "k2").join(left, "cls"), f"{folder}/reps")
    ids = small(reps.select("rep").distinct())
    full = texts.join(ids, texts["doc_id"].eqNullSafe(ids["rep"]), "left_semi").select("text").mapInArrow(lambda x: token_rows(x, width, percent), "k1 long, k2 long, n long, tokens array<long>, other array<long>")
    full = saved(full.join(small(reps.select("cls", "k1", "k2")), ["k1", "k2"]).drop("k1", "k2").dropDuplicates(["cls"]), f"{folder}/full")

    pairs, clusters = candidates(full, percent, folder)
    found = saved(verified(pairs, full, percent), f"{folder}/links")
    in_blocks = saved(block_links(clusters, full, percent, folder), f"{folder}/block-links")

    edges = found.unionByName(in_blocks.filter("links = 0").select("src", "dst"))
    groups = saved(connected_components(edges, folder=f"{folder}/among-groups"), f"{folder}/groups")
    ends = found.select(F.col("src").alias("cls"), F.lit(1).alias("links")).unionByName(found.select(F.col("dst").alias("cls"), F.lit(1).alias("links")))
    links = ends.unionByName(in_blocks.filter("links > 0").select(F.col("src").alias("cls"), "links")).groupBy("cls").agg(F.sum("links").alias("n_links"))
    in_groups = classes.select("cls", "rep").join(groups.withColumnRenamed("node", "cls"), "cls")
    first = in_groups.groupBy("component").agg(F.min("rep").alias("component_id"))
    linked = in_groups.join(first, "component").join(links, "cls", "left").select("cls", "component", "component_id", "n_links")
    named = classes.select("cls", "k1", "k2", "rep").join(linked, "cls", "left").select("k1", "k2", F.coalesce("component", "cls").alias("group"), F.coalesce("component_id", "rep").alias("component_id"), "n_links")
    named = saved(named, f"{folder}/named")  # so that the join with a class of very many copies has two plain sides and can be split
    for name in ("full", "rare", "hash", "second"):
        for part in ("", "-prefixes", "-buckets", "-large"):
            dropped(spark, f"{folder}/{name}{part}")
    return sets.select(*keep, "doc_id", "n", "k1", "k2").join(named, ["k1", "k2"], "left").select(
        *keep, "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "group"
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, four fifths in common), the one of the smallest id, with all columns.

    Rows of one id and text are one document, so all of them stay or go; else one row of a group stays, also if its rows share an id or have none.
    Documents without words are no group and stay.
    """
    folder = work_dir(spark, "jaccard")
    named = {"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), F.col("text"))}  # the text's 128-bit name
    found = jaccard_classes(docs.select("doc_id", "text", *[v.alias(n) for n, v in named.items()]), width=STAGE_WIDTH, percent=STAGE_PERCENT, keep=list(named), folder=folder)
    found = saved(found.filter("group is not null").select("doc_id", *named, "group"), f"{folder}-found")
    dropped(spark, folder)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *named)
    stays = found.groupBy("group").agg(F.min(order).alias("stays"))
    gone = saved(found.join(stays, "group").filter(order != F.col("stays")).select(F.col("doc_id").alias("__id"), *[F.col(n).alias(f"__{n}") for n in named]).distinct(), f"{folder}-gone")
    gone = small(gone)
    same = docs["doc_id"].eqNullSafe(gone["__id"])
    for n, v in named.items():
        same = same & (F.xxhash64(*([] if n == "t1" else [F.lit(1)]), docs["text"]) == gone[f"__{n}"])
    return docs.join(gone, same, "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("group")


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
      ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' '))) END AS shingles FROM w),
n AS (SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n, md5(array_to_string(list_sort(shingles), ',')) AS key FROM s),
t AS (SELECT doc_id, unnest(shingles) AS token FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM t a JOIN t b ON a.token = b.token AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 90 * (x.n + y.n - c)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.v FROM r JOIN e ON r.b = e.u)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id, (SELECT count(DISTINCT o.key) FROM e JOIN n o ON o.doc_id = e.v WHERE e.u = n.doc_id AND o.key != n.key) AS n_links
FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n, n.key
"""
