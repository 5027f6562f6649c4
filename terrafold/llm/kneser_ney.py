"""Scores by an interpolated bigram model with modified Kneser-Ney smoothing.

Counting: tasks count the words of their training texts, Spark sums them, and each shard of the vocabulary is
written as a sorted array of hashes with counts; a word's id is its place.  Bigrams become numbers of two ids, counted per task,
packed, dealt out by the range of their first word and merged into sorted arrays with the statistics of each
context; how many different words stand before a word (its continuation count) is dealt out by ranges of that word.
A first word that occurs more than HOT times, such as the start mark, is dealt out by ranges of the second word as well, and the statistics of its
parts are summed: there are at most as many such words as HOT goes into the tokens.  So no group grows with the corpus.
Scoring: every worker maps the arrays of the shared folder into memory, at most OPEN at a time, and looks its texts up; no text is shuffled.
A text scores after a start mark, and its end is a token like any other.

p(w|v) = max(c(vw) - D(c(vw)), 0) / c(v) + g(v) q(w), with q(w) = max(k(w) - D'(k(w)), 0) / k + g' / (V + 1), where k are continuation
counts, D and D' have values for counts of 1, 2 and more, g and g' are what is left over, and V is the size of the vocabulary.

Defined results: a null text is an empty one, which has its end token; equal texts have equal scores; without training texts all words are
unknown, V is 0 and scores are 0; an empty table gives no rows; other columns are not read.
The model files need spark.checkpoint.dir on a mounted file system.
"""

from __future__ import annotations

import json
import os
import uuid
from collections import OrderedDict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, mounted_path, saved, work_dir
from .words import Words, slices

END = np.uint64(0x5DEECE66D2F1A3B7)
SHARD_WORDS, SHARD_TOKENS, BUFFER, HOT, SPLITS = 2_000_000, 4_000_000, 3_000_000, 1_000_000, 4
LIMIT, OPEN = 1 << 32, 256
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def save_array(folder: str, name: str, values: np.ndarray) -> None:
    """Whole files only: a task that is run again, or twice at once, puts the same file in the same place."""
    os.makedirs(folder, exist_ok=True)
    part = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with open(part, "wb") as file:
        np.save(file, values)
    os.replace(part, f"{folder}/{name}.npy")


def load_array(folder: str, name: str, kind: type, present: bool) -> np.ndarray:
    """A mapped array; one that the model has must be there, or the folder isn't shared with this worker."""
    if not present:
        return np.zeros(0, kind)
    return np.load(f"{folder}/{name}.npy", mmap_mode="r")


class Shelf:
    """A model's mapped arrays, by their names: opened when they are asked for, and of OPEN open ones the longest unused is closed for the next.

    Every mapped array holds a descriptor, so a worker has at most OPEN of them, however many shards a model has.
    """

    def __init__(self, folder: str):
        self.folder, self.open = folder, OrderedDict()

    def array(self, name: str, kind: type, present: bool = True) -> np.ndarray:
        if name in self.open:
            self.open.move_to_end(name)
            return self.open[name]
        found = load_array(self.folder, name, kind, present)
        if present:
            self.open[name] = found
            if len(self.open) > OPEN:
                self.open.popitem(last=False)
        return found


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all tokens of a slice, an end after each text, and each text's bounds."""
    words = Words(data, offsets)
    bounds = words.bounds + np.arange(len(words.bounds))
    out = np.full(bounds[-1], END)
    ends = np.zeros(len(out), bool)
    ends[bounds[1:] - 1] = True
    out[~ends] = words.hashes()
    return out, bounds


def unigram_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, count), summed over as many texts as fit into BUFFER distinct words."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def summed() -> tuple[np.ndarray, np.ndarray]:
        return merged(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))

    size = 0
    for batch in batches:
        for _, _, data, offsets in slices(batch.column(0)):
            held.append(np.unique(tokens_of(data, offsets)[0], return_counts=True))
            size += len(held[-1][0])
            if size > BUFFER:
                held = [summed()]
                size = len(held[0][0])
                if size > BUFFER // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0][0].view(np.int64)), pa.array(held[0][1])], names=["hash", "count"])
                    held, size = [], 0
    if held:
        keys, counts = summed()
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["hash", "count"])


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with their counts summed."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, counts
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def write_words(table: pa.Table, folder: str) -> pa.Table:
    """One shard of the vocabulary."""
    shard = table.column("shard")[0].as_py()
    keys = table.column("hash").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    save_array(folder, f"words-{shard}", keys[order])
    save_array(folder, f"counts-{shard}", table.column("count").to_numpy()[order])
    return pa.table({"shard": pa.array([shard], pa.int64()), "size": pa.array([len(keys)], pa.int64())})


class Vocabulary:
    def __init__(self, model: dict, shelf: Shelf | None = None):
        self.bits, self.bases = model["bits"], np.array(model["bases"])
        self.ends, self.shelf = [*model["bases"][1:], model["size"]], shelf or Shelf(model["folder"])
        for p in range(len(self.bases)):
            if self.filled(p):  # a folder that isn't shared is told at once
                self.shelf.array(f"words-{p}", np.uint64)
                break

    def filled(self, p: int) -> bool:
        return bool(self.ends[p] > self.bases[p])

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and training counts."""
        unique, inverse = np.unique(hashes, return_inverse=True)
        ids, counts = np.full(len(unique), -1), np.zeros(len(unique), np.int64)
        cuts = np.searchsorted(unique >> np.uint64(64 - self.bits) if self.bits else np.zeros(len(unique), np.uint64), np.arange((1 << self.bits) + 1).astype(np.uint64))
        for p, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            if a < b and self.filled(p):
                keys = self.shelf.array(f"words-{p}", np.uint64)
                at = np.minimum(np.searchsorted(keys, unique[a:b]), len(keys) - 1)
                hit = keys[at] == unique[a:b]
                ids[a:b][hit] = at[hit] + self.bases[p]
                counts[a:b][hit] = self.shelf.array(f"counts-{p}", np.int64)[at[hit]]
        return ids[inverse], counts[inverse]


class Dealer:
    """Which shard a bigram is in: by the range of its first word, and the ranges of the second one if the first is hot."""

    def __init__(self, model: dict):
        self.shards, self.size = model["shards"], model["size"]
        self.hot = np.array(sorted(model["hot"]), np.int64)
        self.parts = np.array([-(-model["hot"][v] // HOT) for v in self.hot.tolist()], np.int64)

    def split(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether words are hot, and into how many parts they are dealt."""
        if not len(self.hot):
            return np.zeros(len(v), bool), np.ones(len(v), np.int64)
        at = np.minimum(np.searchsorted(self.hot, v), len(self.hot) - 1)
        found = self.hot[at] == v
        return found, np.where(found, self.parts[at], 1)

    def shard_of(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        hot, parts = self.split(v)
        part = np.where(hot, 1 + w * parts // (self.size + 1), 0)
        return (v * self.shards // (self.size + 1) << 24) + part


def pack(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted keys as differences, byte plane by byte plane, which shuffle compression shortens well."""
    return np.diff(keys, prepend=np.zeros(1, keys.dtype)).view(np.uint8).reshape(-1, 8).T.tobytes(), counts.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = [np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view(np.uint64).ravel() for x in (keys, counts)]
    return np.cumsum(planes[0], dtype=np.uint64), planes[1].astype(np.int64)


def packed_batch(shards: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """A row per shard; keys are sorted by shard, then by key."""
    first = np.flatnonzero(np.diff(shards, prepend=-1))
    ends = np.append(first[1:], len(shards))
    parts = [pack(keys[a:b], counts[a:b]) for a, b in zip(first, ends, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(shards[first], pa.int64()), pa.array([k for k, _ in parts], pa.binary()), pa.array([c for _, c in parts], pa.binary())], names=["shard", "keys", "counts"])


def unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    parts = [unpack(k, c) for k, c in zip(table.column("keys").to_pylist(), table.column("counts").to_pylist(), strict=True)]
    return merged(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))


def bigram_keys(ids: np.ndarray, bounds: np.ndarray, start: int) -> np.ndarray:
    """The number of each token and the one before it; the start mark's id is `start`."""
    before = np.empty(len(ids), np.int64)
    before[1:] = ids[:-1]
    before[bounds[:-1]] = start
    return (before.astype(np.uint64) << np.uint64(32)) | ids.astype(np.uint64)


def bigram_rows(batches: Iterable[pa.RecordBatch], model: dict) -> Iterator[pa.RecordBatch]:
    vocabulary, dealer = Vocabulary(model), Dealer(model)
    held: list[np.ndarray] = []
    size = 0

    def flushed() -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        shards = dealer.shard_of((keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(LIMIT - 1)).astype(np.int64))
        order = np.argsort(shards, kind="stable")
        return packed_batch(shards[order], keys[order], counts[order])

    for batch in batches:
        for _, _, data, offsets in slices(batch.column(0)):
            hashes, bounds = tokens_of(data, offsets)
            held.append(bigram_keys(vocabulary.look_up(hashes)[0], bounds, model["size"]))
            size += len(held[-1])
            if size > BUFFER:
                yield flushed()
                held, size = [], 0
    if held:
        yield flushed()


def count_of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == i).sum()) for i in (1, 2, 3, 4)]


def statistics(context: np.ndarray, counts: np.ndarray, width: int) -> np.ndarray:
    """Per context the sum of its counts and how many of them are 1, 2 and more."""
    return np.stack([np.bincount(context, weights=x, minlength=width) for x in (counts, counts == 1, counts == 2, counts > 2)], axis=1)


def write_bigrams(table: pa.Table, model: dict) -> pa.Table:
    """A shard of bigrams and of its contexts' statistics; returns continuation counts, the counts of counts, and statistics of hot contexts."""
    shard, shards, size = table.column("shard")[0].as_py(), model["shards"], model["size"]
    keys, counts = unpacked(table)
    save_array(model["folder"], f"bigrams-{shard}", keys)
    save_array(model["folder"], f"bigram-counts-{shard}", counts.astype(np.uint32 if not len(counts) or counts.max() < LIMIT else np.uint64))
    v = (keys >> np.uint64(32)).astype(np.int64)
    hot: dict[int, list[int]] = {}
    if shard & ((1 << 24) - 1):
        words, context = np.unique(v, return_inverse=True)
        hot = dict(zip(words.tolist(), statistics(context, counts, len(words)).astype(np.int64).tolist(), strict=True))
    else:
        low, high = (-(-x * (size + 1) // shards) for x in (shard >> 24, (shard >> 24) + 1))
        save_array(model["folder"], f"contexts-{shard >> 24}", statistics(v - low, counts, high - low))
    words, before = np.unique(keys & np.uint64(LIMIT - 1), return_counts=True)
    out = pa.Table.from_batches([packed_batch(words.astype(np.int64) * model["ranges"] // size, words, before)])
    facts = json.dumps({"shard": shard, "counts": [*count_of_counts(counts), len(keys)], "hot": hot}).encode()
    return pa.concat_tables([out, pa.table({"shard": pa.array([-1], pa.int64()), "keys": pa.array([facts], pa.binary()), "counts": pa.array([b""], pa.binary())})])


def write_continuations(table: pa.Table, model: dict) -> pa.Table:
    """How many different words stand before each word of a range of the vocabulary."""
    part = table.column("shard")[0].as_py()
    words, before = unpacked(table)
    low, high = (-(-x * model["size"] // model["ranges"]) for x in (part, part + 1))
    counts = np.zeros(high - low, np.int64)
    counts[words.astype(np.int64) - low] = before
    save_array(model["folder"], f"continuations-{part}", counts)
    n = count_of_counts(counts)
    return pa.table({"part": pa.array([part], pa.int64()), **{f"n{i}": pa.array([x], pa.int64()) for i, x in enumerate((*n, int((counts > 2).sum())), 1)}})


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and more; plain ones where a count of counts is 0, and never less than a tenth, so that every context leaves something for new words."""
    if not n1 or not n2:
        return [0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.0]
    return [min(max(x, 0.1), i + 1.0) for i, x in enumerate(d)]


def discounted(counts: np.ndarray, d: list[float]) -> np.ndarray:
    return np.maximum(counts - np.array([0.0, *d])[np.minimum(counts, 3)], 0.0)


class Model:
    """The mapped arrays."""

    def __init__(self, model: dict):
        self.m = model
        self.shelf = Shelf(model["folder"])
        self.vocabulary, self.dealer = Vocabulary(model, self.shelf), Dealer(model)
        self.parts, self.bigrams = set(model["parts"]), set(model["present"])
        self.contexts = {s >> 24 for s in model["present"] if not s & ((1 << 24) - 1)}
        wanted = {f"{x}-{s}.npy" for s in self.bigrams for x in ("bigrams", "bigram-counts")} | {f"contexts-{s}.npy" for s in self.contexts} | {f"continuations-{p}.npy" for p in self.parts}
        missing = wanted.difference(os.listdir(model["folder"])) if wanted else ()
        if missing:
            raise FileNotFoundError(f"{min(missing)} isn't in {model['folder']}")
        self.hot_stats = np.array([model["statistics"][v] for v in self.dealer.hot.tolist()], float).reshape(-1, 4)

    def lower(self, ids: np.ndarray) -> np.ndarray:
        """q of each word."""
        m = self.m
        out = np.full(len(ids), 1.0 / (m["size"] + 1) * (m["rest"] if m["bigrams"] else 1.0))
        part = np.where(ids >= 0, ids * m["ranges"] // max(1, m["size"]), -1)
        for p in np.unique(part[ids >= 0]).tolist():
            at = np.flatnonzero(part == p)
            if p in self.parts:
                out[at] += discounted(self.shelf.array(f"continuations-{p}", np.int64)[ids[at] - -(-p * m["size"] // m["ranges"])], m["lower"]) / m["bigrams"]
        return out

    def context(self, v: np.ndarray) -> np.ndarray:
        """The statistics of contexts; 0 of one never seen."""
        out = np.zeros((len(v), 4))
        hot, _ = self.dealer.split(v)
        if hot.any():
            out[hot] = self.hot_stats[np.searchsorted(self.dealer.hot, v[hot])]
        shard = np.where((v >= 0) & ~hot, v * self.m["shards"] // (self.m["size"] + 1), -1)
        for s in np.unique(shard[shard >= 0]).tolist():
            if s in self.contexts:
                at = np.flatnonzero(shard == s)
                out[at] = self.shelf.array(f"contexts-{s}", np.float64)[v[at] - -(-s * (self.m["size"] + 1) // self.m["shards"])]
        return out

    def log10(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """log10 p of each token."""
        m = self.m
        before = np.empty(len(ids), np.int64)
        before[1:] = ids[:-1]
        before[bounds[:-1]] = m["size"]
        pairs = (before + 1).astype(np.uint64) << np.uint64(32) | (ids + 1).astype(np.uint64)
        pairs, inverse = np.unique(pairs, return_inverse=True)
        v, w = (pairs >> np.uint64(32)).astype(np.int64) - 1, (pairs & np.uint64(LIMIT - 1)).astype(np.int64) - 1
        q = self.lower(w)
        c = np.zeros(len(pairs), np.int64)
        shard = np.where((v >= 0) & (w >= 0), self.dealer.shard_of(np.maximum(v, 0), np.maximum(w, 0)), -1)
        for s in np.unique(shard[shard >= 0]).tolist():
            if s in self.bigrams:
                keys, counts = (self.shelf.array(f"{x}-{s}", np.int64) for x in ("bigrams", "bigram-counts"))
                here = np.flatnonzero(shard == s)
                wanted = v[here].astype(np.uint64) << np.uint64(32) | w[here].astype(np.uint64)
                at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                c[here] = np.where(keys[at] == wanted, counts[at], 0)
        stats = self.context(v)
        seen = stats[:, 0] > 0
        total = np.where(seen, stats[:, 0], 1.0)
        p = np.where(seen, discounted(c, m["upper"]) / total + (stats[:, 1:] @ np.array(m["upper"])) / total * q, q)
        return np.log10(p)[inverse]


def score_rows(batches: Iterable[pa.RecordBatch], facts: dict) -> Iterator[pa.RecordBatch]:
    model = Model(facts)
    for batch in batches:
        for first, last, data, offsets in slices(batch.column(2)):
            hashes, bounds = tokens_of(data, offsets)
            ids, counts = model.vocabulary.look_up(hashes)
            base = np.log10((counts + 1) / (facts["tokens"] + facts["size"] + 1))
            sums = [np.add.reduceat(x, bounds[:-1]) for x in (base, model.log10(ids, bounds), (counts > 0).astype(np.int64))]
            n = last - first
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, n), batch.column(1).slice(first, n), pa.array(np.diff(bounds)), pa.array(sums[2]), pa.array(np.full(n, facts["tokens"])), pa.array(sums[0]), pa.array(sums[1])],
                names=[x.split()[0] for x in SCHEMA.split(", ")],
            )


def trained(texts: DataFrame) -> dict:
    """Counts the column `text` into the model's files; returns what scoring needs to know about them."""
    spark = texts.sparkSession
    work = work_dir(spark, "kneser-ney")
    folder = mounted_path(f"{work}/model")
    texts = texts.select("text")
    words = saved(texts.mapInArrow(unigram_rows, "hash long, count long").groupBy("hash").agg(F.sum("count").alias("count")), f"{work}/words")
    size, tokens = words.agg(F.count(F.lit(1)), F.sum("count")).first()
    bits = max(0, (-(-size // SHARD_WORDS) - 1).bit_length())
    if size + 1 >= LIMIT:
        raise ValueError("ids of words need 32 bits")
    shard = F.shiftrightunsigned("hash", 64 - bits) if bits else F.lit(0).cast("long")
    sizes = {r["shard"]: r["size"] for r in words.withColumn("shard", shard).groupBy("shard").applyInArrow(lambda t: write_words(t, folder), "shard long, size long").collect()}
    bases = np.cumsum([0, *(sizes.get(p, 0) for p in range(1 << bits))]).tolist()
    shards = max(1, -(-(tokens or 0) // SHARD_TOKENS))
    model = {"folder": folder, "bits": bits, "bases": bases[:-1], "size": size, "tokens": tokens or 0, "shards": shards, "ranges": SPLITS * shards}
    vocabulary = Vocabulary(model)
    frequent = {r["hash"]: r["count"] for r in words.filter(F.col("count") > HOT).collect()}  # at most tokens / HOT
    ids, _ = vocabulary.look_up(np.array([END.view(np.int64), *frequent], np.int64).view(np.uint64))
    texts_seen = int(vocabulary.look_up(np.array([END]))[1][0])
    model["hot"] = {v: n for v, n in [(size, texts_seen), *zip(ids[1:].tolist(), frequent.values(), strict=True)] if n > HOT}
    pairs = texts.mapInArrow(lambda x: bigram_rows(x, model), "shard long, keys binary, counts binary")
    counted = saved(pairs.groupBy("shard").applyInArrow(lambda t: write_bigrams(t, model), "shard long, keys binary, counts binary"), f"{work}/continuations")
    facts = [json.loads(bytes(r["keys"])) for r in counted.filter("shard < 0").select("keys").collect()]
    lower = counted.filter("shard >= 0").groupBy("shard").applyInArrow(lambda t: write_continuations(t, model), "part long, " + ", ".join(f"n{i} long" for i in range(1, 6))).collect()
    stats: dict[int, np.ndarray] = {v: np.zeros(4, np.int64) for v in model["hot"]}
    for x in facts:
        for v, found in x["hot"].items():
            stats[int(v)] += np.array(found)
    upper = np.array([x["counts"] for x in facts], np.int64).reshape(-1, 5).sum(axis=0).tolist()
    low = np.array([tuple(r)[1:] for r in lower], np.int64).reshape(-1, 5).sum(axis=0).tolist()
    model |= {"bigrams": upper[4], "upper": discounts(*upper[:4]), "lower": discounts(*low[:4]), "present": [x["shard"] for x in facts], "parts": [r["part"] for r in lower]}
    model |= {"statistics": {v: x.tolist() for v, x in stats.items()}, "rest": sum(d * n for d, n in zip(discounts(*low[:4]), (low[0], low[1], low[4]), strict=True)) / max(1, upper[4])}
    return model


def scored(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of SCHEMA for each row of docs; the model learns from rows where held_out is false."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    model = trained(rows.filter(~F.col("held_out")))
    return rows.mapInArrow(lambda x: score_rows(x, model), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), F.crc32(F.col("doc_id").cast("string")) % 7 == 2)
