"""Language identification: multinomial logistic regression on TF-IDF of character n-grams.

Features are hashed 1- to 3-grams of characters, weighed by tf-idf and scaled to length 1; document frequencies are counted over
all training texts.  The weights come from follow-the-regularised-leader with elastic-net penalties (L1 makes them sparse), on a bounded
sample of the labelled rows: about `per_label` of each label, in SHARDS shards, more with a sample of over SHARDS * SHARD_ROWS rows, whose models are averaged.  A part of the sample
is kept back for the temperature that calibrates the probabilities: its losses are summed by tasks for a grid of temperatures, so only sums and the weights reach the driver.  There is a weight per feature and label; with so many labels that
2^BITS features would give more than CELLS of them, features are hashed to fewer bits, so memory is bounded and no label is left out.
Tasks get the model as a broadcast variable, whose size CELLS bounds.

Defined results: a null text, or one without a letter, is `und` with score 0, and so is every text if nothing was learned; equal texts
get equal rows; of equal scores the label first in order wins; rows without a label are no training rows; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, saved, work_dir
from .words import slices

BITS, GRAMS = 15, 3
PER_LABEL, SHARDS, SHARD_ROWS, EPOCHS, CELLS = 2000, 4, 20_000, 4, 1 << 24
GRID, PASSES = 65, 3
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.002, 0.0001
UNDETERMINED = "und"
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points (Latin capitals lower-cased, white space and controls as a space) and each text's bounds."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).copy()
    bounds = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    points[points < 33] = 32
    upper = ((points >= 65) & (points <= 90)) | ((points >= 0xC0) & (points <= 0xDE) & (points != 0xD7))
    points[upper] += 32
    return points, bounds


def bits_for(n_labels: int) -> int:
    """The bits of a feature's number."""
    return max(1, min(BITS, (CELLS // max(1, n_labels)).bit_length() - 1))


def gram_features(points: np.ndarray, bits: int = BITS) -> list[np.ndarray]:
    """For each n, the feature of the n-gram that starts at each character."""
    hashed = np.zeros(len(points), np.uint64)
    out = []
    for n in range(GRAMS):
        width = len(points) - n
        if width <= 0:
            break
        hashed = (hashed[:width] + points[n:].astype(np.uint64) + np.uint64(1)) * _FACTORS[n]
        out.append(((hashed ^ (hashed >> np.uint64(29))) * _FACTORS[0] >> np.uint64(64 - bits)).astype(np.int64))
    return out


def text_counts(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per text its features in order, and how often each occurs; memory goes with the text's length or 2^bits, whichever is less."""
    points, bounds = characters(data, offsets)
    grams = gram_features(points, bits)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        found = np.concatenate([g[a : max(a, b - n)] for n, g in enumerate(grams)]) if grams else np.zeros(0, np.int64)
        if len(found) << 3 < 1 << bits:
            yield np.unique(found, return_counts=True)
        else:
            counts = np.bincount(found)
            at = np.flatnonzero(counts)
            yield at, counts[at]


def tf_idf(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values = np.log1p(counts) * idf[at]
    return at, values / max(np.sqrt(values @ values), 1e-12)


def frequency_rows(batches: Iterable[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """(feature, df) of a task's texts; feature -1 counts the texts."""
    df, n = np.zeros(1 << bits, np.int64), 0
    for batch in batches:
        for first, last, data, offsets in slices(batch.column(0)):
            n += last - first
            for at, _ in text_counts(data, offsets, bits):
                df[at] += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], names=["feature", "df"])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def leader(table: pa.Table, labels: list[str], idf: np.ndarray) -> pa.Table:
    """The weights that are not 0 after EPOCHS passes over a shard of the sample."""
    bits = len(idf).bit_length() - 1
    z, n = np.zeros((len(idf), len(labels))), np.zeros((len(idf), len(labels)))
    number = {x: i for i, x in enumerate(labels)}
    order = np.argsort(table.column("order").to_numpy(), kind="stable")
    rows = [tf_idf(*found, idf) for _, _, data, offsets in slices(table.column("text")) for found in text_counts(data, offsets, bits)]
    target = [number[x] for x in table.column("label").to_pylist()]

    def weights(at) -> np.ndarray:
        shrunk = np.sign(z[at]) * L1 - z[at]
        return np.where(np.abs(z[at]) > L1, shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2), 0.0)

    for _ in range(EPOCHS):
        for i in order.tolist():
            at, values = rows[i]
            w = weights(at)
            error = softmax(values @ w)
            error[target[i]] -= 1.0
            g = values[:, None] * error
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    w = weights(slice(None))
    at, label = np.nonzero(w)
    return pa.table({"feature": pa.array(at), "label": pa.array(label), "weight": pa.array(w[at, label]), "rows": pa.array(np.full(len(at), len(rows)))})


def loss_rows(batches: Iterable[pa.RecordBatch], shared: Broadcast, labels: list[str], heats: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The summed cross entropy of a task's rows at each temperature."""
    weights, idf = shared.value
    bits = len(idf).bit_length() - 1
    number, sums = {x: i for i, x in enumerate(labels)}, np.zeros(len(heats))
    for batch in batches:
        target = [number[x] for x in batch.column(0).to_pylist()]
        for first, last, data, offsets in slices(batch.column(1)):
            for i, found in zip(range(first, last), text_counts(data, offsets, bits), strict=True):
                at, values = tf_idf(*found, idf)
                p = softmax((values @ weights[at])[None, :] / heats[:, None])
                sums -= np.log(np.maximum(p[:, target[i]], 1e-300))
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(heats))), pa.array(sums)], names=["heat", "loss"])


def least_loss(losses: Callable[[np.ndarray], np.ndarray | None]) -> float:
    """The temperature of least loss: a grid of logarithms first, then finer ones around the best; 1 where there is no loss."""
    low, high = np.log(0.01), np.log(100.0)
    for _ in range(PASSES):
        grid = np.linspace(low, high, GRID)
        found = losses(np.exp(grid))
        if found is None:
            return 1.0
        best = grid[int(found.argmin())]
        low, high = best - (grid[1] - grid[0]), best + (grid[1] - grid[0])
    return float(np.exp(best))


def temperature(logits: np.ndarray, target: np.ndarray) -> float:
    """The temperature of least cross entropy of rows of logits."""

    def losses(heats: np.ndarray) -> np.ndarray | None:
        p = softmax(logits[None] / heats[:, None, None])[:, np.arange(len(target)), target] if len(logits) else None
        return None if p is None else -np.log(np.maximum(p, 1e-300)).sum(axis=1)

    return least_loss(losses)


def calibrated(kept: DataFrame, shared: Broadcast, labels: list[str]) -> float:
    """The temperature of least cross entropy over the kept rows (label, text), whose losses are summed by tasks."""

    def losses(heats: np.ndarray) -> np.ndarray | None:
        rows = kept.mapInArrow(lambda x: loss_rows(x, shared, labels, heats), "heat long, loss double").groupBy("heat").agg(F.sum("loss").alias("loss")).collect()
        found = np.zeros(len(heats))
        for r in rows:
            found[r["heat"]] = r["loss"]
        return found if found.any() else None

    return least_loss(losses)


class Learned:
    def __init__(self, labels: list[str], idf: np.ndarray, weights: np.ndarray, heat: float):
        self.labels, self.idf, self.weights, self.heat = labels, idf, weights, heat


def learned(rows: DataFrame, per_label: int = PER_LABEL) -> Learned | None:
    """A model of rows (key, label, text); None without rows."""
    spark = rows.sparkSession
    rows = rows.filter(F.col("label").isNotNull())
    found = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if not found:
        return None
    labels = sorted(found)
    bits = bits_for(len(labels))
    frequencies = rows.select("text").mapInArrow(lambda x: frequency_rows(x, bits), "feature long, df long").groupBy("feature").agg(F.sum("df").alias("df")).collect()
    df, total = np.zeros(1 << bits), 0
    for r in frequencies:
        if r["feature"] < 0:
            total = r["df"]
        else:
            df[r["feature"]] = r["df"]
    idf = np.log((1 + total) / (1 + df)) + 1

    share = F.element_at(F.create_map(*[F.lit(x) for label in labels for x in (label, min(1.0, per_label / found[label]))]), F.col("label"))
    order = F.xxhash64("key", F.lit(1))
    parts = -(-sum(min(n, per_label) for n in found.values()) // (SHARDS * SHARD_ROWS))  # 1 up to SHARDS * SHARD_ROWS rows
    part, kept = F.pmod(F.xxhash64("key", F.lit(2)), F.lit(SHARDS + 1)), SHARDS * parts
    shard = F.when(part == SHARDS, kept).otherwise(part * parts + F.pmod(F.xxhash64("key", F.lit(3)), F.lit(parts)))
    sample = rows.filter(F.pmod(order, F.lit(1 << 30)) < share * (1 << 30)).withColumn("order", order).withColumn("shard", shard)
    sample = saved(sample.select("label", "text", "order", "shard"), work_dir(spark, "language-sample"))
    models = sample.filter(F.col("shard") < kept).groupBy("shard").applyInArrow(lambda t: leader(t, labels, idf), "feature long, label long, weight double, rows long")
    models = saved(models, work_dir(spark, "language-models"))
    fitted = sample.filter(F.col("shard") < kept).count()
    weights = np.zeros((1 << bits, len(labels)))
    cells = models.groupBy((F.col("feature") * len(labels) + F.col("label")).cast("int").alias("cell")).agg(F.sum(F.col("weight") * F.col("rows")).alias("weight")).toArrow()
    weights.ravel()[cells.column("cell").to_numpy()] = cells.column("weight").to_numpy() / max(1, fitted)
    shared = spark.sparkContext.broadcast((weights, idf))
    heat = calibrated(sample.filter(F.col("shard") == kept).select("label", "text"), shared, labels)
    return Learned(labels, idf, weights, heat)


def lettered(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts have a letter."""
    ascii_letters = ((data | 0x20) >= 97) & ((data | 0x20) <= 122)
    sums = np.concatenate([[0], np.cumsum(ascii_letters)])
    found = sums[offsets[1:]] > sums[offsets[:-1]]
    for i in np.flatnonzero(~found).tolist():
        found[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8"))
    return found


def predicted_rows(batches: Iterable[pa.RecordBatch], shared: Broadcast, keep: int) -> Iterator[pa.RecordBatch]:
    model: Learned | None = shared.value
    bits = len(model.idf).bit_length() - 1 if model is not None else BITS
    for batch in batches:
        for first, last, data, offsets in slices(batch.column(keep)):
            labels, scores = [UNDETERMINED] * (last - first), np.zeros(last - first)
            if model is not None:
                for i, (found, ok) in enumerate(zip(text_counts(data, offsets, bits), lettered(data, offsets).tolist(), strict=True)):
                    if ok:
                        at, values = tf_idf(*found, model.idf)
                        p = softmax(values @ model.weights[at] / model.heat)
                        labels[i], scores[i] = model.labels[int(p.argmax())], min(1.0, float(p.max()))
            kept = [batch.column(j).slice(first, last - first) for j in range(keep)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(labels, pa.string()), pa.array(scores)], names=[*batch.schema.names[:keep], "lang_pred", "score"])


def identified(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_label: int = PER_LABEL) -> DataFrame:
    """Per row of docs: doc_id, held_out, lang_pred, score; it learns from labelled rows where held_out is false."""
    bounded_batches(docs.sparkSession)
    out = F.coalesce(held_out, F.lit(False))
    model = learned(docs.filter(~out).select(F.col(id_col).alias("key"), F.col(label_col).alias("label"), F.col(text_col).alias("text")), per_label)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), out.alias("held_out"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(lambda x: predicted_rows(x, shared, 2), "doc_id long, held_out boolean, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(spark.read.parquet(f"{sf_dir}/documents.parquet"), F.crc32(F.col("doc_id").cast("string")) % 4 == 2)
