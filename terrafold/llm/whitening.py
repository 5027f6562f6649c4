"""Whitening of embeddings by an incremental eigendecomposition.

An entry c becomes the whole number floor(64 * c) + 1000000.  The fit list has each distinct vector of these once.
Every partition of it keeps a spectrum (`spectra`) that takes its rows as centred rank-one updates, in blocks that QR turns into at most as many rows as columns;
the spectra of partitions are combined, FAN at a time in tasks, by successive rank-one updates.  The combined vectors are then refined by a Rayleigh-Ritz step: the
centred rows are projected on all of them, the products are summed by partitions and FAN at a time, and the small matrix's vectors turn the basis to
the eigenvectors of the covariance, to double precision.  Only sums and spectra (a square of the dimension) ever reach the driver.

Means are exact: n * x - sum in whole numbers, divided once.  identity_error is measured: the covariance of the whitened fit list, summed in the same way.

Defined results: a row is dropped if its vector is null, empty, or has a null, a non-finite entry or one of 2^46 or more (no exact whole
number); also if its length isn't the most common one (the longest of a tie).  Components without variance (below 10 * dimension * 2^-52 of the largest) can't
be scaled to 1 and are left out, so a list of one vector gives no rows.  Rows of equal or null ids each give theirs; an empty table gives no rows.
deviation is null if it is beyond 64 bits.  Of a component's two signs that with a positive largest entry is taken.  Columns other than the id and the vector aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, dropped, saved, work_dir
from .spectra import EPS, Spectrum

SCALE, SHIFT, LARGEST = 64, 1_000_000, float(1 << 46)
COMPONENTS, BLOCK, FAN = 16, 8192, 8
SPECTRUM = "part long, n long, sums array<string>, values array<double>, vectors array<double>"
PRODUCTS = "part long, products array<double>"
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Whitening:
    """What a fit found: components are the columns of vectors, by falling value."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x array<long>) of the rows that have a place in the space."""
    fits = F.forall("v", lambda c: F.coalesce(F.abs(c) < LARGEST, F.lit(False)))
    found = rows.select(rows[id_col].cast("long").alias("vec_id"), rows[vector_col].cast("array<double>").alias("v")).filter((F.size("v") > 0) & fits)
    return found.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE) + SHIFT).alias("x"))


def matrices(batches: Iterable[pa.RecordBatch], at: int = 0) -> Iterator[np.ndarray]:
    for batch in batches:
        if batch.num_rows:
            yield batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exact: in 64 bits where they do, else in whole numbers of any size."""
    if max(int(np.abs(x).max(initial=0)), max(map(abs, sums), default=0) // max(n, 1)) <= (1 << 61) // max(n, 1):
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def deviations(y: np.ndarray) -> list[int | None]:
    """The sums of squares of the rows; None beyond 64 bits."""
    if y.dtype != object and int(np.abs(y).max(initial=0)) ** 2 * y.shape[1] < 1 << 63:
        return (y * y).sum(axis=1).tolist()
    exact = (y.astype(object) ** 2).sum(axis=1).tolist()
    return [s if s < 1 << 63 else None for s in exact]


def _spectra(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    spectrum, block, rows = Spectrum.empty(size), [], 0
    for x in matrices(batches):
        block.append(x)
        rows += len(x)
        if rows >= BLOCK:
            spectrum, block, rows = spectrum.with_rows(np.concatenate(block)), [], 0
    if rows:
        spectrum = spectrum.with_rows(np.concatenate(block))
    if spectrum.n:
        yield pa.RecordBatch.from_pylist([_spectrum_row(TaskContext.get().partitionId(), spectrum)], schema=_SPECTRUM)


_SPECTRUM = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.string())), ("values", pa.list_(pa.float64())), ("vectors", pa.list_(pa.float64()))])


def _spectrum_row(part: int, s: Spectrum) -> dict:
    return {"part": part, "n": s.n, "sums": [str(v) for v in s.sums], "values": s.values.tolist(), "vectors": s.vectors.ravel().tolist()}


def _spectrum_of(row: dict) -> Spectrum:
    values = np.array(row["values"], float)
    return Spectrum(int(row["n"]), [int(v) for v in row["sums"]], values, np.array(row["vectors"], float).reshape(len(values), -1))


def _merged_spectra(pdf: pd.DataFrame) -> pd.DataFrame:
    found = None
    for row in pdf.sort_values("part").to_dict("records"):
        one = _spectrum_of(row)
        found = one if found is None else found.merged(one)
    return pd.DataFrame([_spectrum_row(int(pdf["part"].min()) // FAN, found)])


def _summed_products(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.array(p, float) for p in pdf.sort_values("part")["products"])
    return pd.DataFrame([{"part": int(pdf["part"].min()) // FAN, "products": total.tolist()}])


def combined(parts: DataFrame, fold: Callable[[pd.DataFrame], pd.DataFrame], schema: str, folder: str) -> DataFrame:
    """One row of all parts: FAN neighbours go to a task, and so on with what these give."""
    turn = 0
    parts = saved(parts, f"{folder}-{turn}")
    while parts.limit(2).count() > 1:
        turn += 1
        parts = saved(parts.groupBy(F.floor(F.col("part") / FAN).alias("__group")).applyInPandas(fold, schema), f"{folder}-{turn}")
    return parts


def _products(batches: Iterable[pa.RecordBatch], n: int, sums: list[int], basis: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The products of the projected rows with each other and, in the last column, their sums."""
    size = basis.shape[1]
    total = np.zeros((size, size + 1))
    for x in matrices(batches):
        projected = (centred(x, n, sums) / n).astype(float) @ basis
        total[:, :size] += projected.T @ projected
        total[:, size] += projected.sum(axis=0)
    yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "products": total.ravel().tolist()}], schema=pa.schema([("part", pa.int64()), ("products", pa.list_(pa.float64()))]))


def covariance(fit: DataFrame, n: int, sums: list[int], basis: np.ndarray, folder: str) -> np.ndarray:
    """The covariance of the fit list's projections on the columns of basis."""
    shared = fit.sparkSession.sparkContext.broadcast(basis)
    parts = combined(fit.mapInArrow(lambda batches: _products(batches, n, sums, shared.value), PRODUCTS), _summed_products, PRODUCTS, folder)
    total = np.array(parts.first()["products"]).reshape(basis.shape[1], -1)
    mean = total[:, -1] / n
    return total[:, :-1] / n - np.outer(mean, mean)


def fitted(whole: DataFrame, size: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors of `whole` (vec_id, x), all of that size; None without any."""
    spark = whole.sparkSession
    folder = work_dir(spark, "whitening")
    fit = saved(whole.select("x").distinct(), f"{folder}/fit")
    row = combined(fit.mapInArrow(lambda batches: _spectra(batches, size), SPECTRUM), _merged_spectra, SPECTRUM, f"{folder}/spectra").first()
    if row is None:
        return None
    spectrum = _spectrum_of(row.asDict())
    basis = np.linalg.qr(spectrum.vectors[:, ::-1])[0]
    values, turn = np.linalg.eigh(covariance(fit, spectrum.n, spectrum.sums, basis, f"{folder}/ritz"))
    values, vectors = values[::-1], basis @ turn[:, ::-1]
    trace = float(values.sum())
    kept = int((values[:components] > 10 * size * EPS * values[0]).sum()) if values[0] > 0 else 0
    values, vectors = values[:kept], vectors[:, :kept]
    vectors = vectors * np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(axis=0)[None], 0)[0] < 0, -1.0, 1.0)
    error = float(np.abs(covariance(fit, spectrum.n, spectrum.sums, vectors / np.sqrt(values), f"{folder}/check") - np.eye(kept)).max()) if kept else 0.0
    dropped(spark, folder)
    return Whitening(spectrum.n, spectrum.sums, values, vectors, trace, error)


def _whitened_rows(batches: Iterable[pa.RecordBatch], found: Whitening) -> Iterator[pa.RecordBatch]:
    k = len(found.values)
    scaled, explained = found.vectors / np.sqrt(found.values), found.values / found.trace
    for batch in batches:
        for x in matrices([batch], 1):
            y = centred(x, found.n, found.sums)
            values = (y / found.n).astype(float) @ scaled
            ids, m = batch.column(0), len(x)
            repeat = pa.array(np.repeat(np.arange(m), k))
            columns = [
                ids.take(repeat), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, found.n, np.int64)), pa.array(deviations(y), pa.int64()).take(repeat),
                pa.array(values.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, found.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])


def whitened(rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row per row of rows that has a place in the space and per component: the columns of SCHEMA."""
    spark = rows.sparkSession
    bounded_batches(spark)
    whole = whole_vectors(rows, id_col, vector_col)
    sizes = whole.groupBy(F.size("x").alias("size")).count()
    common = sizes.orderBy(F.desc("count"), F.desc("size")).select("size").first()
    found = None if common is None else fitted(whole.filter(F.size("x") == common["size"]), common["size"], components)
    if found is None or not len(found.values):
        return whole.mapInArrow(lambda batches: iter(()), SCHEMA)
    return whole.filter(F.size("x") == common["size"]).mapInArrow(lambda batches: _whitened_rows(batches, found), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
