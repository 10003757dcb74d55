"""Whitening of embeddings by a randomised range finder and Rayleigh-Ritz.

Entries c become integers x = floor(64 c) + 1000000, so that counts, sums and deviations are exact. The mean is taken off in
integers (n x - S) before anything is multiplied. A random basis of components + oversampling columns goes through power
passes: each pass sums V Q over all centred rows, as d times l numbers from every task that Spark adds up; the driver
holds such matrices only (bounded by the width of a vector), orthonormalises and solves the small Rayleigh-Ritz
problem. If the residuals V u - e u are not down to rounding after ``PASSES`` passes, the basis doubles, up to the full
dimension, where one pass is exact. A last pass measures the covariance of what was whitened.

vectors is scanned once a pass (some eight narrow scans), so it should be a written table.

Defined results: rows whose vector is null or empty, or holds null or non-finite entries or such that 64 c is over 2^53, are
left out; vectors of different lengths have no common space, so each length is fitted on its own rows; repeated rows
each count; a null vec_id stays null; a component without variance (too few different rows) has a null ``whitened``
and stays out of ``identity_error``; components of equal variance are some orthonormal basis of theirs, the same for all
rows; a deviation over 2^63 - 1 is null; an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doselab.llm.common import bounded_batches

#: Components returned; further columns of the first basis; power passes before the basis grows.
COMPONENTS, OVERSAMPLING, PASSES = 32, 10, 4
#: Residuals that count as rounding, relative to the largest eigenvalue; variances that count as none.
RESIDUAL, NO_VARIANCE = 4e-15, 1e-13
SCALE, SHIFT, LARGEST = 64, 1_000_000, float(1 << 53)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of doubles): the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LARGEST / SCALE))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & F.coalesce(fine, F.lit(False)))


def _rows(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """floor(64 c): x without its constant shift, which leaves n x - S as it is."""
    flat = np.asarray(batch.column("v").flatten(), float)
    return np.floor(SCALE * flat.reshape(-1, width)).astype(np.int64)


def _centred(y: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n y - S, exactly: in 64 bits where they hold it, else in Python's integers."""
    if n * (int(np.abs(y).max(initial=0)) + 1) < 1 << 61:
        return n * y - sums.astype(np.int64)
    return n * y.astype(object) - sums


def _deviations(c: np.ndarray) -> list[int | None]:
    top = int(np.abs(c).max(initial=0))
    if c.dtype != object and c.shape[1] * top * top < 1 << 63:
        return (c * c).sum(1).tolist()
    return [x if x < 1 << 63 else None for x in (c.astype(object) ** 2).sum(1)]


def _added(rows: DataFrame, width: int, add: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum of add(rows of a batch) over all rows. Each task gives its sum once; Spark adds them, an entry a group."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                found = add(_rows(batch, width))
                total = found if total is None else total + found
        if total is not None:
            i, j = np.indices(shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel(), pa.float64())], names=["i", "j", "value"])

    bounded_batches(rows.sparkSession)
    out = np.zeros(shape)
    for i, j, value in rows.mapInArrow(each, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value")).collect():  # a matrix of the driver's size
        out[i, j] = value
    return out


class Basis:
    """Of one length of vectors: count, sums, components (columns), eigenvalues, trace, passes and columns used."""

    def __init__(self, rows: DataFrame, width: int, n: int, sums: np.ndarray, components: int = COMPONENTS, seed: int = 0):
        self.width, self.n, self.sums = width, n, sums
        wanted, columns = min(components, width), min(width, components + OVERSAMPLING)
        random = np.random.default_rng(seed)
        basis = np.linalg.qr(random.standard_normal((width, columns)))[0] if columns < width else np.eye(width)
        self.passes, done = 0, False
        while not done:
            columns = basis.shape[1]
            before = np.inf
            for k in range(PASSES):
                image = _covariance_times(rows, width, n, sums, basis)
                self.passes += 1
                self.trace = image[width, 0]
                image = image[:width]
                small = basis.T @ image
                values, turn = np.linalg.eigh((small + small.T) / 2)
                order = np.argsort(-values, kind="stable")[:wanted]
                values, vectors = values[order], basis @ turn[:, order]
                residual = np.linalg.norm(image @ turn[:, order] - vectors * values, axis=0).max(initial=0)
                done = columns == width or residual <= RESIDUAL * max(values.max(initial=0), 0) * np.sqrt(width)
                if done or residual > before / 100 and k + 1 < PASSES:
                    break  # slower than a hundredth a pass: more columns are cheaper than more passes
                before = residual
                basis = np.linalg.qr(image)[0]
            if not done:
                more = min(width, 2 * columns)
                # The directions found stay; new random ones join, or the whole space.
                basis = np.linalg.qr(np.hstack([image, random.standard_normal((width, more - columns))]))[0] if more < width else np.eye(width)
        self.columns, self.values, self.vectors = columns, np.maximum(values, 0), vectors
        self.found = values > NO_VARIANCE * max(self.trace, 0)

    def project(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n x - S, and the whitened coordinates of the components that have variance."""
        c = _centred(y, self.n, self.sums)
        return c, c.astype(float) / self.n @ (self.vectors[:, self.found] / np.sqrt(self.values[self.found]))


def _covariance_times(rows: DataFrame, width: int, n: int, sums: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """V basis, and below it a row that begins with V's trace."""
    whole = basis.shape[1] == width and np.array_equal(basis, np.eye(width))

    def add(y: np.ndarray) -> np.ndarray:
        c = _centred(y, n, sums).astype(float) / n
        out = np.zeros((width + 1, basis.shape[1]))
        out[:width] = c.T @ (c if whole else c @ basis)
        out[width, 0] = (c * c).sum()
        return out

    return _added(rows, width, add, (width + 1, basis.shape[1])) / n


def _sums(rows: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """By length of vector: the number of rows and the sum of floor(64 c) in each dimension, exact."""
    y = F.floor(F.col("y") * SCALE).cast("decimal(38,0)")
    entries = rows.select(F.size("v").alias("width"), F.posexplode("v").alias("i", "y"))
    found: dict[int, dict[int, tuple[int, int]]] = {}
    for width, i, n, total in entries.groupBy("width", "i").agg(F.count("*"), F.sum(y)).collect():  # a row an entry of a vector
        found.setdefault(width, {})[i] = (n, int(total))
    return {w: (e[0][0], np.array([e[i][1] for i in range(w)], dtype=object)) for w, e in found.items()}


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vectors: vec_id, embedding. vec_id, component, n, deviation, whitened, explained, identity_error."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = usable(vectors)
    out = None
    for width, (n, sums) in sorted(_sums(rows).items()):
        own = rows.where(F.size("v") == width)
        basis = Basis(own, width, n, sums, components)
        k, wanted = int(basis.found.sum()), len(basis.values)
        error = 0.0
        if k:

            def add(y: np.ndarray, basis: Basis = basis, k: int = k) -> np.ndarray:
                w = basis.project(y)[1]
                return np.vstack([w.T @ w, w.sum(0)])

            found = _added(own, width, add, (k + 1, k)) / n
            error = float(np.abs(found[:k] - np.outer(found[k], found[k]) - np.eye(k)).max())
        explained = basis.values / basis.trace if basis.trace > 0 else np.zeros(wanted)

        def each(batches: Iterator[pa.RecordBatch], basis: Basis = basis, explained: np.ndarray = explained, error: float = error) -> Iterator[pa.RecordBatch]:
            wanted = len(basis.values)
            for batch in batches:
                c, w = basis.project(_rows(batch, basis.width))
                m = len(c)
                whole = np.zeros((m, wanted))
                whole[:, basis.found] = w
                repeat = lambda a, kind: pa.array(a, kind).take(pa.array(np.repeat(np.arange(m), wanted)))
                yield pa.RecordBatch.from_arrays(
                    [
                        repeat(batch.column("vec_id"), pa.int64()),
                        pa.array(np.tile(np.arange(1, wanted + 1), m), pa.int32()),
                        pa.array(np.full(m * wanted, basis.n), pa.int64()),
                        repeat(_deviations(c), pa.int64()),
                        pa.array(whole.ravel(), pa.float64(), mask=np.tile(~basis.found, m)),
                        pa.array(np.tile(explained, m), pa.float64()),
                        pa.array(np.full(m * wanted, error), pa.float64()),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

        bounded_batches(vectors.sparkSession)
        part = own.mapInArrow(each, schema)
        out = part if out is None else out.unionByName(part)
    return vectors.sparkSession.createDataFrame([], schema) if out is None else out


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
