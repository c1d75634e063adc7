"""Operator 12: embedding whitening by a matrix-free block Lanczos iteration."""

from __future__ import annotations

import decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import materialize

#: Components that are returned at most, and columns of a Lanczos block.
COMPONENTS = 32
#: A component has converged when its residual is at most so many times the largest eigenvalue.
TOLERANCE = 1e-13
#: Entries of vectors that a task works on at a time, or one vector.
ENTRIES = 1 << 21
#: What an entry of 0 becomes (fixed value of the contract).
SHIFT = 1_000_000
#: Largest long.
MOST = (1 << 63) - 1


def integer_vectors(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """key and x: floor(64 * entry) + ``SHIFT`` as longs.  Vectors that are null or hold null or
    non-finite entries are left out.  |64 * entry| beyond 2 ** 52 counts as 2 ** 52."""
    entry = F.col(column)
    fine = F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    most = F.lit(float(1 << 52))
    x = F.transform(entry, lambda c: F.floor(F.greatest(F.least(c.cast("double") * 64, most), -most)) + F.lit(SHIFT))
    return vectors.where(entry.isNotNull() & fine).select(F.col(key), x.alias("x"))


def _matrices(batch: pa.RecordBatch, d: int):
    """(first row, matrix of longs) of parts of a batch; short vectors are filled up by entries of 0."""
    column = batch.column("x")
    step = max(1, ENTRIES // max(d, 1))
    for at in range(0, batch.num_rows, step):
        part = column.slice(at, step)
        values, offsets = part.flatten().to_numpy(zero_copy_only=False), part.offsets.to_numpy()
        sizes = np.diff(offsets)
        if (sizes == d).all():
            yield at, values.reshape(-1, d)
        else:
            out = np.full((len(sizes), d), SHIFT, dtype=np.int64)
            out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = values
            yield at, out


def _scaled(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """n * x - total, exact: longs, or Python integers where those don't reach."""
    if x.size and n * max(abs(int(x.min())), abs(int(x.max()))) >= 1 << 61:
        return n * x.astype(object) - total.astype(object)
    return n * x - total.astype(np.int64)


def _summed(rows: DataFrame, part, schema: str, kind: str) -> DataFrame:
    """Sums of the tasks' partial results by place: each task gives a row a place."""
    return rows.mapInArrow(part, schema).groupBy("place").agg(F.sum("value").cast(kind).alias("value"))


def _column_sums(d: int):
    def run(batches):
        total = np.zeros(d, dtype=object)
        for batch in batches:
            for _, x in _matrices(batch, d):
                total += x.astype(object).sum(axis=0) if x.size and np.abs(x).max() > 1 << 40 else x.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array([decimal.Decimal(int(v)) for v in total], pa.decimal128(38, 0))], ["place", "value"])

    return run


def _product(rows: DataFrame, n: int, total: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The covariance times a block of columns, in one pass over the rows."""
    d, b = block.shape

    def run(batches):
        out = np.zeros((d, b))
        for batch in batches:
            for _, x in _matrices(batch, d):
                centred = (_scaled(x, n, total) / n).astype(np.float64)
                out += centred.T @ (centred @ block)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * b)), pa.array(out.ravel() / n)], ["place", "value"])

    out = np.zeros(d * b)
    for r in _summed(rows, run, "place long, value double", "double").collect():  # d * b numbers
        out[r.place] = r.value
    return out.reshape(d, b)


def _orthonormal(block: np.ndarray, basis: np.ndarray, rng, scale: float) -> np.ndarray:
    """Orthonormal columns of block beside the basis: every earlier column is taken out, twice.

    A column of which nothing is left (breakdown) is restarted by a random one, as long as
    the space has room.
    """
    out = basis
    for k in range(block.shape[1]):
        column, limit = block[:, k], 1e-10 * scale
        for _ in range(8):
            if out.shape[1] == len(column):
                return out[:, basis.shape[1] :]
            for _ in range(2):
                column = column - out @ (out.T @ column)
            size = np.linalg.norm(column)
            if size > limit:
                column = column / size
                # Once more at unit length, for the columns of which little was left.
                column = column - out @ (out.T @ column)
                out = np.column_stack([out, column / np.linalg.norm(column)])
                break
            column, limit = rng.standard_normal(len(column)), 1e-8
    return out[:, basis.shape[1] :]


def block_lanczos(product, d: int, wanted: int = COMPONENTS, width: int | None = None, tolerance: float = TOLERANCE, seed: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a symmetric map of d numbers, falling, and its unit eigenvectors.

    product(block) applies the map to columns, ``width`` of them at a time.  The driver
    holds the basis and its images, d numbers a column; the map itself is never formed.
    Ritz pairs of the whole basis are accepted when the residual of each wanted one is
    small, or when the basis spans the space.
    """
    wanted = min(wanted, d)
    width = min(width or wanted, d)
    rng = np.random.default_rng(seed)
    basis, image = np.zeros((d, 0)), np.zeros((d, 0))
    block = _orthonormal(rng.standard_normal((d, width)), basis, rng, 1.0)
    while True:
        basis = np.column_stack([basis, block])
        image = np.column_stack([image, product(block)])
        small = basis.T @ image
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        values, vectors = values[::-1][:wanted], vectors[:, ::-1][:, :wanted]
        ritz = basis @ vectors
        residual = np.linalg.norm(image @ vectors - ritz * values, axis=0)
        top = max(values[0], 0.0)
        if basis.shape[1] == d or (len(values) == wanted and (residual <= tolerance * top).all()):
            return values, ritz / np.linalg.norm(ritz, axis=0)
        block = _orthonormal(image[:, -block.shape[1] :], basis, rng, max(top, 1e-300))


def _whitened(x: np.ndarray, n: int, total: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    scaled = _scaled(x, n, total)
    return scaled, (scaled / n).astype(np.float64) @ axes


def whiten(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = COMPONENTS, width: int | None = None) -> DataFrame:
    """Per vector and component: key, component, n, deviation, whitened, explained, identity_error.

    Vectors become longs (``integer_vectors``), written once.  Their number, sums and the
    products of the covariance with blocks of columns are sums of partial results of tasks,
    centred before multiplying.  Components are numbered by falling eigenvalue; of either
    sign the one whose largest entry is positive is taken.  The trace comes from the
    deviations.

    Null vectors and those with null or non-finite entries are left out.  A vector shorter
    than the longest counts as filled up by zeros, an empty one as zeros.  Repeated rows,
    null and repeated keys are rows of their own.  A component without variance can't be
    whitened and is left out, so equal vectors give no rows.  A deviation beyond the longs
    is the largest long.  Empty table: no rows.  Other columns aren't read.
    """
    field = vectors.schema[key]
    schema = T.StructType(
        [field, T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error"))]
    )
    rows = materialize(integer_vectors(vectors, key, column))
    shape = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).first()
    n, d = shape["n"], shape["d"] or 0
    spark = vectors.sparkSession
    if not n or not d:
        return spark.createDataFrame([], schema)
    x = rows.select("x")
    told = {r.place: int(r.value) for r in _summed(x, _column_sums(d), "place long, value decimal(38,0)", "decimal(38,0)").collect()}  # d numbers
    total = np.array([told[k] for k in range(d)], dtype=object)
    values, axes = block_lanczos(lambda block: _product(x, n, total, block), d, components, width)

    def variances(batches):
        out = 0.0
        for batch in batches:
            for _, part in _matrices(batch, d):
                out += float((((_scaled(part, n, total) / n).astype(np.float64)) ** 2).sum())
        yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([out / n])], ["place", "value"])

    trace = _summed(x, variances, "place long, value double", "double").first().value
    real = values > max(values[0], 0.0) * d * np.finfo(float).eps
    values, axes = values[real], axes[:, real]
    k = len(values)
    if not k or not trace:
        return spark.createDataFrame([], schema)
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(k)]) / np.sqrt(values)

    def moments(batches):
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for _, part in _matrices(batch, d):
                w = _whitened(part, n, total, axes)[1]
                first += w.sum(axis=0)
                second += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k + k * k)), pa.array(np.concatenate([first, second.ravel()]) / n)], ["place", "value"])

    found = np.zeros(k + k * k)
    for r in _summed(x, moments, "place long, value double", "double").collect():  # k * k numbers
        found[r.place] = r.value
    error = float(np.abs(found[k:].reshape(k, k) - np.outer(found[:k], found[:k]) - np.eye(k)).max())
    shares = values / trace

    def told_rows(batches):
        for batch in batches:
            for at, part in _matrices(batch, d):
                scaled, w = _whitened(part, n, total, axes)
                m = len(part)
                if scaled.dtype == object or not scaled.size or d * int(np.abs(scaled).max()) ** 2 > MOST:
                    deviation = np.array([min(int(v), MOST) for v in (scaled.astype(object) ** 2).sum(axis=1)], dtype=np.int64)
                else:
                    deviation = (scaled * scaled).sum(axis=1)
                keys = batch.column(key).slice(at, m).take(pa.array(np.repeat(np.arange(m), k)))
                component = pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m))
                numbers = [pa.array(np.full(m * k, n, dtype=np.int64)), pa.array(np.repeat(deviation, k)), pa.array(w.ravel()), pa.array(np.tile(shares, m)), pa.array(np.full(m * k, error))]
                yield pa.RecordBatch.from_arrays([keys, component, *numbers], schema.names)

    return rows.mapInArrow(told_rows, schema)
