"""Embedding whitening: two passes for the covariance, one eigendecomposition, one projection.

The fit list is every distinct vector once. A first pass sums its integers exactly, which gives the
mean; a second one sums outer products of centred vectors, a matrix product for each batch. Every
task gives one summary and a tree of tasks merges these, so the driver gets one matrix of the
vectors' width. LAPACK's symmetric solver gives the axes, which are broadcast (16 rows of the
vectors' width) to the pass over all rows. A third pass over the fit list measures how far the
whitened covariance is from the identity.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.tables import stored

SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
#: What an entry gains when it has become an integer, and what it is multiplied by before.
SHIFT, SCALE = 1_000_000, 64
#: Axes whose variance is a smaller part of the first axis' carry rounding only.
NOISE = 1e-12
#: Values of a batch that are worked on at once.
VALUES = 1 << 20


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, x array<bigint>)`` with ``x = floor(64 * c) + 1000000`` of every entry c; what a long can't hold saturates.

    Null and empty vectors, and those with a null or non-finite entry, are left out. A null id stays.
    """
    v = F.col(vector_col)
    sound = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    whole = F.transform(v, lambda c: F.least(F.floor(c.cast("double") * float(SCALE)), F.lit((1 << 63) - 1 - SHIFT)) + F.lit(SHIFT).cast("bigint"))
    return vectors.where(sound).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("x"))


def _matrices(batch: pa.RecordBatch, name: str = "x"):
    """The rows' vectors as matrices of some :data:`VALUES` values, with the number of the first row."""
    lists = batch.column(name)
    width = len(lists[0]) if len(lists) else 1
    values = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    step = max(1, VALUES // width)
    for start in range(0, len(values), step):
        yield start, values[start : start + step]


def _merged(rows: DataFrame, summary: Callable[[np.ndarray], np.ndarray]):
    """The sum of ``summary`` over all matrices: one for each task, merged in a tree of tasks. None for no rows."""

    def add(a, b):
        return b if a is None else a if b is None else a + b

    def run(batches):
        total = None
        for batch in batches:
            for _, x in _matrices(batch):
                total = add(total, summary(x))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], ["part"])

    parts = rows.select("x").mapInArrow(run, "part binary").rdd.map(lambda r: pickle.loads(r.part))
    return parts.treeAggregate(None, add, add)


def _exact_sums(x: np.ndarray) -> np.ndarray:
    """The number of rows, then the sum of each dimension, as Python integers."""
    high, low = x >> 32, x & 0xFFFFFFFF  # halves can't overflow in a batch
    return np.array([len(x), *((int(a) << 32) + int(b) for a, b in zip(high.sum(0), low.sum(0), strict=True))], object)


@dataclass
class Whitening:
    """A fit: the exact mean as ``sums / n``, the axes over the roots of their variances, shares of the variance, the measured error."""

    n: int
    sums: list[int]
    axes: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean, exact but for the last rounding."""
        floors, rests = zip(*(divmod(s, self.n) for s in self.sums), strict=True)
        shares = np.array([r / self.n for r in rests])
        if np.abs(x.astype(float)).max(initial=0) < 2.0**61:
            return (x - np.array(floors, np.int64)).astype(float) - shares
        return (x.astype(object) - np.array(floors, object)).astype(float) - shares

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum of ``(n * x - sums) ** 2`` over dimensions of each row; None where a long can't hold it."""
        reach = np.abs(self.centred(x)).max(initial=0) * self.n
        if reach * reach * x.shape[1] < 2.0**62 and np.abs(x.astype(float)).max(initial=0) * self.n < 2.0**62:
            d = x * self.n - np.array(self.sums, np.int64)
            return (d * d).sum(1).tolist()
        d = x.astype(object) * self.n - np.array(self.sums, object)
        return [v if v < 1 << 63 else None for v in (d * d).sum(1)]

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.axes


def fit(rows: DataFrame, components: int = 16) -> Whitening | None:
    """The whitening of the distinct vectors of ``rows`` (``x``, all of one length). None for no rows.

    A vector that fills most rows meets in its task as one row of every map task, as the distinct
    rows are found in the map tasks first. Axes without variance are left out, so a single distinct
    vector has none.
    """
    listed = stored(rows.select("x").distinct(), "fit-list")
    summed = _merged(listed, _exact_sums)
    if summed is None:
        return None
    made = Whitening(int(summed[0]), [int(s) for s in summed[1:]], np.zeros((len(summed) - 1, 0)), np.zeros(0))

    def outer(x: np.ndarray) -> np.ndarray:
        c = made.centred(x)
        return c.T @ c

    variance = _merged(listed, outer) / made.n
    variances, axes = np.linalg.eigh((variance + variance.T) / 2)
    order = np.argsort(-variances, kind="stable")[:components]
    order = order[variances[order] > NOISE * max(variances.max(), 0)]
    axes, variances = axes[:, order], variances[order]
    axes *= np.sign(axes[np.abs(axes).argmax(0), np.arange(len(order))])  # the same sign in every run
    made.axes, made.explained = axes / np.sqrt(variances), variances / np.trace(variance)

    def whitened_outer(x: np.ndarray) -> np.ndarray:
        w = made.project(x)  # centred: its mean is that of x less the mean
        return w.T @ w

    if len(order):
        made.identity_error = float(np.abs(_merged(listed, whitened_outer) / made.n - np.eye(len(order))).max())
    return made


def whiten(vectors: DataFrame, components: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each sound vector and component, see :data:`SCHEMA`; component 1 has the largest variance.

    Rows that repeat an id or a vector stay rows of their own, a null id stays null, other columns
    are left out. Where vectors differ in length, those of the commonest length take part (of
    several the shortest). ``deviation`` is null where a long can't hold it. No row for an empty
    table, nor where all vectors are equal, as no axis has variance then.
    """
    spark = vectors.sparkSession
    rows = integer_vectors(vectors, id_col, vector_col)
    width = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), "width").first()
    rows = rows.where(F.size("x") == (width.width if width else 0))
    model = fit(rows, components) if width else None
    if model is None:
        return spark.createDataFrame([], SCHEMA)
    known = spark.sparkContext.broadcast(model)

    def run(batches):
        model = known.value
        k = model.axes.shape[1]
        for batch in batches:
            ids = batch.column(0)
            for start, x in _matrices(batch):
                m = len(x)
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(start, m).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)),
                        pa.array(model.deviations(x), pa.int64()).take(each), pa.array(model.project(x).ravel()), pa.array(np.tile(model.explained, m)), pa.array(np.full(m * k, model.identity_error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, SCHEMA)
