"""Embedding whitening by hierarchical SVD merging.

A task takes its rows in blocks, centres each block on its own mean and keeps all of its singular
values and right vectors beside its count and sums. Two summaries merge by stacking
their scaled vectors and one row that corrects for the distance of their means,
sqrt(n1 n2 / (n1 + n2)) (m1 - m2), and taking the SVD again: nothing is cut off, so
the last summary has the spectrum of all rows. Summaries meet in a tree of FAN to a
group, so no task gets more than FAN of them; one summary is a matrix of dimension squared, the only thing
that goes to the driver and from there to all tasks.

Rows are whitened by x - mean, projected on each component, over the root of its eigenvalue.
A second tree adds up the covariance of the whitened rows, centred, and tells how
far it is from the identity.

Counts and sums are whole numbers; differences of means are worked out in whole numbers and rounded once.

Defined results: vectors take part if they aren't null or empty, hold no null or non-finite
component and none of 2**62 or more after scaling, and have the table's most common length (of
equally common ones the longest). Equal scaled vectors count once for the fit and all get their rows back; null and
repeated ids stay. Directions without spread (a singular value of 1e-11 of the largest or less) are no
components, so a table of one distinct vector returns nothing, and so does an empty one. A deviation beyond
64 bits is null. Columns other than the id and the vector are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import written

TIMES, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Summaries of a merge, rows of a block (twice the dimension, if that is more), singular values that count as none.
FAN, BLOCK, NONE = 16, 1024, 1e-11
_WIDE = 1 << 48
_SUMMARY = "node long, n long, sums array<decimal(38,0)>, sigma array<double>, vectors array<double>"
_SPREAD = "node long, n long, mean array<double>, spread array<double>"
_OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def scaled(vector: Column, times: int = TIMES, shift: int = SHIFT) -> Column:
    """floor(times * x) + shift of every component, as array<long>; null if the vector can take no part."""
    x = F.transform(vector, lambda v: v.cast("double") * times)
    good = (F.size(vector) > 0) & F.forall(x, lambda v: F.coalesce(F.abs(v) < float(1 << 62), F.lit(False)))
    return F.when(F.coalesce(good, F.lit(False)), F.transform(x, lambda v: F.floor(v).cast("long") + shift))


class Summary:
    """n rows: their exact sums, and the singular values and right vectors of the centred rows, all of them."""

    def __init__(self, n: int, sums: list[int], sigma: np.ndarray, vectors: np.ndarray):
        self.n, self.sums, self.sigma, self.vectors = n, sums, sigma, vectors

    @classmethod
    def of(cls, x: np.ndarray) -> Summary:
        """Of a block of whole-number rows."""
        if np.abs(x).max() >= _WIDE:
            x = x.astype(object)
        from_first = x - x[0]
        total = from_first.sum(0)
        centred = ((from_first * len(x) - total) / len(x)).astype(np.float64)
        _, sigma, vectors = np.linalg.svd(centred, full_matrices=False)
        return cls(len(x), [int(t) + len(x) * int(f) for t, f in zip(total, x[0])], sigma, vectors)

    def merged(self, other: Summary) -> Summary:
        n = self.n + other.n
        apart = np.array([(a * other.n - b * self.n) / (self.n * other.n) for a, b in zip(self.sums, other.sums)])
        rows = np.vstack([self.sigma[:, None] * self.vectors, other.sigma[:, None] * other.vectors, np.sqrt(self.n * other.n / n) * apart])
        _, sigma, vectors = np.linalg.svd(rows, full_matrices=False)
        return Summary(n, [a + b for a, b in zip(self.sums, other.sums)], sigma, vectors)

    def batch(self, node: int) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.decimal128(38, 0)), pa.list_(pa.float64()), pa.list_(pa.float64()))
        cells = (node, self.n, self.sums, self.sigma, self.vectors.ravel())
        return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds)], [c.split()[0] for c in _SUMMARY.split(", ")])

    @classmethod
    def read(cls, node: int, n: int, sums: list, sigma: list, vectors: list) -> Summary:
        return cls(n, [int(s) for s in sums], np.array(sigma), np.array(vectors).reshape(len(sigma), -1))


class Spread:
    """n rows: their mean and the sums of products of their centred columns."""

    def __init__(self, n: int, mean: np.ndarray, spread: np.ndarray):
        self.n, self.mean, self.spread = n, mean, spread

    @classmethod
    def of(cls, x: np.ndarray) -> Spread:
        centred = x - x.mean(0)
        return cls(len(x), x.mean(0), centred.T @ centred)

    def merged(self, other: Spread) -> Spread:
        n, apart = self.n + other.n, other.mean - self.mean
        return Spread(n, self.mean + apart * (other.n / n), self.spread + other.spread + np.outer(apart, apart) * (self.n * other.n / n))

    def batch(self, node: int) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip((node, self.n, self.mean, self.spread.ravel()), kinds)], [c.split()[0] for c in _SPREAD.split(", ")])

    @classmethod
    def read(cls, node: int, n: int, mean: list, spread: list) -> Spread:
        return cls(n, np.array(mean), np.array(spread).reshape(len(mean), -1))


def matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    """The rows of a column of lists of dim whole numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def merged_in_tree(rows: DataFrame, kind: type, schema: str, block: int, make: Callable[[np.ndarray], Summary | Spread], dim: int, name: str):
    """One `kind` of all rows (a column x), or None if there are none: blocks within tasks, then FAN to a group."""

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, held, n = None, [], 0
        for b in batches:
            for a in range(0, b.num_rows, block):
                part = b.slice(a, block)
                held.append(matrix(part.column(0), dim))
                n += part.num_rows
                if n >= block:
                    whole, held, n = _joined(whole, make(np.concatenate(held))), [], 0
        if n:
            whole = _joined(whole, make(np.concatenate(held)))
        if whole is not None:
            yield whole.batch(TaskContext.get().partitionId())

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        whole = None
        for row in table.sort_by("node").to_pylist():
            whole = _joined(whole, kind.read(*row.values()))
        return pa.Table.from_batches([whole.batch(key[0].as_py())])

    nodes = written(rows.select("x").mapInArrow(start, schema), name)
    width = nodes.agg(F.max("node")).first()[0]
    while width:
        nodes, width = nodes.groupBy(F.expr(f"node div {FAN}").alias("group")).applyInArrow(merge, schema), width // FAN
    found = nodes.collect()  # one row
    return kind.read(*found[0]) if found else None


def _joined(a, b):
    return b if a is None else a.merged(b)


class Whitening:
    """The map from whole-number vectors to whitened components."""

    def __init__(self, fit: Summary, components: int):
        n = fit.n
        self.n, self.dim = n, len(fit.sums)
        some = fit.sigma > NONE * fit.sigma[0]
        k = int(some[:components].sum())
        e = fit.sigma**2 / n
        self.base = np.array([s // n for s in fit.sums])
        self.rest = [s - n * (s // n) for s in fit.sums]
        self.explained = e[:k] / e.sum() if k else e[:0]
        self.axes = fit.vectors[:k] / np.sqrt(e[:k])[:, None]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.base).astype(np.float64) - np.array([r / self.n for r in self.rest])) @ self.axes.T

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Of each row the sum over dimensions of (n x - S)**2, exactly."""
        from_base = x - self.base
        most = self.n * (int(np.abs(from_base).max(initial=0)) + 1)
        if self.dim * most * most < 1 << 63:
            out = (from_base.astype(np.int64) * self.n - np.array(self.rest, np.int64)) ** 2
            return out.sum(1).tolist()
        out = ((from_base.astype(object) * self.n - np.array(self.rest, object)) ** 2).sum(1)
        return [int(v) if v < 1 << 63 else None for v in out]


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error of every vector and component. vectors: id, x (as scaled() gives it)."""
    kind = vectors.schema["id"].dataType.simpleString()
    good = vectors.select("id", "x").where("x IS NOT NULL")
    common = good.groupBy(F.size("x").alias("dim")).count().orderBy(F.col("count").desc(), F.col("dim").desc()).limit(1).collect()
    empty = vectors.sparkSession.createDataFrame([], f"id {kind}, {_OUT}")
    if not common:
        return empty
    dim = common[0].dim
    good = good.where(F.size("x") == dim)
    fit = written(good.select("x").distinct(), "whitening")
    model = Whitening(merged_in_tree(fit, Summary, _SUMMARY, max(BLOCK, 2 * dim), Summary.of, dim, "summaries"), components)
    k = len(model.axes)
    if not k:
        return empty
    spread = merged_in_tree(fit, Spread, _SPREAD, BLOCK, lambda x: Spread.of(model.whitened(x)), dim, "spreads")
    error = float(np.abs(spread.spread / spread.n - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, BLOCK):
                part = b.slice(a, BLOCK)
                x, n = matrix(part.column(1), dim), part.num_rows
                each = pa.array(np.repeat(np.arange(n), k))
                columns = [
                    part.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, model.n)), pa.array(model.deviations(x), pa.int64()).take(each),
                    pa.array(model.whitened(x).ravel()), pa.array(np.tile(model.explained, n)), pa.array(np.full(n * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", *(c.split()[0] for c in _OUT.split(", "))])

    return good.mapInArrow(run, f"id {kind}, {_OUT}")
