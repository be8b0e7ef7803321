"""Whitening of embeddings: moments by Chan's merging, eigenvectors on the driver, the identity checked by a second pass.

Each task folds its batches into one record for each dimension that it meets: count, exact sums of the entries as whole
numbers, and the scatter of the centred rows. Records are merged in pairs, in a tree of tasks, by Chan's formula, whose
difference of means is taken from the exact sums. The driver gets a few records of dimension squared, whatever the number of
rows, and computes the eigenvectors; tasks get ``COMPONENTS`` of them.

Defined results: rows whose vector is null, empty, or holds a null or non-finite entry are dropped, and so are rows whose
dimension isn't the most frequent one (the larger on a tie); entries beyond ``LIMIT`` count as ``LIMIT``; a table without remaining rows
gives no rows; repeated rows count as often as they stand; a null id stays. A component without variance has the whitened
value null and no part in the identity check. ``deviation`` is null where it doesn't fit a long. The sign of a component is that
its entry of largest size is positive. Extra columns are ignored.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

COMPONENTS = 32
#: Rows that a task holds as matrices at once.
ROWS = 4096
#: Whole numbers that stand for entries: floor(SCALE * entry) + SHIFT.
SCALE, SHIFT, LIMIT = 64, 1_000_000, 1 << 40
#: Parts of one that whitened values are rounded to in the check of the identity.
GRAIN = 1 << 30
#: Records that one step of the tree merges.
FAN_IN = 8


@dataclass
class Moments:
    """Count, exact sums and centred scatter of a set of rows."""

    n: int
    sums: list[int]
    scatter: np.ndarray

    def merged(self, other: Moments) -> Moments:
        if not self.n or not other.n:
            return self if self.n else other
        n = self.n + other.n
        delta = np.array([(self.n * b - other.n * a) / (self.n * other.n) for a, b in zip(self.sums, other.sums)])
        scatter = self.scatter + other.scatter + np.outer(delta, delta) * (self.n * other.n / n)
        return Moments(n, [a + b for a, b in zip(self.sums, other.sums)], scatter)


def moments(rows: np.ndarray) -> Moments:
    """Of rows of whole numbers."""
    n, sums = len(rows), rows.sum(axis=0)
    centred = (n * rows - sums) / n
    return Moments(n, [int(x) for x in sums], centred.T @ centred)


def merged(a: dict[int, Moments], b: dict[int, Moments]) -> dict[int, Moments]:
    """Records by dimension."""
    return a | {d: a[d].merged(m) if d in a else m for d, m in b.items()}


def whole_rows(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """dimension, places of its usable rows in the column, and these rows as whole numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
    values = pc.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
    firsts = np.concatenate([[0], np.cumsum(lengths)])
    for d in np.unique(lengths[lengths > 0]).tolist():
        for at in np.array_split(own := np.flatnonzero(lengths == d), -(-len(own) // ROWS)):
            rows = values[firsts[at][:, None] + np.arange(d)]
            usable = np.isfinite(rows).all(axis=1)
            yield d, at[usable], np.clip(np.floor(SCALE * rows[usable]), -LIMIT, LIMIT).astype(np.int64) + SHIFT


def _tree(df: DataFrame, fold: Callable[[int, np.ndarray], Moments | None]) -> dict[int, Moments]:
    """One record by dimension from all tasks of a table whose only column is a vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, Moments] = {}
        for batch in batches:
            for d, _, rows in whole_rows(batch.column(0)):
                m = fold(d, rows) if len(rows) else None
                if m:
                    own = merged(own, {len(m.sums): m})
        yield pa.RecordBatch.from_pydict({
            "d": pa.array(list(own), pa.int64()),
            "n": pa.array([m.n for m in own.values()], pa.int64()),
            "sums": pa.array([json.dumps(m.sums) for m in own.values()], pa.string()),
            "scatter": pa.array([m.scatter.tobytes() for m in own.values()], pa.binary()),
        })

    def record(row) -> dict[int, Moments]:
        scatter = np.frombuffer(bytes(row["scatter"]))
        width = math.isqrt(len(scatter))
        return {row["d"]: Moments(row["n"], json.loads(row["sums"]), scatter.reshape(width, width))}

    records = df.mapInArrow(run, "d long, n long, sums string, scatter binary").rdd.map(record)
    context = df.sparkSession.sparkContext
    depth = max(2, math.ceil(math.log(max(2, records.getNumPartitions()), FAN_IN)))
    return context.union([records, context.parallelize([{}], 1)]).treeReduce(merged, depth)


@dataclass
class Whitening:
    """What ``fit`` learns: moments, components as columns by falling eigenvalue, and the share of each in the trace."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    identity_error: float = math.nan

    @property
    def dimension(self) -> int:
        return len(self.sums)

    def centred(self, rows: np.ndarray) -> np.ndarray:
        """n times each row less the sums: whole numbers, exact as long as they fit."""
        wrapped = np.array([s & (1 << 64) - 1 for s in self.sums], dtype=np.uint64).view(np.int64)
        return rows * np.int64(self.n) - wrapped

    def deviation(self, rows: np.ndarray) -> pa.Array:
        with np.errstate(over="ignore"):
            d = self.centred(rows)
            mean = np.array([s / self.n for s in self.sums])
            size = (((rows - mean) * self.n) ** 2).sum(axis=1)
            return pa.array((d * d).sum(axis=1), mask=size >= 2.0**63 * (1 - 1e-9))

    def whitened(self, rows: np.ndarray) -> np.ndarray:
        """A column for each component; NaN where it has no variance."""
        return (self.centred(rows) / self.n) @ self.vectors / np.where(self.eigenvalues > 0, np.sqrt(self.eigenvalues), np.nan)


def fit(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Moments of all rows, and the components; the second pass measures how far the whitened rows' covariance is from the
    identity. None if no row remains."""
    vectors = rows.select(vector)
    found = _tree(vectors, lambda _, x: moments(x))
    if not found:
        return None
    d = max(found, key=lambda k: (found[k].n, k))
    m = found[d]
    covariance = m.scatter / m.n
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    values, axes = values[::-1], axes[:, ::-1]
    values = np.where(values > max(values[0], 0) * d * np.finfo(float).eps, values, 0.0)
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(d)])
    k, trace = min(components, d), float(np.trace(covariance))
    made = Whitening(m.n, m.sums, values[:k], axes[:, :k], values[:k] / trace if trace > 0 else np.zeros(k))
    made.identity_error = _identity_error(vectors, made)
    return made


def _identity_error(vectors: DataFrame, made: Whitening) -> float:
    """Largest entry by which the covariance of the whitened rows differs from the identity. Whitened values are at most
    the root of n in size, so that they merge as whole numbers of a ``GRAIN``-th."""
    live = np.flatnonzero(made.eigenvalues > 0)
    if not len(live):
        return 0.0

    def fold(d: int, rows: np.ndarray) -> Moments | None:
        return moments(np.rint(made.whitened(rows)[:, live] * GRAIN).astype(np.int64)) if d == made.dimension else None

    m = _tree(vectors, fold)[len(live)]
    return float(np.abs(m.scatter / GRAIN**2 / m.n - np.eye(len(live))).max())


COLUMNS = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def transform(rows: DataFrame, made: Whitening | None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each usable row of ``rows`` and each component."""
    spark = rows.sparkSession
    kind = rows.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, {COLUMNS}"
    if made is None:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(made.eigenvalues)
        for batch in batches:
            for d, at, x in whole_rows(batch.column(1)):
                if d != made.dimension or not len(at):
                    continue
                white, m = made.whitened(x).ravel(), len(at)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(np.repeat(at, k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, made.n, dtype=np.int64)),
                    made.deviation(x).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(white, mask=np.isnan(white)),
                    pa.array(np.tile(made.explained, m)),
                    pa.array(np.full(m * k, made.identity_error)),
                ], [key, *[c.split()[0] for c in COLUMNS.split(", ")]])

    return rows.select(key, vector).mapInArrow(run, schema)


def report(rows: DataFrame) -> DataFrame:
    return transform(rows, fit(rows))
