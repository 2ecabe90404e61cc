"""Whitening of embeddings: projections on the principal components, each divided by its standard deviation.

Vectors become whole numbers first (quantized), so that sums are exact. The components come from singular values that
are merged up a tree: a summary is the count, the exact sums and the rows s V' of a singular value decomposition of the
centred vectors, all singular values kept. Two summaries merge by stacking their rows and one more,
sqrt(n1 n2 / (n1 + n2)) (mean1 - mean2), and decomposing again: the products of the stack are those of all vectors about
their common mean, so nothing is lost but rounding, and no covariance is formed whose squares would lose half the digits.
Batches merge inside a partition, partitions FAN at a time; a summary has at most d x d numbers however many vectors it
stands for. Only the last one, of that size, comes to the driver.

Rows whose vector is null, empty, or holds null or non-finite entries are dropped. Repeated rows count as often as they
stand; a null id stays. Vectors of unlike lengths are an error. Components whose eigenvalue is 0 but for rounding (fewer
vectors than dimensions, constant entries) have null in the place of a whitened value. Of equal eigenvalues either
vector may come first. An empty table has no components and gives no rows. Other columns are never looked at.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize, small_batches

FAN = 8
SUMMARY = "node long, n long, sums binary, factor binary"
FLAT = 1e-12  # eigenvalues up to this share of their sum are 0 but for rounding


def quantized(vector: str = "embedding", scale: int = 1024, shift: int = 100_000) -> Column:
    """floor(scale c) + shift for each entry as long; null where the vector is null, empty or has an entry that is null or not finite."""
    wide = F.col(vector).cast("array<double>")
    odd = F.exists(wide, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform(wide, lambda c: F.floor(c * F.lit(float(scale))).cast("long") + F.lit(shift))
    return F.when((F.size(wide) > 0) & ~odd, whole)


@dataclass
class Summary:
    """Of n vectors: sums by dimension (exact for whole numbers) and s V' of their centred rows."""

    n: int
    sums: list
    factor: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Summary:
        n, sums = len(x), x.sum(0)
        centred = (x - sums // n) - (sums % n) / n if x.dtype.kind == "i" else x - sums / n
        return cls(n, sums.tolist(), _compact(centred))

    def merge(self, other: Summary) -> Summary:
        n, m = self.n, other.n
        if len(self.sums) != len(other.sums):
            raise ValueError(f"vectors of {len(self.sums)} and of {len(other.sums)} entries")
        apart = np.array([(a * m - b * n) / (n * m) for a, b in zip(self.sums, other.sums)])
        correction = np.sqrt(n / (n + m) * m) * apart
        return Summary(n + m, [a + b for a, b in zip(self.sums, other.sums)], _compact(np.vstack([self.factor, other.factor, correction])))


def _compact(rows: np.ndarray) -> np.ndarray:
    """Fewer rows with the same products: singular values times right vectors, none left out."""
    _, s, vt = np.linalg.svd(rows, full_matrices=False)
    return s[:, None] * vt


def _matrix(column: pa.ListArray, kind: type) -> Iterator[np.ndarray]:
    """The vectors of a batch as one matrix, nulls in them as 0; nothing for an empty batch."""
    if len(column):
        sizes = np.diff(column.offsets.to_numpy())
        if (sizes != sizes[0]).any():
            raise ValueError(f"vectors of {sizes.min()} and of {sizes.max()} entries")
        yield column.flatten().fill_null(0).to_numpy().astype(kind, copy=False).reshape(len(column), -1)


def _merged(summaries: Iterable[Summary]) -> Summary | None:
    held = None
    for s in summaries:
        held = s if held is None else held.merge(s)
    return held


def _written(node: int, s: Summary | None) -> pa.Table:
    kept = [] if s is None else [{"node": node, "n": s.n, "sums": json.dumps(s.sums).encode(), "factor": s.factor.tobytes()}]
    return pa.Table.from_pylist(kept, pa.schema([("node", pa.int64()), ("n", pa.int64()), ("sums", pa.binary()), ("factor", pa.binary())]))


def _read(row: dict) -> Summary:
    sums = json.loads(bytes(row["sums"]))
    return Summary(row["n"], sums, np.frombuffer(bytes(row["factor"]), np.float64).reshape(-1, len(sums)))


def summarize(vectors: DataFrame, column: str = "x") -> Summary | None:
    """One summary of all vectors (arrays of long or double, of one length); None if there are none."""
    small_batches(vectors.sparkSession)
    kind = np.int64 if vectors.schema[column].dataType.elementType.simpleString() == "bigint" else np.float64

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, node = None, 0
        for batch in batches:
            for x in _matrix(batch.column("x"), kind):
                node, own = batch.column("node")[0].as_py(), Summary.of(x)
                held = own if held is None else held.merge(own)
        yield from _written(node, held).to_batches()

    def branch(table: pa.Table) -> pa.Table:
        held = sorted(table.to_pylist(), key=lambda r: r["node"])
        return _written(held[0]["node"] // FAN, _merged(map(_read, held)))

    leaves = vectors.select(F.spark_partition_id().cast("long").alias("node"), F.col(column).alias("x")).mapInArrow(leaf, SUMMARY)
    written = tree = materialize(leaves, "summaries")
    nodes = tree.agg(F.max("node")).first()[0]  # partitions are numbered from 0
    while nodes:
        tree, nodes = tree.groupBy(F.shiftright("node", FAN.bit_length() - 1)).applyInArrow(branch, SUMMARY), nodes // FAN
    last = tree.collect()  # one row, of at most d x d numbers
    discard(written)
    return _read(last[0].asDict()) if last else None


@dataclass
class Whitening:
    """What fitting found, for d dimensions: components are rows of unit length by falling eigenvalue."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    components: np.ndarray

    def explained(self) -> np.ndarray:
        total = self.eigenvalues.sum()
        return self.eigenvalues / total if total > 0 else np.zeros(len(self.eigenvalues))

    def live(self) -> np.ndarray:
        return self.explained() > FLAT


def fit(vectors: DataFrame, column: str = "x") -> Whitening | None:
    """Mean, eigenvalues and eigenvectors of the covariance (divisor n) of all vectors; None if there are none."""
    s = summarize(vectors, column)
    if s is None:
        return None
    _, values, vt = np.linalg.svd(s.factor, full_matrices=True)  # square: directions that no vector takes have eigenvalue 0
    eigenvalues = np.zeros(len(s.sums))
    eigenvalues[: len(values)] = values**2 / s.n
    return Whitening(s.n, s.sums, eigenvalues, vt)


def whiten(vectors: DataFrame, model: Whitening, components: int | None = None, column: str = "x", into: str = "whitened") -> DataFrame:
    """vectors with an array of whitened values, one for each of the first components (all, if null)."""
    small_batches(vectors.sparkSession)
    k = min(components or len(model.sums), len(model.sums))
    live, n = model.live()[:k], model.n
    turn = np.zeros((k, len(model.sums)))
    turn[live] = model.components[:k][live] / np.sqrt(model.eigenvalues[:k][live])[:, None]
    whole = np.array([s // n for s in model.sums], np.int64)
    part = np.array([(s % n) / n for s in model.sums])
    names = vectors.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((0, k))
            for x in _matrix(batch.column(column), np.int64):
                out = ((x - whole) - part) @ turn.T
            values = pa.array(out.ravel(), mask=np.tile(~live, len(out)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays((np.arange(len(out) + 1) * k).astype(np.int32), values)], names=[*names, into])

    return vectors.mapInArrow(run, T.StructType([*vectors.schema.fields, T.StructField(into, T.ArrayType(T.DoubleType()))]))


def identity_error(whitened: DataFrame, model: Whitening, column: str = "whitened") -> float:
    """The largest absolute entry of the covariance of whitened values, measured on all rows, less the identity."""
    found = summarize(whitened, column)
    if found is None:
        return 0.0
    live = model.live()[: len(found.sums)]
    covariance = (found.factor.T @ found.factor / found.n)[np.ix_(live, live)]
    return float(np.abs(covariance - np.eye(len(covariance))).max(initial=0.0))


def deviation(model: Whitening, column: str = "x") -> Column:
    """Sum over dimensions of (n x - S)^2 of a vector, exact in 38 digits."""
    n, sums = F.lit(model.n), F.array(*(F.lit(s).cast("long") for s in model.sums))
    square = lambda d: (d.cast("decimal(19,0)") * d.cast("decimal(19,0)")).cast("decimal(38,0)")
    return F.aggregate(F.zip_with(column, sums, lambda x, s: square(n * x - s)), F.lit(0).cast("decimal(38,0)"), lambda a, d: (a + d).cast("decimal(38,0)"))
