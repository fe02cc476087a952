"""Whitening of vectors on an integer grid, by singular value decompositions of partitions that merge without loss."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Places up to here are exact as doubles, and sums over a block of them fit in a long.
_MOST = float(1 << 40)
_SUMMARY = "part int, n long, sums array<decimal(38,0)>, rows int, factor binary"


@dataclass(frozen=True)
class Summary:
    """n vectors: their exact sums by dimension, and rows whose Gram matrix is that of the centred vectors (singular
    values times right singular vectors)."""

    n: int
    sums: tuple[int, ...]
    factor: np.ndarray

    @property
    def dims(self) -> int:
        return len(self.sums)


def _decomposed(rows: np.ndarray) -> np.ndarray:
    """Singular values times right vectors; all of min(rows, dimensions) are kept."""
    _, s, v = np.linalg.svd(rows, full_matrices=False)
    return s[:, None] * v


def summary_of(x: np.ndarray) -> Summary:
    """Of integer vectors, centred on their exact mean before anything is multiplied."""
    n, sums = len(x), x.sum(axis=0)
    pivot = np.rint(sums / n).astype(np.int64)
    rest = (sums - n * pivot) / n
    return Summary(n, tuple(int(s) for s in sums), _decomposed((x - pivot).astype(np.float64) - rest))


def merged(a: Summary, b: Summary) -> Summary:
    """Of both sets of vectors: the rows of both and the mean-correction row, decomposed again. Nothing is truncated.

    The difference of the means comes from the exact sums.
    """
    gap = np.array([(t * a.n - s * b.n) / (a.n * b.n) for s, t in zip(a.sums, b.sums, strict=True)])
    row = gap * np.sqrt(a.n * b.n / (a.n + b.n))
    sums = tuple(s + t for s, t in zip(a.sums, b.sums, strict=True))
    return Summary(a.n + b.n, sums, _decomposed(np.vstack([a.factor, b.factor, row])))


def _as_batch(part: int, s: Summary) -> pa.RecordBatch:
    sums = pa.array([[Decimal(x) for x in s.sums]], pa.list_(pa.decimal128(38, 0)))
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int32()), pa.array([s.n], pa.int64()), sums, pa.array([len(s.factor)], pa.int32()), pa.array([s.factor.tobytes()], pa.binary())],
        ["part", "n", "sums", "rows", "factor"],
    )


def _from_row(n: int, sums: list, rows: int, factor: bytes) -> Summary:
    return Summary(n, tuple(int(x) for x in sums), np.frombuffer(factor, np.float64).reshape(rows, len(sums)))


def on_grid(df: DataFrame, vector: str, out: str, scale: int, shift: int) -> DataFrame:
    """Rows whose vector is usable, with out, its places on the grid: floor(scale * c) + shift as longs, c as double.

    Null and empty vectors and those that hold null, non-finite entries or places beyond 2**40 are left out; so are
    vectors of another length than the most frequent one (of equally frequent ones the longest).
    """
    own = F.col(vector).cast("array<double>")
    odd = F.exists(own, lambda c: F.coalesce(F.isnan(c) | (F.abs(c) * scale >= _MOST), F.lit(True)))
    usable = df.where(F.coalesce((F.size(own) > 0) & ~odd, F.lit(False)))
    usual = usable.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not usual:
        usable = usable.limit(0)
    else:
        usable = usable.where(F.size(vector) == usual[0]["d"])
    return usable.withColumn(out, F.transform(own, lambda c: F.floor(c * scale).cast("long") + shift))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fit(df: DataFrame, grid: str, fan: int = 16) -> Summary | None:
    """The summary of all rows' integer vectors (None without rows): one for each partition, then merged fan by fan in
    rounds of Spark tasks. A summary has a row for each dimension at most, so what moves is bounded by partitions x dimensions^2.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Summary | None = None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                step = max(1, (4 << 20) // x.shape[1])
                for at in range(0, len(x), step):
                    own = summary_of(x[at : at + step])
                    held = own if held is None else merged(held, own)
        if held is not None:
            yield _as_batch(TaskContext.get().partitionId(), held)

    source = df.select(grid)
    found = source.mapInArrow(local, _SUMMARY)

    def join(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        held = _from_row(rows[0]["n"], rows[0]["sums"], rows[0]["rows"], rows[0]["factor"])
        for r in rows[1:]:
            held = merged(held, _from_row(r["n"], r["sums"], r["rows"], r["factor"]))
        return pa.Table.from_batches([_as_batch(rows[0]["part"] // fan, held)])

    many = source.rdd.getNumPartitions()
    while many > 1:
        found = found.groupBy(F.floor(F.col("part") / fan).alias("g")).applyInArrow(join, _SUMMARY)
        many = -(-many // fan)
    last = found.collect()
    return _from_row(last[0]["n"], last[0]["sums"], last[0]["rows"], bytes(last[0]["factor"])) if last else None


@dataclass(frozen=True)
class Whitening:
    """What a fitted whitening knows: exact n and sums, unit eigenvectors by falling eigenvalue, and their shares of the trace."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    values: np.ndarray
    shares: np.ndarray

    @classmethod
    def of(cls, s: Summary, most: int) -> Whitening:
        """The components with variance: singular values that aren't zero to double precision, most of them at most."""
        _, sigma, v = np.linalg.svd(s.factor, full_matrices=False)
        variance = sigma**2 / s.n
        real = sigma > sigma[0] * max(s.factor.shape) * np.finfo(np.float64).eps if len(sigma) else np.zeros(0, bool)
        k = min(most, int(real.sum()))
        return cls(s.n, s.sums, v[:k], variance[:k], variance[:k] / variance.sum() if k else variance[:0])

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, where the integer part of the mean is taken off exactly."""
        pivot = np.array([round(s / self.n) for s in self.sums], np.int64)
        rest = np.array([(s - self.n * int(p)) / self.n for s, p in zip(self.sums, pivot, strict=True)])
        return (x - pivot).astype(np.float64) - rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components.T / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n x - S)^2, exact; null where it is beyond a long."""
        far = (self.centred(x) * self.n) ** 2
        if len(far) and float(far.sum(axis=1).max()) < 2.0**62:
            pivot = [round(s / self.n) for s in self.sums]
            rest = np.array([s - self.n * p for s, p in zip(self.sums, pivot, strict=True)], np.int64)
            gap = (x - np.array(pivot, np.int64)) * self.n - rest
            return (gap * gap).sum(axis=1).tolist()
        exact = [sum((int(c) * self.n - s) ** 2 for c, s in zip(row, self.sums, strict=True)) for row in x.tolist()]
        return [v if v < 1 << 63 else None for v in exact]


def _identity_error(df: DataFrame, grid: str, w: Whitening) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity: products are summed by
    partition around its own mean, so as many small numbers as components squared reach the driver."""
    k = len(w.values)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, square = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                y = w.whitened(_matrix(batch.column(0)))
                n, total = n + len(y), total + y.sum(axis=0)
                own = y - y.mean(axis=0)
                square += own.T @ own + len(y) * np.outer(y.mean(axis=0), y.mean(axis=0))
        if n:
            i, j = np.indices((k, k + 1)).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(np.hstack([square, total[:, None]]).ravel())], ["i", "j", "v"])

    sums = df.select(grid).mapInArrow(local, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    both = np.zeros((k, k + 1))
    for r in sums:
        both[r["i"], r["j"]] = r["v"]
    mean = both[:, k] / w.n
    return float(np.abs(both[:, :k] / w.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(df: DataFrame, *, vector: str = "embedding", key: str = "vec_id", components: int = 8, scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """Whitened coordinates of all usable vectors: for each row and component key, component (from 1, by falling
    variance), n, deviation, whitened, explained (the component's share of all variance) and identity_error.

    Fitted on all usable vectors, see on_grid(); others have no rows. All dimensions are kept until the last step. Components whose variance is zero to double precision are left out, as
    they can't be scaled: equal vectors give no rows, like an empty table. deviation is null where it exceeds a long.
    Null keys stay, repeated rows count each. Other columns aren't read.
    """
    rows = on_grid(df.select(F.col(key).alias("key"), F.col(vector).alias("vector")), "vector", "grid", scale, shift)
    kind = df.schema[key].dataType
    schema = T.StructType(
        [T.StructField(key, kind), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType())]
        + [T.StructField(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error")]
    )
    total = fit(rows, "grid")
    w = Whitening.of(total, components) if total is not None else None
    if w is None or not len(w.values):
        return df.sparkSession.createDataFrame([], schema)
    error, k, names = _identity_error(rows, "grid", w), len(w.values), schema.fieldNames()
    typed = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("grid"))
                m = len(x)
                each = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key").take(pa.array(each)).cast(typed), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, w.n)),
                        pa.array(w.deviations(x), pa.int64()).take(pa.array(each)), pa.array(w.whitened(x).ravel()), pa.array(np.tile(w.shares, m)), pa.array(np.full(m * k, error)),
                    ],
                    names,
                )

    return rows.select("key", "grid").mapInArrow(run, schema)
