"""Whitening of embedding vectors, from exact second moments over bit planes.

A component becomes the integer x = floor(scale * c) + offset.

1. A task takes rows in chunks of ``CHUNK``. Each dimension is shifted by its least value in the chunk, and bit b of all
   its rows is packed into 64-bit words. With the planes P of dimensions i and j,
   sum(y_i * y_j) = sum over a, b of 2^(a+b) * popcount(P_ia & P_jb), which is exact; shifts are added back as integers.
   Tasks give one row a pair of dimensions, which Spark sums as decimals: the data are read once, and what moves is
   the square of the dimension for each task.
2. n * cross - S_i * S_j are integers, divided by n^2 and given to eigh as doubles. The driver holds the square of
   the dimension and nothing that grows with the rows.
3. A second pass projects the rows and sums products of the results for the identity error, a third gives the rows.

Edge cases: vectors that are null or hold nulls or non-finite values take no part; vectors of each length are a list of
their own; integers are held within +-2^50; sums are exact below 10^38. An eigenvalue that is 0 within rounding has no
whitened value (null) but keeps its rows; explained is null where all vectors are equal. ``deviation`` is null where it
passes a long, ``deviation_exact`` holds it as a decimal (null past 38 digits). Equal or null ids are rows of their
own; no vectors give no rows; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretrace.llm.common import column

CHUNK = 8192
HELD = 1 << 50
_LONGEST = (1 << 63) - 1


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, sums of products) of the columns of an integer matrix, as Python integers."""
    n, d = x.shape
    low = x.min(axis=0)
    y = (x - low).astype(np.uint64)
    bits = [int(m).bit_length() for m in y.max(axis=0)]
    words = -(-n // 64)
    planes = np.zeros((d, max(bits), words * 8), np.uint8)
    for b in range(max(bits)):
        plane = np.packbits((y >> np.uint64(b) & np.uint64(1)).astype(np.uint8), axis=0)
        planes[:, b, : plane.shape[0]] = plane.T
    used = np.arange(max(bits)) < np.array(bits)[:, None]
    owner, weight = np.nonzero(used)
    planes = planes.view(np.uint64)[owner, weight]
    shared = np.zeros((len(planes), len(planes)), np.int64)
    for p in range(len(planes)):
        shared[p, p:] = np.bitwise_count(planes[p] & planes[p:]).sum(axis=1, dtype=np.int64)
    shared = np.triu(shared) + np.triu(shared, 1).T
    own = np.bitwise_count(planes).sum(axis=1, dtype=np.int64)
    wide = 2 * max(bits) + n.bit_length() > 62  # of the sums of all planes of two dimensions
    power = np.array([1 << int(b) for b in weight], object if wide else np.int64)
    cross, total = np.zeros((d, d), object), np.zeros(d, object)
    if len(planes):
        live = np.unique(owner)
        first = np.searchsorted(owner, live)
        by_row = np.add.reduceat(shared.astype(power.dtype) * power[:, None], first, axis=0)
        cross[np.ix_(live, live)] = np.add.reduceat(by_row * power, first, axis=1).astype(object)
        total[live] = np.add.reduceat(own.astype(power.dtype) * power, first).astype(object)
    low = low.astype(object)
    shifted = np.outer(low, total)
    return total + n * low, cross + shifted + shifted.T + n * np.outer(low, low)


@dataclass(frozen=True)
class Grid:
    """How components become integers."""

    scale: float
    offset: int

    def matrices(self, batch: pa.RecordBatch, at: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows of the batch, their integer matrix) for each vector length, ``CHUNK`` rows at most; only of vectors
        whose components are all there and finite."""
        lists = batch.column(at)
        ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype(float)
        sizes = np.where(lists.is_null().to_numpy(zero_copy_only=False), 0, np.diff(ends))
        for d in np.unique(sizes[sizes > 0]).tolist():
            rows = np.flatnonzero(sizes == d)
            for k in range(0, len(rows), CHUNK):
                part = rows[k : k + CHUNK]
                c = flat[ends[part][:, None] + np.arange(d)]
                good = np.isfinite(c).all(axis=1)
                if good.any():
                    with np.errstate(over="ignore"):
                        x = np.clip(np.floor(self.scale * c[good]), -HELD, HELD)
                    yield part[good], x.astype(np.int64) + self.offset


@dataclass(frozen=True)
class Axes:
    """What whitens the vectors of one length: components are the columns of ``vectors``."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    explained: list[float | None]
    sound: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact; of Python integers where they need it."""
        wide = self.n * max(abs(int(x.min())), abs(int(x.max()))) >= 1 << 61
        return self.n * x.astype(object if wide else np.int64) - np.array(self.sums, object if wide else np.int64)

    def whitened(self, z: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.sound, (z / self.n).astype(float) @ self.vectors / np.sqrt(self.values), np.nan)


def deviations(z: np.ndarray) -> np.ndarray:
    """The sum of squares of each row, as Python integers: by halves of 26 bits as long as they suffice."""
    if z.dtype == object or max(abs(int(z.min())), abs(int(z.max()))) >= 1 << 52:
        return (z.astype(object) ** 2).sum(axis=1)
    z = np.abs(z)
    high, low = z >> 26, z & (1 << 26) - 1
    a, b, c = ((u * v).sum(axis=1).astype(object) for u, v in ((high, high), (high, low), (low, low)))
    return a * (1 << 52) + b * (1 << 27) + c


class Whitening:
    """Axes by vector length, fitted on all vectors of a table."""

    def __init__(self, vectors: DataFrame, components: int = 8, scale: float = 1024, offset: int = 100_000, vec_id: str = "vec_id", vector: str = "embedding"):
        self.grid = grid = Grid(float(scale), int(offset))
        self.rows = vectors.select(column(vec_id).cast("bigint").alias("vec_id"), column(vector).alias("x"))
        moments: dict[int, dict] = {}
        sums = self.rows.select("x").mapInArrow(lambda batches: _moments(batches, grid), "d int, i int, j int, total decimal(38,0)").groupBy("d", "i", "j").agg(F.sum("total").alias("total"))
        for r in sums.collect():
            moments.setdefault(r.d, {})[r.i, r.j] = int(r.total)
        self.axes = {d: _axes(d, m, components) for d, m in moments.items()}
        self.errors = self._measured()

    def _measured(self) -> dict[int, float]:
        """The largest entry of the whitened vectors' covariance minus the identity, for each vector length."""
        axes, grid, got = self.axes, self.grid, {}
        summed = self.rows.select("x").mapInArrow(lambda batches: _products(batches, axes, grid), "d int, i int, j int, total double")
        for r in summed.groupBy("d", "i", "j").agg(F.sum("total").alias("total")).collect():
            got.setdefault(r.d, {})[r.i, r.j] = r.total / axes[r.d].n
        out = {}
        for d, m in got.items():
            k = np.flatnonzero(axes[d].sound).tolist()
            out[d] = max((abs(m[i, j] - m[i, -1] * m[j, -1] - (i == j)) for i in k for j in k if i <= j), default=0.0)
        return out

    def transformed(self) -> DataFrame:
        """(vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact) of every vector."""
        axes, errors, grid = self.axes, self.errors, self.grid
        schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, wide decimal(38,0)"
        out = self.rows.mapInArrow(lambda batches: _transformed(batches, axes, errors, grid), schema)
        return out.withColumn("deviation_exact", F.coalesce("wide", F.col("deviation").cast("decimal(38,0)"))).drop("wide")


def _moments(batches: Iterator[pa.RecordBatch], grid: Grid) -> Iterator[pa.RecordBatch]:
    held: dict[int, tuple] = {}
    for batch in batches:
        for _, x in grid.matrices(batch, 0):
            total, cross = scatter(x)
            n, s, c = held.get(x.shape[1], (0, 0, 0))
            held[x.shape[1]] = n + len(x), s + total, c + cross
    for d, (n, s, c) in held.items():
        i, j = np.triu_indices(d)
        cells = [(-1, -1, n), *((k, -1, v) for k, v in enumerate(s)), *zip(i.tolist(), j.tolist(), c[i, j], strict=True)]
        i, j, total = zip(*cells, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array([d] * len(cells), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([int(t) for t in total], pa.decimal128(38))], ["d", "i", "j", "total"])


def _axes(d: int, m: dict, components: int) -> Axes:
    n, sums = m[-1, -1], [m[i, -1] for i in range(d)]
    v = np.array([[(n * m[min(i, j), max(i, j)] - sums[i] * sums[j]) / (n * n) for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:components]
    values, vectors = values[order], vectors[:, order]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)
    trace = float(np.trace(v))
    sound = values > d * np.finfo(float).eps * trace
    return Axes(n, sums, vectors, np.where(sound, values, 1.0), [float(e) / trace if trace > 0 else None for e in np.maximum(values, 0)], sound)


def _products(batches: Iterator[pa.RecordBatch], axes: dict[int, Axes], grid: Grid) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for _, x in grid.matrices(batch, 0):
            w = axes[x.shape[1]].whitened(axes[x.shape[1]].centred(x))
            w = np.c_[w, np.ones(len(w))]
            held[x.shape[1]] = held.get(x.shape[1], 0) + w.T @ w
    for d, total in held.items():
        k = len(total) - 1
        cells = [(i, j if j < k else -1, total[i, j]) for i in range(k) for j in range(i, k + 1)]
        i, j, t = zip(*cells, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array([d] * len(cells), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(t, pa.float64())], ["d", "i", "j", "total"])


def _transformed(batches: Iterator[pa.RecordBatch], axes: dict[int, Axes], errors: dict[int, float], grid: Grid) -> Iterator[pa.RecordBatch]:
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "wide"]
    for batch in batches:
        for rows, x in grid.matrices(batch, 1):
            d = x.shape[1]
            own, k = axes[d], len(axes[d].values)
            z = own.centred(x)
            w, far = own.whitened(z), deviations(z).tolist()
            each = pa.array(np.repeat(np.arange(len(rows)), k))
            deviation = pa.array([v if v <= _LONGEST else None for v in far], pa.int64())
            wide = pa.array([v if _LONGEST < v < 10**38 else None for v in far], pa.decimal128(38))
            n, parts = len(rows), np.arange(1, k + 1, dtype=np.int32)
            cells = [batch.column(0).take(pa.array(rows)).take(each), pa.array(np.tile(parts, n)), pa.array(np.full(n * k, own.n)), deviation.take(each), pa.array(w.ravel(), from_pandas=True), pa.array(own.explained * n, pa.float64()), pa.array(np.full(n * k, errors[d])), wide.take(each)]
            yield pa.RecordBatch.from_arrays(cells, names)


def whiten(vectors: DataFrame, components: int = 8, scale: float = 1024, offset: int = 100_000, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Every vector's whitened components, up to ``components``; fitted on all vectors."""
    return Whitening(vectors, components, scale, offset, vec_id, vector).transformed()
