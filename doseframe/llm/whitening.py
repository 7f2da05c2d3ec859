"""Embedding whitening by a bit-sliced scatter matrix.

Entries become integers, ``x = floor(SCALE * c) + OFFSET``. The scatter matrix of
integers is a sum of products of bits: each dimension is shifted to start at zero,
its values are cut into bit planes, a plane of 64 rows is one machine word, and
the cross-product of two dimensions is the weighted count of bits that pairs of
their planes share. A task adds up the counts of its rows; Spark adds up tasks.
So sums are exact whatever their order and whichever task ran twice, and the
large common part of the numbers costs no precision: covariances are centred as
integers (``n * sum(xy) - sum(x) * sum(y)``) and only then divided. The driver
gets one number per pair of dimensions, never a row, and solves the eigenproblem.

Whitened values are projections of centred rows on the components, divided by
the root of the eigenvalue. ``identity_error`` is measured on the whitened values
themselves: tasks report count, mean and scatter, which are merged pairwise.

Edge cases. Left out are rows whose vector is null or holds null or non-finite
entries, entries too large for a long (``64 * c`` of 2**62 and more), and vectors
of another length than most rows have (ties: the longer). Repeated rows count as
often as they occur. Directions without variance, beyond rounding, have null as
whitened value, and the error is taken over the others; without any of those it is
null. ``explained`` is zero if nothing varies. No rows give no rows. ``deviation``
is a decimal of up to 38 digits, null beyond. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doseframe.llm.common import pa_type, quoted

#: Fixed by the contract.
SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 32

#: 64 * c has to stay below this.
LARGEST = float(1 << 62)

#: Rows whose planes are packed at once; a multiple of 64.
BLOCK = 4096

#: Bits of a weight that are added up in one long; a limb per so many bits.
LIMB = 20

#: Groups in which the moments of tasks are merged before they come to the driver.
MERGE_GROUPS = 64

#: Eigenvalues below this share of the largest, times the number of dimensions, are rounding.
ROUNDING = 1e-15


@dataclass(frozen=True)
class Whitening:
    """What a task needs to whiten rows: ``sums`` are exact, ``axes`` has a unit component per row, either is bounded by the dimensions."""

    n: int
    sums: tuple[int, ...]
    axes: np.ndarray
    values: np.ndarray
    explained: np.ndarray

    @property
    def usable(self) -> np.ndarray:
        return self.values > ROUNDING * len(self.sums) * max(self.values.max(initial=0.0), 0.0)


def matrix(column: pa.Array, dims: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows that can be used, and which rows those are; all lengths if ``dims`` is None gives lengths instead of numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    flat = column.flatten().cast(pa.float64())
    values = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False)
    ends = np.cumsum(np.maximum(lengths, 0))
    bad = np.concatenate(([0], np.cumsum(~(np.abs(values) < LARGEST / SCALE))))
    fine = (lengths >= 0) & (bad[ends] == bad[ends - np.maximum(lengths, 0)])
    if dims is None:
        return lengths[fine], fine
    fine &= lengths == dims
    rows = values[np.repeat(fine, np.maximum(lengths, 0))].reshape(-1, dims)
    return np.floor(SCALE * rows).astype(np.int64) + OFFSET, fine


def dimensions(vectors: DataFrame) -> int:
    """The length that most usable vectors have, the longer one if there are two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, n = np.unique(matrix(batch.column("v"), None)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(n.astype(np.int64))], names=["dims", "n"])

    counts = vectors.mapInArrow(run, "dims bigint, n bigint").groupBy("dims").agg(F.sum("n").alias("n"))
    most = counts.orderBy(F.col("n").desc(), F.col("dims").desc()).first()
    return most["dims"] if most else 0


def ranges(vectors: DataFrame, dims: int) -> tuple[int, list[int], list[int], list[int]]:
    """Number of rows, and sum, least and greatest number of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, low, high = 0, np.zeros(dims, object), None, None
        for batch in batches:
            x, _ = matrix(batch.column("v"), dims)
            if len(x):
                # Halves of 32 bits: their sums stay within a long.
                sums = sums + (x >> 32).sum(axis=0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(axis=0).astype(object)
                low = x.min(axis=0) if low is None else np.minimum(low, x.min(axis=0))
                high = x.max(axis=0) if high is None else np.maximum(high, x.max(axis=0))
                n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(dims)),
                    pa.array(np.full(dims, n)),
                    pa.array([Decimal(int(s)) for s in sums], pa.decimal128(38, 0)),
                    pa.array(low),
                    pa.array(high),
                ],
                names=["d", "n", "s", "low", "high"],
            )

    parts = vectors.mapInArrow(run, "d bigint, n bigint, s decimal(38,0), low bigint, high bigint")
    rows = parts.groupBy("d").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("low").alias("low"), F.max("high").alias("high"))
    found = sorted(rows.collect(), key=lambda r: r["d"])
    return found[0]["n"] if found else 0, [int(r["s"]) for r in found], [r["low"] for r in found], [r["high"] for r in found]


def packed_planes(x: np.ndarray, bits: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit planes that are not empty, packed into words along the rows, with their dimensions and bit numbers.

    ``x`` has numbers from zero, ``bits`` the greatest bit length of each dimension.
    """
    padded = np.zeros((-(-len(x) // 64) * 64, x.shape[1]), np.uint64)
    padded[: len(x)] = x
    words, dims, at = [], [], []
    for b in range(max(bits, default=0)):
        some = np.array([d for d, n in enumerate(bits) if n > b])
        plane = (padded[:, some] >> np.uint64(b) & np.uint64(1)).astype(np.uint8)
        packed = np.ascontiguousarray(np.packbits(plane, axis=0).T).view(np.uint64)
        full = packed.any(axis=1)
        words.append(packed[full])
        dims.append(some[full])
        at.append(np.full(int(full.sum()), b))
    if not words:
        return np.zeros((0, len(padded) // 64), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(words), np.concatenate(dims), np.concatenate(at)


def add_shared_bits(limbs: np.ndarray, planes: np.ndarray, dims: np.ndarray, at: np.ndarray) -> None:
    """Add the weighted counts of bits that planes share to ``limbs[limb, i, j]`` for dimensions i <= j."""
    order = np.argsort(dims, kind="stable")
    planes, dims, at = planes[order], dims[order], at[order]
    for row, i, a in zip(planes, dims, at):
        begin = np.searchsorted(dims, i)
        shared = np.bitwise_count(planes[begin:] & row).sum(axis=1, dtype=np.int64)
        shift = at[begin:] + a
        np.add.at(limbs, (shift // LIMB, i, dims[begin:]), shared << (shift % LIMB))


def scatter(vectors: DataFrame, low: list[int], high: list[int]) -> list[list[int]]:
    """Exact sums of products of all pairs of dimensions, each shifted to start at zero; upper triangle."""
    dims, bits = len(low), [int(h - lo).bit_length() for lo, h in zip(low, high)]
    n_limbs = max(1, -(-(2 * max(bits, default=0)) // LIMB))
    base = np.array(low, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limbs, any_rows = np.zeros((n_limbs, dims, dims), np.int64), False
        for batch in batches:
            x, _ = matrix(batch.column("v"), dims)
            # Wraps around at 64 bits and back: the difference is exact as an unsigned number.
            shifted = x.view(np.uint64) - base.view(np.uint64)
            for start in range(0, len(x), BLOCK):
                add_shared_bits(limbs, *packed_planes(shifted[start : start + BLOCK], bits))
                any_rows = True
        if any_rows:
            at = np.triu_indices(dims)
            for k in range(n_limbs):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at[0]), pa.array(at[1]), pa.array(np.full(len(at[0]), k)), pa.array(limbs[k][at])], names=["i", "j", "limb", "c"]
                )

    parts = vectors.mapInArrow(run, "i bigint, j bigint, limb bigint, c bigint")
    total = [[0] * dims for _ in range(dims)]
    for r in parts.groupBy("i", "j", "limb").agg(F.sum(F.col("c").cast("decimal(38,0)")).alias("c")).collect():
        total[r["i"]][r["j"]] += int(r["c"]) << (LIMB * r["limb"])
    return total


def fit_whitening(vectors: DataFrame) -> Whitening | None:
    """The components of all usable vectors in column ``v``; None if there are none or they are empty."""
    dims = dimensions(vectors)
    n, sums, low, high = ranges(vectors, dims) if dims else (0, [], [], [])
    if not n:
        return None
    shifted, products = [s - n * lo for s, lo in zip(sums, low)], scatter(vectors, low, high)
    covariance = np.zeros((dims, dims))
    for i in range(dims):
        for j in range(i, dims):
            # Division of integers rounds once.
            covariance[i, j] = covariance[j, i] = (n * products[i][j] - shifted[i] * shifted[j]) / (n * n)
    values, axes = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:COMPONENTS]
    trace = sum(n * products[i][i] - shifted[i] ** 2 for i in range(dims)) / (n * n)
    values, axes = np.maximum(values[order], 0.0), axes[:, order].T
    # Either sign is right; a component's largest entry is positive, so that reruns agree.
    axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]
    return Whitening(n, tuple(sums), axes, values, values / trace if trace else np.zeros_like(values))


def centred(x: np.ndarray, model: Whitening) -> np.ndarray:
    """``n * x - sums``, exact: as long integers where they fit, as Python's beyond."""
    sums = np.array(model.sums, object)
    widest = int(np.abs(x).max(initial=0))
    if model.n * widest < 1 << 62 and max(abs(s) for s in model.sums) < 1 << 62:
        return model.n * x - sums.astype(np.int64)
    return model.n * x.astype(object) - sums


def whitened_rows(x: np.ndarray, model: Whitening) -> tuple[np.ndarray, np.ndarray]:
    """Exact centred rows, and whitened values (NaN where a component has no variance)."""
    exact = centred(x, model)
    usable = model.usable
    scaled = np.full(model.axes.shape, np.nan)
    scaled[usable] = model.axes[usable] / np.sqrt(model.values[usable])[:, None]
    return exact, (exact / model.n).astype(np.float64) @ scaled.T


def deviations(exact: np.ndarray) -> list[Decimal | None]:
    """Sums of squares of exact rows; null beyond 38 digits."""
    if not exact.size:
        return []
    if exact.dtype == object or exact.shape[1] * float(np.abs(exact).max()) ** 2 >= 2.0**62:
        exact = exact.astype(object)
    return [Decimal(int(v)) if v < 10**38 else None for v in (exact * exact).sum(axis=1)]


def identity_error(vectors: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of the whitened values' covariance minus the identity."""
    dims, usable = len(model.sums), model.usable
    if not usable.any():
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = None
        for batch in batches:
            x, _ = matrix(batch.column("v"), dims)
            if len(x):
                y = whitened_rows(x, model)[1][:, usable]
                mean = y.mean(axis=0)
                part = merged(part, (len(y), mean, (y - mean).T @ (y - mean)))
        if part:
            yield moments_row(TaskContext.get().partitionId(), part)

    def together(key: tuple, rows: pa.Table) -> pa.Table:
        return pa.Table.from_batches([moments_row(key[0].as_py(), merged_all(rows.to_pylist()))])

    schema = "task bigint, n bigint, mean array<double>, scatter array<double>"
    parts = vectors.mapInArrow(run, schema)
    groups = parts.groupBy(F.pmod("task", F.lit(MERGE_GROUPS)).alias("g")).applyInArrow(together, schema)
    total = merged_all([r.asDict() for r in groups.collect()])
    return float(np.abs(total[2] / total[0] - np.eye(len(total[1]))).max())


def moments_row(task: int, moments) -> pa.RecordBatch:
    row = [[task], [moments[0]], [moments[1].tolist()], [moments[2].ravel().tolist()]]
    return pa.RecordBatch.from_arrays([pa.array(v) for v in row], names=["task", "n", "mean", "scatter"])


def merged_all(rows: list[dict]):
    """Rows of moments merged in order of their task, so that reruns agree."""
    total = None
    for r in sorted(rows, key=lambda r: r["task"]):
        k = len(r["mean"])
        total = merged(total, (r["n"], np.array(r["mean"]), np.array(r["scatter"]).reshape(k, k)))
    return total


def merged(a, b):
    """Count, mean and centred scatter of two sets of rows together."""
    if a is None:
        return b
    n, apart = a[0] + b[0], b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def whiten(embeddings: DataFrame, vector: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """Per usable row and component: the id, component, n, deviation, whitened, explained, identity_error."""
    vectors = embeddings.select(quoted(vector).cast("array<double>").alias("v"))
    model = fit_whitening(vectors)
    id_type = embeddings.schema[id_col].dataType
    schema = f"`{id_col}` {id_type.simpleString()}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    rows = embeddings.select(quoted(id_col), quoted(vector).cast("array<double>").alias("v"))
    if model is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    error, dims, parts = identity_error(vectors, model), len(model.sums), len(model.values)
    arrow_id = pa_type(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, fine = matrix(batch.column("v"), dims)
            exact, y = whitened_rows(x, model)
            of_row = pa.array(np.repeat(np.arange(len(x)), parts))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(id_col).filter(pa.array(fine)).cast(arrow_id).take(of_row),
                    pa.array(np.tile(np.arange(1, parts + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(x) * parts, model.n)),
                    pa.array(deviations(exact), pa.decimal128(38, 0)).take(of_row),
                    pa.array(y.ravel(), from_pandas=True),
                    pa.array(np.tile(model.explained, len(x))),
                    pa.array([error], pa.float64()).take(pa.array(np.zeros(len(x) * parts, np.int64))),
                ],
                names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema)
