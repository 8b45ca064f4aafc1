"""What the operators on vectors share: rows that take part, Hilbert keys, ranks along an ordering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from verivane.llm.common import materialize

SCALE = 256  #: steps a unit, where components become whole numbers


def usable(rows: DataFrame, columns: list[str], vector: str) -> tuple[DataFrame, int]:
    """`columns` and the vector as v, of rows whose vector is not empty and has finite components only, and the number of components.

    Vectors are of one length: the commonest, of several the longest; rows of other lengths are left out. 0 components: no row is left."""
    v, inf = F.col(vector), F.lit(float("inf"))
    floats = isinstance(rows.schema[vector].dataType, ArrayType) and isinstance(rows.schema[vector].dataType.elementType, FloatType)
    fine = F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < inf), F.lit(False)))
    good = rows.where(v.isNotNull() & (F.size(v) > 0)).where(fine).select(*columns, (v if floats else v.cast("array<double>")).alias("v"))
    sizes = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = sizes["d"] if sizes else 0
    return good.where(F.size("v") == d), d


def whole(v: str | Column = "v") -> Column:
    """The components as whole numbers, floor(256 c); beyond a long's range they saturate."""
    return F.transform(F.col(v) if isinstance(v, str) else v, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))


def matrix(column: pa.ChunkedArray | pa.Array, d: int, kind=np.float64) -> np.ndarray:
    """The rows of a column of lists of d numbers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, d)


def lists(m: np.ndarray) -> pa.Array:
    """The rows of a matrix as a column of lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), pa.array(m.ravel()))


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two whole-number matrices, exact: in doubles where these hold all sums, else in Python's numbers."""
    top = (int(np.abs(a).max(initial=0)), int(np.abs(b).max(initial=0)))
    if top[0] * top[1] * a.shape[1] < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    out = a.astype(object) @ b.astype(object).T
    if out.size and max(abs(int(out.max())), abs(int(out.min()))) >= 1 << 63:
        raise OverflowError("an inner product is beyond a long's range")
    return out.astype(np.int64)


# ---- Hilbert orderings -----------------------------------------------------------------------------------

DIMS, BITS = 8, 7  #: of the projection that a curve runs through; their product fits a long


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place along the Hilbert curve of each row of cells (whole numbers below 2^bits), by Skilling's transform of the axes."""
    x = cells.astype(np.uint64).T.copy()
    m, zero, one = len(x), np.uint64(0), np.uint64(1)
    for b in range(bits - 1, 0, -1):
        bit, low = np.uint64(1 << b), np.uint64((1 << b) - 1)
        for i in range(m):
            turned = (x[i] & bit) != zero
            swap = np.where(turned, zero, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(turned, low, swap)
            if i:
                x[i] ^= swap
    for i in range(1, m):
        x[i] ^= x[i - 1]
    carry = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, 0, -1):
        carry ^= np.where((x[-1] & np.uint64(1 << b)) != zero, np.uint64((1 << b) - 1), zero)
    x ^= carry
    key = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(m):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key.astype(np.int64)


def projections(d: int, orders: int, dims: int = DIMS) -> np.ndarray:
    """For each ordering, directions to project on: random, orthogonal where d allows; the same for the same d."""
    draw = np.random.default_rng(d).normal(size=(orders, d, dims))
    return np.stack([np.linalg.qr(p)[0] if d >= dims else p for p in draw])


def spread(points: DataFrame, project: np.ndarray) -> np.ndarray:
    """Mean and deviation of each projected coordinate over all rows of points (v): sums from each task, added up in Spark."""
    flat = project.transpose(1, 0, 2).reshape(project.shape[1], -1)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, flat.shape[1]))
        for b in batches:
            y = matrix(b["v"], len(flat)) @ flat
            total += np.stack([np.full(y.shape[1], len(y)), y.sum(0), (y * y).sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array(range(flat.shape[1]), pa.int32()), *map(pa.array, total)], ["c", "n", "s", "q"])

    rows = points.select("v").mapInArrow(sums, "c int, n double, s double, q double").groupBy("c").agg(*[F.sum(x).alias(x) for x in "nsq"]).orderBy("c").collect()
    n, s, q = np.array([r[1:] for r in rows]).T
    mean = s / np.maximum(n, 1)
    return np.stack([mean, np.sqrt(np.maximum(q / np.maximum(n, 1) - mean * mean, 0))]).reshape(2, *project.shape[::2])


def keyed(points: DataFrame, project: np.ndarray, scale: np.ndarray, bits: int = BITS) -> DataFrame:
    """The rows of points (v and others) once for each ordering o, with their Hilbert key there. A grid covers three deviations on
    either side of the mean, moved by a random part of a deviation for each ordering; what lies outside counts to its border."""
    shift = np.random.default_rng(project.shape[0]).uniform(-0.5, 0.5, project.shape[::2])
    mean, deviation = scale[0], np.where(scale[1] > 0, scale[1], 1)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = matrix(b["v"], project.shape[1])
            for o in range(len(project)):
                y = ((v @ project[o] - mean[o]) / deviation[o] + shift[o]) / 6 + 0.5
                cells = np.clip(np.floor(y * (1 << bits)), 0, (1 << bits) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), o, np.int32)), pa.array(hilbert(cells, bits)), *b.columns], ["o", "key", *b.schema.names])

    kinds = ", ".join(f"{c} {t}" for c, t in points.dtypes)
    return points.mapInArrow(keys, f"o int, key long, {kinds}")


def ranked(entries: DataFrame, ties: list[str], each: int, name: str) -> DataFrame:
    """A written table of entries, each with its rank (from 0) within its ordering o, by key and then ties; `each`: rows of an ordering.

    Ranges of (o, key, ties) are sorted apart from each other, so that a key with any number of rows is split by its ties; a
    task's rows are numbered, and the sizes of the ranges (one row a task) give what lies before."""
    by = ["o", "key", *ties]
    at = materialize(entries.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)
    sizes = at.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = at.withColumn("_part", part).join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part")
    rank = F.col("_before") + F.col("_at") - F.shiftleft("_part", 33) - F.col("o") * F.lit(each)
    return placed.withColumn("rank", rank).drop("_part", "_before", "_at")
