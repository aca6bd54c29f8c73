"""Whitening of embeddings by an exact integer scatter.

An entry c, as double, becomes the integer x = floor(scale * c) + shift. With
the shift subtracted, tasks accumulate the sums S and cross-products of
integers of any size: the digits of 20 bits of up to ROWS vectors at a time
are multiplied as doubles, which is exact below 2 ** 53, and added up as
integers without a bound. n XᵀX - SSᵀ is formed exactly on the driver and only
then divided by n ** 2, to the nearest double, and decomposed by eigh. The
shift, the order of rows and how they are dealt change no bit of it. What is
collected are the d sums and d (d + 1) / 2 products of d dimensions, a row of
the matrix at a time, added up over tasks before.

Defined cases: a vector that is null, is empty, or holds null, NaN or infinite
entries is left out, of the fit and of the result. All vectors are of one
length, the most frequent one (of equally frequent ones the longest); others
lack an entry, or have one that no other has, and are left out, too. An x
beyond 63 bits is held at their limit. Components whose eigenvalue is zero to
rounding (at most d * 2 ** -52 of the largest) can't be scaled to a unit
variance and are left out, so equal vectors and an empty table give no rows.
A deviation beyond 63 bits is null. Repeated rows count each and give a row
each; ids may be null. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: Vectors multiplied at once: products of digits of 20 bits stay exact in doubles.
ROWS = 4096
DIGIT = 20
_LIMIT = (1 << 63) - 1


def usable(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v (array<double>) of the vectors that are finite and not empty."""
    bounded_batches(df.sparkSession)
    own = df.select(df[id_col].cast("long").alias("vec_id"), df[vector_col].cast("array<double>").alias("v"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return own.where(F.coalesce((F.size("v") > 0) & F.forall("v", finite), F.lit(False)))


def integers(values: np.ndarray, scale: int, shift: int) -> np.ndarray:
    """x - shift of the entries, as 64-bit integers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * float(scale))
    most = _LIMIT - abs(shift)
    fits = np.abs(scaled) < 2.0**62
    y = np.where(fits, scaled, 0).astype(np.int64)
    return np.where(fits, y, np.where(scaled > 0, most, -most))


def digits(y: np.ndarray) -> list[np.ndarray]:
    """y in parts of DIGIT bits, least first; the last one has the sign."""
    parts = []
    while np.any((y < -(1 << DIGIT)) | (y > 1 << DIGIT)):
        parts.append((y & ((1 << DIGIT) - 1)).astype(float))
        y = y >> DIGIT
    return [*parts, y.astype(float)]


def scatter(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and cross-products of at most ROWS rows of integers, exact, as arrays of Python's integers."""
    parts = digits(y)
    whole = lambda m, bits: m.astype(np.int64).astype(object) * (1 << bits)
    sums = sum(whole(p.sum(0), DIGIT * k) for k, p in enumerate(parts))
    return sums, sum(whole(p.T @ q, DIGIT * (k + j)) for k, p in enumerate(parts) for j, q in enumerate(parts))


def _vectors(batch: pa.RecordBatch, dims: int) -> tuple[pa.Array, np.ndarray]:
    lists = batch.column(batch.schema.get_field_index("v"))
    return batch.column(0), lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


@dataclass(frozen=True)
class Whitening:
    """A fit: n vectors' sums of x - shift, and the leading unit eigenvectors (columns) of x's covariance with their eigenvalues."""

    n: int
    dims: int
    scale: int
    shift: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def own(self, df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
        return usable(df, id_col, vector_col).where(F.size("v") == self.dims)

    def _scores(self, y: np.ndarray) -> tuple[list[int | None], np.ndarray]:
        """Of rows y: the sum of squares of n y - S, exact, and the rows whitened."""
        sums, most = np.array(self.sums, object), max(map(abs, self.sums), default=0)
        reach = self.n * (max(int(y.max(initial=0)), -int(y.min(initial=0)))) + most
        if reach <= _LIMIT:
            away = self.n * y - sums.astype(np.int64)
            if reach * reach * self.dims <= _LIMIT:
                squares = (away * away).sum(1).tolist()
            else:
                squares = (away.astype(object) ** 2).sum(1).tolist()
            centred = away / self.n
        else:
            away = y.astype(object) * self.n - sums
            squares, centred = (away**2).sum(1).tolist(), (away / self.n).astype(float)
        return [s if s <= _LIMIT else None for s in squares], centred @ (self.vectors / np.sqrt(self.values))

    def transform(self, df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
        """vec_id, deviation (sum of squares of n x - S), whitened (array<double>, a value a component)."""
        schema = pa.schema([("vec_id", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.list_(pa.float64()))])

        def run(batches):
            for batch in batches:
                ids, rows = _vectors(batch, self.dims)
                squares, made = self._scores(integers(rows, self.scale, self.shift))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1, dtype=np.int32) * made.shape[1]), pa.array(made.reshape(-1)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(squares, pa.int64()), lists], schema=schema)

        return self.own(df, id_col, vector_col).mapInArrow(run, "vec_id long, deviation long, whitened array<double>")

    def identity_error(self, df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> float:
        """The largest entry, without sign, of the whitened rows' covariance less the identity; measured over df."""
        k = len(self.values)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, some = np.zeros((k + 1, k + 1)), False
            for batch in batches:
                made = self._scores(integers(_vectors(batch, self.dims)[1], self.scale, self.shift))[1]
                made = np.column_stack([made, np.ones(len(made))])
                total, some = total + made.T @ made, True
            if some:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.reshape(-1))], names=["at", "sum"])

        sums = {r["at"]: r["total"] for r in self.own(df, id_col, vector_col).mapInArrow(run, "at long, sum double").groupBy("at").agg(F.sum("sum").alias("total")).collect()}  # (k + 1) ** 2 rows
        whole = np.array([sums[i] for i in range((k + 1) ** 2)]).reshape(k + 1, k + 1) / self.n
        return float(np.abs(whole[:k, :k] - np.outer(whole[k, :k], whole[k, :k]) - np.eye(k)).max(initial=0.0))


def covariance(n: int, sums: np.ndarray, products: np.ndarray) -> tuple[np.ndarray, float]:
    """(n XᵀX - SSᵀ) / n ** 2 to the nearest double, and its trace; from exact integers."""
    exact = n * products - np.outer(sums, sums)
    return (exact / (n * n)).astype(float), int(np.trace(exact)) / (n * n)


def fit(df: DataFrame, components: int = 32, scale: int = 64, shift: int = 1_000_000, id_col: str = "vec_id", vector_col: str = "embedding") -> Whitening | None:
    """The whitening of df's vectors; None where none is usable. Runs two jobs."""
    own = usable(df, id_col, vector_col).select("v")
    size = F.size("v").alias("dims")
    often = own.groupBy(size).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if often is None:
        return None
    dims, n = often["dims"], often["n"]
    parts = pa.schema([("i", pa.int32()), ("exact", pa.string())])

    def partial(batches):
        sums, products, held, rows = 0, 0, [], 0

        def add():
            nonlocal sums, products, held, rows
            if rows:
                more = scatter(np.concatenate(held))
                sums, products, held, rows = sums + more[0], products + more[1], [], 0

        for batch in batches:
            y = integers(_vectors(batch, dims)[1], scale, shift)
            for start in range(0, len(y), ROWS):
                part = y[start : start + ROWS]
                if rows + len(part) > ROWS:
                    add()
                held.append(part)
                rows += len(part)
        add()
        if not isinstance(sums, int):
            yield from told([(-1, sums), *((i, products[i, i:]) for i in range(dims))])

    def told(found):
        for i, row in found:
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([",".join(map(str, row))])], schema=parts)

    def added(batches):
        total = {}
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                row = np.array([int(x) for x in text.split(",")], object)
                total[i] = total[i] + row if i in total else row
        yield from told(total.items())

    shuffles = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = own.where(size == dims).mapInArrow(partial, "i int, exact string").repartition(shuffles, "i").mapInArrow(added, "i int, exact string")
    rows = {r.i: np.array([int(x) for x in r.exact.split(",")], object) for r in made.collect()}  # d + 1 rows
    products = np.zeros((dims, dims), object)
    for i in range(dims):
        products[i, i:] = products[i:, i] = rows[i]
    spread, trace = covariance(n, rows[-1], products)
    values, vectors = np.linalg.eigh(spread)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, int(np.count_nonzero(values > dims * 2.0**-52 * max(values[0], 0))))
    return Whitening(n, dims, scale, shift, tuple(map(int, rows[-1])), values[:k].copy(), np.ascontiguousarray(vectors[:, :k]), trace)
