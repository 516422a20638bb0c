"""Whitening of embeddings by spectrum slicing.

Vectors become integers, so that their sums and their products about the mean add up exactly, whatever the order of tasks. The
covariance has the size of a vector squared and goes to the driver. There the inertia of LDL-transposed factorisations of the
shifted covariance counts the eigenvalues above a shift; bisection by these counts isolates each leading eigenvalue, Rayleigh
quotient iteration converges inside its interval, and two more counts certify its number. Eigenvalues that no shift tells apart
in double precision share an interval and get an orthonormal basis of their common space.

Defined results: rows whose vector is null, is empty, holds null or non-finite entries, or entries of 2^38 and more in size, take no part;
of vectors of different lengths only those of the most frequent length take part (of equally frequent ones the longest); repeated rows
count and return each; ids may be null or repeat; components whose eigenvalue is not above rounding error are left out, so that fewer than
32 can come back (none where all vectors are equal); a deviation beyond 64 bits is null; an empty table gives an empty result; other columns
are ignored."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Context, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from .shared import equal_lengths, shuffle_width

#: x = floor(SCALE * c) + OFFSET
SCALE = 64
OFFSET = 1_000_000
#: Larger entries would not fit the exact sums.
MOST = 2.0**38
EPS = np.finfo(np.float64).eps
#: Pivots of one row are taken while they are at least this share of the largest element beside the diagonal.
PIVOT = (1 + 17**0.5) / 8
_EXACT = Context(prec=60)


@dataclass(frozen=True)
class Fit:
    """n vectors with mean sums/n; components of unit length as columns, their eigenvalues, and the total variance."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float


def integer_vectors(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, x as long integers, one row each) of the usable vectors of a batch."""
    for length, rows, c in equal_lengths(column):
        usable = (np.abs(c) < MOST).all(axis=1)  # false for what is not a number, too
        if usable.any():
            yield length, rows[usable], np.floor(SCALE * c[usable]).astype(np.int64) + OFFSET


def exact_gram(y: np.ndarray) -> np.ndarray:
    """y' y of integers as Python integers, by double-precision products of so few rows that they are exact where the entries allow it."""
    top = int(np.abs(y).max(initial=0))
    if top * top >= 1 << 50:
        own = y.astype(object)
        return own.T @ own
    rows = max(1, (1 << 52) // max(1, top * top))
    out = np.zeros((y.shape[1], y.shape[1]), object)
    for first in range(0, len(y), min(rows, 1 << 16)):
        part = y[first : first + min(rows, 1 << 16)].astype(np.float64)
        out += (part.T @ part).astype(np.int64).astype(object)
    return out


def vector_sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """How many usable vectors of the most frequent length there are, and their sums; (0, []) without any."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[int, int] = {}
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for length, _, x in integer_vectors(batch.column(0)):
                count[length] = count.get(length, 0) + len(x)
                total[length] = total.get(length, np.zeros(length, object)) + x.sum(axis=0, dtype=np.int64).astype(object)
        for length, n in count.items():
            same = lambda value, length=length: pa.array([value] * length)
            sums = pa.array([Decimal(int(s)) for s in total[length]], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([same(length), pa.array(range(length)), same(n), sums], ["length", "place", "n", "s"])

    parts = vectors.mapInArrow(add, "length long, place long, n long, s decimal(38,0)").groupBy("length", "place").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    best = parts.filter("place = 0").orderBy(F.desc("n"), F.desc("length")).limit(1).select("length", "n").collect()
    if not best:
        return 0, []
    rows = parts.filter(F.col("length") == best[0].length).orderBy("place").select("s").collect()
    return best[0].n, [int(r.s) for r in rows]


def covariance(vectors: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """The covariance, each entry correctly rounded: integers about the rounded mean are multiplied and added exactly."""
    length, middle = len(sums), np.array([round(s / n) if abs(s) < 1 << 52 else s // n for s in sums], np.int64)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((length, length), object)
        seen = False
        for batch in batches:
            for own, _, x in integer_vectors(batch.column(0)):
                if own == length:
                    total += exact_gram(x - middle)
                    seen = True
        if seen:
            for k in range(length):
                products = pa.array([[Decimal(int(v)) for v in total[k]]], pa.list_(pa.decimal128(38, 0)))
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), products], ["k", "products"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                own = np.array([int(v) for v in row["products"]], object)
                held[row["k"]] = held[row["k"]] + own if row["k"] in held else own
        for k, own in held.items():
            products = pa.array([[_EXACT.create_decimal(int(v)) for v in own]], pa.list_(pa.decimal128(38, 0)))
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), products], ["k", "products"])

    schema = "k long, products array<decimal(38,0)>"
    width = min(length, shuffle_width(vectors.sparkSession))
    rows = vectors.mapInArrow(multiply, schema).repartition(width, "k").mapInArrow(merge, schema)
    rest = [s - n * int(m) for s, m in zip(sums, middle, strict=True)]
    out = np.zeros((length, length))
    for row in rows.toLocalIterator():
        for j, v in enumerate(row.products):
            out[row.k, j] = (n * int(v) - rest[row.k] * rest[j]) / (n * n)  # one division of integers rounds correctly
    return out


def count_above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix lie above shift: the positive pivots of an LDL-transposed factorisation of matrix - shift I, with
    pivots of one or two rows from the whole rest (the larger of the two kinds)."""
    a = matrix - shift * np.eye(len(matrix))
    above = first = 0

    def swap(i: int, j: int) -> None:
        if i != j:
            a[[i, j]] = a[[j, i]]
            a[:, [i, j]] = a[:, [j, i]]

    while first < len(a):
        rest = a[first:, first:]
        diagonal = np.abs(np.diagonal(rest))
        beside = np.abs(rest - np.diag(np.diagonal(rest)))
        p, most = int(diagonal.argmax()), float(beside.max(initial=0))
        if diagonal[p] == 0 and most == 0:
            break
        if diagonal[p] >= PIVOT * most:
            swap(first, first + p)
            pivot, column = a[first, first], a[first + 1 :, first].copy()
            above += int(pivot > 0)
            a[first + 1 :, first + 1 :] -= np.outer(column / pivot, column)
            first += 1
        else:
            i, j = divmod(int(beside.argmax()), len(rest))
            i, j = min(i, j), max(i, j)
            swap(first, first + i)
            swap(first + 1, first + j)
            block, columns = a[first : first + 2, first : first + 2].copy(), a[first + 2 :, first : first + 2].copy()
            above += 1  # such a block has one eigenvalue of each sign
            a[first + 2 :, first + 2 :] -= columns @ np.linalg.solve(block, columns.T)
            first += 2
    return above


def _shifted_solve(matrix: np.ndarray, shift: float, right: np.ndarray, size: float) -> np.ndarray:
    try:
        out = np.linalg.solve(matrix - shift * np.eye(len(matrix)), right)
        if np.isfinite(out).all():
            return out
    except np.linalg.LinAlgError:
        pass
    return np.linalg.solve(matrix - (shift + 4 * EPS * size) * np.eye(len(matrix)), right)


def rayleigh(matrix: np.ndarray, low: float, high: float, start: np.ndarray, size: float) -> tuple[float, np.ndarray, float] | None:
    """(eigenvalue, unit vector, residual) by Rayleigh quotient iteration from the middle of the interval, or None where it leaves (low, high)."""
    v, shift = start / np.linalg.norm(start), (low + high) / 2
    best = None
    for step in range(14):
        w = _shifted_solve(matrix, shift, v, size)
        v = w / np.linalg.norm(w)
        value = float(v @ matrix @ v)
        residual = float(np.linalg.norm(matrix @ v - value * v))
        if low < value < high and (best is None or residual < best[2]):
            best = (value, v, residual)
        if residual <= 2 * EPS * size:
            break
        if step > 0:  # the second step still iterates about the middle
            shift = value
    return best if best is not None and best[2] <= 64 * len(matrix) ** 0.5 * EPS * size else None


def leading(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as columns) of the largest eigenvalues above rounding error, falling; see the module's head."""
    d = len(matrix)
    size = float(np.abs(matrix).sum(axis=1).max(initial=0))
    floor = 8 * d * EPS * size
    counts: dict[float, int] = {}

    def above(shift: float) -> int:
        if shift not in counts:
            counts[shift] = count_above(matrix, shift)
        return counts[shift]

    wanted = min(most, above(floor)) if size else 0
    values, vectors = np.zeros(wanted), np.zeros((d, wanted))
    starts = np.random.default_rng(0).standard_normal((d, d))
    k = 0
    while k < wanted:
        low, high = floor, 2 * size
        for shift in counts:  # what earlier bisections have told about eigenvalue k
            if counts[shift] > k:
                low = max(low, shift)
            else:
                high = min(high, shift)
        while True:
            inside = above(low) - k
            if inside == 1 and (found := rayleigh(matrix, low, high, starts[:, k], size)):
                value, vector, residual = found
                off = max(4 * residual, floor)
                # the numbering is certain once as many eigenvalues as counted lie above the two sides of the value; closer ones share a space
                if above(value - off) == k + 1 and above(value + off) == k:
                    values[k], vectors[:, k] = value, vector
                    k += 1
                    break
            if high - low <= 4 * floor:
                inside = min(inside, d - k)
                basis = starts[:, k : k + inside]
                for _ in range(6):
                    basis = _shifted_solve(matrix, (low + high) / 2, basis, size)
                    basis -= vectors[:, :k] @ (vectors[:, :k].T @ basis)
                    basis = np.linalg.qr(basis)[0]
                for j in range(min(inside, wanted - k)):
                    values[k + j], vectors[:, k + j] = basis[:, j] @ matrix @ basis[:, j], basis[:, j]
                k = min(wanted, k + inside)
                break
            middle = (low + high) / 2
            if above(middle) > k:
                low = middle
            else:
                high = middle
    return values, vectors


def fit(table: DataFrame, vec_col: str = "embedding", components: int = 32) -> Fit:
    """Fits over all vectors of the table in two passes."""
    vectors = table.select(F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
    n, sums = vector_sums(vectors)
    if not n:
        return Fit(0, [], np.zeros((0, 0)), np.zeros(0), 0.0)
    matrix = covariance(vectors, n, sums)
    values, found = leading(matrix, components)
    return Fit(n, sums, found, values, float(np.trace(matrix)))


def _centred(x: np.ndarray, model: Fit) -> tuple[np.ndarray, np.ndarray]:
    """n x - S exactly, and the same over n in double precision."""
    top = int(np.abs(x).max(initial=0)) * model.n + max(abs(s) for s in model.sums)
    kind = np.int64 if top < 1 << 62 else object
    exact = x.astype(kind) * model.n - np.array(model.sums, kind)
    return exact, exact.astype(np.float64) / model.n


def _whitened(x: np.ndarray, model: Fit) -> tuple[np.ndarray, np.ndarray]:
    exact, centred = _centred(x, model)
    return exact, centred @ model.vectors / np.sqrt(model.values)


def identity_error(table: DataFrame, model: Fit, vec_col: str = "embedding") -> float:
    """The largest absolute entry of the covariance of what `transform` gives, minus the identity, measured over all rows."""
    k, sent = len(model.values), table.sparkSession.sparkContext.broadcast(model)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((k, k + 1)), False
        for batch in batches:
            for length, _, x in integer_vectors(batch.column(0)):
                if length == len(sent.value.sums):
                    w = _whitened(x, sent.value)[1]
                    total += np.column_stack([w.T @ w, w.sum(axis=0)])
                    seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["place", "s"])

    vectors = table.select(F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
    rows = vectors.mapInArrow(multiply, "place long, s double").groupBy("place").agg(F.sum("s").alias("s")).collect()  # (components + 1) squared at most
    total = np.zeros(k * (k + 1))
    for row in rows:
        total[row.place] = row.s / model.n
    total = total.reshape(k, k + 1)
    return float(np.abs(total[:, :k] - np.outer(total[:, k], total[:, k]) - np.eye(k)).max(initial=0))


def transform(table: DataFrame, model: Fit, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, component, deviation, whitened, explained): a row for each usable vector and component."""
    own = table.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
    schema = StructType([
        StructField(id_col, own.schema["id"].dataType), StructField("component", IntegerType()), StructField("deviation", LongType()),
        StructField("whitened", DoubleType()), StructField("explained", DoubleType()),
    ])
    k, sent = len(model.values), table.sparkSession.sparkContext.broadcast(model)
    names = [f.name for f in schema.fields]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = sent.value
        for batch in batches:
            for length, rows, x in integer_vectors(batch.column(1)):
                if length != len(fitted.sums) or not k:
                    continue
                exact, w = _whitened(x, fitted)
                if int(np.abs(exact).max()) ** 2 * length >= 1 << 63:
                    far = [int(d) for d in (exact.astype(object) ** 2).sum(axis=1)]
                    deviation = pa.array([d if d < 1 << 63 else None for d in far], pa.int64())
                else:
                    deviation = pa.array((exact * exact).sum(axis=1).astype(np.int64))
                at = pa.array(np.repeat(np.arange(len(rows)), k))
                component = pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows)))
                share = pa.array(np.tile(fitted.values / fitted.trace, len(rows)))
                ids = batch.column(0).take(pa.array(rows)).take(at)
                yield pa.RecordBatch.from_arrays([ids, component, deviation.take(at), pa.array(w.ravel()), share], names)

    return own.mapInArrow(project, schema)


def whitening_digest(table: DataFrame) -> DataFrame:
    """The contract's columns over embeddings: fitted, measured and returned over all rows."""
    model = fit(table)
    error = identity_error(table, model) if len(model.values) else 0.0
    out = transform(table, model)
    return out.select("vec_id", "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(error).alias("identity_error"))
