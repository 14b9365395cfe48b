"""Whitening of embeddings from an exact scatter in residue numbers.

Vectors become integers, x. Each distinct x counts once: the fit list. Its rows, less the rounded mean, are multiplied in
matrix products modulo several primes, per partition: residues are at most 2^20 in size, so that a product over BLOCK rows
is exact in double precision. Partitions pass on one row for each prime and dimension; those are summed modulo the prime,
and the Chinese remainder theorem gives the scatter as whole numbers, whatever the number of rows or their order. Its
covariance is rounded once, to doubles, and decomposed by eigh.

What reaches the driver is of the size of the scatter: length times length numbers for each prime.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import stored, trimmed
from loomwright.llm.embed_dedup import usable

#: Primes lie below TOP; a centred residue's square times BLOCK rows stays below 2^53.
TOP, BLOCK = 1 << 21, 4096
#: An eigenvalue up to this share of the largest is rounding of zero.
NOTHING = 1e-13


def primes_beyond(bound: int) -> list[int]:
    """The largest primes below TOP whose product exceeds `bound`, two at least."""
    found, product, at = [], 1, TOP - 1
    while product <= bound or len(found) < 2:
        if all(at % d for d in range(3, int(at**0.5) + 1, 2)):
            found.append(at)
            product *= at
        at -= 2
    return found


def centred(x: np.ndarray, shift: np.ndarray, prime: int) -> np.ndarray:
    """x - shift modulo the prime, in doubles of at most half of it in size; neither difference nor product overflows."""
    rest = (x % prime - shift) % prime
    return np.where(rest > prime // 2, rest - prime, rest).astype(float)


def from_residues(residues: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """The whole numbers, as Python's, of least size that leave these residues (Garner's form of the Chinese remainders)."""
    value, product = residues[0].astype(object), primes[0]
    for rest, prime in zip(residues[1:], primes[1:], strict=True):
        digit = (rest.astype(object) - value) * pow(product, -1, prime) % prime
        value, product = value + digit * product, product * prime
    return np.where(value > product // 2, value - product, value)


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places of the rows of each length in the column x, and their vectors as one matrix."""
    lengths = np.asarray(batch.column("x").value_lengths())
    for width in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == width)
        vectors = batch.column("x") if len(at) == len(lengths) else batch.column("x").take(pa.array(at))
        yield at, vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


@dataclass
class Whitening:
    """What was fitted for vectors of one length; `axes` has a column for each component, divided by its deviation."""

    n: int
    sums: list[int]
    most: int
    shift: list[int]
    axes: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    explained: list[float] = field(default_factory=list)
    error: float | None = None

    @classmethod
    def of(cls, n: int, sums: list[int], most: int) -> Whitening:
        return cls(n, sums, most, [(2 * s + n) // (2 * n) for s in sums])

    def left(self) -> np.ndarray:
        """What the rounded mean leaves of the sums: S - n shift, at most n / 2 in size."""
        return np.array([s - self.n * m for s, m in zip(self.sums, self.shift, strict=True)], object)

    def bound(self) -> int:
        """No entry of the scatter of the shifted rows is larger."""
        return self.n * (2 * self.most + 1) ** 2

    def solve(self, scatter: np.ndarray, components: int) -> None:
        """Components of the covariance, from the exact scatter of the shifted rows."""
        rest, n = self.left(), self.n
        exact = scatter * n - np.outer(rest, rest)  # n^2 times the covariance
        covariance = np.array([[int(v) / (n * n) for v in row] for row in exact])
        values, vectors = np.linalg.eigh(covariance)
        order = np.argsort(-values, kind="stable")[:components]
        values, vectors, trace = values[order], vectors[:, order], sum(int(v) for v in exact.diagonal()) / (n * n)
        fine = values > max(0.0, NOTHING * float(values[:1].sum()))
        self.axes = np.where(fine, vectors / np.sqrt(np.where(fine, values, 1)), np.nan)
        self.explained = [float(v) / trace if trace else None for v in np.where(fine, values, 0.0)]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        small = self.most < 1 << 52
        moved = (x - np.array(self.shift)).astype(float) if small else x.astype(float) - np.array(self.shift, float)
        return (moved - (self.left() / self.n).astype(float)) @ self.axes

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The exact sums over dimensions of (n x - S)^2; None beyond 64 bits."""
        reach = self.n * (2 * self.most + 1)
        if reach * reach * len(self.sums) < 1 << 63:
            moved = self.n * (x - np.array(self.shift)) - self.left().astype(np.int64)
            return (moved * moved).sum(1).tolist()
        found = []
        for row in x.tolist():
            total = sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums, strict=True))
            found.append(total if total < 1 << 63 else None)
        return found


def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows, sums and the largest size of a partition's vectors, by length and dimension."""
    found: dict[int, list] = {}
    for batch in batches:
        for _, x in matrices(batch):
            held = found.setdefault(x.shape[1], [0, [0] * x.shape[1], 0])
            most = max(int(x.max()), -int(x.min()))
            sums = x.sum(0) if most * len(x) < 1 << 63 else x.astype(object).sum(0)
            found[x.shape[1]] = [held[0] + len(x), [a + int(b) for a, b in zip(held[1], sums, strict=True)], max(held[2], most)]
    whole = lambda values: pa.array([decimal.Decimal(v) for v in values], pa.decimal128(38, 0))
    for width, (n, sums, most) in found.items():
        places = [pa.array([v] * width, t) for v, t in ((width, pa.int32()), (n, pa.int64()))]
        yield pa.RecordBatch.from_arrays([*places, pa.array(range(width), pa.int32()), whole(sums), whole([most] * width)], names=["width", "n", "place", "total", "most"])


SCATTER = "width int, prime int, place int, total array<long>"


def rows_of(tables: dict[tuple[int, int], dict[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for (width, prime), table in tables.items():
        for place, total in table.items():
            columns = [pa.array([v], pa.int32()) for v in (width, prime, place)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([total], pa.list_(pa.int64()))], names=["width", "prime", "place", "total"])


def scatters(fit: DataFrame, fitted: dict[int, Whitening]) -> dict[int, np.ndarray]:
    """The exact scatter of the rows of each length, less the rounded mean."""
    primes = {w: primes_beyond(2 * m.bound()) for w, m in fitted.items()}
    shifts = {(w, p): np.array([s % p for s in fitted[w].shift]) for w in fitted for p in primes[w]}

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for _, x in matrices(batch):
                width = x.shape[1]
                for prime in primes[width]:
                    total = found.setdefault((width, prime), np.zeros((width, width), np.int64))
                    for at in range(0, len(x), BLOCK):
                        rest = centred(x[at : at + BLOCK], shifts[width, prime], prime)
                        total += (rest.T @ rest).astype(np.int64) % prime
                    total %= prime
        yield from rows_of({key: dict(enumerate(total)) for key, total in found.items()})
        trimmed()

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], dict[int, np.ndarray]] = {}
        for batch in batches:
            for width, prime, place, total in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column("total"), strict=True):
                held, more = found.setdefault((width, prime), {}), total.values.to_numpy(zero_copy_only=False)
                held[place] = (held[place] + more) % prime if place in held else more % prime
        yield from rows_of(found)

    parts = fit.mapInArrow(partial, SCATTER).repartition("width", "prime", "place").mapInArrow(reduced, SCATTER)
    tables = {(w, p): np.zeros((w, w), np.int64) for w in primes for p in primes[w]}
    for row in parts.toArrow().to_pylist():
        tables[row["width"], row["prime"]][row["place"]] = row["total"]
    return {w: from_residues([tables[w, p] for p in primes[w]], primes[w]) for w in primes}


def fitted_to(fit: DataFrame, components: int) -> dict[int, Whitening]:
    """The whitening of each length of the column x of `fit`, whose rows count once each."""
    shape = "width int, n long, place int, total decimal(38,0), most decimal(38,0)"
    by_place = fit.mapInArrow(measured, shape).groupBy("width", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("most").alias("most"))
    sums: dict[int, list] = {}
    for row in by_place.orderBy("width", "place").collect():
        sums.setdefault(row["width"], []).append(row)
    fitted = {w: Whitening.of(rows[0]["n"], [int(r["total"]) for r in rows], int(rows[0]["most"])) for w, rows in sums.items()}
    for width, scatter in scatters(fit, fitted).items() if fitted else ():
        fitted[width].solve(scatter, components)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in matrices(batch):
                values = fitted[x.shape[1]].whitened(x)
                values = np.where(np.isnan(values), None, values).tolist()
                yield pa.RecordBatch.from_arrays([pa.array([x.shape[1]] * len(x), pa.int32()), pa.array(values, pa.list_(pa.float64()))], names=["width", "w"])

    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    value = lambda i: F.get("w", F.lit(i))
    spread = [F.covar_pop(value(i), value(j)).alias(f"c{i}_{j}") for i, j in pairs]
    for row in fit.mapInArrow(project, "width int, w array<double>").groupBy("width").agg(*spread).collect() if fitted else ():
        off = [abs(row[f"c{i}_{j}"] - (i == j)) for i, j in pairs if row[f"c{i}_{j}"] is not None]
        fitted[row["width"]].error = max(off, default=None)
    return fitted


def whiten(rows: DataFrame, components: int = 4, scale: int = 256) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error for each usable row and component.

    A component c of a vector counts as the long floor(scale * c); one beyond 64 bits as the nearest long. A null or
    empty vector and one with a null or non-finite component are left out. Vectors of each length are fitted among
    themselves, each distinct integer vector once (n of them); repeated rows and rows with a null vec_id are returned
    like others. There are as many components as the vector has, `components` at most, by falling eigenvalue. Where
    the eigenvalue is zero, the variance of one vector or of a flat set, whitened is null and the component is left out of
    identity_error, which is null without any. explained is null where all variance is zero, deviation where it exceeds
    64 bits. An empty table gives an empty result; other columns are not read.
    """
    source = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where(usable("v"))
    whole = source.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("v", lambda c: F.floor(c * scale)).alias("x"))
    fit = stored(whole.select("x").groupBy("x").agg(F.count(F.lit(1)).alias("copies")).select("x"))
    fitted = fitted_to(fit, components)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in matrices(batch):
                model = fitted[x.shape[1]]
                many = model.axes.shape[1]
                values = model.whitened(x).ravel()
                deviations = [d for d in model.deviations(x) for _ in range(many)]
                yield pa.RecordBatch.from_arrays([
                    batch.column("vec_id").take(pa.array(np.repeat(at, many))), pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), len(x))),
                    pa.array([model.n] * len(values), pa.int64()), pa.array(deviations, pa.int64()), pa.array(values, pa.float64(), mask=np.isnan(values)),
                    pa.array(model.explained * len(x), pa.float64()), pa.array([model.error] * len(values), pa.float64()),
                ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return whole.mapInArrow(apply, schema)
