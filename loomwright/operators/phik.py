"""phi-K: the correlation of a bivariate normal distribution that has the chi-square of a contingency table.

After Baak, Koopman, Snoek and Klous (2020). Numbers are binned evenly; a table's chi-square is compared with that of a
bivariate normal on as many even bins from -5 to 5, scaled so that independence gives the noise pedestal, the degrees of
freedom, and full correlation the largest possible value. The correlation is found by bisection. A pair of columns is one
group of bounded size; tables of one shape share their integrals.
"""

from __future__ import annotations

from functools import lru_cache
from math import erf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.operators.measures import pair_values

#: How far the normal's bins reach, nodes of the quadrature in a panel, panels, and steps of the bisection.
REACH, NODES, PANELS, STEPS = 5.0, 16, 15, 24
normal_cdf = np.frompyfunc(lambda z: 0.5 * (1 + erf(z / 2**0.5)), 1, 1)


def edges(rows: int, columns: int) -> tuple[np.ndarray, np.ndarray]:
    return np.linspace(-REACH, REACH, rows + 1), np.linspace(-REACH, REACH, columns + 1)


@lru_cache(maxsize=256)
def independent(rows: int, columns: int) -> np.ndarray:
    """The probabilities of the cells of two independent standard normals on even bins."""
    x, y = edges(rows, columns)
    return np.outer(*(np.diff(normal_cdf(z).astype(float)) for z in (x, y)))


def gained(rho: float, rows: int, columns: int) -> np.ndarray:
    """What the cells of a standard bivariate normal have more than independent ones.

    The distribution function gains its density integrated over the correlation, from 0 to rho. Over the arc cosine of the
    correlation the integrand is bounded, and changes on the scale of the distance of two bins' edges. Panels that halve
    towards full correlation hold every scale, so that the work is the same for any rho.
    """
    x, y = edges(rows, columns)
    apart, product = np.subtract.outer(x, y) ** 2 / 2, np.outer(x, y)
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    least = np.arccos(rho)
    ends = [max(np.pi / 2 / 2**k, least) for k in range(PANELS)] + [least]
    total = np.zeros_like(product)
    for high, low in zip(ends, ends[1:]):
        half = (high - low) / 2
        for angle, weight in zip(low + half * (nodes + 1), half * weights):
            if half > 0:
                total += weight * np.exp(-apart / np.sin(angle) ** 2 - product / (1 + np.cos(angle)))
    return np.diff(np.diff(total, axis=0), axis=1) / (2 * np.pi)


@lru_cache(maxsize=65536)
def normal_chi2(rho: float, rows: int, columns: int) -> float:
    """Chi-square a row of a bivariate normal against independence."""
    return float((gained(rho, rows, columns) ** 2 / independent(rows, columns)).sum())


def phi_k(chi2: float, n: float, rows: int, columns: int) -> float:
    """The correlation for the chi-square of n rows in a table of this shape; 0 up to the pedestal."""
    if rows < 2 or columns < 2:
        return 0.0
    pedestal, largest = (rows - 1) * (columns - 1), n * min(rows - 1, columns - 1)
    if chi2 <= pedestal:
        return 0.0
    if chi2 >= largest:
        return 1.0
    share, whole = (chi2 - pedestal) / (largest - pedestal), normal_chi2(1.0, rows, columns)
    low, high = 0.0, 1.0
    for _ in range(STEPS):
        middle = (low + high) / 2
        low, high = (middle, high) if normal_chi2(middle, rows, columns) / whole < share else (low, middle)
    return (low + high) / 2


def phi_k_pairs(df: DataFrame, threshold: float = 0.80, bins: int = 10, most: int = 50) -> DataFrame:
    """(column_a, column_b, phi_k), to three places, of pairs of columns with phi-K of at least the threshold.

    Columns are binned as for Cramer's V; one with a single value has no correlation. A pair's group holds the cells of its
    contingency table, most * most at most.
    """
    cells = pair_values(df, bins, most).groupBy("column_a", "column_b", "x", "y").agg(F.sum("n").cast("double").alias("n"))

    def solve(group: pa.Table) -> pa.Table:
        ranks = [np.unique(np.array(group.column(c).to_pylist(), object).astype(str), return_inverse=True) for c in ("x", "y")]
        (a, i), (b, j) = ranks
        table = np.zeros((len(a), len(b)))
        table[i, j] = np.asarray(group.column("n"))
        n = table.sum()
        expected = np.outer(table.sum(1), table.sum(0)) / n
        found = phi_k(float(((table - expected) ** 2 / expected).sum()), float(n), *table.shape)
        return pa.table({"column_a": group.column("column_a")[:1], "column_b": group.column("column_b")[:1], "phi_k": [round(found, 3)]})

    return cells.groupBy("column_a", "column_b").applyInArrow(solve, "column_a string, column_b string, phi_k double").where(F.col("phi_k") >= threshold)
