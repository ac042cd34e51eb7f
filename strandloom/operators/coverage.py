"""Coverage of reads: how often k-mers occur, and the count that parts errors from coverage."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.kmers import gapped_kmers
from strandloom.operators.index import KEY

MAX_COUNT, MIN_BIN = 1000, 50
#: Where the fit starts: share of errors, and mean coverage.
START = (0.8, 20.0)


def kmer_counts(reads: DataFrame, k: int, rc: bool = True) -> DataFrame:
    """``key_hi``, ``key_lo``, ``n`` of all reads; qualities and middle bases play no part."""
    return gapped_kmers(reads, k, rc).groupBy(*KEY).agg(F.count("*").alias("n"))


def histogram(counts: DataFrame, min_bin: int = MIN_BIN) -> DataFrame:
    """``count``, ``n_kmers`` for each count from 1 to the last that ``min_bin`` k-mers have.

    Counts over 1000 are left out, counts between that no k-mer has are 0.
    """
    bins = counts.where(F.col("n") <= MAX_COUNT).groupBy(F.col("n").alias("count")).agg(F.count("*").alias("n_kmers"))
    last = bins.where(F.col("n_kmers") >= min_bin).agg(F.max("count").alias("last"))
    steps = last.where("last is not null").select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("last").cast("long"))).alias("count"))
    return steps.join(bins, "count", "left").select("count", F.coalesce("n_kmers", F.lit(0)).alias("n_kmers"))


def _log_poisson(x: np.ndarray, mean: float) -> np.ndarray:
    return x * math.log(mean) - np.array([math.lgamma(v + 1) for v in x]) - mean


@dataclass(frozen=True)
class Fit:
    errors: float
    coverage: float
    cutoff: int


def components(x: np.ndarray, errors: float, coverage: float) -> tuple[np.ndarray, np.ndarray]:
    """Log densities of the error (mean 1) and coverage components, with their weights."""
    return math.log(errors) + _log_poisson(x, 1.0), math.log1p(-errors) + _log_poisson(x, coverage)


def fit(counts: list[int] | np.ndarray, rounds: int = 20, tolerance: float = 1e-6) -> Fit:
    """Maximum likelihood of the two-Poisson mixture by BFGS with Armijo backtracking.

    The likelihood is taken per k-mer, which makes steps and tolerance independent of
    the input's size.  Raises if it doesn't converge within ``rounds``.
    """
    n = np.asarray(counts, float)
    if not n.sum():
        raise ValueError("no counts to fit")
    x, n = np.arange(1, len(n) + 1, dtype=float), n / n.sum()

    def cost(p: np.ndarray) -> float:
        if not 0 < p[0] < 1 or p[1] < 1:
            return math.inf
        return -float(n @ np.logaddexp(*components(x, *p)))

    def slope(p: np.ndarray) -> np.ndarray:
        a, b = components(x, *p)
        error = 1 / (1 + np.exp(np.clip(b - a, -700, 700)))
        return -np.array([n @ (error / p[0] - (1 - error) / (1 - p[0])), n @ ((1 - error) * (x / p[1] - 1))])

    p, h = np.array(START), np.eye(2)
    value, g = cost(p), slope(p)
    h = np.diag([0.1, 10.0])
    for _ in range(rounds * 5):
        step, size = -h @ g, 1.0
        if g @ step >= 0:
            h, step = np.eye(2), -g
        while cost(p + size * step) > value + 1e-4 * size * (g @ step):
            size /= 2
            if size < 1e-12:
                break
        new = p + size * step
        if size < 1e-12 or value - cost(new) < tolerance * 1e-3:
            x_cut = np.arange(1, len(x) + 1, dtype=float)
            a, b = components(x_cut, *p)
            below = np.flatnonzero(a[:-1] < b[:-1])
            return Fit(float(p[0]), float(p[1]), int(below[0]) + 1 if len(below) else len(x))
        s, y = new - p, slope(new) - g
        if s @ y > 1e-12:
            r = 1 / (s @ y)
            left = np.eye(2) - r * np.outer(s, y)
            h = left @ h @ left.T + r * np.outer(s, s)
        p, value, g = new, cost(new), slope(new)
    raise RuntimeError("the coverage model did not converge")


def density(bins: DataFrame, errors: float, coverage: float) -> DataFrame:
    """``count n_kmers density component``: the mixture's density, and whether errors or coverage is likelier there."""
    i = F.col("count").cast("double")
    factorial = F.aggregate(F.sequence(F.lit(1), F.col("count").cast("int")), F.lit(0.0), lambda acc, v: acc + F.log(v.cast("double")))
    a = F.lit(math.log(errors)) - factorial - 1.0
    b = F.lit(math.log1p(-errors)) + i * F.lit(math.log(coverage)) - factorial - F.lit(float(coverage))
    return bins.select("count", "n_kmers", (F.exp(a) + F.exp(b)).alias("density"), F.when(a < b, "Coverage").otherwise("Error").alias("component"))


def table(bins: DataFrame, found: Fit) -> DataFrame:
    """The printed table: counts below the cutoff are errors."""
    shown = density(bins, found.errors, found.coverage)
    return shown.select("count", "n_kmers", "density", F.when(F.col("count") < found.cutoff, "Error").otherwise("Coverage").alias("component"))


def min_count(reads: DataFrame, k: int, rc: bool = True, min_bin: int = MIN_BIN) -> Fit:
    """The fit of the reads' histogram (at most 1000 numbers come to the driver).

    An empty histogram (reads so deep that every count is over 1000, or too few of them) has no slope:
    the fit stays where it starts, and nothing is cut.
    """
    bins = histogram(kmer_counts(reads, k, rc), min_bin).orderBy("count").collect()
    return fit([b["n_kmers"] for b in bins]) if bins else Fit(*START, 1)


def choose_min_count(choice: int | str | None, reads: DataFrame, samples: list[str], k: int, rc: bool = True) -> int:
    """5 unless a number is given; ``auto`` fits the coverage of the first files of the first two read samples, if there are two.

    Without a ``file_no`` all of a sample's reads are its first file.
    """
    if choice is None:
        return 5
    if choice == "auto":
        first = (reads.where(F.col("file_no") == 0) if "file_no" in reads.columns else reads).where(F.col("sample").isin(samples[:2]))
        if len(samples) >= 2 and first.isEmpty():
            raise ValueError("no reads in the first files")
        return min_count(first, k, rc).cutoff if len(samples) >= 2 else 5
    if int(choice) < 1:
        raise ValueError("a minimum count is at least 1")
    return int(choice)
