"""Whole programs: k-means, logistic regression, principal components, Black-Scholes, binomial options, Mandelbrot, sampling."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vec as v
from ..functions.vec import Vec
from .matrix import covariance, eigen_symmetric

#: Coefficients of the normal distribution's approximation (cumulative, from the innermost).
CND_COEFFICIENTS = (1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.31938153)
CND_SCALE, INVERSE_SQRT_2PI = 0.2316419, 0.39894228040
#: Coefficients of the inverse normal distribution (central numerator and denominator, tail numerator and denominator).
INVERSE_CENTRE_TOP = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
INVERSE_CENTRE_BOTTOM = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
INVERSE_TAIL_TOP = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
INVERSE_TAIL_BOTTOM = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
TAIL = 0.02425


def _polynomial(coefficients, x: Vec) -> Vec:
    out = v.lift(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def cnd(x: Vec) -> Vec:
    """Cumulative normal distribution."""
    k = 1.0 / (1.0 + CND_SCALE * abs(x))
    w = _polynomial(CND_COEFFICIENTS, k) * k * INVERSE_SQRT_2PI * v.exp(x * x * -0.5)
    return v.ifelse(x > 0.0, 1.0 - w, w)


def black_scholes(s: Vec, x: Vec, t: Vec, r: Vec, sigma: Vec) -> Vec:
    """Call price, with the decimal logarithm of s/x."""
    delta = sigma * v.sqrt(t)
    d1 = (v.log(s / x) / math.log(10) + (r + sigma * sigma * 0.5) * t) / delta
    return s * cnd(d1) - x * v.exp(-r * t) * cnd(d1 - delta)


def inverse_normal(p: Vec) -> Vec:
    """Quantile of the standard normal distribution."""
    low, high = v.sqrt(-2.0 * v.log(p)), v.sqrt(-2.0 * v.log(1.0 - p))
    tail = lambda q: _polynomial(INVERSE_TAIL_TOP, q) / _polynomial((*INVERSE_TAIL_BOTTOM, 1.0), q)
    q = p - 0.5
    r = q * q
    centre = _polynomial(INVERSE_CENTRE_TOP, r) * q / _polynomial((*INVERSE_CENTRE_BOTTOM, 1.0), r)
    return v.ifelse(p < TAIL, tail(low), v.ifelse(p <= 1 - TAIL, centre, -tail(high)))


def mandelbrot(re: Column, im: Column, steps: int) -> Column:
    """Iterations for which the point stays within radius 2.  One higher-order fold: the plan doesn't grow with steps."""
    start = F.struct(re.alias("a"), im.alias("b"), F.lit(0).cast("bigint").alias("n"))

    def step(z: Column, _: Column) -> Column:
        a2, b2 = z["a"] * z["a"], z["b"] * z["b"]
        inside = a2 + b2 <= 4
        # outside, the point is held: it has left for good, and its powers would overflow
        return F.struct(F.when(inside, re + (a2 - b2)).otherwise(z["a"]).alias("a"), F.when(inside, im + 2.0 * z["a"] * z["b"]).otherwise(z["b"]).alias("b"), (z["n"] + F.when(inside, 1).otherwise(0)).alias("n"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda z: z["n"])


def nearest(columns: list[str], means: list[list[float]]) -> Column:
    """Number (from 0) of the nearest mean; the first of equals."""
    distances = []
    for m in means:
        d: Column = F.lit(0.0)
        for c, x in zip(columns, m, strict=True):
            d = d + (F.col(c) - float(x)) * (F.col(c) - float(x))
        distances.append(d)
    return (F.array_position(F.array(*distances), F.least(*distances)) - 1).cast("bigint")


def kmeans_step(df: DataFrame, columns: list[str], means: list[list[float]]) -> DataFrame:
    """One assignment and update: code, size and mean of each cluster that has rows."""
    return df.withColumn("code", nearest(columns, means)).groupBy("code").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in columns])


def _blocks(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without NA as blocks (cells: doubles, row by row), cached: many rounds read them without taking rows apart again."""
    d = len(columns)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(d)]).astype("f8") if batch.num_rows else np.zeros((0, d))
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary())], names=["cells"])

    return df.select(*columns).where(" and ".join(f"`{c}` is not null" for c in columns)).mapInArrow(pack, "cells binary").cache()


def _block_sums(blocks: DataFrame, d: int, sums: Callable[[np.ndarray], np.ndarray]) -> np.ndarray | None:
    """sums(matrix of a block's rows) added up, or None without rows: each partition adds its own, and of each one short row
    comes to the driver.  The plan is the same in every round, so that nothing is compiled anew."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for cells in batch.column("cells").to_pylist():
                if cells:
                    found = sums(np.frombuffer(cells).reshape(-1, d))
                    total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.reshape(-1)], pa.list_(pa.float64()))], names=["s"])

    rows = blocks.mapInArrow(part, "s array<double>").collect()
    return np.sum([r["s"] for r in rows], axis=0) if rows else None


def kmeans(df: DataFrame, columns: list[str], means: list[list[float]], rounds: int) -> list[list[float]]:
    """So many rounds over a cached table.  Empty clusters keep their mean; a row with an NA is in none.

    Ends early when nothing moves, as all later rounds would change nothing either.
    """
    blocks, k, d = _blocks(df, columns), len(means), len(columns)
    try:
        for _ in range(rounds):
            centres = np.array(means, float)

            def sums(x: np.ndarray, centres: np.ndarray = centres) -> np.ndarray:
                code = ((x[:, None, :] - centres) ** 2).sum(2).argmin(1)
                return np.column_stack([np.bincount(code, minlength=k), *[np.bincount(code, x[:, j], k) for j in range(d)]])

            found = _block_sums(blocks, d, sums)
            if found is None:
                return means
            found = found.reshape(k, d + 1)
            new = [(found[i, 1:] / found[i, 0]).tolist() if found[i, 0] else list(means[i]) for i in range(k)]
            if new == means:
                break
            means = new
        return means
    finally:
        blocks.unpersist()


def logistic_gradient(df: DataFrame, columns: list[str], label: str, w: list[float]) -> DataFrame:
    """Mean gradient of the likelihood at w: one pass, one fold a feature."""
    z: Column = F.lit(0.0)
    for c, x in zip(columns, w, strict=True):
        z = z + F.col(c) * float(x)
    diff = 1 / (1 + F.exp(-z)) - F.col(label)
    return df.agg(*[F.avg(F.col(c) * diff).alias(c) for c in columns])


def logistic_regression(df: DataFrame, columns: list[str], label: str, w: list[float], rounds: int, step: float = 0.07) -> list[float]:
    """Gradient descent over a cached table.  Rows with an NA are left out."""
    blocks = _blocks(df, [*columns, label])
    try:
        for _ in range(rounds):

            def sums(x: np.ndarray, w: np.ndarray = np.array(w, float)) -> np.ndarray:  # noqa: B008  this round's weights
                diff = 1 / (1 + np.exp(-(x[:, :-1] @ w))) - x[:, -1]
                return np.append(x[:, :-1].T @ diff, len(x))

            found = _block_sums(blocks, len(columns) + 1, sums)
            if found is None:
                return w
            w = [a - step * b for a, b in zip(w, (found[:-1] / found[-1]).tolist(), strict=True)]
        return w
    finally:
        blocks.unpersist()


def pca(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, ascending, and vectors of the covariance matrix."""
    return eigen_symmetric(covariance(df, columns))


def binomial_put(s: Column, x: Column, t: Column, r: Column, sigma: Column, steps: int) -> Column:
    """Put price on a binomial tree of so many leaves, folded back level by level within the row."""
    dt = t / steps
    u = F.exp(sigma * F.sqrt(dt))
    down, disc = 1.0 / u, F.exp(r * dt)
    up = (disc - down) / (u - down)
    leaves = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda j: F.greatest(F.lit(0.0), x - s * F.pow(u, (2 * j - steps).cast("double"))))

    def back(values: Column, _: Column) -> Column:
        n = F.size(values)
        return F.zip_with(F.slice(values, F.lit(1), n - 1), F.slice(values, F.lit(2), n - 1), lambda a, b: ((1 - up) * a + up * b) / disc)

    return F.element_at(F.aggregate(F.sequence(F.lit(1), F.lit(steps - 1)), leaves, back), 1)
