"""Matrices: wide (tall tables with a column for each matrix column) and long (i, j, v, counted from 1)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vec import Vec

#: Rows of a block of tall_qr, about: a block is in memory at once, and each sends one small R to the driver.
BLOCK_ROWS = 65_536


def conformable(ok: bool) -> None:
    if not ok:
        raise ValueError("matrices are not conformable")


def inner(df: DataFrame, x: str, y: str, out: str = "v") -> DataFrame:
    """1 x k by k x 1."""
    return df.agg(F.coalesce(F.sum(F.col(x) * F.col(y)), F.lit(0.0)).alias(out))


def vec_mat(df: DataFrame, v: str, columns: list[str]) -> DataFrame:
    """v' M for a wide M whose rows carry v: one fold a column, one pass."""
    return df.agg(*[F.sum(F.col(v) * F.col(c)).alias(c) for c in columns])


def mat_vec(columns: list[str], v: list[float]) -> Column:
    """M v for a wide M and a short v: a map."""
    conformable(len(columns) == len(v))
    total: Column = F.lit(0.0)
    for c, x in zip(columns, v, strict=True):
        total = total + F.col(c) * float(x)
    return total


def mat_mat(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product of long matrices; partial sums are made before the shuffle by (i, j)."""
    left = a.select("i", F.col("j").alias("k"), F.col("v").alias("x"))
    right = b.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def elementwise(a: DataFrame, b: DataFrame, fun) -> DataFrame:
    """fun of the elements at equal places of two long matrices."""
    return a.join(b.withColumnRenamed("v", "_w"), ["i", "j"]).select("i", "j", fun(Vec(F.col("v"), "double"), Vec(F.col("_w"), "double")).alias("v"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def element(a: DataFrame, i: int | None = None, j: int | None = None) -> DataFrame:
    """M[i, j], M[i, ] or M[, j]."""
    if i is not None:
        a = a.where(F.col("i") == i)
    return a if j is None else a.where(F.col("j") == j)


def upper_tri(a: DataFrame, diagonal: bool = False) -> DataFrame:
    """Adds whether an element is above the diagonal."""
    return a.withColumn("upper", F.col("i") <= F.col("j") if diagonal else F.col("i") < F.col("j"))


def set_diag(a: DataFrame, value: float) -> DataFrame:
    return a.withColumn("v", F.when(F.col("i") == F.col("j"), F.lit(float(value))).otherwise(F.col("v")))


def to_long(df: DataFrame, row: str, columns: list[str]) -> DataFrame:
    """A wide matrix in long form; row counts from 1."""
    pairs = F.array(*[F.struct(F.lit(k).cast("bigint").alias("j"), F.col(c).cast("double").alias("v")) for k, c in enumerate(columns, 1)])
    return df.select(F.col(row).alias("i"), F.explode(pairs).alias("_e")).select("i", "_e.j", "_e.v")


def from_vector(df: DataFrame, position: str, x: str, rows: int) -> DataFrame:
    """Long matrix from a vector (position from 0), column by column."""
    return df.select((F.col(position) % rows + 1).alias("i"), (F.floor(F.col(position) / rows) + 1).alias("j"), F.col(x).cast("double").alias("v"))


def centred(df: DataFrame, cells: Column, d: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, means, and sums of products of deviations from them, of rows whose cells are an array of d numbers.

    Two passes: the means, then each partition sums its own products and the sums, d rows of d + 1, are added up.
    Rows with an NA in them are left out.
    """
    rows = df.select(F.transform(cells, lambda x: x.cast("double")).alias("x")).where(F.size("x") == d).where(F.forall("x", lambda x: x.isNotNull()))
    first = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.element_at("x", k + 1)).alias(f"m{k}") for k in range(d)]).first()
    n, mean = first["n"], np.array([first[f"m{k}"] or 0.0 for k in range(d)])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros((d, d)), False
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, d) - mean
            total += x.T @ x
            some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "g"])

    out = np.zeros((d, d))
    for r in rows.mapInArrow(part, "i int, g array<double>").groupBy("i").agg(*[F.sum(F.element_at("g", k + 1)).alias(f"g{k}") for k in range(d)]).collect():  # d rows
        out[r["i"]] = [r[f"g{k}"] for k in range(d)]
    return n, mean, out


def covariance(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Covariance matrix of a wide matrix, in two passes however many columns it has; NaN for fewer than two rows."""
    n, _, g = centred(df, F.array(*[F.col(c).cast("double") for c in columns]), len(columns))
    return g / (n - 1) if n > 1 else np.full_like(g, np.nan)


def covariance_long(df: DataFrame, columns: list[str]) -> DataFrame:
    """Covariance matrix in long form, as one aggregate and an unpivot."""
    d = range(1, len(columns) + 1)
    one = df.agg(*[F.covar_samp(F.col(columns[i - 1]).cast("double"), F.col(columns[j - 1]).cast("double")).alias(f"c{i}_{j}") for i in d for j in d if i <= j])
    cells = F.array(*[F.struct(F.lit(i).cast("bigint").alias("i"), F.lit(j).cast("bigint").alias("j"), F.col(f"c{min(i, j)}_{max(i, j)}").alias("v")) for i in d for j in d])
    return one.select(F.explode(cells).alias("_c")).select("_c.*")


def eigen_symmetric(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, ascending, and vectors of a small symmetric matrix."""
    conformable(m.ndim == 2 and m.shape[0] == m.shape[1])
    return np.linalg.eigh(m)


def qr(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Householder decomposition of a small square matrix; the diagonal of R has the signs opposite to the pivots."""
    r = np.array(m, float)
    n = len(r)
    q = np.eye(n)
    for i in range(n - 1):
        v = np.where(np.arange(n) < i, 0.0, r[:, i])
        norm = -np.copysign(np.linalg.norm(v), r[i, i])
        v[i] -= norm
        b = v @ v
        if b == 0:
            continue
        r -= np.outer(2 / b * v, v @ r)
        q -= np.outer(q @ v, 2 / b * v)
    return q, r


def tall_qr(df: DataFrame, row: str, cells: str, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, np.ndarray]:
    """Householder decomposition of all rows of a tall matrix (a row name and an array a row): long thin Q, and R.

    Rows are dealt by name to blocks.  Each is decomposed by reflections (LAPACK's), the R of all blocks are stacked and
    decomposed on the driver, and a block's rows of Q are its own Q times its share of the stack's.  Columns may depend on
    each other and rows may be fewer than columns.  R's diagonal is not negative.  Rows of unequal lengths, and rows or
    elements that are NA, are an error.
    """
    rows = df.select(F.col(row).cast("bigint").alias("i"), F.col(cells).cast("array<double>").alias("cells"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("cells")).alias("d")).first()
    spark, d = df.sparkSession, max(size["d"] or 0, 0)
    if not d:
        return spark.createDataFrame([], "i bigint, j bigint, v double"), np.zeros((0, 0))
    blocks = -(-size["n"] // block_rows)
    # Both passes see a block's rows in one order.
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("i"), F.lit(blocks)).cast("bigint")).repartition(blocks, "block").sortWithinPartitions("block", "i", "cells")

    def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Number, row names and matrix of each block, from rows (block, i, cells) that come sorted by block."""
        block, names, cells = None, [], []
        for batch in batches:
            lists = batch.column("cells")
            if lists.null_count or lists.flatten().null_count or (np.diff(lists.offsets.to_numpy()) != d).any():
                raise ValueError("matrices are not conformable")
            number, name, x = batch.column("block").to_numpy(), batch.column("i").to_numpy(), lists.flatten().to_numpy().reshape(-1, d)
            bounds = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
            for a, z in zip(bounds[:-1], bounds[1:], strict=True):
                if a == z:
                    continue
                if number[a] != block:
                    if names:
                        yield block, np.concatenate(names), np.concatenate(cells)
                    block, names, cells = int(number[a]), [], []
                names.append(name[a:z])
                cells.append(x[a:z])
        if names:
            yield block, np.concatenate(names), np.concatenate(cells)

    def reduce_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, a in blocks_of(batches):
            r = np.linalg.qr(a, mode="r")
            yield pa.RecordBatch.from_pydict({"block": [block], "r": [r.astype("f8").tobytes()]})

    parts = {r["block"]: np.frombuffer(r["r"]).reshape(-1, d) for r in dealt.mapInArrow(reduce_, "block long, r binary").collect()}
    q, r = np.linalg.qr(np.concatenate([parts[b] for b in sorted(parts)]))
    sign = np.where(np.diag(r) < 0, -1.0, 1.0)
    q, r = q * sign, r * sign[:, None]
    ends = np.cumsum([len(parts[b]) for b in sorted(parts)])
    shares = spark.sparkContext.broadcast({b: q[end - len(parts[b]) : end] for b, end in zip(sorted(parts), ends, strict=True)})
    k = q.shape[1]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, names, a in blocks_of(batches):
            own = np.linalg.qr(a)[0] @ shares.value[block]
            for begin in range(0, len(own), 1024):
                some, name = own[begin : begin + 1024], names[begin : begin + 1024]
                yield pa.RecordBatch.from_pydict({"i": np.repeat(name, k), "j": np.tile(np.arange(1, k + 1), len(name)), "v": some.reshape(-1)})

    return dealt.mapInArrow(spread, "i long, j long, v double"), r
