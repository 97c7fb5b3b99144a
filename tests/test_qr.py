import os

import numpy as np
import pytest

from vecframe.operators import matrix as m
from vecframe.plans.catalog import queries

DATA = os.environ.get("VECFRAME_TEST_DATA", "/root/testdata/sf0.001")


def table(spark, a):
    return spark.createDataFrame([(i + 1, [float(x) for x in row]) for i, row in enumerate(a)], "i bigint, cells array<double>").repartition(3)


def matrix(rows, name, shape):
    out = np.full(shape, np.nan)
    for r in rows:
        if r[name] is not None:
            out[r.i - 1, r.j - 1] = r[name]
    assert not np.isnan(out).any()
    return out


@pytest.mark.parametrize("shape, block", [((200, 5), 30), ((200, 5), 1000), ((7, 3), 2), ((3, 8), 2), ((1, 1), 1)])
def test_tall_qr(spark, shape, block):
    a = np.random.default_rng(1).normal(size=shape)
    q, r = m.tall_qr(table(spark, a), "i", "cells", block)
    k = min(shape)
    q = matrix(q.collect(), "v", (shape[0], k))
    assert r.shape == (k, shape[1]) and np.allclose(q @ r, a) and np.allclose(q.T @ q, np.eye(k))
    assert np.allclose(np.tril(r, -1), 0) and (np.diag(r) >= 0).all()
    assert np.allclose(np.abs(r), np.abs(np.linalg.qr(a)[1]))


def test_dependent_columns(spark):
    a = np.random.default_rng(2).normal(size=(60, 4))
    a[:, 2] = a[:, 0] - a[:, 1]
    a[:, 3] = 0
    q, r = m.tall_qr(table(spark, a), "i", "cells", 16)
    q = matrix(q.collect(), "v", (60, 4))
    assert np.allclose(q @ r, a) and np.allclose(q.T @ q, np.eye(4))


def test_odd_tables(spark):
    q, r = m.tall_qr(spark.createDataFrame([], "i bigint, cells array<double>"), "i", "cells")
    assert q.count() == 0 and r.size == 0
    with pytest.raises(Exception, match="conformable"):
        m.tall_qr(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "i bigint, cells array<double>"), "i", "cells")[0].collect()


def test_qr_householder_takes_the_whole_table(spark):
    rows = queries()["qr_householder"](spark, DATA).collect()
    source = {r.vec_id: r.embedding for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()}
    a = np.array([source[i] for i in sorted(source)], float)
    n, d = a.shape
    assert sorted(source) == list(range(n)) and len(rows) == n * d + d * d
    q, r = matrix(rows, "q", (n, d)), matrix(rows, "r", (d, d))
    assert np.allclose(q @ r, a, atol=1e-5) and np.allclose(q.T @ q, np.eye(d), atol=1e-9)
