"""Queries of whole workloads."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import vec as v
from ..functions.vec import Vec
from ..operators import algorithms as al
from ..operators import folds as fo
from ..operators import generators as g
from ..operators import matrix as m
from ..operators.frame import POSITION
from .positional import _LONG as LONG_SQL
from .positional import WIDE, wide
from .registry import frame, query


@query(
    "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, "
    "round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order "
    "FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL"
)
def tpc_q1(spark, d):
    f = frame(spark, d, "lineitem")
    f = f.filter(Vec(F.col("l_shipdate") <= F.expr("timestamp_ntz'1998-09-02'"), "logical"))
    q, price, disc, tax = f["l_quantity"], f["l_extendedprice"], f["l_discount"], f["l_tax"]
    net = price * (1 - disc)
    out = f.split("l_returnflag", "l_linestatus").fold(sum_qty=fo.sum_(q), sum_base_price=fo.sum_(price), sum_disc_price=fo.sum_(net), sum_charge=fo.sum_(net * (1 + tax)), avg_qty=fo.mean(q), avg_price=fo.mean(price), avg_disc=fo.mean(disc), count_order=fo.length())
    digits = {"avg_qty": 4, "avg_price": 4, "avg_disc": 6}
    return out.select("l_returnflag", "l_linestatus", *[F.round(c, digits.get(c, 2)).alias(c) for c in out.columns[2:-1]], "count_order")


@query(
    "WITH t AS (SELECT *, (CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END * 2 + CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END)::BIGINT AS code FROM lineitem) "
    "SELECT code, coalesce(round(sum(l_quantity), 2), 0) AS qty, coalesce(round(sum(l_extendedprice), 2), 0) AS price, (SELECT round(sum(l_discount), 4) FROM lineitem) AS disc, (SELECT round(sum(l_tax), 4) FROM lineitem) AS tax "
    "FROM (SELECT unnest(range(6)) AS code) LEFT JOIN t USING (code) GROUP BY code"
)
def tpc_q1_subset(spark, d):
    f = frame(spark, d, "lineitem")
    a = v.ifelse(f["l_returnflag"] == "A", 0, v.ifelse(f["l_returnflag"] == "N", 1, 2))
    f = f.with_(code=a * 2 + v.ifelse(f["l_linestatus"] == "F", 0, 1))
    # One pass: the plain sums come from the groups' sums.
    out = f.split("code").dense(6, qty=fo.sum_(f["l_quantity"]), price=fo.sum_(f["l_extendedprice"]), disc=fo.sum_(f["l_discount"]), tax=fo.sum_(f["l_tax"]))
    whole = out.agg(F.round(F.sum("disc"), 4).alias("disc"), F.round(F.sum("tax"), 4).alias("tax"))
    return out.select("code", F.round("qty", 2).alias("qty"), F.round("price", 2).alias("price")).join(F.broadcast(whole))


@query("WITH u AS (SELECT l_extendedprice AS x FROM lineitem WHERE l_linenumber <> 3), s AS (SELECT avg(x) AS m, stddev_samp(x) AS d FROM u) SELECT count(*) FILTER (abs((l_extendedprice - m) / d) > 1) AS n FROM lineitem, s")
def cleaning(spark, d):
    f = frame(spark, d, "lineitem")
    x, use = f["l_extendedprice"], f["l_linenumber"] != 3
    used = f.filter(use)
    stats = used.fold(m=fo.mean(x), s=fo.sd(x))
    both = f.df.join(F.broadcast(stats))
    z = (x - Vec(F.col("m"), "double")) / Vec(F.col("s"), "double")
    return both.agg(fo.length(where=abs(z) > 1).alias("n"))


@query(
    "SELECT round(min(least((-b - s) / 2, (-b + s) / 2)), 6) AS t FROM (SELECT *, sqrt(disc) AS s FROM (SELECT 2 * rx AS b, 4 * rx * rx - 4 * (rx * rx + ry * ry + rz * rz - 1) AS disc FROM "
    "(SELECT -l_quantity AS rx, -(l_discount * 10) AS ry, -(l_tax * 10) AS rz FROM lineitem)) WHERE disc > 0)"
)
def raysphere(spark, d):
    f = frame(spark, d, "lineitem")
    rx, ry, rz = 0.0 - f["l_quantity"], 0.0 - f["l_discount"] * 10, 0.0 - f["l_tax"] * 10
    b = 2 * (1.0 * rx + 0.0 * ry + 0.0 * rz)
    disc = b * b - 4 * (rx * rx + ry * ry + rz * rz - 1)
    root = v.sqrt(disc)
    t = v.pmin((-b - root) / 2, (-b + root) / 2)
    return f.fold(t=fo.min_(t, where=disc > 0)).select(F.round("t", 6).alias("t"))


_CND = "(CASE WHEN {0} > 0 THEN 1 - {1} ELSE {1} END)"
_W = "((((((1.330274429 * k{0}) - 1.821255978) * k{0} + 1.781477937) * k{0} - 0.356563782) * k{0} + 0.31938153) * k{0} * 0.39894228040 * exp(d{0} * d{0} * -0.5))"


@query(
    "WITH a AS (SELECT l_extendedprice / l_quantity AS s, p_retailprice AS x, 2.0 AS t, 0.02 AS r, 0.3 AS v FROM lineitem JOIN part ON l_partkey = p_partkey), "
    "b AS (SELECT *, v * sqrt(t) AS delta, (ln(s / x) / ln(10) + (r + v * v * 0.5) * t) / (v * sqrt(t)) AS d1 FROM a), c AS (SELECT *, d1 - delta AS d2 FROM b), "
    "k AS (SELECT *, 1 / (1 + 0.2316419 * abs(d1)) AS k1, 1 / (1 + 0.2316419 * abs(d2)) AS k2 FROM c) SELECT round(sum(s * "
    + _CND.format("d1", _W.format(1))
    + " - x * exp(-r * t) * "
    + _CND.format("d2", _W.format(2))
    + ") / count(*), 6) AS price FROM k"
)
def black_scholes(spark, d):
    lines, part = frame(spark, d, "lineitem").df, frame(spark, d, "part").df
    f = lines.select("l_partkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("s")).join(part.select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    price = al.black_scholes(Vec(F.col("s"), "double"), Vec(F.col("p_retailprice"), "double"), v.lift(2.0), v.lift(0.02), v.lift(0.3))
    return f.agg(F.round(F.sum(price.col) / F.count(F.lit(1)), 6).alias("price"))


def _horner(coefficients, x):
    out = f"{coefficients[0]!r}"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


_TAIL = lambda q: f"{_horner(al.INVERSE_TAIL_TOP, q)} / {_horner((*al.INVERSE_TAIL_BOTTOM, 1.0), q)}"


@query(
    "SELECT event_id, round(CASE WHEN p < 0.02425 THEN " + _TAIL("sqrt(-2 * ln(p))") + " WHEN p <= 0.97575 THEN " + _horner(al.INVERSE_CENTRE_TOP, "((p - 0.5) * (p - 0.5))") + " * (p - 0.5) / " + _horner((*al.INVERSE_CENTRE_BOTTOM, 1.0), "((p - 0.5) * (p - 0.5))")
    + " ELSE -(" + _TAIL("sqrt(-2 * ln(1 - p))") + ") END, 6) AS z FROM (SELECT event_id, (event_id + 0.5::DOUBLE) / 1000000 + (event_id % 100)::DOUBLE / 101 AS p FROM events)"
)
def sample_inv_cdf(spark, d):
    f = frame(spark, d, "events")
    p = (f["event_id"] + 0.5) / 1000000 + (f["event_id"] % 100) / 101
    return f.select("event_id", z=v.round_(al.inverse_normal(p), 6))


@query(
    "WITH RECURSIVE c AS (SELECT i AS cell, -2 + (i % 64) * (3.0::DOUBLE / 64) AS re, -1 + (i // 64) * (2.0::DOUBLE / 48) AS im FROM range(64 * 48) t(i)), "
    "z AS (SELECT cell, re, im, re AS a, im AS b, 0 AS n, 0 AS k FROM c UNION ALL SELECT cell, re, im, CASE WHEN a * a + b * b <= 4 THEN re + (a * a - b * b) ELSE a END, CASE WHEN a * a + b * b <= 4 THEN im + 2.0 * a * b ELSE b END, "
    "n + (a * a + b * b <= 4)::INT, k + 1 FROM z WHERE k < 50) SELECT cell::BIGINT AS cell, n::BIGINT AS n FROM z WHERE k = 50"
)
def mandelbrot(spark, d):
    width, height = 64, 48
    f = g.seq(spark, 0, 1, width * height)
    i, j = F.col("x") % width, F.floor(F.col("x") / width)
    return f.df.select(F.col("x").alias("cell"), al.mandelbrot(-2 + i * (3.0 / width), -1 + j * (2.0 / height), 50).alias("n"))


MEANS = [[10.0, 20000.0], [25.0, 40000.0], [40.0, 60000.0]]


@query(
    "SELECT code, count(*) AS n, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_extendedprice), 4) AS l_extendedprice FROM (SELECT *, (CASE WHEN a <= b AND a <= c THEN 0 WHEN b <= c THEN 1 ELSE 2 END)::BIGINT AS code FROM (SELECT *, "
    + ", ".join(f"(l_quantity - {q}) * (l_quantity - {q}) + (l_extendedprice - {p}) * (l_extendedprice - {p}) AS {n}" for n, (q, p) in zip("abc", MEANS, strict=True))
    + " FROM lineitem)) GROUP BY code"
)
def kmeans_step(spark, d):
    out = al.kmeans_step(frame(spark, d, "lineitem").df, ["l_quantity", "l_extendedprice"], MEANS)
    return out.select("code", "n", F.round("l_quantity", 6).alias("l_quantity"), F.round("l_extendedprice", 4).alias("l_extendedprice"))


@query(
    "WITH RECURSIVE r AS (SELECT 0 AS k, " + ", ".join(f"{float(x)!r}::DOUBLE AS {n}{j}" for j, m_ in enumerate(MEANS) for n, x in zip("qp", m_, strict=True)) + " UNION ALL SELECT k + 1, "
    + ", ".join(f"coalesce(avg(x) FILTER (c = {j}), q{j}), coalesce(avg(y) FILTER (c = {j}), p{j})" for j in range(3))
    + " FROM (SELECT r.*, l_quantity AS x, l_extendedprice AS y, CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS c FROM r, lineitem, LATERAL (SELECT "
    + ", ".join(f"(l_quantity - q{j}) * (l_quantity - q{j}) + (l_extendedprice - p{j}) * (l_extendedprice - p{j}) AS d{j}" for j in range(3))
    + ")) r WHERE k < 100 GROUP BY k, " + ", ".join(f"q{j}, p{j}" for j in range(3)) + ") "
    + " UNION ALL ".join(f"SELECT {j}::BIGINT AS code, round(q{j}, 4) AS l_quantity, round(p{j}, 2) AS l_extendedprice FROM r WHERE k = 100" for j in range(3))
)
def kmeans_100(spark, d):
    means = al.kmeans(frame(spark, d, "lineitem").df, ["l_quantity", "l_extendedprice"], MEANS, 100)
    out = spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(means)], "code bigint, l_quantity double, l_extendedprice double")
    return out.select("code", F.round("l_quantity", 4).alias("l_quantity"), F.round("l_extendedprice", 2).alias("l_extendedprice"))


FEATURES = ["one", "quantity", "discount", "tax"]
_FEATURES_SQL = "SELECT 1.0 AS one, l_quantity / 50 AS quantity, l_discount * 10 AS discount, l_tax * 10 AS tax, (l_returnflag = 'R')::INT AS y FROM lineitem"


def _labelled(spark, d):
    return frame(spark, d, "lineitem").df.select(F.lit(1.0).alias("one"), (F.col("l_quantity") / 50).alias("quantity"), (F.col("l_discount") * 10).alias("discount"), (F.col("l_tax") * 10).alias("tax"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"))


@query("SELECT round(avg(one * e), 9) AS one, round(avg(quantity * e), 9) AS quantity, round(avg(discount * e), 9) AS discount, round(avg(tax * e), 9) AS tax FROM (SELECT *, 1 / (1 + exp(-(0.1 * one - 0.2 * quantity + 0.3 * discount + 0.05 * tax))) - y AS e FROM (" + _FEATURES_SQL + "))")
def logreg_gradient(spark, d):
    out = al.logistic_gradient(_labelled(spark, d), FEATURES, "y", [0.1, -0.2, 0.3, 0.05])
    return out.select(*[F.round(c, 9).alias(c) for c in FEATURES])


@query(
    "WITH RECURSIVE t AS (" + _FEATURES_SQL + "), r AS (SELECT 0 AS k, 0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2, 0.0::DOUBLE AS w3 UNION ALL SELECT k + 1, "
    + ", ".join(f"w{j} - 0.07 * avg({c} * e)" for j, c in enumerate(FEATURES))
    + " FROM (SELECT r.*, t.*, 1 / (1 + exp(-(" + " + ".join(f"w{j} * {c}" for j, c in enumerate(FEATURES)) + "))) - y AS e FROM r, t) WHERE k < 100 GROUP BY k, w0, w1, w2, w3) SELECT "
    + ", ".join(f"round(w{j}, 8) AS {c}" for j, c in enumerate(FEATURES)) + " FROM r WHERE k = 100"
)
def logreg_100(spark, d):
    w = al.logistic_regression(_labelled(spark, d), FEATURES, "y", [0.0] * 4, 100)
    out = spark.createDataFrame([tuple(w)], ", ".join(f"{c} double" for c in FEATURES))
    return out.select(*[F.round(c, 8).alias(c) for c in FEATURES])


@query(
    "WITH t AS (SELECT l_quantity AS a, l_extendedprice / 1000 AS b, l_discount * 100 AS c, l_tax * 100 AS d FROM lineitem) SELECT i::BIGINT AS i, j::BIGINT AS j, round(v, 5) AS v FROM ("
    + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, covar_samp({x}, {y}) AS v FROM t" for i, x in enumerate("abcd", 1) for j, y in enumerate("abcd", 1))
    + ")"
)
def pca_cov(spark, d):
    df = frame(spark, d, "lineitem").df.select(F.col("l_quantity").alias("a"), (F.col("l_extendedprice") / 1000).alias("b"), (F.col("l_discount") * 100).alias("c"), (F.col("l_tax") * 100).alias("d"))
    return m.covariance_long(df, list("abcd")).select("i", "j", F.round("v", 5).alias("v"))


@query()
def pca_eigen(spark, d):
    values, vectors = al.pca(wide(spark, d), WIDE)
    return spark.createDataFrame([(k, float(x), [float(y) for y in vectors[:, k]]) for k, x in enumerate(values)], "k bigint, value double, vector array<double>")


@query(f"SELECT round(sum(v), 6) AS trace, true AS ascending FROM (SELECT var_samp(v) AS v FROM ({LONG_SQL}) GROUP BY j)")
def pca_trace(spark, d):
    """The eigenvalues of all 64 dimensions add up to the variances."""
    values, _ = al.pca(wide(spark, d), WIDE)
    return spark.createDataFrame([(round(float(values.sum()), 6), bool((np.diff(values) >= 0).all()))], "trace double, ascending boolean")


def _cells(spark, d):
    cells = F.transform("embedding", lambda x: F.round(x.cast("double"), 6))
    return frame(spark, d, "embeddings").df.select((F.col("vec_id") + 1).alias("i"), cells.alias("cells"))


@query()
def qr(spark, d):
    """R of all rows and dimensions of embeddings."""
    _, r = m.tall_qr(_cells(spark, d), "i", "cells")
    return spark.createDataFrame([(i + 1, j + 1, float(x)) for (i, j), x in np.ndenumerate(r)], "i bigint, j bigint, v double")


@query(f"WITH a AS ({LONG_SQL}) SELECT x.j AS i, y.j AS j, round(sum(x.v * y.v), 4) AS v FROM a x JOIN a y ON x.i = y.i GROUP BY ALL")
def qr_gram(spark, d):
    """R'R, which is the matrix's own product with itself."""
    _, r = m.tall_qr(_cells(spark, d), "i", "cells")
    return spark.createDataFrame([(i + 1, j + 1, round(float(x), 4)) for (i, j), x in np.ndenumerate(r.T @ r)], "i bigint, j bigint, v double")


@query()
def qr_householder(spark, d):
    """All rows and dimensions of embeddings: q has the elements of Q (row i = vec_id + 1), r those of R; the other one is null."""
    q, r = m.tall_qr(_cells(spark, d), "i", "cells")
    factor = spark.createDataFrame([(i + 1, j + 1, None, float(x)) for (i, j), x in np.ndenumerate(r)], "i bigint, j bigint, q double, r double")
    return q.select("i", "j", F.col("v").alias("q"), F.lit(None).cast("double").alias("r")).unionByName(factor)


@query(
    "WITH RECURSIVE o AS (SELECT i AS option, 100.0::DOUBLE + i AS s, exp(0.3 * sqrt(2.0::DOUBLE / 64)) AS u, exp(0.02 * 2.0::DOUBLE / 64) AS disc FROM range(5) t(i)), p AS (SELECT *, (disc - 1 / u) / (u - 1 / u) AS up FROM o), "
    "b AS (SELECT option, up, disc, 63 AS k, list_transform(range(64), lambda j: greatest(0.0::DOUBLE, 98.0 - s * pow(u, (2 * j - 64)::DOUBLE))) AS v FROM p UNION ALL "
    "SELECT option, up, disc, k - 1, list_transform(range(1, k + 1), lambda j: ((1 - up) * v[j] + up * v[j + 1]) / disc) FROM b WHERE k > 0) SELECT option::BIGINT AS option, round(v[1], 8) AS price FROM b WHERE k = 0"
)
def binomial_put(spark, d):
    f = g.seq(spark, 0, 1, 5)
    put = al.binomial_put(F.lit(100.0) + F.col("x"), F.lit(98.0), F.lit(2.0), F.lit(0.02), F.lit(0.3), 64)
    return f.df.select(F.col(POSITION).alias("option"), F.round(put, 8).alias("price"))
