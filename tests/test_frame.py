"""Folds, positions, lookups, generators, sources, streams and algorithms on small frames."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vecframe.functions.vec import Vec
from vecframe.operators import algorithms as al
from vecframe.operators import apply as ap
from vecframe.operators import folds as fo
from vecframe.operators import generators as g
from vecframe.operators import lookup as lo
from vecframe.operators import matrix as m
from vecframe.operators.frame import POSITION, Frame
from vecframe.sources import tables
from vecframe.streaming import folds as streaming

INF = float("inf")


def frame(spark, xs, kind="double", order="i"):
    return Frame(spark.createDataFrame([(i, x) for i, x in enumerate(xs)], f"i long, x {kind}").repartition(3), order)


def test_folds(spark):
    f = frame(spark, [1.0, None, 3.0])
    r = f.fold(s=fo.sum_(f["x"]), t=fo.sum_(f["x"], na_rm=True), n=fo.length(), m=fo.mean(f["x"], na_rm=True), v=fo.var(f["x"], na_rm=True), c=fo.cm2(f["x"], f["x"], na_rm=True), sd=fo.sd(f["x"])).first()
    assert (r.s, r.t, r.n, r.m, r.v, r.c, r.sd) == (None, 4.0, 3, 2.0, 2.0, 2.0, None)
    b = frame(spark, [True, None, False], "boolean")
    r = b.fold(a=fo.any_(b["x"]), e=fo.all_(b["x"]), s=fo.sum_(b["x"], na_rm=True)).first()
    assert (r.a, r.e, r.s) == (True, False, 1)
    half = frame(spark, [None, True], "boolean")
    assert half.fold(e=fo.all_(half["x"]), r=fo.all_(half["x"], na_rm=True)).first()[:] == (None, True)


def test_empty_folds(spark):
    f = frame(spark, [])
    x = f["x"]
    r = f.fold(s=fo.sum_(x), p=fo.prod(x), lo=fo.min_(x), hi=fo.max_(x), m=fo.mean(x), n=fo.length(), lt=fo.min_(Vec(F.lit("a"), "character"))).first()
    assert tuple(r) == (0.0, 1.0, INF, -INF, None, 0, "ÿ")
    assert f.scan("sum", "x", "s").df.count() == 0 and f.index().df.count() == 0


def test_dense_groups(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 2.0), (1, 5.0), (3, None), (7, 9.0), (None, 1.0)], "g long, x double")
    f = Frame(df)
    got = {r.g: (r.s, r.n, r.m) for r in f.split("g").dense(5, s=fo.sum_(f["x"]), n=fo.length(), m=fo.mean(f["x"])).collect()}
    assert got == {0: (3.0, 2, 1.5), 1: (5.0, 1, 5.0), 2: (0.0, 0, None), 3: (None, 1, None), 4: (0.0, 0, None)}
    with pytest.raises(Exception, match="out of range"):
        f.split("g").dense(5, strict=True, n=fo.length()).collect()


@pytest.mark.parametrize("parts", [1, 4])
def test_scans_and_positions(spark, parts):
    r = random.Random(1)
    xs = [None if i == 150 else r.randrange(-5, 6) for i in range(200)]
    keys = r.sample(range(10_000), 200)
    rows = sorted(zip(keys, xs, strict=True))
    f = Frame(spark.createDataFrame(list(zip(keys, xs, strict=True)), "k long, x long").repartition(parts), "k")
    got = {row.k: row for row in f.index().scan("sum", "x", "s").scan("min", "x", "lo").df.collect()}
    total, low, dead = 0, None, False
    for at, (k, x) in enumerate(rows):
        dead |= x is None
        if not dead:
            total, low = total + x, x if low is None else min(low, x)
        assert (got[k][POSITION], got[k].s, got[k].lo) == ((at, None, None) if dead else (at, total, low))


def test_subsets(spark):
    f = frame(spark, [10.0, 20.0, 30.0, 40.0])
    idx = spark.createDataFrame([(1,), (3,), (3,), (0,), (None,), (99,)], "k long")
    assert sorted((repr(r.k), repr(r.x)) for r in f.gather(idx, "k", ["x"]).collect()) == sorted([("1", "10.0"), ("3", "30.0"), ("3", "30.0"), ("None", "None"), ("99", "None")])
    xs = lambda fr: [r.x for r in fr.df.orderBy("i").collect()]
    assert xs(f.exclude([1, 3, 99])) == [20.0, 40.0]
    assert xs(f.slice(2, 3)) == [20.0, 30.0]
    assert xs(f.assign("x", f["x"] > 15, [1, 2])) == [10.0, 1.0, 2.0, 1.0]
    assert xs(f.assign_at("x", spark.createDataFrame([(2, "7"), (9, "8")], "at long, v string"), "at", "v")) == [10.0, 7.0, 30.0, 40.0]
    na = Vec(F.when(F.col("i") != 1, F.col("x") > 15), "logical")
    assert xs(f.filter(na)) == [30.0, 40.0] and xs(f.filter(na, keep_na=True)) == [None, 30.0, 40.0]


@pytest.mark.parametrize("block", [2, 5, 100])
def test_stencil(spark, block):
    xs = [float(x * x % 17) for x in range(40)]
    taps = [0.1, 0.15, 0.2, 0.3, 0.2]
    got = {r.i: r.y for r in frame(spark, xs).stencil("x", taps, "y", block=block if block >= 5 else 5).collect()}
    want = {i + 1: sum(t * xs[i + k] for k, t in enumerate(taps, 1)) for i in range(len(xs) - len(taps))}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i]) for i in want)


def test_lookups(spark):
    t = frame(spark, ["b", "a", "b", None], "string")
    x = spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "k string")
    assert {r.k: r.match for r in lo.match(x, "k", t, "x", nomatch=0).collect()} == {"a": 2, "b": 1, "z": 0, None: 0}
    assert lo.any_duplicated(t, "x").first().first == 3
    assert lo.any_duplicated(frame(spark, [1.0, 2.0]), "x").first().first == 0
    assert lo.paste_collapse(t, "x", [], "+", "p").first().p == "b+a+b+NA"
    both = lo.cbind(frame(spark, [1.0, 2.0]), Frame(spark.createDataFrame([(0, "u")], "j long, y string"), "j"), ["x"], ["y"])
    assert sorted((r[POSITION], r.x, r.y) for r in both.collect()) == [(0, 1.0, "u"), (1, 2.0, None)]
    assert [r.x for r in lo.sort(frame(spark, [2.0, None, 1.0]), "x").collect()] == [1.0, 2.0, None]
    nested = spark.createDataFrame([(1, [[1, 2], [3]])], "k long, a array<array<long>>")
    assert [r.x for r in lo.unlist(nested, "a", ["k"]).collect()] == [1, 2, 3]


def test_generators(spark):
    xs = lambda f: [r.x for r in f.df.orderBy(POSITION).collect()]
    assert xs(g.seq(spark, 1, 2.5, 3)) == [1.0, 3.5, 6.0] and xs(g.seq(spark, 1, 2, 3)) == [1, 3, 5]
    assert xs(g.colon(spark, 3, 1)) == [3, 2, 1] and xs(g.colon(spark, 2, 2)) == [2]
    assert xs(g.index(spark, 2, 2, 7)) == [1, 1, 2, 2, 1, 1, 2]
    assert xs(g.rep(spark, [1, 2], length=5)) == [1, 2, 1, 2, 1] and xs(g.vector(spark, "character", 2)) == ["", ""]
    a, b = xs(g.runif(spark, 500, seed=1)), xs(g.runif(spark.newSession(), 500, seed=1))
    assert a == b and 0 <= min(a) and max(a) < 1 and abs(np.mean(a) - 0.5) < 0.05


def test_matrices(spark):
    r = np.random.default_rng(0)
    a = r.normal(size=(30, 3))
    df = spark.createDataFrame([(i + 1, *map(float, x)) for i, x in enumerate(a)], "i long, x1 double, x2 double, x3 double")
    names = ["x1", "x2", "x3"]
    assert np.allclose(m.covariance(df, names), np.cov(a.T))
    values, vectors = al.pca(df, names)
    assert np.allclose(vectors @ np.diag(values) @ vectors.T, np.cov(a.T)) and list(values) == sorted(values)
    assert np.allclose(m.tall_qr(df.select(F.monotonically_increasing_id().alias("i"), F.array(*names).alias("c")), "i", "c")[1], np.abs(np.sign(np.diag(np.linalg.qr(a)[1])))[:, None] * np.sign(np.diag(np.linalg.qr(a)[1]))[:, None] * np.linalg.qr(a)[1])
    long = m.to_long(df, "i", names)
    got = np.zeros((3, 3))
    for x in m.mat_mat(m.transpose(long), long).collect():
        got[x.i - 1, x.j - 1] = x.v
    assert np.allclose(got, a.T @ a)
    q, rr = m.qr(a[:3])
    assert np.allclose(q @ rr, a[:3]) and np.allclose(q @ q.T, np.eye(3)) and np.allclose(np.tril(rr, -1), 0)
    with pytest.raises(ValueError):
        m.mat_vec(names, [1.0])


def test_algorithms(spark):
    r = np.random.default_rng(3)
    pts = np.concatenate([r.normal(c, 0.3, (40, 2)) for c in ((0, 0), (5, 5), (0, 6))])
    df = spark.createDataFrame([tuple(map(float, p)) for p in pts], "a double, b double")
    means = al.kmeans(df, ["a", "b"], [[1.0, 1.0], [4.0, 4.0], [0.0, 5.0]], 20)
    assert np.allclose(sorted(means), sorted(pts[k : k + 40].mean(0).tolist() for k in (0, 40, 80)))
    x = np.column_stack([np.ones(200), r.normal(size=200)])
    y = (x[:, 1] + r.normal(size=200) > 0).astype(float)
    w = np.zeros(2)
    for _ in range(10):
        w -= 0.5 * (x * (1 / (1 + np.exp(-x @ w)) - y)[:, None]).mean(0)
    df = spark.createDataFrame([(*map(float, p), float(t)) for p, t in zip(x, y, strict=True)], "a double, b double, y double")
    assert np.allclose(al.logistic_regression(df, ["a", "b"], "y", [0.0, 0.0], 10, 0.5), w)
    p = al.inverse_normal(Vec(F.col("p"), "double"))
    z = spark.createDataFrame([(x,) for x in (0.001, 0.02425, 0.3, 0.5, 0.9, 0.999)], "p double").select(p.alias("z"), al.cnd(p).alias("q"), "p").collect()
    assert all(abs(row.q - row.p) < 1e-4 for row in z)
    put = spark.range(1).select(al.binomial_put(F.lit(100.0), F.lit(98.0), F.lit(2.0), F.lit(0.02), F.lit(0.3), 5).alias("v")).first().v
    dt = 2 / 5
    u = math.exp(0.3 * math.sqrt(dt))
    disc, up = math.exp(0.02 * dt), (math.exp(0.02 * dt) - 1 / u) / (u - 1 / u)
    vs = [max(0.0, 98 - 100 * u ** (2 * j - 5)) for j in range(5)]
    for n in range(4, 0, -1):
        vs = [((1 - up) * vs[k] + up * vs[k + 1]) / disc for k in range(n)]
    assert math.isclose(put, vs[0])
    cells = spark.range(12).select(al.mandelbrot(F.col("id") * 0.25 - 2, F.lit(0.3), 30).alias("n"), "id").collect()
    for c in cells:
        zc, n = complex(c.id * 0.25 - 2, 0.3), 0
        point = zc
        for _ in range(30):
            if abs(zc) ** 2 > 4:
                break
            n, zc = n + 1, point + zc * zc
        assert c.n == n


def test_apply(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [10.0, 20.0]), ([], [1.0])], "a array<double>, b array<double>")
    assert [r.x for r in df.select(ap.mapply(lambda a, b: a + b, F.col("a"), F.col("b")).alias("x")).collect()] == [[11.0, 22.0, 13.0], []]
    groups = ap.group_map(spark.createDataFrame([(1, 2.0), (1, 4.0)], "k long, x double"), ["k"], lambda p: pd.DataFrame({"k": [p.k[0]], "s": [p.x.sum()]}), "k long, s double")
    assert groups.first().s == 6.0
    assert ap.type_of(df, "a") == "other" and ap.is_kind(df, "a", "list") and not ap.is_kind(df, "a", "numeric")


def test_tables(spark, tmp_path):
    p = tmp_path / "t.tbl"
    p.write_text("1|x|2.5|1998-12-01\n2|y|-3|1999-01-02\n")
    df = tables.read_table(spark, str(p), "|", [None, "character", "double", "date"], ["a", "b", "c", "d"])
    assert df.columns == ["b", "c", "d"] and [(r.b, r.c, r.d.isoformat()) for r in df.collect()] == [("x", 2.5, "1998-12-01"), ("y", -3.0, "1999-01-02")]
    p.write_text("1|x|zzz|1998-12-01\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        tables.read_table(spark, str(p), "|", [None, "character", "double", "date"]).collect()
    tables.write_table(df.limit(0).select("b"), str(tmp_path / "out"))
    tables.write(spark.range(3).toDF("x"), str(tmp_path / "pq"))
    assert tables.read(spark, str(tmp_path / "pq")).count() == 3


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = Frame(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    out = streaming.windowed(stream.df, "ts", "1 day", "1 hour", ["event_type"], s=fo.sum_(stream["value"]), n=fo.length(), hi=fo.max_(stream["value"]))
    streaming.into_table(out, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {(r.window.start, r.event_type): (round(r.s, 6), r.n, r.hi) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    f = Frame(events)
    want = {(r.window.start, r.event_type): (round(r.s, 6), r.n, r.hi) for r in events.groupBy(F.window("ts", "1 day"), "event_type").agg(fo.sum_(f["value"]).alias("s"), fo.length().alias("n"), fo.max_(f["value"]).alias("hi")).collect()}
    assert got and all(want[k] == x for k, x in got.items())


def test_attributes_and_registry(spark):
    from vecframe.functions import registry
    from vecframe.lang.run import evaluate
    from vecframe.operators import attributes as at

    df = spark.createDataFrame([(0,), (1,), (5,), (None,)], "g long")
    df = at.set_levels(at.set_attr(df, "g", unit="m", dim=[2, 2]), "g", ["a", "b"])
    assert at.attr(df, "g", "unit") == "m" and at.attr(at.strip(df, "g"), "g", "unit") is None and at.attr(at.set_attr(df, "g", unit=None), "g", "unit") is None
    assert [r.l for r in at.label(df, "g", "l").collect()] == ["a", "b", None, None]
    assert at.names(at.set_names(df, ["h"])) == ["h"] and at.dim(df) == (4, 1)
    with pytest.raises(ValueError):
        at.check_dim(4, [3, 2])
    registry.register("twice", lambda x: x * 2, 1)
    assert evaluate(Frame(df), "sum(twice(g), na.rm = TRUE)") == 12
    with pytest.raises(TypeError):
        registry.call("twice", 1, 2)
    with pytest.raises(NameError):
        registry.call("nothing")


@pytest.mark.parametrize("n", [0, 1, 5, 63, 64, 65, 81, 82, 200])
def test_place_counts_the_bounds_below(spark, n):
    from vecframe.operators.frame import place

    bounds = list(range(0, 3 * n, 3))
    rows = spark.range(-2, 3 * n + 3).select(F.col("id").alias("x"), place(F.col("id"), [F.lit(b) for b in bounds]).alias("r"))
    assert all(r.r == sum(b < r.x for b in bounds) for r in rows.collect())
    assert spark.range(1).select(place(F.lit(None).cast("long"), [F.lit(b) for b in bounds]).alias("r")).first().r == 0


@pytest.mark.parametrize("partitions", [3, 90])
def test_positions_and_scans_in_orders_of_any_type(spark, partitions):
    """Texts, several columns with ties in the first, dates, NA in the order; on few and on many ranges."""
    import datetime as dt

    r = random.Random(1)
    rows = [(f"k{r.randrange(5)}" if i % 50 else None, f"n{i:04d}", dt.date(2024, 1, 1) + dt.timedelta(days=i), float(i % 9), bool(i % 2)) for i in range(700)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "a string, b string, d date, x double, t boolean").repartition(6)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        for order, key in ((["a", "b"], lambda q: (q[0] is not None, q[0] or "", q[1])), (["b"], lambda q: q[1]), (["d"], lambda q: q[2]), (["t", "d"], lambda q: (q[4], q[2]))):
            want = sorted(rows, key=key)
            got = {q.b: (q[POSITION], q.s) for q in Frame(df, order).scan("sum", "x", "s").index().df.collect()}
            total = 0.0
            for i, q in enumerate(want):
                total += q[3]
                assert got[q[1]] == (i, total)
            f = Frame(df, order)
            assert [q.b for q in f.slice(3, 7).df.collect()] == [q[1] for q in want[2:7]]
            assert len({q["_range"] for q in f._ranged()[0].select("_range").distinct().collect()}) > 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_slices_and_products_at_their_edges(spark):
    f = Frame(spark.range(10).toDF("i"), "i")
    assert [r.i for r in f.slice(0, 2).df.collect()] == [0, 1] and f.slice(11, 20).df.count() == 0 and f.slice(5, 4).df.count() == 0
    assert sorted(r.i for r in f.slice(9, 200_000).df.collect()) == [8, 9]
    with pytest.raises(ValueError):
        Frame(spark.range(3).toDF("i")).slice(1, 2)
    a, b = spark.range(3).toDF("x"), spark.range(100_002).toDF("y")
    assert lo.outer(a, b, lambda x, y: x * y, "x", "y").agg(F.sum("v")).first()[0] == 3 * sum(range(100_002))


def test_programs_of_many_rounds_on_no_rows(spark):
    empty = spark.createDataFrame([], "x double, y double")
    assert al.kmeans(empty, ["x", "y"], [[1.0, 2.0]], 5) == [[1.0, 2.0]] and al.logistic_regression(empty, ["x"], "y", [0.5], 5) == [0.5]
    one = spark.createDataFrame([(1.0, 1.0), (None, 1.0)], "x double, y double")
    assert al.kmeans(one, ["x", "y"], [[0.0, 0.0], [9.0, 9.0]], 5) == [[1.0, 1.0], [9.0, 9.0]]
